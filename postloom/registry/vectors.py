from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions.vectors import widen
from postloom.operators import centroids as C
from postloom.operators import search as S
from postloom.plans import stages
from postloom.registry.base import query, rounded, table

CELLS = (
    "select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos "
    "from embeddings"
)


def cells_sql(function: str) -> str:
    return f"""
with e as ({CELLS})
select label, cast(pos as integer) as pos, round({function}(v::double), 6) + 0.0 as value
from e group by all"""


def _cells(centroids):
    return C.as_cells(centroids).select("label", "pos", rounded("value"))


@query("centroid_mean", cells_sql("avg"))
def centroid_mean(spark, sf_dir):
    return _cells(C.mean_centroids(table(spark, sf_dir, "embeddings")))


@query("centroid_std", cells_sql("stddev_samp"))
def centroid_std(spark, sf_dir):
    return _cells(C.std_centroids(table(spark, sf_dir, "embeddings")))


@query("centroid_median", cells_sql("median"))
def centroid_median(spark, sf_dir):
    return _cells(C.median_centroids(table(spark, sf_dir, "embeddings")))


@query("centroid_median_by_rank", cells_sql("median"))
def centroid_median_by_rank(spark, sf_dir):
    """From a sample of about a fifth of the rows, so that most values are only counted."""
    rows = table(spark, sf_dir, "embeddings")
    return _cells(C.median_centroids(rows, bracket_rows=max(1, rows.count() // 5)))


@query("centroid_median_approx")
def centroid_median_approx(spark, sf_dir):
    return _cells(C.approx_median_centroids(table(spark, sf_dir, "embeddings")))


@query(
    "centroid_median_approx_rank",
    f"""with e as ({CELLS})
select label, cast(pos as integer) as pos, count(*) as n, true as near_middle from e group by label, pos""",
)
def centroid_median_approx_rank(spark, sf_dir):
    """Whether the rank of each approximate median is within its error of the middle."""
    rows = table(spark, sf_dir, "embeddings")
    found = C.as_cells(C.approx_median_centroids(rows, accuracy=1000))
    cells = rows.select("label", F.posexplode("embedding").alias("pos", "x"))
    below = F.count_if(F.col("x") < F.col("value")) / F.count("x")
    upto = F.count_if(F.col("x") <= F.col("value")) / F.count("x")
    near = (below <= 0.5 + 1e-3) & (upto >= 0.5 - 1e-3)
    return (
        cells.join(found, ["label", "pos"])
        .groupBy("label", "pos")
        .agg(F.count("x").alias("n"), near.alias("near_middle"))
    )


RANKED = f"""
with e as ({CELLS}),
m as (select label, pos, avg(v::double) as v from e group by all),
c as (select label as narrative, list(v order by pos) as centroid from m group by label),
d as (
  select c.narrative, p.vec_id, p.label,
         list_cosine_distance(c.centroid, p.embedding::double[]) as distance
  from c cross join embeddings p),
r as (
  select *, cast(row_number() over (
    partition by narrative order by round(distance, 12), vec_id) as integer) as rank
  from d)
"""


@query(
    "cosine_topk",
    RANKED
    + """select narrative, rank, vec_id, label, round(distance, 6) + 0.0 as distance,
       narrative = label as match
from r where rank <= 25""",
)
def cosine_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    hits = S.with_match(S.nearest(rows, C.mean_centroids(rows), 25))
    return hits.withColumn("distance", rounded("distance"))


@query(
    "retrieval_precision",
    RANKED
    + """select narrative, sum((narrative = label)::integer)::bigint as hits,
       sum((narrative = label)::integer) / 25.0::double as precision
from r where rank <= 25 group by narrative""",
)
def retrieval_precision(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    per_label, _ = stages.retrieval_quality(rows, rows, 25, "vec_id", "label")
    return per_label


@query(
    "retrieval_mean_precision",
    RANKED
    + """, p as (select narrative, sum((narrative = label)::integer) / 25.0::double as precision
from r where rank <= 25 group by narrative)
select round(avg(precision), 6) as mean_precision from p""",
)
def retrieval_mean_precision(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    _, overall = stages.retrieval_quality(rows, rows, 25, "vec_id", "label")
    return overall.select(rounded("mean_precision"))


@query(
    "cosine_to_own_centroid",
    f"""
with e as ({CELLS}),
m as (select label, pos, avg(v::double) as v from e group by all),
c as (select label, list(v order by pos) as centroid from m group by label)
select p.vec_id, p.label,
       round(list_cosine_distance(c.centroid, p.embedding::double[]), 6) + 0.0 as distance
from embeddings p join c using (label)""",
)
def cosine_to_own_centroid(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    out = S.distances_to_own(rows, C.mean_centroids(rows))
    return out.select("vec_id", "label", rounded("distance"))


@query(
    "vector_widen",
    "select vec_id, "
    + ", ".join(f"embedding[{i + 1}] as embed_{i + 1}" for i in range(64))
    + " from embeddings",
)
def vector_widen(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", *widen(F.col("embedding"), 64))
