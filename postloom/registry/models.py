from __future__ import annotations

from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from postloom.operators import centroid_days as CD
from postloom.operators import centroids as C
from postloom.operators import encode as V
from postloom.operators import reduce as R
from postloom.plans import stages
from postloom.registry.base import query, rounded, table
from postloom.registry.texts import word_list
from postloom.session import shared_folder, spread, store


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "tweet_id")


@query(
    "svd_gram",
    """with e as (select vec_id, unnest(embedding)::double as v,
                         generate_subscripts(embedding, 1) - 1 as i from embeddings)
select a.i::integer as i, b.i::integer as j, round(sum(a.v * b.v), 5) + 0.0 as value
from e a join e b using (vec_id) group by 1, 2""",
)
def svd_gram(spark, sf_dir):
    rows = R.gram_rows(table(spark, sf_dir, "embeddings"))
    return rows.select("i", F.posexplode("row").alias("j", "value")).withColumn(
        "value", rounded("value", 5)
    )


def _model(spark, sf_dir):
    return R.fit_svd(_vectors(spark, sf_dir), fraction=1.0)


@query("svd_project")
def svd_project(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return R.project(vectors, _model(spark, sf_dir)).select("tweet_id", "label", rounded("x"), rounded("y"))


@query("svd_from_sample")
def svd_from_sample(spark, sf_dir):
    """The model of a seeded sample: stored, then read instead of fitted again."""
    vectors = _vectors(spark, sf_dir)
    path = shared_folder(spark, "model")
    R.load_or_fit(spark, path, vectors, "v1", fraction=0.2)
    model = R.load_or_fit(spark, path, vectors, "v1", fraction=0.2)
    return R.project(vectors, model).select("tweet_id", rounded("x"), rounded("y"))


@query(
    "svd_check",
    """select component::integer as component, count(embedding) as n, true as same_energy,
       true as unit_length, true as orthogonal
from embeddings, (values (0), (1)) c(component) group by component""",
)
def svd_check(spark, sf_dir):
    """Per component: squares of all coordinates sum to the squared singular value, weights have
    unit length, and the coordinates of the two components are orthogonal."""
    model = _model(spark, sf_dir)
    points = R.project(_vectors(spark, sf_dir), model)
    energy = [F.sum(F.col(c) * F.col(c)) for c in ("x", "y")]
    sums = points.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("x") * F.col("y")).alias("mixed"),
        energy[0].alias("first"),
        F.array(*energy).alias("energy"),
    ).select("n", "mixed", "first", F.posexplode("energy").alias("component", "energy"))
    squared = F.col("singular_value") * F.col("singular_value")
    length = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w * w)
    return model.join(sums, "component").select(
        "component",
        "n",
        (F.abs(F.col("energy") / squared - 1) < 1e-9).alias("same_energy"),
        (F.abs(length - 1) < 1e-9).alias("unit_length"),
        (F.abs(F.col("mixed")) < 1e-9 * F.col("first")).alias("orthogonal"),
    )


@query(
    "fixed_project",
    """select vec_id as tweet_id, label, round(list_sum(embedding::double[]), 6) + 0.0 as x,
       round(embedding[1]::double - embedding[64]::double, 6) + 0.0 as y from embeddings""",
)
def fixed_project(spark, sf_dir):
    """A projection with given weights."""
    first, second = np.ones(64), np.zeros(64)
    second[0], second[63] = 1.0, -1.0
    model = spark.createDataFrame(
        [(0, 1.0, first.tolist()), (1, 1.0, second.tolist())], R.MODEL_SCHEMA
    )
    out = R.project(_vectors(spark, sf_dir), model)
    return out.select("tweet_id", "label", rounded("x"), rounded("y"))


@query("narrative_points_mean")
def narrative_points_mean(spark, sf_dir):
    means = C.mean_centroids(_vectors(spark, sf_dir))
    points = stages.narrative_points(means, _model(spark, sf_dir))
    return points.select("narrative", rounded("x"), rounded("y"))


@query("narrative_points_median")
def narrative_points_median(spark, sf_dir):
    medians = C.median_centroids(_vectors(spark, sf_dir))
    points = stages.narrative_points(medians, _model(spark, sf_dir))
    return points.select("narrative", rounded("x"), rounded("y"))


@query(
    "centroid_tables",
    """with e as (select label, unnest(embedding)::double as v,
                         generate_subscripts(embedding, 1) - 1 as pos from embeddings)
select 'mean' as kind, label, pos::integer as pos, round(avg(v), 6) + 0.0 as value from e group by all
union all
select 'median', label, pos::integer, round(median(v), 6) + 0.0 from e group by all
union all
select 'std', label, pos::integer, round(stddev_samp(v), 6) + 0.0 from e group by all""",
)
def centroid_tables(spark, sf_dir):
    """Written as tables; a second run leaves them alone."""
    root = shared_folder(spark, "centroids")
    vectors = _vectors(spark, sf_dir)
    for _ in range(2):
        stages.centroid_tables(vectors, root, "label")
    parts = [
        C.as_cells(spark.read.parquet(f"{root}/{k}")).select(
            F.lit(k).alias("kind"), "label", "pos", rounded("value")
        )
        for k in ("mean", "median", "std")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "centroid_days",
    """with e as (select label, unnest(embedding)::double as v,
                         generate_subscripts(embedding, 1) - 1 as pos from embeddings)
select label, pos::integer as pos, count(*) as n, round(avg(v), 6) + 0.0 as mean,
       round(stddev_samp(v), 6) + 0.0 as std from e group by all""",
)
def centroid_days(spark, sf_dir):
    """Three days, then one of them again with all its rows, then the other days, merged."""
    start = date(2024, 1, 1)
    days = [start + timedelta(d) for d in range(7)]
    vectors = _vectors(spark, sf_dir).withColumn(
        "day", F.date_add(F.lit(start), F.pmod("tweet_id", F.lit(7)).cast("int"))
    )
    path = shared_folder(spark, "centroid-days")
    CD.update_days(vectors.where("tweet_id % 3 = 0"), path, days[:3])
    CD.update_days(vectors, path, days[1:3])
    CD.update_days(vectors, path, [days[0], *days[3:]])
    whole = CD.centroids_of_days(spark, path)
    cells = whole.select("label", "n", F.posexplode(F.arrays_zip("mean", "std")).alias("pos", "c"))
    return cells.select(
        "label", "pos", "n", F.col("c.mean").alias("mean"), F.col("c.std").alias("std")
    ).withColumns({"mean": rounded("mean"), "std": rounded("std")})


@query("encode_hashing")
def encode_hashing(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return V.encode_hashing(rows, "text").drop("text")


@query(
    "encode_totals",
    f"select doc_id, len({word_list('text')})::bigint as tokens from documents where text is not null",
)
def encode_totals(spark, sf_dir):
    """The term counts of each hashed vector add up to the words of its text."""
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return encode_hashing(spark, sf_dir).select("doc_id", total.cast("long").alias("tokens"))


@query("encode_weighted")
def encode_weighted(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return V.encode_hashing(rows, "text", V.fit_weights(rows, "text")).drop("text")


@query(
    "encode_idf",
    f"""select doc_id, len({word_list('text')})::bigint as tokens, true as weighted
from documents where text is not null""",
)
def encode_idf(spark, sf_dir):
    """Every weighted vector is its counts times log((n + 1) / (documents with the term + 1)),
    with the documents of each bucket counted anew.

    The counts are stored, as three steps read them. Whole vectors are joined, a row per document;
    their positions become rows only in the task that sums them up."""
    counts = store(encode_hashing(spark, sf_dir), "counts").withColumnRenamed("embedding", "tf")
    weighted = encode_weighted(spark, sf_dir).withColumnRenamed("embedding", "w")
    n = counts.agg(F.countDistinct("doc_id").alias("n"))
    each = counts.select(F.posexplode("tf").alias("pos", "tf"))
    held = each.groupBy("pos").agg(F.sum((F.col("tf") > 0).cast("long")).alias("held"))
    # stored vectors are mostly zeros: their files are far smaller than a copy of them in memory
    both = counts.hint("merge").join(weighted, "doc_id")
    cells = (
        both.select("doc_id", "w", F.posexplode("tf").alias("pos", "tf"))
        .withColumn("w", F.get("w", F.col("pos")))
        .join(F.broadcast(held), "pos")
        .join(F.broadcast(n))
    )
    expected = F.col("tf") * F.log((F.col("n") + 1) / (F.col("held") + 1))
    near = F.abs(F.col("w") - expected) <= 1e-5 * (1 + F.abs(expected))
    return cells.groupBy("doc_id").agg(
        F.sum("tf").cast("long").alias("tokens"), F.min(near).alias("weighted")
    )


LETTERS = "etaoinsh"


def letter_encoder():
    """A stand-in for a model a caller would load: letter counts."""

    def encode(texts):
        return np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=np.float32)

    return encode


@query(
    "encode_with_model",
    "select doc_id, "
    + ", ".join(
        f"(length(text) - length(replace(text, '{c}', '')))::float as {c}" for c in LETTERS
    )
    + " from documents",
)
def encode_with_model(spark, sf_dir):
    rows = V.encode_with(spread(table(spark, sf_dir, "documents")), "doc_id", "text", letter_encoder)
    return rows.select("doc_id", *[F.col("embedding")[i].alias(c) for i, c in enumerate(LETTERS)])


@query("post_points")
def post_points(spark, sf_dir):
    """Clean posts to vectors to points, with the fields of the post."""
    posts = spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("string").alias("id_str"),
        F.expr("timestampadd(MINUTE, doc_id, timestamp_ntz'2024-01-01 00:00:00')").alias("created_at"),
        "lang",
        F.col("text").alias("full_text"),
    )

    def encode(rows):
        return V.encode_hashing(rows, "normalized_tweet", width=64).drop("normalized_tweet")

    vectors = stages.vectors_of(posts, encode, limit=5000)
    model = R.fit_svd(vectors, fraction=1.0)
    out = stages.points_of(vectors, model, posts)
    return out.select("tweet_id", "created_at", "tweet", rounded("x", 4), rounded("y", 4))


COUNTS_SQL = ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::double" for c in LETTERS)


@query(
    "retrieval_from_text",
    f"""with v as (select doc_id, lang, [{COUNTS_SQL}] as e from documents
           where text is not null),
cells as (select doc_id, lang, unnest(e) as x, generate_subscripts(e, 1) as pos from v where doc_id % 2 = 0),
m as (select lang, pos, avg(x) as x from cells group by all),
c as (select lang as narrative, list(x order by pos) as c from m group by 1),
d as (select narrative, lang, row_number() over (partition by narrative
             order by round(list_cosine_distance(c, e), 12), doc_id) as rank
      from v, c where doc_id % 2 = 1 and list_sum(e) > 0)
select narrative, sum((narrative = lang)::integer)::bigint as hits,
       sum((narrative = lang)::integer) / 25.0::double as precision
from d where rank <= 25 group by 1""",
)
def retrieval_from_text(spark, sf_dir):
    """Texts to vectors by an encoder; means of the train rows, precision on the test rows."""
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    languages = table(spark, sf_dir, "documents").select("doc_id", "lang")
    vectors = V.encode_with(rows, "doc_id", "text", letter_encoder).join(languages, "doc_id")
    train, test = (vectors.where(F.col("doc_id") % 2 == k) for k in (0, 1))
    per_label, _ = stages.retrieval_quality(train, test, 25, "doc_id", "lang")
    return per_label
