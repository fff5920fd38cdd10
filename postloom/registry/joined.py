from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions.words import words
from postloom.operators import joins as J
from postloom.plans import stages
from postloom.registry.base import POST_SQL, post_text, query, rounded, table
from postloom.registry.texts import V2, trimmed, word_list
from postloom.session import shared_folder, spread


@query(
    "label_vectors",
    """select e.vec_id, l.quality as narrative, list_sum(e.embedding::double[]) is not null as has_vector
from embeddings e join labels l on l.doc_id = e.vec_id""",
)
def label_vectors(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("vec_id"), F.col("quality").alias("narrative")
    )
    joined = J.attach_labels(table(spark, sf_dir, "embeddings"), labels, "vec_id")
    return joined.select("vec_id", "narrative", F.col("embedding").isNotNull().alias("has_vector"))


POINTS = "select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings"
# Posts with repeated ids: the one that is latest in text order is kept.
POSTS = "select doc_id // 2 as vec_id, doc_id, text from documents"


@query(
    "points_with_text",
    f"""with one as (
  select * from ({POSTS}) qualify row_number() over (partition by vec_id order by doc_id desc) = 1)
select p.vec_id, one.doc_id, one.text, round(x, 6) as x, round(y, 6) as y
from ({POINTS}) p left join one using (vec_id)""",
)
def points_with_text(spark, sf_dir):
    out = J.attach_posts(
        _points(spark, sf_dir),
        table(spark, sf_dir, "documents").select(
            F.expr("doc_id div 2").alias("vec_id"), "doc_id", "text"
        ),
        "vec_id",
        F.col("doc_id"),
        ["doc_id", "text"],
    )
    return out.select("vec_id", "doc_id", "text", rounded("x"), rounded("y"))


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
    )


@query(
    "points_with_narratives",
    f"""with s as (select * from ({POINTS}) order by md5('8:' || vec_id), vec_id limit 100)
select vec_id, null as narrative, round(x, 6) as x, round(y, 6) as y, 'post' as kind from s
union all
select null, label, round(avg(embedding[1]::double), 6), round(avg(embedding[2]::double), 6),
       'narrative' from embeddings group by label""",
)
def points_with_narratives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    centres = rows.groupBy(F.col("label").alias("narrative")).agg(
        F.avg(F.col("embedding")[0].cast("double")).alias("x"),
        F.avg(F.col("embedding")[1].cast("double")).alias("y"),
    )
    out = J.points_with_narratives(_points(spark, sf_dir), centres, "vec_id", 100)
    return out.select("vec_id", "narrative", rounded("x"), rounded("y"), "kind")


# A lexicon made from the benchmark passages: a word's valence is its length's distance to 5.
LEXICON = f"""
with b as (select distinct lower(unnest({word_list('text')})) as word from benchmark),
lexicon as (select word, (length(word) - 5)::double as valence from b),
w as (select doc_id, lower(unnest({word_list('text')})) as word from documents),
s as (select doc_id, sum(coalesce(valence, 0)) as s from w left join lexicon using (word) group by 1)
select doc_id, round(s / sqrt(s * s + 15), 6) + 0.0 as sentiment from s"""


def _lexicon(spark, sf_dir):
    passages = table(spark, sf_dir, "benchmark")
    return (
        passages.select(F.explode(words(F.col("text"))).alias("w"))
        .select(F.lower("w").alias("word"))
        .distinct()
        .withColumn("valence", (F.length("word") - 5).cast("double"))
    )


@query("sentiment_lexicon", LEXICON)
def sentiment_lexicon(spark, sf_dir):
    documents = spread(table(spark, sf_dir, "documents"))
    out = J.sentiment_scores(documents, _lexicon(spark, sf_dir), "doc_id", "text")
    return out.select("doc_id", rounded("sentiment"))


@query(
    "narrative_job",
    f"""with p as (select doc_id, n_chars, lang, {POST_SQL} as t from documents),
b as (select distinct lower(unnest({word_list('text')})) as word from benchmark),
lexicon as (select word, (length(word) - 5)::double as valence from b),
w as (select doc_id, lower(unnest({word_list('t')})) as word from p),
s as (select doc_id, sum(coalesce(valence, 0)) as s from w left join lexicon using (word) group by 1)
select cast(n_chars as varchar) as created_at, cast(doc_id as varchar) as id, t as tweet,
       round(coalesce(s / sqrt(s * s + 15), 0), 6) + 0.0 as sentiment, 'lang=' || lang as narrative,
       {trimmed(V2)} as processed_tweet
from p left join s using (doc_id)""",
)
def narrative_job(spark, sf_dir):
    """One folder per narrative to scored and cleaned JSON lines, read back."""
    root, target = shared_folder(spark, "narratives"), shared_folder(spark, "scored")
    posts = spread(table(spark, sf_dir, "documents")).select(
        F.col("n_chars").cast("string").alias("created_at"),
        F.col("doc_id").cast("string").alias("id"),
        post_text().alias("tweet"),
        "lang",
    )
    posts.write.partitionBy("lang").json(root)
    stages.narrative_job(spark, root, _lexicon(spark, sf_dir), target)
    back = spark.read.schema(
        "created_at string, id string, tweet string, sentiment double, narrative string,"
        " processed_tweet string"
    ).json(target)
    return back.withColumn("sentiment", rounded("sentiment"))


@query(
    "listed_word_drop",
    f"""with stop as (select distinct unnest({word_list('text')}) as word from benchmark),
w as (select unnest({word_list('text')}) as word from conversations)
select word, count(*) as n from w anti join stop using (word) group by 1""",
)
def listed_word_drop(spark, sf_dir):
    """Stop words from a table instead of a list."""
    stop = table(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("word"))
    spoken = table(spark, sf_dir, "conversations").select(
        F.explode(words(F.col("text"))).alias("word")
    )
    # counted first, so that distinct words meet the list
    counts = spoken.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return J.drop_listed_words(counts, stop)
