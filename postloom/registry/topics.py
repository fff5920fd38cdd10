from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import fixed
from postloom.functions import topics as T
from postloom.operators import catalogue as C
from postloom.operators import profile as P
from postloom.operators import timeseries as TS
from postloom.session import spread
from postloom.registry.base import POST_SQL, posts, query, table, text_literal

# Patterns that the prose of the tables holds, beside the fixed topics.
PROSE = {
    "article": r"(?iu)th\w*",
    "ending": r"(?iu)(?:tion|ment|keit|ción)+",
    "secret": r"(?iu)token[\s]*=",
    "symbols": r"[#@&%]{3}",
}
ALL_TOPICS = {**fixed.TOPICS, **PROSE}
FAST_TOPICS = {**fixed.FAST_TOPICS, **PROSE}


def plain(pattern):
    return text_literal(pattern.replace("(?iu)", "(?i)").replace(")++", ")+"))


def hits_sql(pattern):
    return f"regexp_extract_all(t, {plain(pattern)})"


WITH_POSTS = f"with p as (select doc_id, {POST_SQL} as t from documents)\n"


@query(
    "topic_counts",
    WITH_POSTS
    + "select doc_id, "
    + ", ".join(f"len({hits_sql(p)})::integer as {n}" for n, p in ALL_TOPICS.items())
    + " from p",
)
def topic_counts(spark, sf_dir):
    counts = [T.topic_count(F.col("post"), p).alias(n) for n, p in FAST_TOPICS.items()]
    return posts(spark, sf_dir).select("doc_id", *counts)


@query(
    "topic_plain_counts",
    WITH_POSTS
    + "select doc_id, "
    + ", ".join(f"len({hits_sql(p)})::integer as {n}" for n, p in fixed.TOPIC_PLAIN_COUNTS.items())
    + " from p",
)
def topic_plain_counts(spark, sf_dir):
    counts = [
        T.topic_count(F.col("post"), p).alias(n) for n, p in fixed.TOPIC_PLAIN_COUNTS.items()
    ]
    return posts(spark, sf_dir).select("doc_id", *counts)


@query(
    "topic_matches",
    WITH_POSTS
    + "select doc_id, "
    + ", ".join(
        f"case when len({hits_sql(p)}) > 0 then array_to_string({hits_sql(p)}, ',') "
        f"else '{'N/a' if n in ('china', 'usa') else ''}' end as {n}"
        for n, p in ALL_TOPICS.items()
    )
    + " from p",
)
def topic_matches(spark, sf_dir):
    none = {n: fixed.NO_TOPIC for n in fixed.TOLD_TOPICS}
    hits = [
        T.topic_hits(F.col("post"), p, none.get(n, "")).alias(n) for n, p in FAST_TOPICS.items()
    ]
    return posts(spark, sf_dir).select("doc_id", *hits)


@query(
    "topic_flags",
    WITH_POSTS
    + "select doc_id, "
    + ", ".join(f"regexp_matches(t, {plain(p)}) as {n}" for n, p in ALL_TOPICS.items())
    + " from p",
)
def topic_flags(spark, sf_dir):
    flags = [T.topic_flag(F.col("post"), p).alias(n) for n, p in FAST_TOPICS.items()]
    return posts(spark, sf_dir).select("doc_id", *flags)


CATALOGUE_SQL = "values " + ", ".join(f"('{n}', {plain(p)})" for n, p in ALL_TOPICS.items())


@query(
    "topic_catalogue",
    WITH_POSTS
    + f""", c(topic, pattern) as ({CATALOGUE_SQL})
select topic, count(*) as n from p join c on regexp_matches(t, pattern) group by topic""",
)
def topic_catalogue(spark, sf_dir):
    catalogue = spark.createDataFrame(list(FAST_TOPICS.items()), "topic string, pattern string")
    tagged = C.tag_topics(posts(spark, sf_dir), "post", catalogue)
    return tagged.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


# Characters that mean something in a pattern.
SPECIAL = r"([\\.*+?^$|(){}\[\]-])"


@query(
    "topic_passages",
    rf"""with w as (select item_id, string_split_regex(trim(text), '\s+') as w from benchmark),
c as (select item_id, '(?i)' || regexp_replace(w[1], {text_literal(SPECIAL)}, '\\\1', 'g') || '\s+'
             || regexp_replace(w[2], {text_literal(SPECIAL)}, '\\\1', 'g') as pattern from w where len(w) > 1)
select item_id, count(*) as n from documents d join c on regexp_matches(d.text, c.pattern)
group by item_id""",
)
def topic_passages(spark, sf_dir):
    """A catalogue made from a table: the first two words of every benchmark item."""
    w = F.split(F.trim("text"), r"\s+")
    safe = lambda i: F.regexp_replace(F.col("w")[i], SPECIAL, r"\\$1")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"), w.alias("w"))
    catalogue = items.where(F.size("w") > 1).select(
        "topic", F.concat(F.lit("(?iu)"), safe(0), F.lit(r"\s+"), safe(1)).alias("pattern")
    )
    tagged = C.tag_topics(table(spark, sf_dir, "documents"), "text", catalogue)
    return tagged.groupBy(F.col("topic").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "topic_top_hits",
    f"""with p as (select text as t from documents),
h as (select array_to_string({hits_sql(PROSE['ending'])}, ',') as hits from p)
select hits, count(*) as n from h where hits <> '' group by hits order by n desc, hits limit 26""",
)
def topic_top_hits(spark, sf_dir):
    """Frequencies of the hit lists, without the bucket of posts that have none."""
    hits = T.topic_hits(F.col("text"), PROSE["ending"], fixed.NO_TOPIC)
    rows = spread(table(spark, sf_dir, "documents")).select(hits.alias("hits"))
    return P.value_counts(rows, "hits", 26, skip_missing=True, missing=fixed.NO_TOPIC)


@query(
    "topic_timeline",
    """select time_bucket(interval '30 minutes', ts) as bucket, count(*) as n
from events where regexp_matches(props, '(?i)"k": 7[0-9]?') group by 1""",
)
def topic_timeline(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.col("props").rlike(r'(?iu)"k": 7[0-9]?'))
    return TS.bucket_counts(rows, "ts", "30 minutes")
