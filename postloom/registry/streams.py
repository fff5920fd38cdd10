"""Streaming queries: a table is read as a stream to its end, the sink is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions.markers import clean_markers
from postloom.functions.topics import matched_topics
from postloom.registry.base import POST_SQL, post_text, query, table
from postloom.registry.texts import V2, trimmed
from postloom.registry.topics import PROSE, plain
from postloom.session import shared_folder
from postloom.streaming import capture as S
from postloom.streaming import windows as SW


def stream(spark, sf_dir, name, partitions=None):
    schema = table(spark, sf_dir, name).schema
    # A glob, so that the table may be one file or a folder of files.
    return S.file_stream(spark, f"{sf_dir}/{name}.parquet*", schema, partitions=partitions)


def to_the_end(df, name, cap=None):
    """Run the stream over all there is, then read its sink."""
    spark = df.sparkSession
    out = shared_folder(spark, name)
    S.append_stream(df, f"{out}/data", f"{out}/checkpoint", cap=cap).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def feed(spark, sf_dir):
    """Conversations in the shape of a live feed; a third come with a long text."""
    cut = F.col("turn") % 3 == 0
    return stream(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id_str"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        F.when(cut, F.concat(F.col("role"), F.lit("…"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("conv_id") % 2 == 0, "en").otherwise("fr").alias("lang"),
        F.struct(
            F.col("conv_id").cast("string").alias("id_str"),
            F.col("role").alias("screen_name"),
            F.col("role").alias("name"),
        ).alias("user"),
        F.when(cut, F.struct(F.col("text").alias("full_text"))).alias("extended_tweet"),
        F.when(F.col("turn") == 1, F.struct(F.col("role").alias("id_str"))).alias("retweeted_status"),
        F.lit(0).alias("reply_count"),
        F.length("text").alias("retweet_count"),
        F.lit(0).alias("favorite_count"),
    )


@query(
    "stream_filter",
    """select conv_id || '-' || turn as id, cast(conv_id as varchar) as user_id, role as username,
       text as tweet, length(text)::integer as retweets_count
from conversations
where conv_id % 2 = 0 and turn <> 1
  and (contains(lower(text), 'the') or contains(lower(text), 'ein'))""",
)
def stream_filter(spark, sf_dir):
    """Original posts in English that hold a keyword, with their long text."""
    posts = S.tracked(S.full_text(S.original(feed(spark, sf_dir))), ["The", "ein"], "tweet")
    out = to_the_end(S.capture_columns(posts), "capture")
    return out.select("id", "user_id", "username", "tweet", "retweets_count")


@query(
    "stream_short_columns",
    """select cast(conv_id as varchar) as user_id, role as user_screenname,
       conv_id || '-' || turn as tweet_id,
       case when turn % 3 = 0 then role || '…' else text end as text
from conversations where turn <> 1""",
)
def stream_short_columns(spark, sf_dir):
    out = to_the_end(S.capture_columns_short(S.original(feed(spark, sf_dir))), "capture")
    return out.drop("created_at")


@query("stream_capped", "select least(count(*), 1000) as captured from events")
def stream_capped(spark, sf_dir):
    """A capture that stops after 1000 rows; which rows is up to the feed."""
    out = to_the_end(stream(spark, sf_dir, "events").select("event_id"), "capped", cap=1000)
    return out.agg(F.count_distinct("event_id").alias("captured"))


@query(
    "stream_clean_posts",
    f"""with p as (select doc_id, {POST_SQL} as t from documents)
select doc_id, {trimmed(V2)} as clean from p""",
)
def stream_clean_posts(spark, sf_dir):
    cores = spark.sparkContext.defaultParallelism
    rows = stream(spark, sf_dir, "documents", cores).select("doc_id", clean_markers(post_text()).alias("clean"))
    return to_the_end(rows, "clean")


@query(
    "stream_topics",
    "select doc_id, concat_ws(',', "
    + ", ".join(f"case when regexp_matches(text, {plain(p)}) then '{n}' end" for n, p in PROSE.items())
    + ") as topics from documents",
)
def stream_topics(spark, sf_dir):
    topics = F.array_join(matched_topics(F.col("text"), PROSE), ",")
    return to_the_end(stream(spark, sf_dir, "documents").select("doc_id", topics.alias("topics")), "topics")


@query(
    "stream_quarantine",
    """select 'good' as sink, conv_id, turn, text, null::varchar as _corrupt_record
from conversations where turn <> 1
union all
select 'quarantine', null, null, null, '{"conv_id": ' || conv_id || ' ' || role
from conversations where turn = 1""",
)
def stream_quarantine(spark, sf_dir):
    """JSON lines as a stream: those that parse go to one sink, broken ones whole to another."""
    path = shared_folder(spark, "lines")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    broken = F.concat(F.lit('{"conv_id": '), F.col("conv_id").cast("string"), F.lit(" "), F.col("role"))
    line = F.when(F.col("turn") == 1, broken).otherwise(F.to_json(F.struct("conv_id", "turn", "text")))
    rows.select(line.alias("value")).write.text(path)
    lines = S.file_stream(spark, path, spark.read.text(path).schema, "text")
    good, bad = S.split_malformed(S.parse_lines(lines, rows.drop("role").schema))
    return (
        to_the_end(good, "good")
        .withColumn("sink", F.lit("good"))
        .unionByName(to_the_end(bad, "quarantine").withColumn("sink", F.lit("quarantine")), True)
    )


CLOSED = """window_end <= (select date_trunc('milliseconds', max(ts)) - interval 1 hour from events)"""


def closed_sql(body):
    return f"with w as ({body})\nselect * from w where {CLOSED}"


def plain_times(df):
    return df.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    )


def events(spark, sf_dir):
    return SW.with_event_time(stream(spark, sf_dir, "events"), "ts", "1 hour")


@query(
    "stream_tumbling",
    closed_sql(
        "select time_bucket(interval '15 minutes', ts) as window_start,"
        " time_bucket(interval '15 minutes', ts) + interval 15 minute as window_end,"
        " count(*) as n from events group by all"
    ),
)
def stream_tumbling(spark, sf_dir):
    """Windows the watermark has passed; the last hour stays open."""
    return plain_times(to_the_end(SW.tumbling_counts(events(spark, sf_dir), "ts", "15 minutes"), "tumbling"))


@query(
    "stream_sliding",
    closed_sql(
        """select b + off as window_start, b + off + interval 30 minute as window_end, event_type,
              count(*) as n
from (select time_bucket(interval '15 minutes', ts) as b, event_type from events),
     (values (interval 0 minute), (interval '-15 minutes')) o(off) group by all"""
    ),
)
def stream_sliding(spark, sf_dir):
    counts = SW.sliding_counts(events(spark, sf_dir), "ts", "30 minutes", "15 minutes", "event_type")
    return plain_times(to_the_end(counts, "sliding"))


@query(
    "stream_session",
    closed_sql(
        """select min(ts) as window_start, max(ts) + interval 30 minute as window_end, user_id,
              count(*) as n
from (select *, sum(fresh) over (partition by user_id order by ts) as session
      from (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts)
                                                + interval 30 minute then 0 else 1 end as fresh
            from events))
group by user_id, session"""
    ),
)
def stream_session(spark, sf_dir):
    counts = SW.session_counts(events(spark, sf_dir), "ts", "30 minutes", "user_id")
    return plain_times(to_the_end(counts, "session"))


@query("stream_dedupe", "select event_id, event_type from events")
def stream_dedupe(spark, sf_dir):
    """Every event arrives twice and leaves once."""
    rows = stream(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    twice = rows.union(stream(spark, sf_dir, "events").select("event_id", "event_type", "ts"))
    once = SW.first_of_each(SW.with_event_time(twice, "ts", "1 hour"), "event_id")
    return to_the_end(once.select("event_id", "event_type"), "once")



@query(
    "stream_gaps",
    """with t as (select time_bucket(interval '15 minutes', max(ts) - interval 1 hour) as edge from events),
c as (select distinct event_type, time_bucket(interval '15 minutes', ts) as bucket from events),
p as (select event_type, bucket + interval 15 minute as gap_start,
             lead(bucket) over (partition by event_type order by bucket) as gap_end from c, t where bucket < edge)
select event_type, gap_start, gap_end, cast(epoch(gap_end - gap_start) / 900 as bigint) as buckets
from p where gap_end > gap_start""",
)
def stream_gaps(spark, sf_dir):
    """Silent quarter hours of each type of event, from state and timers."""
    found = to_the_end(SW.gap_runs(events(spark, sf_dir), "ts", 900, "event_type"), "gaps")
    return found.select(
        "event_type",
        F.col("gap_start").cast("timestamp_ntz").alias("gap_start"),
        F.col("gap_end").cast("timestamp_ntz").alias("gap_end"),
        "buckets",
    )
