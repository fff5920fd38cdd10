"""Counts per time bucket, complete series and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Buckets of a dense series that one row stands for before it is unfolded.
RUN_BUCKETS = 10_000


def bucket_start(ts: str, width: str) -> Column:
    """Left-closed, left-labelled bucket."""
    return F.window(F.col(ts), width)["start"]


def bucket_end_right_closed(ts: str, width: str) -> Column:
    """Right-closed, right-labelled bucket: an instant on an edge ends its bucket."""
    return F.window(F.col(ts) - F.expr("interval 1 microsecond"), width)["end"]


def bucket_counts(
    df: DataFrame, ts: str, width: str = "15 minutes", counted: str | None = None,
    right_closed: bool = False,
) -> DataFrame:
    """Rows (or present values of ``counted``) per bucket."""
    bucket = bucket_end_right_closed(ts, width) if right_closed else bucket_start(ts, width)
    n = F.count(F.lit(1) if counted is None else F.col(counted))
    return df.where(F.col(ts).isNotNull()).groupBy(bucket.alias("bucket")).agg(n.alias("n"))


def dense_counts(
    df: DataFrame, ts: str, width: str = "15 minutes", counted: str | None = None,
    right_closed: bool = False,
) -> DataFrame:
    """As ``bucket_counts``, with a zero row for each empty bucket in between.

    The series is as long as the covered time, whatever the number of rows. Its ends come
    from the first and last instant, so the counts are shuffled once. It is made in runs of
    ``RUN_BUCKETS``, dealt to all tasks: one stray instant makes no long array.
    """
    counts = bucket_counts(df, ts, width, counted, right_closed)
    bucket = bucket_end_right_closed(ts, width) if right_closed else bucket_start(ts, width)
    ends = df.agg(F.array(F.min(ts), F.max(ts)).alias("ends")).select(F.explode("ends").alias(ts))
    step = F.expr(f"interval {width}")
    last = F.least("hi", F.col("first") + step * (RUN_BUCKETS - 1))
    spine = (
        ends.where(F.col(ts).isNotNull())
        .select(bucket.alias("bucket"))
        .agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
        .where(F.col("lo").isNotNull())
        .select("hi", F.explode(F.sequence("lo", "hi", step * RUN_BUCKETS)).alias("first"))
        .repartition("first")
        .select(F.explode(F.sequence("first", last, step)).alias("bucket"))
    )
    return spine.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n")
    )


def gaps(
    df: DataFrame, ts: str, width: str = "15 minutes", at_most: int = 0, min_buckets: int = 1
) -> DataFrame:
    """Runs of buckets with ``at_most`` rows or fewer between two fuller buckets.

    Neighbours are looked up within each day first; only one row per day goes on to the
    window over days.
    """
    full = bucket_counts(df, ts, width).where(F.col("n") > at_most).select(
        "bucket", F.to_date("bucket").alias("day")
    )
    in_day = full.withColumn("next", F.lead("bucket").over(W.partitionBy("day").orderBy("bucket")))
    by_day = full.groupBy("day").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    across = by_day.select(
        F.col("last").alias("bucket"), F.lead("first").over(W.orderBy("day")).alias("next")
    )
    pairs = in_day.select("bucket", "next").unionByName(across).where("next is not null")
    step = F.expr(f"interval {width}")
    start = F.col("bucket") + step
    length = (
        F.unix_timestamp(F.col("next").cast("timestamp"))
        - F.unix_timestamp(start.cast("timestamp"))
    ) / (
        F.unix_timestamp(start.cast("timestamp"))
        - F.unix_timestamp(F.col("bucket").cast("timestamp"))
    )
    return pairs.select(
        start.alias("gap_start"),
        F.col("next").alias("gap_end"),
        length.cast("long").alias("buckets"),
    ).where(F.col("buckets") >= min_buckets)
