"""Capturing posts from a stream. Works on batch frames too, which is how it is tested."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from postloom.operators.clean import not_retweets


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet",
    files_per_batch: int | None = None, partitions: int | None = None,
) -> DataFrame:
    """Files of a folder (or glob) as a replayable stream.

    ``partitions`` spreads each batch when it is made of few large files.
    """
    reader = spark.readStream.schema(schema).format(form)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.load(path)
    return rows.repartition(partitions) if partitions else rows


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """JSON posts of a Kafka topic; needs Spark's Kafka package on the class path.

    The raw text stays in ``_raw`` for the rows that do not parse.
    """
    lines = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
        .select(F.col("value").cast("string").alias("_raw"))
    )
    return lines.select("_raw", F.from_json("_raw", schema).alias("p")).select("_raw", "p.*")


def tracked(
    posts: DataFrame, keywords: Sequence[str], text: str = "text", languages: Sequence[str] = ("en",)
) -> DataFrame:
    """Posts in one of the languages that hold one of the keywords, in any case."""
    body = F.lower(F.col(text))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(body, F.lit(word.lower()))
    return posts.where(F.col("lang").isin(list(languages)) & hit)


def original(posts: DataFrame) -> DataFrame:
    """Without retweets, as in batch."""
    return not_retweets(posts)


def full_text(posts: DataFrame) -> DataFrame:
    """The long text where there is one."""
    return posts.withColumn("tweet", F.coalesce(F.col("extended_tweet.full_text"), F.col("text")))


def capture_columns(posts: DataFrame) -> DataFrame:
    return full_text(posts).select(
        "created_at",
        F.col("id_str").alias("id"),
        F.col("user.id_str").alias("user_id"),
        F.col("user.screen_name").alias("username"),
        F.col("user.name").alias("name"),
        "tweet",
        F.col("reply_count").alias("replies_count"),
        F.col("retweet_count").alias("retweets_count"),
        F.col("favorite_count").alias("likes_count"),
    )


def capture_columns_short(posts: DataFrame) -> DataFrame:
    return posts.select(
        "created_at",
        F.col("user.id_str").alias("user_id"),
        F.col("user.screen_name").alias("user_screenname"),
        F.col("id_str").alias("tweet_id"),
        "text",
    )


def parse_lines(
    lines: DataFrame, schema: T.StructType, column: str = "value", bad: str = "_corrupt_record"
) -> DataFrame:
    """JSON texts to columns; a text that does not parse, or is blank, is kept whole in ``bad``."""
    kind = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    whole = F.coalesce(F.col(column), F.lit(""))
    return lines.select(F.from_json(column, kind).alias("_p"), whole.alias("_whole")).select(
        *[F.col("_p")[f.name].alias(f.name) for f in schema.fields],
        F.when(F.col("_p").isNull(), F.col("_whole")).otherwise(F.col("_p")[bad]).alias(bad),
    )


def split_malformed(posts: DataFrame, bad: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine rows)."""
    return posts.where(F.col(bad).isNull()).drop(bad), posts.where(F.col(bad).isNotNull()).select(bad)


def append_stream(
    df: DataFrame, path: str, checkpoint: str, form: str = "parquet", cap: int | None = None,
    until_empty: bool = True,
) -> StreamingQuery:
    """Append to files, exactly once across restarts; ``cap`` stops after that many rows."""
    out = df if cap is None else df.limit(cap)
    writer = out.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint)
    if form == "csv":
        writer = writer.option("header", True)
    if until_empty:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start()


class Progress(StreamingQueryListener):
    """Counts rows and reports each time another ``every`` rows have come in."""

    def __init__(self, every: int = 100, report=print):
        self.every = every
        self.report = report
        self.rows = 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        before = self.rows // self.every
        self.rows += event.progress.numInputRows
        if self.rows // self.every > before:
            self.report(f"rows so far: {self.rows}")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
