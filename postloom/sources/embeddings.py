"""Vector tables: Parquet with one array column, and the wide CSV form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.vectors import fold, widen


def write_embeddings(df: DataFrame, path: str) -> None:
    """Ids stay in the same row as their vectors."""
    df.select("tweet_id", F.col("embedding").cast("array<float>")).write.mode(
        "overwrite"
    ).parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tweet_id string, embedding array<float>").parquet(path)


def write_wide_csv(df: DataFrame, path: str, n: int) -> None:
    df.select("tweet_id", *widen(F.col("embedding"), n)).write.mode("overwrite").option(
        "header", True
    ).csv(path)


def read_wide_csv(spark: SparkSession, path: str | list[str], n: int) -> DataFrame:
    """``tweet_id, embed_1..embed_n`` files of many days as (tweet_id, embedding)."""
    names = [f"embed_{i + 1}" for i in range(n)]
    schema = "tweet_id string, " + ", ".join(f"{c} float" for c in names)
    wide = spark.read.schema(schema).option("header", True).csv(path)
    return wide.select("tweet_id", fold(names).alias("embedding"))
