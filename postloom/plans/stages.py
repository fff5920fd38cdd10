"""The main paths: raw day to clean table, clean day to points, labels to centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import schemas
from postloom.functions import fixed
from postloom.functions.dates import platform_time
from postloom.functions.markers import clean_markers
from postloom.functions.normalise import normalise_post
from postloom.operators.centroids import mean_and_std, median_centroids
from postloom.operators.clean import clean_posts, counted, prepare_for_encoding
from postloom.operators.joins import attach_posts, sentiment_scores
from postloom.operators.reduce import project
from postloom.operators.search import mean_precision, nearest, precision
from postloom.session import store
from postloom.sources.posts import read_labelled, read_raw_posts, write_days, write_json

Encode = Callable[[DataFrame], DataFrame]


def ingest(spark: SparkSession, paths: str | list[str], target: str) -> int:
    """Raw JSON lines to the clean table partitioned by day; returns the row count.

    Records that do not parse, or whose time does not, go whole to ``<target>_quarantine``,
    below a folder for these paths, and are not counted. Reading the same paths again replaces
    their records; those of other paths stay.
    """
    raw, before = counted(read_raw_posts(spark, paths), "raw rows")
    posts = raw.withColumn("created_at", platform_time(F.col("created_at")))
    bad = F.col("_corrupt_record").isNotNull() | F.col("created_at").isNull()
    good = clean_posts(posts.where(~bad)).withColumn("day", F.to_date("created_at"))
    flat, after = counted(good, "clean rows")
    write_days(flat, target)
    lost = before.get["rows"] - after.get["rows"]
    if lost:
        # A second scan, only when there is something to keep back.
        broken = read_raw_posts(spark, paths).where(
            F.col("_corrupt_record").isNotNull() | platform_time(F.col("created_at")).isNull()
        )
        named = [paths] if isinstance(paths, str) else sorted(paths)
        run = hashlib.md5("\n".join(named).encode()).hexdigest()
        kept = f"{target}_quarantine/run={run}"
        whole = F.to_json(F.struct("*")).alias("record")
        broken.select("id_str", "created_at", "_corrupt_record", whole).write.mode(
            "overwrite"
        ).parquet(kept)
        if spark.read.parquet(kept).count() != lost:
            raise ValueError(f"{lost} rows are missing, not all of them are in quarantine")
    return after.get["rows"]


def vectors_of(posts: DataFrame, encode: Encode, limit: int = fixed.MAX_POST_LENGTH) -> DataFrame:
    """Clean posts to (tweet_id, embedding). ``encode`` takes (tweet_id, normalized_tweet).

    The vectors are stored: fitting a model and projecting read them several times.
    """
    ready = prepare_for_encoding(posts, limit=limit)
    # No kept post lacks a text. Said here, an encoder's filter on NULL is dropped; else Spark
    # pushes it below the projection, and each text is normalised twice.
    text = F.coalesce("normalized_tweet", F.lit("")).alias("normalized_tweet")
    return store(encode(ready.select(F.col("id_str").alias("tweet_id"), text)), "vectors")


def points_of(vectors: DataFrame, model: DataFrame, posts: DataFrame) -> DataFrame:
    """(tweet_id, created_at, tweet, x, y); every vector keeps its row."""
    flat = project(vectors.select("tweet_id", "embedding"), model)
    fields = posts.select(
        F.col("id_str").alias("tweet_id"), "created_at", F.col("full_text").alias("tweet")
    )
    joined = attach_posts(flat, fields, "tweet_id", F.col("created_at"), ["created_at", "tweet"])
    return joined.select("tweet_id", "created_at", "tweet", "x", "y")


def narrative_vectors(narratives: DataFrame, encode: Encode, text: str = "tweet") -> DataFrame:
    """(tweet_id, narrative, embedding) of labelled posts, joined by id."""
    posts = narratives.select(
        F.col("id").alias("tweet_id"), "narrative", normalise_post(F.col(text)).alias("normalized_tweet")
    )
    vectors = encode(posts.select("tweet_id", "normalized_tweet"))
    return vectors.join(posts.select("tweet_id", "narrative"), "tweet_id")


def narrative_job(spark: SparkSession, root: str, lexicon: DataFrame, target: str) -> None:
    """Labelled files to one set of JSON lines with sentiment and cleaned text.

    Reads one folder per narrative below ``root`` and writes created_at, id, tweet, sentiment,
    narrative and processed_tweet. Every row of the files stays; each distinct text is scored
    once with the (word, valence) ``lexicon``, and a post without text scores 0.
    """
    posts = read_labelled(spark, root, schemas.NARRATIVE_POST)
    posts = posts.withColumn("_text", F.sha2("tweet", 256))
    texts = posts.where("tweet is not null").select("_text", "tweet").dropDuplicates(["_text"])
    scored = posts.join(sentiment_scores(texts, lexicon, "_text", "tweet"), "_text", "left")
    out = scored.select(
        "created_at",
        "id",
        "tweet",
        F.coalesce("sentiment", F.lit(0.0)).alias("sentiment"),
        "narrative",
        clean_markers(F.col("tweet")).alias("processed_tweet"),
    )
    write_json(out, target)


def centroid_tables(vectors: DataFrame, root: str, label: str = "narrative") -> None:
    """Mean, deviation and median tables below ``root``; existing ones stay."""
    both = mean_and_std(vectors, label)
    tables = {
        "mean": lambda: both.select("label", F.col("mean").alias("centroid")),
        "std": lambda: both.select("label", F.col("std").alias("centroid")),
        "median": lambda: median_centroids(vectors, label),
    }
    for name, make in tables.items():
        make().write.mode("ignore").parquet(f"{root}/{name}")


def narrative_points(centroids: DataFrame, model: DataFrame) -> DataFrame:
    """(narrative, x, y) of a centroid table."""
    named = centroids.select(F.col("label").alias("narrative"), "centroid")
    return project(named, model, "centroid")


def retrieval_quality(
    train: DataFrame, test: DataFrame, k: int = fixed.PRECISION_K, post_id: str = "tweet_id",
    label: str = "narrative",
) -> tuple[DataFrame, DataFrame]:
    """Precision per label of the test posts nearest to the train means, and its mean."""
    means = mean_and_std(train, label).select("label", F.col("mean").alias("centroid"))
    per_label = precision(nearest(test, means, k, post_id, label), k)
    return per_label, mean_precision(per_label)

