"""Keyed joins between posts, labels, points, lexicons and day lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.words import words
from postloom.operators.clean import latest_per_key
from postloom.operators.sampling import exact_sample


def missing_days(wanted: DataFrame, done: DataFrame, day: str = "day") -> DataFrame:
    return wanted.select(day).distinct().join(done.select(day).distinct(), day, "left_anti")


def present_days(wanted: DataFrame, done: DataFrame, day: str = "day") -> DataFrame:
    return wanted.select(day).distinct().join(done.select(day).distinct(), day, "left_semi")


def day_difference(wanted: DataFrame, done: DataFrame, day: str = "day") -> DataFrame:
    return wanted.select(day).subtract(done.select(day))


def attach_labels(vectors: DataFrame, labels: DataFrame, key: str, label: str = "narrative") -> DataFrame:
    return vectors.join(labels.select(key, label), key)


def attach_posts(points: DataFrame, posts: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """Points with the fields of their post; every point stays, none is doubled."""
    # only posts that a point asks for are aggregated
    asked = posts.select(key, *columns).join(points.select(key).distinct(), key, "left_semi")
    one = latest_per_key(asked, key, order)
    return points.join(one, key, "left")


def points_with_narratives(
    day_points: DataFrame, narrative_points: DataFrame, key: str, n: int, seed: int = 8
) -> DataFrame:
    """``n`` points of a day together with the narrative points, told apart by ``kind``."""
    some = exact_sample(day_points, key, n, seed).withColumn("kind", F.lit("post"))
    fixed_points = narrative_points.withColumn("kind", F.lit("narrative"))
    return some.unionByName(fixed_points, allowMissingColumns=True)


def sentiment_scores(
    posts: DataFrame, lexicon: DataFrame, key: str, text: str, tokens: Column | None = None
) -> DataFrame:
    """(key, sentiment): word valences summed and squashed to -1..1, 0 without a hit.

    ``lexicon`` is (word, valence), one row per word. Spark broadcasts it by its bytes,
    and else joins by word; AQE splits the partition of a word that most posts share.
    """
    found = words(F.lower(F.col(text))) if tokens is None else tokens
    each = posts.select(F.col(key), F.explode_outer(found).alias("word"))
    valences = lexicon.select("word", "valence")
    total = F.coalesce(F.sum("valence"), F.lit(0.0))
    summed = each.join(valences, "word", "left").groupBy(key).agg(total.alias("s"))
    return summed.select(key, (F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15)).alias("sentiment"))


def drop_listed_words(tokens: DataFrame, stop_words: DataFrame, word: str = "word") -> DataFrame:
    """Exploded words without those of a (long) list, broadcast or not by its bytes."""
    return tokens.join(stop_words.select(word).distinct(), word, "left_anti")
