"""The most frequent values of a column at bounded memory, with exact counts.

A frequent-items sketch (a counter table that gives up its smallest counters when full) proposes
candidates in one pass; a second pass counts these exactly. Neither sends more than the sketch's
``tracked`` values from a task, however many distinct values there are.

The sketch proposes every value that occurs more than twice its error, and the error is at most
``ERROR / tracked`` of the rows. So the result is complete if the last value returned is more
frequent than that. Else no sketch of this size can tell, and all values are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.words import words
from postloom.operators.profile import value_counts
from postloom.session import store

# 3.5 rows per place of the sketch's table, of which it fills three quarters.
ERROR = 3.5 * 0.75
TRACKED = 100_000


def frequent_values(df: DataFrame, column: str, k: int, tracked: int = TRACKED) -> DataFrame:
    """``value_counts(df, column, k)``: the k most frequent values, ties by value, NULL left out.

    Two scans of the column with bounded shuffles; values that are all about as rare as each
    other, where no value stands out, take a third one that shuffles each distinct value.
    """
    counts = proven_counts(df, column, k, tracked)
    if counts is None:
        return value_counts(df, column, k)
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(k)


def proven_counts(df: DataFrame, column: str, k: int, tracked: int = TRACKED) -> DataFrame | None:
    """Exact counts of candidates that hold the k most frequent values, or None without proof.

    ``tracked`` bounds the candidates (at least ``k``); only two numbers reach the driver.
    """
    if not 0 < k <= tracked:
        raise ValueError("more values are asked for than the sketch holds")
    rows = df.select(F.col(column).alias("value")).where("value is not null")
    sketch = rows.agg(
        F.expr(f"approx_top_k(value, {tracked}, {tracked})").alias("top"),
        F.count(F.lit(1)).alias("total"),
    )
    proposed = store(sketch.select("total", F.explode("top").alias("c")), "frequent-proposed")
    proposed = proposed.select("total", F.col("c.item").alias("value"))
    found = rows.join(proposed.select("value"), "value").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    counts = store(found, "frequent-counts")
    # the k-th count, or that of the last one if fewer were proposed
    kth = counts.orderBy(F.desc("n")).limit(k).agg(F.min("n"), F.count(F.lit(1))).first()
    total = proposed.agg(F.max("total")).first()[0]
    if total is None:
        return None
    seen = counts.agg(F.sum("n")).first()[0]
    # fewer than k are all there are if they make up all rows
    complete = seen == total or (kth[1] == k and kth[0] > 2 * ERROR / tracked * total)
    return counts.withColumnRenamed("value", column) if complete else None


def frequent_words(
    df: DataFrame, text: str, k: int, tokens: Column | None = None, tracked: int = TRACKED
) -> DataFrame:
    """``word_counts(df, text, k)`` without a shuffle of the whole vocabulary."""
    found = words(F.col(text)) if tokens is None else tokens
    return frequent_values(df.select(F.explode(found).alias("word")), "word", k, tracked)
