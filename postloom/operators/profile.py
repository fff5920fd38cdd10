"""Column profiles and word frequencies.

All are partial aggregates: a value that fills a third of the table is combined on the
map side and reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import fixed
from postloom.functions.words import drop_stop_words, words


def value_counts(
    df: DataFrame,
    column: str,
    k: int | None = None,
    keep_null: bool = False,
    skip_missing: bool = False,
    missing: str = fixed.MISSING,
) -> DataFrame:
    """Frequencies, most frequent first; ties go by value."""
    rows = df if keep_null else df.where(F.col(column).isNotNull())
    if skip_missing:
        rows = rows.where(F.col(column) != missing)
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.desc("n"), F.asc(column))
    return ordered if k is None else ordered.limit(k)


def value_shares(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Frequencies with their percentage. The total is a scalar subquery, not a window
    without partitions, so no task sees all values."""
    counts = value_counts(df, column)
    total = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1))).scalar()
    share = F.round(F.col("n") / total * 100, 4)
    out = counts.select(column, "n", share.alias("percent")).orderBy(F.desc("n"), F.asc(column))
    return out if k is None else out.limit(k)


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct values per column, NULL counted as one.

    One shuffle of (column, value) pairs; equal pairs are merged before it, and values of more
    than 64 bytes are compared by SHA-256 digest, which is one character longer than any value.
    """
    names = list(columns or df.columns)

    def short(name: str) -> Column:
        value = F.col(name).cast("string")
        digest = F.concat(F.lit("#"), F.sha2(value, 256))
        return F.when(F.octet_length(value) > 64, digest).otherwise(value).alias("value")

    pairs = F.array(*[F.struct(F.lit(c).alias("column"), short(c)) for c in names])
    return (
        df.select(F.inline(pairs))
        .distinct()
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("distinct_values"))
    )


def approx_distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row with a column for each, NULL counted as one value as in the exact form."""
    names = list(columns or df.columns)
    null = [F.coalesce(F.max(F.when(F.col(c).isNull(), 1)), F.lit(0)) for c in names]
    return df.agg(*[(F.approx_count_distinct(c) + n).alias(c) for c, n in zip(names, null)])


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """Rows beyond the first of each key. Long texts are compared by SHA-256 digest."""
    digest = F.sha2(F.to_json(F.array(*[F.col(k).cast("string") for k in keys])), 256)
    groups = df.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed, empty ones kept."""
    value = F.col(column).cast("double")
    rows = df.where(value.isNotNull()).select(value.alias("v"))
    # One scalar subquery for both ends; a single value gives one full first bin.
    ends = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    place = F.try_divide(F.col("v") - ends["lo"], ends["hi"] - ends["lo"]) * bins
    slot = F.least(F.floor(F.coalesce(place, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    width = (ends["hi"] - ends["lo"]) / bins
    spine = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    n = F.coalesce("n", F.lit(0))
    return spine.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (ends["lo"] + width * F.col("bin")).alias("lower"),
        (ends["lo"] + width * (F.col("bin") + 1)).alias("upper"),
        n.alias("n"),
        F.when(n > 0, F.log10(n)).alias("log10_n"),
    )


def share_matching(df: DataFrame, text: str, pattern: str) -> DataFrame:
    return df.agg(F.avg(F.col(text).rlike(pattern).cast("double")).alias("share"))


def column_profile(df: DataFrame) -> DataFrame:
    """Type and number of present values per column, in one pass."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col(f.name).alias("non_null"),
            )
            for f in df.schema
        ]
    )
    return counts.select(F.inline(rows))


def word_counts(
    df: DataFrame,
    text: str,
    k: int | None = None,
    stop_words: Sequence[str] = (),
    tokens: Column | None = None,
) -> DataFrame:
    """Word frequencies over all texts; stop words are left out when given."""
    found = words(F.col(text)) if tokens is None else tokens
    kept = drop_stop_words(found, stop_words) if stop_words else found
    return value_counts(df.select(F.explode(kept).alias("word")), "word", k)


def corpus_length(df: DataFrame, text: str) -> DataFrame:
    """Characters of all texts joined by one space, and the number of words."""
    return df.where(F.col(text).isNotNull()).agg(
        (F.sum(F.length(text)) + F.count(F.lit(1)) - 1).alias("characters"),
        F.sum(F.size(words(F.col(text)))).alias("words"),
    )
