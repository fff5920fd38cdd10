"""Seeded samples and ordered limits. The same seed always gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postloom.functions import fixed


def ticket(key: str, seed: int = fixed.SEED) -> Column:
    """A random-looking text per key; its order is the drawing order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def bernoulli(df: DataFrame, key: str, fraction: float, seed: int = fixed.SEED) -> DataFrame:
    """Each row with probability ``fraction``, decided by its key alone."""
    if fraction >= 1:
        return df
    edge = f"{int(fraction * 16**8):08x}"
    return df.where(F.substring(ticket(key, seed), 1, 8) < F.lit(edge))


def exact_sample(df: DataFrame, key: str, n: int, seed: int = fixed.SEED) -> DataFrame:
    """Exactly ``n`` rows (all rows when there are fewer).

    A first pass counts tickets by their leading four digits and finds where the n-th
    one lies; only rows up to there, about n + rows / 65536, are ranked, among those of
    the same lead, so the sample is spread over as many tasks as it has leads.
    """
    lead = F.substring(ticket(key, seed), 1, 4)
    counts = df.groupBy(lead.alias("lead")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.orderBy("lead").rowsBetween(W.unboundedPreceding, W.currentRow))
    last = counts.select("lead", (F.lit(n) - upto + F.col("c")).alias("wanted"), upto.alias("upto"))
    last = last.where(F.col("upto") >= n).agg(F.min(F.struct("lead", "wanted")).alias("e"))
    edge, wanted = last.select("e.lead").scalar(), last.select("e.wanted").scalar()
    # no edge: fewer rows than n, and "g" is beyond all leads
    near = df.withColumn("_lead", lead).where(F.col("_lead") <= F.coalesce(edge, F.lit("g")))
    place = F.row_number().over(W.partitionBy("_lead").orderBy(ticket(key, seed), key))
    kept = (F.col("_lead") < F.coalesce(edge, F.lit("g"))) | (F.col("_place") <= wanted)
    return near.withColumn("_place", place).where(kept).drop("_lead", "_place")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def newest_days(days: DataFrame, n: int, day: str = "day") -> DataFrame:
    return days.orderBy(F.desc(day)).limit(n)
