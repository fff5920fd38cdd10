"""Mean and deviation vectors kept up day by day.

A stored state holds, for each day and label, the number of vectors, their mean and the sum of
squared distances from it, position by position. States of any days merge exactly, so a new day
is read once and alone, and a rerun day replaces what it had put in before.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.joins import missing_days


def day_states(df: DataFrame, day: str = "day", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(day, label, n, mean, squares) in one pass; each task sends a row per day and label."""
    rows = df.where(F.col(day).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    summary = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(F.col(vector)))
    return (
        rows.groupBy(F.col(day).alias("day"), F.col(label).alias("label"))
        .agg(summary.alias("s"))
        .select(
            "day",
            "label",
            F.col("s.count").alias("n"),
            vector_to_array("s.mean").alias("mean"),
            F.transform(
                vector_to_array("s.variance"), lambda v: v * (F.col("s.count") - 1)
            ).alias("squares"),
        )
    )


def update_days(
    df: DataFrame, path: str, days: Sequence[date], day: str = "day", label: str = "label",
    vector: str = "embedding",
) -> None:
    """Writes the states of ``days``, read from ``df`` alone, over those stored before.

    A day without vectors is stored as such, so it takes back what an earlier run had put in.
    """
    spark = df.sparkSession
    listed = spark.createDataFrame([(d,) for d in sorted(set(days))], "day date")
    states = day_states(df.where(F.col(day).isin(list(days))), day, label, vector)
    # one row without a label for every day: its folder is replaced even if nothing is left
    marks = listed.select(
        "day",
        F.lit(None).cast(states.schema["label"].dataType).alias("label"),
        F.lit(0).cast("long").alias("n"),
        F.array().cast("array<double>").alias("mean"),
        F.array().cast("array<double>").alias("squares"),
    )
    out = states.unionByName(marks).hint("rebalance", "day")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("day").distinct()


def days_to_do(wanted: DataFrame, path: str, day: str = "day") -> DataFrame:
    """Days of ``wanted`` without a stored state, from folder names."""
    return missing_days(wanted, stored_days(wanted.sparkSession, path), day)


def merge_states(states: DataFrame) -> DataFrame:
    """(label, n, mean, std) over all days given; std is NULL for a label of one vector.

    The states of a label and position, one for each day, are merged pair by pair, which
    subtracts no large sums from each other.
    """
    cells = states.where("label is not null").select(
        "label", "day", "n", F.posexplode(F.arrays_zip("mean", "squares")).alias("pos", "c")
    )
    each = F.array_sort(F.collect_list(F.struct("day", "n", "c.mean", "c.squares")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def merge(a, b):
        n = a["n"] + b["n"]
        apart = b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"),
            (a["mean"] + apart * b["n"] / n).alias("mean"),
            (a["squares"] + b["squares"] + apart * apart * a["n"] * b["n"] / n).alias("squares"),
        )

    merged = cells.groupBy("label", "pos").agg(F.aggregate(each, zero, merge).alias("m"))
    spread = F.when(F.col("m.n") > 1, F.sqrt(F.col("m.squares") / (F.col("m.n") - 1)))
    parts = F.array_sort(F.collect_list(F.struct("pos", F.col("m.mean").alias("mean"), spread.alias("std"))))
    whole = merged.groupBy("label").agg(F.max("m.n").alias("n"), parts.alias("parts"))
    return whole.select(
        "label",
        "n",
        F.transform("parts", lambda p: p["mean"]).alias("mean"),
        F.when(F.col("n") > 1, F.transform("parts", lambda p: p["std"])).alias("std"),
    )


def centroids_of_days(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """(label, n, mean, std) of the stored days from ``first`` to ``last``; reads their states only."""
    states = spark.read.parquet(path)
    if first is not None:
        states = states.where(F.col("day") >= F.lit(first))
    if last is not None:
        states = states.where(F.col("day") <= F.lit(last))
    return merge_states(states)
