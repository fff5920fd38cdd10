"""Running a step for the days that still need it."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from postloom.functions.dates import day_of_path
from postloom.operators.joins import missing_days
from postloom.operators.sampling import newest_days
from postloom.sources.posts import drop_days, write_days

STATUS = "step string, day date, rows bigint, finished timestamp"


def listed_days(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Days named in a list of paths, whichever of several file names they use."""
    names = spark.createDataFrame([(p,) for p in paths], "path string")
    return names.select(day_of_path(F.col("path")).alias("day")).where("day is not null").distinct()


def days_of(table: DataFrame, day: str = "day") -> DataFrame:
    return table.select(F.col(day).alias("day")).distinct()


def finished_days(spark: SparkSession, status_path: str, step: str) -> DataFrame:
    """Days a step has finished, read from its small status table."""
    try:
        status = spark.read.schema(STATUS).parquet(status_path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        status = spark.createDataFrame([], STATUS)
    return status.where(F.col("step") == step).select("day").distinct()


def _days_seen(seen: Observation) -> set:
    """Days among the rows that passed; none where the plan was known to be empty."""
    try:
        return set(seen.get["days"] or ())
    except Py4JJavaError as problem:
        # a plan that the optimizer reduced to no rows reports no row of metrics either
        if "toPyRow" not in str(problem):
            raise
        return set()


def run_days(
    spark: SparkSession,
    source: DataFrame,
    step: str,
    work: Callable[[DataFrame], DataFrame],
    target: str,
    status_path: str,
    at_most: int | None = None,
) -> list[str]:
    """One job over all missing days, newest first, at most ``at_most`` of them.

    ``source`` has a ``day`` column; ``work`` keeps it. A rerun after a failure replaces
    the same days, since days only count as finished after their rows are written. A day
    that keeps no rows is finished with zero, and rows of earlier runs go.
    """
    todo = missing_days(days_of(source), finished_days(spark, status_path, step))
    wanted = newest_days(todo, at_most) if at_most else todo
    days = sorted((r["day"] for r in wanted.collect()), reverse=True)
    if not days:
        return []
    rows = source.where(F.col("day").isin(days))
    seen = Observation(f"days of {step}")
    out = work(rows)
    # the set of days is no longer than the list of them
    write_days(out.observe(seen, F.collect_set("day").alias("days")), target)
    written = _days_seen(seen)
    drop_days(spark, target, [d for d in days if d not in written])
    done = spark.createDataFrame([(d,) for d in days], "day date")
    if written:
        counts = (
            spark.read.schema(out.schema).parquet(target).where(F.col("day").isin(days))
            .groupBy("day").agg(F.count(F.lit(1)).alias("rows"))
        )
        done = done.join(counts, "day", "left")
    else:
        done = done.withColumn("rows", F.lit(0).cast("long"))
    done.select(
        F.lit(step).alias("step"),
        "day",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.current_timestamp().alias("finished"),
    ).coalesce(1).write.mode("append").parquet(status_path)
    return [str(d) for d in days]


def run_each_day(
    days: list[str], work: Callable[[str], None]
) -> dict[str, str]:
    """For steps that cannot share a job: go on after a failed day and tell which failed."""
    outcome = {}
    for day in days:
        try:
            work(day)
            outcome[day] = "done"
        except Exception as problem:
            outcome[day] = f"failed: {type(problem).__name__}: {problem}"
    return outcome
