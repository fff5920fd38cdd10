"""Event-time counts and de-duplication on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need a zoned time stamp; the session zone is UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def counts_in(df: DataFrame, window: Column, *keys: str) -> DataFrame:
    counts = df.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n"
    )


def tumbling_counts(df: DataFrame, ts: str, width: str, *keys: str) -> DataFrame:
    return counts_in(df, F.window(ts, width), *keys)


def sliding_counts(df: DataFrame, ts: str, width: str, slide: str, *keys: str) -> DataFrame:
    return counts_in(df, F.window(ts, width, slide), *keys)


def session_counts(df: DataFrame, ts: str, gap: str, *keys: str) -> DataFrame:
    return counts_in(df, F.session_window(ts, gap), *keys)


def first_of_each(df: DataFrame, key: str) -> DataFrame:
    """One row per key; a key is forgotten once the watermark has passed it."""
    return df.dropDuplicatesWithinWatermark([key])


GAP = "gap_start timestamp, gap_end timestamp, buckets long"


def gap_runs(df: DataFrame, ts: str, width_seconds: int, *keys: str) -> DataFrame:
    """Runs of empty buckets between two buckets with rows, per key, once the watermark is past.

    ``df`` has a watermark on ``ts``. A key's state is its last closed bucket and the open ones,
    of which there are as many as the delay holds; a timer at the end of the first open bucket
    closes it, with or without new rows. A row later than the delay is left out, as by windows.
    """
    bucket = F.floor(F.unix_timestamp(ts) / width_seconds).cast("long").alias("bucket")
    rows = df.select(*(keys or [F.lit(0).alias("_all")]), F.col(ts).alias("_ts"), bucket)
    names = list(keys) or ["_all"]
    kinds = [rows.schema[c] for c in keys]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + [GAP])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        buckets = set(waiting)
        for part in parts:
            buckets.update(part["bucket"].unique().tolist())
        passed = state.getCurrentWatermarkMs() // (1000 * width_seconds)  # first bucket still open
        found = []
        for b in sorted(x for x in buckets if x < passed):
            if last is not None and b > last + 1:
                found.append((last + 1, b, b - last - 1))
            last = b if last is None else max(b, last)
        waiting = sorted(x for x in buckets if x >= passed)
        state.update((last, waiting))
        if waiting:
            state.setTimeoutTimestamp(max((waiting[0] + 1) * width_seconds, passed * width_seconds) * 1000)
        if found:
            out = {n: [v] * len(found) for n, v in zip(keys, key)}
            for name, at in (("gap_start", 0), ("gap_end", 1)):
                out[name] = pd.to_datetime([g[at] * width_seconds for g in found], unit="s")
            out["buckets"] = [g[2] for g in found]
            yield pd.DataFrame(out)

    return rows.groupBy(*names).applyInPandasWithState(
        step, schema, "last long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
