"""Mean, median and standard deviation vector per label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from postloom.operators.blocks import matrix
from postloom.session import ensure_checkpoints, shared_folder

# Rows drawn to place the brackets, and how many standard errors wide they are.
BRACKET_ROWS = 200_000
BRACKET_ERRORS = 8.0


def _present(df: DataFrame, label: str, vector: str) -> DataFrame:
    return df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(label).alias("label"), F.col(vector).alias("v")
    )


def mean_and_std(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, n, mean, std) in one pass; each task sends one row per label.

    The deviation divides by n - 1 and is NULL for a label with one row.
    """
    rows = _present(df, label, vector).select("label", array_to_vector("v").alias("v"))
    summary = Summarizer.metrics("mean", "std", "count").summary(F.col("v"))
    out = rows.groupBy("label").agg(summary.alias("s"))
    several = F.col("s.count") > 1
    return out.select(
        "label",
        F.col("s.count").alias("n"),
        vector_to_array("s.mean").alias("mean"),
        F.when(several, vector_to_array("s.std")).alias("std"),
    )


def mean_centroids(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    return mean_and_std(df, label, vector).select("label", F.col("mean").alias("centroid"))


def std_centroids(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    return mean_and_std(df, label, vector).select("label", F.col("std").alias("centroid"))


def as_cells(centroids: DataFrame) -> DataFrame:
    """(label, pos, value), one row per vector position."""
    return centroids.select("label", F.posexplode("centroid").alias("pos", "value"))


def _as_vectors(cells: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return cells.groupBy("label").agg(F.transform(parts, lambda c: c["value"]).alias("centroid"))


def median_centroids(
    df: DataFrame, label: str = "label", vector: str = "embedding", bracket_rows: int = BRACKET_ROWS
) -> DataFrame:
    """Exact median vector per label, the mean of the middle two for an even count.

    The built-in median keeps all values of a group in one task; here the middle values are
    selected by rank at every size, see ``_ranked_medians``. ``bracket_rows`` are drawn to
    place the intervals.
    """
    ensure_checkpoints(df.sparkSession)
    return _as_vectors(_ranked_medians(_present(df, label, vector), bracket_rows))


def approx_median_centroids(
    df: DataFrame, label: str = "label", vector: str = "embedding", accuracy: int = 10_000
) -> DataFrame:
    cells = _present(df, label, vector).select("label", F.posexplode("v").alias("pos", "x"))
    middle = F.percentile_approx("x", 0.5, accuracy).cast("double")
    return _as_vectors(cells.groupBy("label", "pos").agg(middle.alias("value")))


def _brackets(rows: DataFrame, bracket_rows: int) -> DataFrame:
    """(label, lo, hi): per position an interval that holds the median, from a small sample.

    A label with few or no sampled rows gets the whole line; it then is a rare label, whose
    values are few. Any sample leads to the same medians; it only decides how many values
    are looked at. The table is written once, so that every task sees the same intervals and
    the join knows its size.
    """
    spark = rows.sparkSession
    share = min(1.0, bracket_rows / max(1, rows.count()))
    cells = rows.sample(False, share, 8).select("label", F.posexplode("v").alias("pos", "x"))
    arrays = cells.groupBy("label", "pos").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    n = F.size("xs")
    margin = F.ceil(F.lit(BRACKET_ERRORS / 2) * F.sqrt(n)).cast("int") + 1
    low = (F.floor(n / 2).cast("int") - margin).alias("low")
    high = (F.ceil(n / 2).cast("int") + margin).alias("high")
    picked = arrays.select("label", "pos", low, high, "xs").select(
        "label",
        "pos",
        F.when(F.col("low") >= 0, F.get("xs", F.col("low"))).alias("lo"),
        F.get("xs", F.col("high")).alias("hi"),
    )
    ends = F.array_sort(F.collect_list(F.struct("pos", "lo", "hi")))
    found = picked.groupBy("label").agg(ends.alias("ends")).select(
        "label",
        F.transform("ends", lambda e: F.coalesce(e["lo"], F.lit(float("-inf")))).alias("lo"),
        F.transform("ends", lambda e: F.coalesce(e["hi"], F.lit(float("inf")))).alias("hi"),
    )
    folder = shared_folder(spark, "brackets")
    found.write.parquet(folder)
    return spark.read.schema(found.schema).parquet(folder)


def _ranked_medians(rows: DataFrame, bracket_rows: int) -> DataFrame:
    """Median by rank, without a task that holds a whole group.

    1. A sample gives per label and position an interval around the median. Few intervals are
       broadcast, within Spark's own bound; many are joined, and AQE splits hot labels.
    2. One pass counts the values below it and passes on only the values inside.
    3. Equal inside values are merged, and their running count gives the middle ranks.
    A middle rank outside its interval fails the query instead of returning a wrong value.
    """
    kind = rows.schema["label"].dataType
    arrow_kind = to_arrow_type(kind)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values, lo, hi = (matrix(batch.column(c)) for c in ("v", "lo", "hi"))
            coded = batch.column("label").dictionary_encode()
            names = coded.dictionary.cast(arrow_kind)
            code = coded.indices.to_numpy()
            row, pos = np.nonzero((values >= lo) & (values <= hi))
            none = np.zeros(len(pos), dtype=np.int64)
            yield _records(names.take(pa.array(code[row])), pos, values[row, pos], none, none)
            width = values.shape[1]
            below = np.zeros((len(names), width), dtype=np.int64)
            np.add.at(below, code, values < lo)
            each = np.repeat(np.arange(len(names)), width)
            yield _records(
                names.take(pa.array(each)),
                np.tile(np.arange(width), len(names)),
                pa.nulls(len(each), pa.float64()),
                below.ravel(),
                np.bincount(code, minlength=len(names))[each],
            )

    schema = f"label {kind.simpleString()}, pos int, x double, below bigint, n bigint"
    bounded = rows.join(_brackets(rows, bracket_rows), "label", "left").select(
        "label",
        "v",
        *[
            F.coalesce(c, F.array_repeat(F.lit(float(f"{sign}inf")), F.size("v"))).alias(c)
            for c, sign in (("lo", "-"), ("hi", ""))
        ],
    )
    parts = bounded.mapInArrow(split, schema)
    merged = parts.groupBy("label", "pos", "x").agg(
        F.count(F.lit(1)).alias("times"), F.sum("below").alias("below"), F.sum("n").alias("n")
    )
    # Written once: all steps below read it, and the vectors are scanned a single time.
    merged = merged.checkpoint()
    heads = merged.where("x is null").select("label", "pos", "below", "n")
    inside = merged.where("x is not null").select("label", "pos", "x", "times")
    # Equal-width slots inside an interval, so the running count is over slots first and
    # over single values only in the slots that hold a middle rank.
    spans = inside.groupBy("label", "pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    slot = F.least(
        F.floor(
            F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
            * 1000
        ),
        F.lit(999),
    )
    slotted = inside.join(spans, ["label", "pos"]).select(
        "label", "pos", "x", "times", slot.alias("slot")
    )
    slots = slotted.groupBy("label", "pos", "slot").agg(F.sum("times").alias("size"))
    before = W.partitionBy("label", "pos").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("below") + F.coalesce(F.sum("size").over(before), F.lit(0))
    ranked = slots.join(heads, ["label", "pos"]).select(
        "label", "pos", "slot", "size", "n", start.alias("start")
    )
    first = F.floor((F.col("n") + 1) / 2)
    last = F.floor(F.col("n") / 2) + 1
    wanted = ranked.where((F.col("start") < last) & (F.col("start") + F.col("size") >= first))
    values = slotted.join(wanted.drop("size"), ["label", "pos", "slot"])
    upto = W.partitionBy("label", "pos", "slot").orderBy("x").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    placed = values.select(
        "label", "pos", "x", "n", "times", (F.col("start") + F.sum("times").over(upto)).alias("end")
    )
    begin = F.col("end") - F.col("times")
    holds_first = (begin < first) & (F.col("end") >= first)
    holds_last = (begin < last) & (F.col("end") >= last)
    middle = placed.groupBy("label", "pos").agg(
        F.max(F.when(holds_first, F.col("x"))).alias("a"),
        F.max(F.when(holds_last, F.col("x"))).alias("b"),
    )
    missing = F.raise_error(F.lit("a median lies outside its interval"))
    checked = heads.select("label", "pos").join(middle, ["label", "pos"], "left")
    value = (F.coalesce("a", missing) + F.coalesce("b", missing)) / 2
    return checked.select("label", "pos", value.alias("value"))


def _records(labels: pa.Array, pos, x, below, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            labels,
            pa.array(pos, type=pa.int32()),
            pa.array(x, type=pa.float64()),
            pa.array(below, type=pa.int64()),
            pa.array(n, type=pa.int64()),
        ],
        names=["label", "pos", "x", "below", "n"],
    )
