"""CSV with newlines in its texts, read by many tasks per file.

A newline ends a record where the quotes before it, counted from the file's start, are even.
So a range of bytes needs one bit from all ranges before it: the parity of their quotes.

1. Spark's text reader cuts files into ranges and lines; a map-side aggregate gives one row
   per range, and running sums per file give each range its bit.
2. Ranges at whose ends a record is open hand on its pieces, two at most. They are stored,
   numbered by their keys and put together per record.
3. All ranges cut their own records; these stay in the task that read them.

The rows per range are broadcast in 2 and 3. They are no more than the files and splits which
Spark's scan lists on the driver: one for each ``spark.sql.files.maxPartitionBytes``, at most
one more for each file. Both scans look their ranges up by place and length, and fail if the
files or the split size have changed since 1, rather than read a record twice or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.session import store

RANGE = ["path", "start", "length"]
PIECE = "path string, start long, kind int, header boolean, text string"


def read_csv_ranges(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str
) -> DataFrame:
    """Rows of CSV files with a header, as ``read_csv`` gives them, without a task per file.

    Fields are quoted by ``"`` and quotes inside them doubled, as ``write_csv`` does; a quote
    inside an unquoted field is not allowed. Lines end in ``\\n`` or ``\\r\\n``; newlines in
    texts stay as they are (``read_csv`` makes them ``\\n`` where a file's lines end in
    ``\\r\\n``). Columns are taken by position, lines without characters are skipped, and each
    file's first line begins its header. Fields that don't parse are NULL. A record that is
    open at a file's end ends there. Compressed files are one range each.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"),
    )
    ranges = store(_ranges(lines), "csv-ranges")
    records = _cut(lines, ranges, pieces=False).union(_joined(lines, ranges))
    records = records.select(F.regexp_replace("text", "\r\\z", "").alias("text")).where("text <> ''")
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    return records.select(F.from_csv("text", _ddl(schema), options).alias("row")).select("row.*")


def _ddl(schema: T.StructType | str) -> str:
    if isinstance(schema, str):
        return schema
    names = [f.name.replace("`", "``") for f in schema]
    return ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, schema))


def _ranges(lines: DataFrame) -> DataFrame:
    """A row per range: ``before`` and ``after``, whether quotes are open at its ends."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    odd = lines.groupBy(*RANGE).agg(F.bit_xor(quotes.bitwiseAND(F.lit(1))).alias("odd"))
    upto = F.sum("odd").over(Window.partitionBy("path").orderBy("start"))
    return odd.select(
        *RANGE,
        ((upto - F.col("odd")) % 2).cast("int").alias("before"),
        (upto % 2).cast("int").alias("after"),
    )


def _joined(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Records that reach over the end of a range."""
    found = store(_cut(lines, ranges, pieces=True), "csv-pieces")
    # a record begins with the last piece of a range (kind 1) and goes on in the next ranges;
    # the numbering sees keys only, texts meet by record
    along = Window.partitionBy("path").orderBy("start", "kind")
    numbers = found.select("path", "start", "kind", F.sum("kind").over(along).alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("start", "kind", "text")))
    whole = found.join(numbers, ["path", "start", "kind"]).groupBy("path", "record").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text"),
        F.max("header").alias("header"),
    )
    return whole.where(~F.col("header")).select("text")


def _cut(lines: DataFrame, ranges: DataFrame, pieces: bool) -> DataFrame:
    """Records inside ranges, or the pieces of records that reach over a range's ends."""
    keys = F.broadcast(ranges)
    if pieces:
        # other ranges never reach the Python workers
        known = lines.join(keys.where("before = 1 or after = 1"), RANGE)
    else:
        changed = F.raise_error(F.concat(F.lit("splits have changed: "), "path")).cast("int")
        known = lines.join(keys, RANGE, "left").withColumn("before", F.coalesce("before", changed))

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["path", "start", "kind", "header", "text"] if pieces else ["text"]

        def out(key, kind, header, text):
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
            columns = [[key[0]], [key[1]], [kind], [header], [text]]
            return pa.RecordBatch.from_arrays([pa.array(*c) for c in zip(columns, kinds)], names=names)

        key, parity, waiting, closed, opened = None, 0, [], False, False

        def last():
            # the record that is open at the end of a range, or all of a range inside a record
            if pieces and waiting:
                inner = opened and not closed
                header = key[1] == 0 and not closed
                yield out(key, 0 if inner else 1, header, "\n".join(waiting))

        for batch in batches:
            if not batch.num_rows:
                continue
            path, start = batch.column("path"), batch.column("start").to_numpy()
            new = start[1:] != start[:-1]
            new |= pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                here = (path[a].as_py(), int(start[a]))
                if here != key:
                    yield from last()
                    key, waiting, closed = here, [], False
                    parity = batch.column("before")[a].as_py()
                    opened = parity == 1
                text = batch.column("value").slice(a, b - a)
                quotes = pc.count_substring(text, '"').to_numpy(zero_copy_only=False)
                after = (parity + np.cumsum(quotes)) % 2
                parity = int(after[-1])
                ends = np.flatnonzero(after == 0) + 1
                if not len(ends):
                    waiting += text.to_pylist()
                    continue
                first = "\n".join([*waiting, *text[: ends[0]].to_pylist()])
                waiting = text[ends[-1] :].to_pylist()
                if closed or not (opened or key[1] == 0):
                    if not pieces:
                        yield pa.RecordBatch.from_arrays([pa.array([first], pa.string())], names=names)
                elif opened and pieces:
                    yield out(key, 0, False, first)
                closed = True
                if not pieces and len(ends) > 1:
                    inner = text[ends[0] : ends[-1]].cast(pa.string())
                    groups = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), inner)
                    yield pa.RecordBatch.from_arrays([pc.binary_join(groups, "\n")], names=names)
        yield from last()

    wanted = known.select("path", "start", "before", "value")
    return wanted.mapInArrow(cut, PIECE if pieces else "text string")
