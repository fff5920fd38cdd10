"""Near-duplicate vectors: random-hyperplane sign hashing, exact check, components.

Each table takes the signs of a vector against its own hyperplanes as a key; vectors that
share label and key are compared exactly. A pair that shares keys in several tables counts in
the first of them, so links are counted without listing pairs. Equal vectors are one class.
Full keys are split into chunks, and every two chunks meet in a task of their own.
"""

from __future__ import annotations

from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.frames import components, store
from postloom.llm.simhash import forest

THRESHOLD = 0.98
RECALL = 0.9995
# Vectors with one key that are compared at once, and the vectors a key is meant to hold.
CHUNK = 1024
KEY_ROWS = 256
SEED = 20


def table_plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits per key, tables): keys hold about KEY_ROWS vectors, and a pair exactly at the
    threshold shares a key in some table with probability ``recall``, closer ones more often.
    """
    bits = min(30, max(8, ceil(log2(max(n, 1) / KEY_ROWS)))) if n else 8
    same = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(1 - recall) / log(1 - same))


def _planes(width: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((width, bits * tables))


def _keys(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = vectors @ _planes(vectors.shape[1], bits, tables) > 0
    return signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    # by the largest component first: squares of very large or small ones leave the doubles
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_width(batch: pa.RecordBatch):
    """Parts of a batch whose vectors have one width."""
    widths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
    for w in np.unique(widths):
        yield batch.take(pa.array(np.flatnonzero(widths == w)))


def _deal(bits: int, tables: int):
    def run(batches):
        for batch in batches:
            for part in _by_width(batch) if batch.num_rows else ():
                keys = _keys(_matrix(part.column("embedding")), bits, tables)
                rows = pa.array(np.repeat(np.arange(part.num_rows), tables))
                number = np.tile(np.arange(tables, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*part.take(rows).columns, pa.array(number), pa.array(keys.ravel())],
                    names=[*part.schema.names, "number", "key"],
                )

    return run


def _compare(bits: int, tables: int, threshold: float):
    """Task: sorted rows of (label, width, number, key, a, b) to counts and a forest of links."""
    names = ("label", "width", "number", "key", "a", "b")

    def solve(table: pa.Table):
        x = _matrix(table["embedding"].combine_chunks())
        node, n, side = (table[c].to_numpy() for c in ("node", "n", "side"))
        number, a, b = (int(table[c][0].as_py()) for c in ("number", "a", "b"))
        keys = _keys(x, bits, tables)[:, :number]
        left = np.flatnonzero(side == a)
        right = np.flatnonzero(side == b)
        counts = np.zeros(len(node), np.int64)
        root = np.arange(len(node))
        for at in range(0, len(left), CHUNK):
            i = left[at : at + CHUNK]
            close = x[i] @ x[right].T >= threshold
            if a == b:
                close &= i[:, None] < right[None, :]
            p, q = np.nonzero(close)
            p, q = i[p], right[q]
            if number:
                new = ~(keys[p] == keys[q]).any(axis=1)
                p, q = p[new], q[new]
            counts += np.bincount(p, n[q], len(node)).astype(np.int64)
            counts += np.bincount(q, n[p], len(node)).astype(np.int64)
            root = forest(len(node), p, q, root)
        some = np.flatnonzero(counts)
        away = some[root[some] != some]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([node[some], node[away]])),
                pa.array([None] * len(some) + node[root[away]].tolist(), pa.int64()),
                pa.array(np.concatenate([counts[some], np.zeros(len(away), np.int64)])),
            ],
            names=["node", "other", "links"],
        )

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            change = np.zeros(held.num_rows - 1, dtype=bool)
            for c in names:
                v = held[c].to_numpy()
                change |= v[1:] != v[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
            for x, y in zip(cuts, cuts[1:]):
                if y - x > 1:
                    yield solve(held.slice(x, y - x))
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows > 1:
            yield solve(held)

    return run


def link_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Rows of equal label link when their cosine, in double precision, is at least
    ``threshold``; n_links counts other rows, component_id is the smallest vec_id reachable,
    and kept says whether it is the row's own. ``vectors`` needs vec_id, embedding and label;
    other columns are ignored. Vectors that are NULL, empty, all zero, or hold NULL or
    non-finite values link with nothing, nor do rows with NULL label or vec_id (whose
    component is NULL and kept false). Vectors of different widths don't link. Equal vectors
    link with each other. A link is missed with probability 1 - ``recall`` at the threshold,
    less above. An empty table gives no rows.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    fine = F.coalesce(
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine & some, F.lit(False)
    )
    # two hashes, 128 bits, stand for a vector
    rows = rows.withColumn("fine", fine).withColumns(
        {"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.reverse("embedding"), F.lit(1))}
    )
    classes = rows.filter("fine").groupBy("label", "k1", "k2")
    classes = store(
        classes.agg(
            F.min("vec_id").alias("node"),
            F.count(F.lit(1)).alias("n"),
            F.any_value("embedding").alias("embedding"),
        ),
        "vectors",
    )
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = table_plan(most, threshold, recall)
    vectors = classes.select(
        "label", F.size("embedding").alias("width"), "node", "n", "embedding"
    )
    schema = "label long, width int, node long, n long, embedding array<double>, number int, key long"
    dealt = vectors.mapInArrow(_deal(bits, tables), schema)
    key = ["label", "width", "number", "key"]
    sizes = vectors.mapInArrow(_deal(bits, tables), schema).groupBy(key).count()
    sizes = sizes.filter(F.col("count") > CHUNK).withColumn(
        "chunks", F.ceil(F.col("count") / CHUNK).cast("int")
    )
    sizes = store(sizes.drop("count"), "full-keys")
    spread = (
        dealt.join(sizes, key, "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("side", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumns({"a": F.least("side", "to"), "b": F.greatest("side", "to")})
        .drop("chunks", "to")
    )
    order = [*key, "a", "b"]
    found = spread.repartition(*order).sortWithinPartitions(*order)
    found = found.mapInArrow(
        _compare(bits, tables, threshold), "node long, other long, links long"
    )
    found = store(found, "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("other is not null").select(
        F.col("node").alias("u"), F.col("other").alias("v")
    )
    result = (
        classes.filter("n > 1")
        .select("node")
        .union(links.select("node"))
        .distinct()
        .join(classes.select("label", "k1", "k2", "node", "n"), "node")
        .join(links, "node", "left")
        .join(components(edges), "node", "left")
        .select(
            "label", "k1", "k2",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"),
            F.coalesce("root", "node").alias("_root"),
        )
    )
    ids = rows.withColumn("label", F.when(F.col("fine"), F.col("label")))
    ids = ids.select("vec_id", "label", "k1", "k2")
    return ids.join(result, ["label", "k1", "k2"], "left").select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_root", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("_root", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
