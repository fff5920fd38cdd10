"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints within ``d`` bits share at least two of ``d + 2`` blocks of their bits, so every
pair of two blocks deals them out by value. The fingerprints of one task are sorted by Gray
rank, and groups of neighbours form a tree whose nodes hold the bits that all members share:
two nodes whose shared bits differ in more than ``d`` places are pruned with all they hold, and
two nodes that cannot differ in more are linked as a whole. Only a spanning forest leaves a
task, never all pairs of a group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.frames import components, key_filter, store, text_column, with_hit
from postloom.llm.words import give_back, slices, split_words, text_bytes, xxh64

SHINGLE = 3
DISTANCE = 3
# Fingerprints that share a key are dealt out again by their other bits beyond this many.
# After three rounds at most 14 bits are left, so no more than this many share a key.
KEY_ROWS = 1 << 14
CHUNK_ROWS = 1 << 18
FANOUT = 8
PAIRS = 1 << 20


# ---- fingerprints --------------------------------------------------------------------------


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """One unsigned fingerprint per text: bits set in over half of its shingles' XXH64."""
    words = split_words(data, offsets, lower=True)
    n = len(offsets) - 1
    counts = np.diff(words.docs)
    ones, total = np.zeros((n, 64), np.int64), np.maximum(counts - shingle + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(n), total)
    first = words.docs[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(total) - total, total)
    last = np.minimum(first + shingle, words.docs[doc + 1]) - 1
    step = 1 << 18
    for at in range(0, len(doc), step):
        a, b, d = first[at : at + step], last[at : at + step], doc[at : at + step]
        hashes = xxh64(words.data, words.start[a], words.end[b] - words.start[a])
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        ones[d[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    most = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_rows(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = fingerprints(*text_bytes(part.column("text")), shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "bits"]
                )
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs))
    return rows.mapInArrow(run, "doc_id long, bits long")


# ---- the index of one task -------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the order in which neighbours differ in one bit."""
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable node of each of ``n`` nodes, with links a - b added to ``root``."""
    root = np.arange(n) if root is None else root
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


class GrayIndex:
    """Tree over codes sorted by (key, Gray rank); level 0 has a node for each code."""

    def __init__(self, codes: np.ndarray, keys: np.ndarray):
        ones, zeros, low, high = codes, ~codes, keys, keys
        self.levels = [(ones, ones | zeros, low, high)]
        while len(ones) > FANOUT:
            at = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            low, high = low[at], np.maximum.reduceat(high, at)
            self.levels.append((ones, ones | zeros, low, high))
        self.size = len(codes)

    def components(self, distance: int) -> np.ndarray:
        """Smallest code (by place) linked to each, over all pairs of one key."""
        root = np.arange(self.size)
        top = len(self.levels[-1][0])
        a, b = np.triu_indices(top)
        stack = [(len(self.levels) - 1, a, b)]
        while stack:
            level, a, b = stack.pop()
            ones, known, low, high = self.levels[level]
            near = low[b] <= high[a]
            a, b = a[near], b[near]
            both = known[a] & known[b]
            least = np.bitwise_count((ones[a] ^ ones[b]) & both)
            near = least <= distance
            a, b, both, least = a[near], b[near], both[near], least[near]
            most = least + np.bitwise_count(~both)
            width = FANOUT**level
            if level:
                sure = (most <= distance) & (low[a] == high[a]) & (low[b] == high[b])
                sure &= low[a] == low[b]
            else:
                sure = np.ones(len(a), dtype=bool)
            for x, y in ((a[sure], b[sure]), (b[sure], a[sure])) if level else ((a, b),):
                # all of y's codes are linked to x's first one
                each = np.minimum(width, self.size - y * width)
                end = np.cumsum(each)
                inside = np.arange(end[-1] if len(end) else 0) - np.repeat(end - each, each)
                root = forest(
                    self.size, np.repeat(x * width, each), np.repeat(y * width, each) + inside, root
                )
            if not level:
                continue
            a, b = a[~sure], b[~sure]
            below = len(self.levels[level - 1][0])
            i, j = (g.ravel() for g in np.mgrid[:FANOUT, :FANOUT])
            step = PAIRS // (FANOUT * FANOUT)
            for at in range(0, len(a), step):
                x = (a[at : at + step, None] * FANOUT + i).ravel()
                y = (b[at : at + step, None] * FANOUT + j).ravel()
                good = (x <= y) & (x < below) & (y < below)
                stack.append((level - 1, x[good], y[good]))
        return root


def _linked(distance: int):
    """Task: rows (mask, key, bits, node) sorted by mask and key to a forest of links."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def solve(table: pa.Table):
            mask, key, bits, node = (
                table[c].to_numpy().astype(np.int64) for c in ("mask", "key", "bits", "node")
            )
            change = np.concatenate([[0], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            number = np.cumsum(change)
            codes = bits.view(np.uint64)
            order = np.lexsort((gray_rank(codes), number))
            root = GrayIndex(codes[order], number[order]).components(distance)
            away = np.flatnonzero(root != np.arange(len(root)))
            names = node[order]
            return pa.RecordBatch.from_arrays(
                [pa.array(names[away]), pa.array(names[root[away]])], names=["u", "v"]
            )

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                table = pa.Table.from_batches(held)
                mask, key = table["mask"].to_numpy(), table["key"].to_numpy()
                cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
                cut = int(cuts[-1]) if len(cuts) else 0
                if cut:
                    yield solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows = table.num_rows - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


# ---- the join ------------------------------------------------------------------------------


def _blocks(mask: int, distance: int) -> list[int]:
    """``mask`` with two of ``distance + 2`` blocks of the other bits added, in all ways."""
    free = [1 << k for k in range(64) if not mask >> k & 1]
    parts = [sum(p.tolist()) for p in np.array_split(np.array(free, dtype=object), distance + 2)]
    return [mask | x | y for x, y in combinations(parts, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (u, v) between nodes of ``codes`` (bits, node; bits distinct) that join all within
    ``distance`` bits: the same components as all close pairs, without listing the pairs.

    Each row goes to the ten ways (for three bits) of choosing its blocks. Keys that too many
    fingerprints share are dealt out again by two blocks of their other bits.
    """
    spark = codes.sparkSession
    rows = codes.select("bits", "node", F.lit(0).cast("long").alias("mask"))
    masks, found = [0], None
    while True:
        # at most 10, 100 and 1,000 rows for three bits
        ways = [(_signed(m), _signed(x)) for m in masks for x in _blocks(m, distance)]
        step = spark.createDataFrame(ways, "mask long, next long")
        dealt = rows.join(F.broadcast(step), "mask").select(
            F.col("next").alias("mask"),
            F.col("bits").bitwiseAND(F.col("next")).alias("key"),
            "bits",
            "node",
        )
        counts = dealt.groupBy("mask", "key").count()
        heavy = store(counts.filter(F.col("count") > KEY_ROWS).select("mask", "key"), "heavy")
        some = not heavy.isEmpty()
        light = dealt.join(heavy, ["mask", "key"], "left_anti") if some else dealt
        sorted_rows = light.repartition("mask", "key").sortWithinPartitions("mask", "key")
        links = store(
            sorted_rows.mapInArrow(_linked(distance), "u long, v long").distinct(), "links"
        )
        found = links if found is None else found.union(links)
        if not some:
            return found
        rows = store(dealt.join(heavy, ["mask", "key"], "left_semi").drop("key"), "again")
        masks = [x & (1 << 64) - 1 for x in sorted({x for _, x in ways})]


def simhash_components(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """doc_id, bits (the fingerprint as a long) and component_id of every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``distance`` differing
    bits, a row's own included. ``docs`` needs doc_id and text; other columns are ignored. NULL
    text is empty; texts without words have fingerprint zero, which links like any other. A row
    with NULL doc_id takes the component of documents with its fingerprint, NULL if there are
    none. Repeated rows stay. An empty table gives no rows.
    """
    rows = store(fingerprint_rows(docs, shingle), "fingerprints")
    codes = rows.groupBy("bits").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    codes = store(codes.filter("node is not null"), "codes")
    roots = components(fingerprint_links(codes.select("bits", "node"), distance))
    # documents alone in their component need no look-up
    shared = codes.join(roots, "node", "left").filter("n > 1 or root is not null")
    shared = shared.select("bits", F.coalesce("root", "node").alias("_component"))
    return rows.join(shared, "bits", "left").select(
        "doc_id", "bits", F.coalesce("_component", "doc_id").alias("component_id")
    )


def hexadecimal(bits: str) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` without the documents that are not the first of their component.

    Rows that repeat a doc_id stay or go together: they stay if any of them is first. Rows
    with NULL doc_id stay.
    """
    found = simhash_components(docs, shingle, distance).filter("doc_id is not null")
    gone = found.groupBy("doc_id").agg(F.max(F.expr("doc_id = component_id")).alias("first"))
    gone = store(gone.filter("not first").select("doc_id"), "gone")
    marked = with_hit(docs, "doc_id", key_filter(gone, "doc_id"), "__pl_hit")
    clear = marked.filter("not __pl_hit").drop("__pl_hit")
    maybe = marked.filter("__pl_hit").drop("__pl_hit")
    return clear.union(maybe.join(gone, "doc_id", "left_anti").select(docs.columns))
