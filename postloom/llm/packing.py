"""Packing of token sequences: dominance reduction, then best fit.

Pieces of one length are alike, so the plan is made on the counts per length: at most
``capacity`` numbers, whatever the data. Documents get their places by their rank among the
pieces of their length, in two levels, so a length with a third of all pieces is split.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.frames import store, text_column
from postloom.llm.tokens import id_batches

CAPACITY = 2048
END_ID = 0
# Hashed groups that the pieces of one length are ranked in: at least so many, and more of a
# length with many pieces, so that a group keeps to about GROUP_ROWS pieces.
GROUPS = 64
GROUP_ROWS = 50_000


class Bins(NamedTuple):
    items: tuple[tuple[int, int], ...]  # (length, how many) of each bin
    count: int  # bins of this kind


# ---- the plan, on counts per length -----------------------------------------------------


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Bins], dict[int, int]]:
    """Fixes the bins that dominate all others for their item; returns them and the rest.

    For an item j of the remaining ones let room = capacity - j. With at most k further items
    (k from the smallest ones), a set dominates every other set that holds j when

    * k = 0: j alone;
    * the largest item i that fits fills the bin exactly, or k = 1: j and i;
    * k = 2 and i is at least as large as the best fitting pair: j and i;
    * k = 2 and no two items larger than b fit beside j, where b is the largest that fits
      beside j and i: j, i and b, as any pair is at most (i, b) item by item.

    Each rule stays true while the items it names last, since removing items only makes the
    smallest ones larger; so one decision covers all items of its lengths.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[Bins] = []

    def largest(room: int, j: int) -> int:
        return max((s for s in left if s <= room and left[s] > (s == j)), default=0)

    def smallest(j: int, n: int, above: int = 0) -> list[int]:
        out: list[int] = []
        for s in sorted(s for s in left if s > above):
            out += [s] * min(n - len(out), left[s] - (s == j))
            if len(out) >= n:
                break
        return out

    def fix(*items: int) -> None:
        need = {s: items.count(s) for s in items}
        times = min(left[s] // k for s, k in need.items())
        fixed.append(Bins(tuple(sorted(need.items(), reverse=True)), times))
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left:
                room = capacity - j
                least = smallest(j, 3)
                if not least or least[0] > room:
                    fix(j)
                    changed = True
                    continue
                i = largest(room, j)
                if i == room or sum(least[:2]) > room or len(least) < 2:
                    fix(j, i)
                    changed = True
                    continue
                if len(least) == 3 and sum(least) <= room:
                    break
                b = max(
                    (s for s in left if s <= room - i and left[s] > (s == j) + (s == i)), default=0
                )
                pair = 0
                for s in left:
                    if left[s] > (s == j):
                        other = [t for t in left if t <= room - s and left[t] > (t == j) + (t == s)]
                        pair = max(pair, s + max(other)) if other else pair
                if i >= pair:
                    fix(j, i)
                elif b and (len(big := smallest(j, 2, b)) < 2 or sum(big) > room):
                    fix(j, i, b)
                else:
                    break
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Best fit of decreasing lengths, for all bins of one kind at a time.

    A kind of bins is used up or a length is, so there are at most a few kinds per length.
    """
    open_bins: dict[int, list[list]] = {}  # room -> [items, bins]

    def put(room: int, items: tuple, n: int) -> None:
        if n:
            open_bins.setdefault(room, []).append([items, n])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in open_bins if r >= size), default=0)
            if not room:
                each = capacity // size
                put(capacity - each * size, ((size, each),), n // each)
                if n % each:
                    put(capacity - n % each * size, ((size, n % each),), 1)
                break
            items, bins = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
            each = room // size
            full = min(bins, n // each)
            put(room - each * size, (*items, (size, each)), full)
            n -= full * each
            bins -= full
            if bins and n:  # fewer than a whole bin takes
                put(room - n * size, (*items, (size, n)), 1)
                bins, n = bins - 1, 0
            put(room, items, bins)
    return [Bins(items, n) for kinds in open_bins.values() for items, n in kinds]


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Bins for ``counts`` items per length (1 to ``capacity``); empty for no items."""
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(bins: list[Bins]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, offset), sorted."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for items, count in bins:
        offset = 0
        for size, each in items:
            rows.append((size, taken.get(size, 0), sequence, each, offset))
            taken[size] = taken.get(size, 0) + each * count
            offset += size * each
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


# ---- documents -----------------------------------------------------------------------------


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32."""

    def cut(batches):
        for part, ids, begins in id_batches(tokenizer, END_ID)(batches):
            whole = np.diff(begins)
            pieces = -(-whole // capacity)
            row = np.repeat(np.arange(len(whole)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            length = np.minimum(whole[row] - start, capacity)
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            at = (begins[:-1][row] + start) * 4
            crc = [zlib.crc32(data[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(row)),
                    pa.array(number.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs))
    return rows.mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs whole documents into few sequences of at most ``capacity`` tokens.

    ``docs`` needs doc_id and text; other columns are ignored. A document is its ids and one
    end id; NULL text is empty, so it has the end id alone. Longer documents are cut into
    pieces of ``capacity``. Repeated rows are packed each; a NULL doc_id stays NULL. Long texts
    are read whole, in one task each. An empty table gives no rows.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    pieces = cut_pieces(docs, tokenizer, capacity)
    # the stored salt parts pieces that are equal in all else
    pieces = store(pieces.withColumn("_salt", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = spark.sparkContext.broadcast(slots(plan_bins(counts, capacity)))
    # ranks: groups of a length by hash, running counts over groups, order inside a group
    many = [(length, max(GROUPS, n // GROUP_ROWS)) for length, n in counts.items()]
    groups = spark.createDataFrame(many, "length long, _groups long")  # ``capacity`` rows at most
    order = ["doc_id", "piece", "start", "ids_crc32"]
    pieces = (
        pieces.join(F.broadcast(groups), "length")
        .withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "_salt"), F.col("_groups")))
        .drop("_groups", "_salt")
    )
    before = (
        Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = pieces.groupBy("length", "_group").count()
    sizes = sizes.select(
        "length", "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("length", "_group").orderBy(*order)
    ranked = (
        pieces.withColumn("_in", F.row_number().over(inside) - 1)
        .join(sizes, ["length", "_group"])
        .select(*order, "length", (F.col("_before") + F.col("_in")).cast("long").alias("_rank"))
    )

    def place(batches):
        plan = table.value
        # (length, rank) as one number: fewer than 2**48 pieces of one length
        keys = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            row = plan[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            nth = rank - row[:, 1]
            sequence = row[:, 2] + nth // row[:, 3]
            offset = row[:, 4] + nth % row[:, 3] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long",
    )
