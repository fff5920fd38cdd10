"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Words become rows of padded code-point matrices, once aligned left and once right. Pairs of
blocks of such rows are compared as a whole: the equal columns from the left give the common
prefix, those from the right the common suffix, and two different words whose lengths differ by
at most one are a single edit apart exactly where both together reach the longer length minus one.

Only words that can be that close meet. An edit touches one position of the longer word, so
with its ``M`` positions cut into segments, two such words agree before and after one segment;
each word is dealt once for every segment, as the longer and as the shorter word of a pair.
Segments have two positions, so what shares a key differs in two letters and one length: a
group has at most 90 * 91 words (the alphabet has 90 letters), whatever the vocabulary. Words
of over ``2 * SEGMENTS`` letters have wider segments; their groups are split into blocks that
meet pairwise.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.frames import store, text_column
from postloom.llm.words import LOWER, give_back, slices, split_words, text_bytes

LEAST_LENGTH = 5
LEAST_COUNT = 3
DAMAGED = 97  # one run of so many loses a letter
SEGMENTS = 128
BLOCK = 4096  # words of a split group that meet at once
TILE = 1 << 17  # pairs of rows compared at once
ROUNDS = 12  # counts double along forms, so chains have under 64 words

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
LEAD = 0xC3  # first byte of U+00C0 to U+00FF in UTF-8


# ---- words ---------------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def crc32_of(data: np.ndarray, start: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of many byte ranges, each carried on from the CRC-32 ``before`` it."""
    crc = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-length, kind="stable")
    at, left, state = start[order], length[order], crc[order]
    for k in range(min(int(left[0]), 64) if len(left) else 0):
        n = int(np.searchsorted(-left, -k))  # those with more than k bytes come first
        state[:n] = CRC[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> 8)
    crc[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > 64):
        a, b = int(start[i]) + 64, int(start[i] + length[i])
        crc[i] = zlib.crc32(data[a:b].tobytes(), int(crc[i]))
    return crc


def _counted(ids: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of some texts, after the deletions, and how often each occurs."""
    data, offsets = text_bytes(texts)
    lead = data == LEAD
    # a lead byte of one text is never followed by another text's first byte
    kept = LETTER[data] | lead
    kept[1:] |= lead[:-1]
    runs = split_words(np.where(kept, LOWER[data], np.uint8(0x20)), offsets)
    length = runs.end - runs.start
    heads = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()]
    before = np.repeat(np.array(heads, np.uint32), np.diff(runs.docs))
    crc = crc32_of(runs.data, runs.start, length, before)
    cut = crc % DAMAGED == 0
    solid = runs.data[: int(runs.end[-1]) + 1 if len(length) else 0]
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    body = np.ones(len(solid), dtype=bool)
    body[runs.end] = False
    flat = np.ascontiguousarray(solid[body])
    whole = pa.Array.from_buffers(
        pa.large_string(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(flat)]
    )
    shorter = []
    for word, h in zip(whole.filter(pa.array(cut)).to_pylist(), crc[cut].tolist()):
        place = h % len(word)
        shorter.append(word[:place] + word[place + 1 :])
    words = pa.chunked_array([whole.filter(pa.array(~cut)), pa.array(shorter, pa.large_string())])
    found = pc.value_counts(words)
    values, n = found.field("values"), found.field("counts")
    long = pc.greater_equal(pc.utf8_length(values), LEAST_LENGTH)
    return values.filter(long).cast(pa.string()), n.filter(long)


def count_words(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words that occur ``least`` times or more; counts are summed in the tasks."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words, n = _counted(part.column("doc_id"), part.column("text"))
                yield pa.RecordBatch.from_arrays([words, n], names=["word", "n"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs))
    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least)


# ---- pairs ---------------------------------------------------------------------------------


def _keyed(words: DataFrame) -> DataFrame:
    """(key, size, segment, word, n): a row for each segment of each role of a word.

    ``size`` is the length of the longer word of the pairs meant: the word's own or one more.
    """
    size, at = F.col("size"), F.col("segment")
    width = _width(size)
    after = F.greatest(size - (at + 1) * width, F.lit(0))
    word, length = F.col("word"), F.length("word")
    return (
        words.select("word", "n", F.explode(F.array(length, length + 1)).alias("size"))
        .withColumn("segment", F.explode(F.sequence(F.lit(0), F.ceil(size / width).cast("int") - 1)))
        .select(
            F.xxhash64(
                "size", "segment", word.substr(F.lit(1), at * width), word.substr(length - after + 1, after)
            ).alias("key"),
            "size", "segment", "word", "n",
        )
    )


def _width(size: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(size / SEGMENTS)).cast("int")


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points padded on the right, padded on the left, and lengths."""
    left = np.array(words, dtype=np.str_)
    left = left.view(np.uint32).reshape(len(words), -1)
    length = (left != 0).sum(axis=1)
    width = left.shape[1]
    place = np.arange(width) - (width - length)[:, None]
    right = np.where(place >= 0, np.take_along_axis(left, np.maximum(place, 0), axis=1), 0)
    return left, right, length


def common(left: np.ndarray, right: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal columns from the left and from the right of rows ``p`` and ``q``."""
    width = left.shape[1]
    unlike = left[p] != left[q]
    prefix = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
    unlike = (right[p] != right[q])[:, ::-1]
    return prefix, np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)


def block_pairs(first: np.ndarray, past: np.ndarray):
    """Rows ``i`` with each of ``first[i]`` to ``past[i] - 1``, about TILE pairs at a time."""
    counts = np.maximum(past - first, 0)
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + TILE, "right")))
        n = counts[at:to]
        if n.sum():
            p = np.repeat(np.arange(at, to), n)
            yield p, np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
        at = to


def single_edits(table: pa.Table) -> pa.Table:
    """Rows sorted by group to (word, near, near_n), both ways, for pairs one edit apart.

    A pair counts in the group of the segment with its first difference, so it comes once.
    """
    out = []
    sizes = table["size"].to_numpy()
    for size in np.unique(sizes):
        part = table.filter(pa.array(sizes == size))
        key, segment, side = (part[c].to_numpy() for c in ("key", "segment", "side"))
        a, b = part["a"].to_numpy(), part["b"].to_numpy()
        words = part["word"].combine_chunks()
        left, right, length = matrices(words.to_pylist())
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        past = np.append(begin[1:], len(key))[group]
        width = max(2, -(-int(size) // SEGMENTS))
        for p, q in block_pairs(np.arange(len(key)) + 1, past):
            # two blocks meet across, one block within itself
            meet = (a[p] == b[p]) | (side[p] != side[q])
            meet &= (segment[p] == segment[q]) & (np.maximum(length[p], length[q]) == size)
            p, q = p[meet], q[meet]
            prefix, suffix = common(left, right, p, q)
            prefix = np.minimum(prefix, np.minimum(length[p], length[q]))
            near = (prefix + suffix >= size - 1) & (prefix // width == segment[p])
            # equal words in one group would be repeats of a row
            near &= (length[p] != length[q]) | (prefix < length[p])
            p, q = p[near], q[near]
            i, j = pa.array(np.concatenate([p, q])), pa.array(np.concatenate([q, p]))
            n = part["n"].combine_chunks().take(j)
            out.append(pa.table({"word": words.take(i), "near": words.take(j), "near_n": n}))
    empty = pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string()), "near_n": pa.array([], pa.int64())})
    return pa.concat_tables([empty, *out])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all ordered pairs of words one edit apart."""
    keyed = _keyed(words)
    wide = keyed.filter(F.col("size") > 2 * SEGMENTS).groupBy("key").count()
    wide = wide.filter(F.col("count") > BLOCK)
    wide = wide.select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # groups of short words are bounded; only long words' groups may be split
    short = keyed.filter(F.col("size") <= 2 * SEGMENTS).withColumns(
        {"side": F.lit(0), "a": F.lit(0), "b": F.lit(0)}
    )
    long = (
        keyed.filter(F.col("size") > 2 * SEGMENTS)
        .join(wide, "key", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("side", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
        .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"a": F.least("side", "to"), "b": F.greatest("side", "to")})
        .drop("blocks", "to")
    )

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            key = held["key"].to_numpy()
            last = int(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1])
            # blocks of a split group follow each other and are dealt with one by one
            if last == 0 and held["size"][0].as_py() > 2 * SEGMENTS:
                a, b = held["a"].to_numpy(), held["b"].to_numpy()
                new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                last = int(np.flatnonzero(np.concatenate([[True], new]))[-1])
            if last:
                yield from single_edits(held.slice(0, last)).to_batches()
                held = held.slice(last).combine_chunks()
        if held is not None:
            yield from single_edits(held).to_batches()

    order = ["key", "a", "b"]
    dealt = short.unionByName(long).repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "word string, near string, near_n long")


def follow(steps: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of each chain, by doubling its reach."""
    now = store(steps.select("word", F.col("form").alias("root")), "forms")
    for _ in range(ROUNDS):
        beyond = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if now.join(beyond, "root", "left_semi").isEmpty():
            return now
        further = now.join(beyond, "root", "left")
        now = store(further.select("word", F.coalesce("_next", "root").alias("root")), "forms")
    raise RuntimeError(f"chains of forms are longer than 2**{ROUNDS}")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` (doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; a run whose
    CRC-32 with its doc_id is a multiple of 97 first loses one letter. Those of 5 letters or
    more that occur 3 times or more are compared: a word's form is the most frequent word one
    edit away (of equal counts the first in code-point order), if it is at least twice as
    frequent, else NULL; its root is the end of that chain.

    NULL and empty texts hold no words. A NULL doc_id counts as empty text. Repeated rows count
    as often as they occur, other columns are ignored, texts and words of any length are taken
    whole, and an empty table gives no rows.
    """
    words = store(count_words(docs), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), best.alias("best")
    )
    takes = -F.col("best.less") >= 2 * F.col("n")
    linked = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(takes, F.col("best.near")).alias("form"),
        F.when(takes, -F.col("best.less")).alias("form_n"),
    )
    linked = store(linked, "near-words")
    roots = follow(linked.filter("form is not null"))
    return linked.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
