"""Benchmark decontamination by greedy string tiling.

Documents and items are runs of lower-case words of letters and digits. Shared seeds of
``LEAST`` words join documents to items. For each pair, the longest common runs of words not
yet marked are marked, again and again, with a running Karp-Rabin hash, down to ``LEAST``
words; so passages count in whatever order they come. A document is contaminated by an item
when its tiles cover at least ``COVERAGE`` of the item's words. Items of fewer words are one
seed, and one tile, as a whole. Letters of scripts without spaces are a word each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.frames import key_filter, store, text_column, with_hit
from postloom.llm.words import (
    gram_hashes,
    ragged,
    range_hash,
    range_sums,
    slices,
    split_words,
    text_bytes,
    word_hashes,
)

LEAST = 5
COVERAGE = 0.8
# Benchmark text per pass over the documents; the items of one pass are copied to every task.
BLOCK_BYTES = 32 * 1024 * 1024
LOOK_BITS = 22


# Scripts without spaces between words, and the first bytes of their letters in UTF-8.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
UNSPACED_BYTES = np.zeros(256, dtype=bool)
UNSPACED_BYTES[[0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0]] = True


def plain_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the words before each text."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    texts = pc.replace_substring_regex(texts, r"[^\pL\pN]+", " ")
    if UNSPACED_BYTES[text_bytes(texts)[0]].any():
        texts = pc.replace_substring_regex(texts, UNSPACED, r" \1 ")
    words = split_words(*text_bytes(texts))
    return word_hashes(words), words.docs


# ---- tiling of one pair ----------------------------------------------------------------------


class Tile(NamedTuple):
    item: int  # first word in the item
    doc: int
    length: int


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Places where ``length`` words in a row are not marked."""
    before = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(before[length:] == before[: len(before) - length])


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[Tile]:
    """Greedy tiles of two runs of word hashes: longest first, then first in the item, then
    first in the document; none shorter than ``least`` words, none overlapping in either.
    """
    used_item, used_doc = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool)
    sums_i, back_i = range_sums(item)
    sums_d, back_d = range_sums(doc)

    def common(length: int):
        i, d = _free(used_item, length), _free(used_doc, length)
        hi = range_hash(sums_i, back_i, i, i + length)
        hd = range_hash(sums_d, back_d, d, d + length)
        hit = np.isin(hi, hd)
        return i[hit], hi[hit], d, hd

    out: list[Tile] = []
    longest = min(len(item), len(doc))
    while longest >= least:
        low, high = least - 1, longest  # a common run of low words is known to exist
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        longest = low
        for i, hi, d, hd in [common(longest)]:
            order = np.argsort(hd, kind="stable")
            ranked = hd[order]
            for a, h in zip(i.tolist(), hi):
                if used_item[a : a + longest].any():
                    continue
                first = np.searchsorted(ranked, h)
                for at in order[first : np.searchsorted(ranked, h, "right")]:
                    b = int(d[at])
                    if used_doc[b : b + longest].any():
                        continue
                    if (item[a : a + longest] == doc[b : b + longest]).all():
                        used_item[a : a + longest] = used_doc[b : b + longest] = True
                        out.append(Tile(a, b, longest))
                        break
        # whatever still has this length overlaps a tile or was hashed alike by chance
        longest -= 1
    return out


# ---- items of one pass -------------------------------------------------------------------------


class Items(NamedTuple):
    ids: list
    words: np.ndarray  # word hashes of all items
    begins: np.ndarray
    seeds: np.ndarray  # sorted distinct seed hashes
    posts: np.ndarray  # first entry of each seed, one more entry than seeds
    item: np.ndarray  # entries: the item, and the place in it
    place: np.ndarray
    look: np.ndarray  # whether any seed has these upper bits
    short: list  # for items of fewer words than a seed: (words, sorted hashes, items)


def index_items(ids: list, texts: pa.Array) -> Items:
    words, begins = plain_hashes(texts)
    counts = np.maximum(np.diff(begins) - LEAST + 1, 0)
    at = ragged(begins[:-1], counts)
    item = np.repeat(np.arange(len(counts)), counts)
    hashes = gram_hashes(words, LEAST)[at] if len(at) else np.empty(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    seeds, first = np.unique(hashes[order], return_index=True)
    look = np.zeros(1 << LOOK_BITS, dtype=bool)
    look[seeds >> np.uint64(64 - LOOK_BITS)] = True
    short, sizes = [], np.diff(begins)
    for n in range(1, LEAST):
        whole = np.flatnonzero(sizes == n)
        if len(whole):
            found = gram_hashes(words, n)[begins[whole]]
            ranked = np.argsort(found, kind="stable")
            short.append((n, found[ranked], whole[ranked]))
    return Items(
        ids, words, begins, seeds, np.concatenate([first, [len(order)]]),
        item[order], (at - begins[item])[order], look, short,
    )


def match_short(words: np.ndarray, begins: np.ndarray, items: Items) -> list[tuple[int, int, list[Tile]]]:
    """(text, item, tile) for items of fewer than ``LEAST`` words that stand whole in a text."""
    out = []
    for n, hashes, whole in items.short:
        grams = gram_hashes(words, n)
        place = np.flatnonzero(np.isin(grams, hashes))
        text = np.searchsorted(begins, place, "right") - 1
        inside = place + n <= begins[text + 1]
        place, text = place[inside], text[inside]
        # the first place of each hash in each text
        order = np.lexsort((place, grams[place], text))
        place, text = place[order], text[order]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (grams[place[1:]] != grams[place[:-1]])
        for p, t in zip(place[new].tolist(), text[new].tolist()):
            a, b = (int(np.searchsorted(hashes, grams[p], side)) for side in ("left", "right"))
            for k in whole[a:b].tolist():
                if (items.words[items.begins[k] : items.begins[k] + n] == words[p : p + n]).all():
                    out.append((t, k, [Tile(0, int(p - begins[t]), n)]))
    return out


def match(texts: pa.Array, items: Items, coverage: float) -> list[tuple[int, int, list[Tile]]]:
    """(text, item, tiles) of the pairs with at least ``coverage``."""
    words, begins = plain_hashes(texts)
    out = match_short(words, begins, items)
    counts = np.maximum(np.diff(begins) - LEAST + 1, 0)
    grams = gram_hashes(words, LEAST)
    if not len(grams) or not len(items.seeds):
        return out
    maybe = np.flatnonzero(items.look[grams >> np.uint64(64 - LOOK_BITS)])
    text = np.searchsorted(begins, maybe, "right") - 1
    inside = maybe - begins[text] < counts[text]
    maybe, text = maybe[inside], text[inside]
    seed = np.minimum(np.searchsorted(items.seeds, grams[maybe]), len(items.seeds) - 1)
    real = items.seeds[seed] == grams[maybe]
    maybe, text, seed = maybe[real], text[real], seed[real]
    cuts = np.flatnonzero(np.diff(text)) + 1
    for rows in np.split(np.arange(len(text)), cuts) if len(text) else ():
        t = int(text[rows[0]])
        found = np.unique(seed[rows])
        entry = ragged(items.posts[found], items.posts[found + 1] - items.posts[found])
        order = np.lexsort((items.place[entry], items.item[entry]))
        item, place = items.item[entry][order], items.place[entry][order]
        new = np.concatenate([[True], item[1:] != item[:-1]])
        gap = np.minimum(np.diff(place, append=place[-1] + LEAST), LEAST)
        gap[np.concatenate([new[1:], [True]])] = LEAST
        first = np.flatnonzero(new)
        most = np.add.reduceat(gap, first)  # words of the item that any tile could cover
        size = np.diff(items.begins)[item[first]]
        good = item[first][most >= coverage * size]
        if not len(good):
            continue
        # words in shared seeds, and one word after each run that matches nothing
        covered = np.unique((maybe[rows][:, None] + np.arange(LEAST)).ravel())
        edge = np.setdiff1d(covered + 1, covered)
        kept = np.union1d(covered, edge)
        doc = np.where(np.isin(kept, edge), np.uint64(0), words[np.minimum(kept, len(words) - 1)])
        for k in good.tolist():
            own = items.words[items.begins[k] : items.begins[k + 1]]
            found_tiles = tiles(own, doc)
            if sum(x.length for x in found_tiles) >= coverage * len(own):
                place_in = kept - begins[t]
                out.append(
                    (t, k, [Tile(x.item, int(place_in[x.doc]), x.length) for x in found_tiles])
                )
    return out


# ---- tables ------------------------------------------------------------------------------------


def _blocks(benchmark: DataFrame) -> tuple[int, Iterator[Items]]:
    """Number of passes, and the items of each: about BLOCK_BYTES of text, one item at least."""
    rows = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), text_column(benchmark)
    ).filter("item_id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = size // BLOCK_BYTES + 1

    def block(k: int) -> Items:
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        table = part.sort("item_id", "text").toArrow().combine_chunks()
        texts = table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())
        return index_items(table["item_id"].to_pylist(), texts)

    return count, map(block, range(count))


FOUND = (
    "doc_id long, item_id long, n_words long, covered long, coverage double, "
    "tiles array<struct<item_start:int,doc_start:long,length:int>>"
)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Documents that hold benchmark items: doc_id, item_id, the item's n_words, how many of
    them the tiles cover, the covered share, and the tiles.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored.
    NULL texts are empty. Items of fewer than ``LEAST`` words match where they stand whole, items
    without words nothing; NULL item_ids are left out. Repeated rows are matched each, a NULL doc_id stays NULL. Whole texts of any
    length are searched. Without documents or items there are no rows.

    One pass over the documents for each BLOCK_BYTES of benchmark text, without a shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs))
    found = None
    for items in _blocks(benchmark)[1]:
        shared = docs.sparkSession.sparkContext.broadcast(tuple(items))  # plain arrays, no class

        def find(batches, shared=shared):
            items = Items(*shared.value)
            sizes = np.diff(items.begins)
            for batch in batches:
                for part in slices(batch):
                    pairs = match(part.column("text"), items, coverage)
                    covered = [sum(x.length for x in t) for _, _, t in pairs]
                    lengths = [int(sizes[k]) for _, k, _ in pairs]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array([t for t, _, _ in pairs], pa.int64())),
                            pa.array([items.ids[k] for _, k, _ in pairs], pa.int64()),
                            pa.array(lengths, pa.int64()),
                            pa.array(covered, pa.int64()),
                            pa.array([c / n for c, n in zip(covered, lengths)], pa.float64()),
                            pa.array(
                                [
                                    [
                                        {"item_start": x.item, "doc_start": x.doc, "length": x.length}
                                        for x in t
                                    ]
                                    for _, _, t in pairs
                                ],
                                pa.list_(
                                    pa.struct(
                                        [
                                            ("item_start", pa.int32()),
                                            ("doc_start", pa.int64()),
                                            ("length", pa.int32()),
                                        ]
                                    )
                                ),
                            ),
                        ],
                        names=["doc_id", "item_id", "n_words", "covered", "coverage", "tiles"],
                    )

        part = rows.mapInArrow(find, FOUND)
        if found is not None:
            part = store(part, "matches")
        found = part if found is None else found.union(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without contaminated documents, columns as they are.

    One block of items is looked for in the pass that keeps the documents. With several, every
    block has a pass of its own that stores the keys of contaminated texts, and one last pass
    keeps the others; texts are not shuffled for it, but for the few whose key is among them.
    """
    count, blocks = _blocks(benchmark)
    spark = docs.sparkSession
    if count == 1:
        shared = spark.sparkContext.broadcast(tuple(next(blocks)))  # plain arrays, no class

        def keep(batches):
            items = Items(*shared.value)
            for batch in batches:
                for part in slices(batch):
                    good = np.ones(part.num_rows, dtype=bool)
                    good[[t for t, _, _ in match(part.column("text"), items, coverage)]] = False
                    yield part.filter(pa.array(good))

        return docs.mapInArrow(keep, docs.schema)
    text = text_column(docs)
    keys = {"__pl_a": F.xxhash64(text), "__pl_b": F.xxhash64(F.lit(1), text)}
    rows = docs.select(text).withColumns({"a": keys["__pl_a"], "b": keys["__pl_b"]})
    bad = None
    for items in blocks:
        shared = spark.sparkContext.broadcast(tuple(items))

        def find(batches, shared=shared):
            items = Items(*shared.value)
            for batch in batches:
                for part in slices(batch):
                    found = sorted({t for t, _, _ in match(part.column("text"), items, coverage)})
                    yield part.select(["a", "b"]).take(pa.array(found, pa.int64()))

        part = store(rows.mapInArrow(find, "a long, b long").distinct(), "contaminated")
        bad = part if bad is None else bad.union(part)
        shared.unpersist()
    bad = bad.select(F.col("a").alias("__pl_a"), F.col("b").alias("__pl_b")).distinct()
    marked = with_hit(docs.withColumns(keys), "__pl_a", key_filter(bad, "__pl_a"), "__pl_hit")
    sure = marked.filter("not __pl_hit").select(docs.columns)
    maybe = marked.filter("__pl_hit").join(bad, ["__pl_a", "__pl_b"], "left_anti")
    return sure.unionByName(maybe.select(docs.columns))
