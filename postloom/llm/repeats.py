"""Exact repeats of long word runs across documents, found by seed and extend.

Seeds are winnowed anchors: of the ``SPAN - SEED + 1`` seeds (runs of ``SEED`` words) in each
window of ``SPAN`` words, the one with the smallest hash, the rightmost of equal ones. Equal
windows pick equal anchors, so a repeat of ``SPAN`` words always shares one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.frames import FILTER_BITS, key_filter, store, with_hit
from postloom.llm.words import (
    gram_hashes,
    hash_longs,
    mix,
    ragged,
    range_hash,
    range_sums,
    slices,
    split_words,
    text_bytes,
    word_hashes,
)

SPAN = 50
SEED = 25
CHOICE = SPAN - SEED + 1


class Runs(NamedTuple):
    """Neighbouring windows of one text that pick the same anchor."""

    text: np.ndarray  # which text
    first: np.ndarray  # first window's first word, counted in the text
    last: np.ndarray  # last window's first word
    anchor: np.ndarray  # hash of the anchor's words
    whole: np.ndarray  # hash of all words of the run's windows and of where the anchor is


def anchor_runs(hashes: np.ndarray, docs: np.ndarray) -> Runs:
    """Runs of all texts; ``docs`` has the words before each text."""
    n = len(hashes)
    empty = np.empty(0, np.int64)
    if n < SPAN:
        return Runs(empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    seeds = gram_hashes(hashes, SEED)
    value, place = seeds, np.arange(len(seeds))
    width = 1
    while width < CHOICE:
        step = min(width, CHOICE - width)
        a, b = value[:-step], value[step:]
        right = b <= a
        value, place = np.where(right, b, a), np.where(right, place[step:], place[:-step])
        width += step
    # windows inside one text
    counts = np.maximum(np.diff(docs) - SPAN + 1, 0)
    window = ragged(docs[:-1], counts)
    text = np.repeat(np.arange(len(counts)), counts)
    at = place[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    if not len(begin):
        return Runs(empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    end = np.concatenate([begin[1:], [len(window)]]) - 1
    first, last, anchor = window[begin], window[end], at[begin]
    sums, back = range_sums(hashes)
    whole = range_hash(sums, back, first, last + SPAN)
    with np.errstate(over="ignore"):
        shape = ((anchor - first) * 64 + last - first).astype(np.uint64)
        whole = mix(whole + shape * np.uint64(0x9E3779B97F4A7C15))
    text = text[begin]
    return Runs(text, first - docs[text], last - docs[text], seeds[anchor], whole)


# ---- the job ---------------------------------------------------------------------------

RUN = "doc_id long, text_key long, first int, last int, anchor long, whole long"


def _runs(docs: DataFrame) -> DataFrame:
    def find(batches):
        for batch in batches:
            for part in slices(batch):
                words = split_words(*text_bytes(part.column("text")))
                r = anchor_runs(word_hashes(words), words.docs)
                rows = pa.array(r.text)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(rows),
                        part.column("text_key").take(rows),
                        pa.array(r.first.astype(np.int32)),
                        pa.array(r.last.astype(np.int32)),
                        pa.array(r.anchor.view(np.int64)),
                        pa.array(r.whole.view(np.int64)),
                    ],
                    names=["doc_id", "text_key", "first", "last", "anchor", "whole"],
                )

    return docs.filter("doc_id is not null").mapInArrow(find, RUN)


def _windows(docs: DataFrame, open_runs: DataFrame) -> DataFrame:
    """Windows of the runs in ``open_runs`` (anchor, whole, doc_id), one row each."""
    spark = docs.sparkSession
    keys = key_filter(open_runs.select(F.xxhash64("anchor", "whole", "doc_id").alias("k")), "k")
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in keys.collect():  # at most 2**18 rows
        bits[row["_row"]] = row["_bits"]
    shared = spark.sparkContext.broadcast(bits.view(np.uint64))

    def find(batches):
        for batch in batches:
            for part in slices(batch):
                words = split_words(*text_bytes(part.column("text")))
                hashes = word_hashes(words)
                r = anchor_runs(hashes, words.docs)
                doc_id = part.column("doc_id").to_numpy()[r.text]
                key = hash_longs(r.anchor, r.whole, doc_id.view(np.uint64))
                place = hash_longs(key) >> np.uint64(64 - FILTER_BITS)
                hit = (shared.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
                k = np.flatnonzero(hit)
                counts = r.last[k] - r.first[k] + 1
                row = np.repeat(k, counts)
                first = ragged(r.first[k], counts)
                at = first + words.docs[r.text[row]]
                sums, back = range_sums(hashes)
                rows = pa.array(r.text[row])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(rows),
                        part.column("text_key").take(rows),
                        pa.array(first.astype(np.int32)),
                        pa.array(r.anchor[row].view(np.int64)),
                        pa.array(range_hash(sums, back, at, at + SPAN).view(np.int64)),
                    ],
                    names=["doc_id", "text_key", "first", "anchor", "window"],
                )

    # only documents that hold such a run, by a filter without a shuffle
    ids = key_filter(open_runs, "doc_id")
    some = with_hit(docs.filter("doc_id is not null"), "doc_id", ids, "_open").filter("_open")
    return some.select("doc_id", "text", "text_key").mapInArrow(
        find, "doc_id long, text_key long, first int, anchor long, window long"
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans): the runs of windows, [first, last] by their first word, whose
    words also start in a document with a smaller doc_id. ``docs``: doc_id, text, text_key.

    * Runs of windows around one anchor, joined on the anchor. Anchors found once are done.
    * A run extended both ways to all its windows, equal word by word (by hash) to one in a
      smaller document, is a repeat as a whole.
    * The first document of each such class is left. Where one anchor has several classes,
      their windows are compared one by one; where it has one, nothing is left to find.

    Classes and windows are counted by map-side aggregates, so an anchor that a third of all
    documents share arrives as a few rows; nothing gathers an anchor's occurrences.
    """
    runs = store(_runs(docs), "runs")
    anchors = runs.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min("whole") < F.max("whole")).alias("open"),
    )
    anchors = store(anchors.filter("n > 1").select("anchor", "open"), "anchors")
    again = with_hit(runs, "anchor", key_filter(anchors, "anchor"), "_again").filter("_again")
    again = again.drop("_again")
    classes = again.groupBy("anchor", "whole").agg(
        F.min("doc_id").alias("doc"), F.max("doc_id").alias("other")
    )
    classes = store(classes, "classes")
    repeated = classes.filter("doc < other").select("anchor", "whole", "doc")
    copied = (
        again.join(repeated, ["anchor", "whole"])
        .filter("doc_id > doc")
        .select("doc_id", "text_key", "first", "last")
    )
    left = classes.join(anchors.filter("open"), "anchor")
    left = store(left.select("anchor", "whole", F.col("doc").alias("doc_id")), "open-runs")
    windows = store(_windows(docs, left), "windows")
    least = windows.groupBy("anchor", "window").agg(
        F.min("doc_id").alias("doc"), F.max("doc_id").alias("other")
    )
    least = least.filter("doc < other").select("anchor", "window", "doc")
    single = (
        windows.join(least, ["anchor", "window"])
        .filter("doc_id > doc")
        .select("doc_id", "text_key", "first", F.col("first").alias("last"))
    )
    spans = copied.union(single).groupBy("doc_id", "text_key")
    return spans.agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Removes each word that a window of ``SPAN`` words covers whose words also start in a
    document with a smaller doc_id; windows are judged on the input.

    ``docs`` needs doc_id and text; other columns are ignored. Returns doc_id, n_words,
    n_removed, removed (maximal repeats as word ranges [first, stop)) and kept_text, the kept
    words joined by one space. NULL and empty texts have no words. Rows of one doc_id don't
    remove from each other. A NULL doc_id removes and loses nothing. Of equal texts the one
    with the smallest doc_id stays whole. An empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("text_key", F.xxhash64("text"))
    spans = store(repeated_spans(rows), "spans")
    rows = with_hit(rows, "text_key", key_filter(spans, "text_key"), "_hit")
    some = rows.filter("_hit").drop("_hit").join(spans, ["doc_id", "text_key"], "left")
    none = rows.filter("not _hit").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    columns = ["doc_id", "text", "spans"]
    schema = (
        "doc_id long, n_words long, n_removed long, "
        "removed array<struct<first:int,stop:int>>, kept_text string"
    )
    return some.select(columns).union(none.select(columns)).mapInArrow(_cut, schema)


def _cut(batches):
    for batch in batches:
        for part in slices(batch):
            words = split_words(*text_bytes(part.column("text")))
            out = []
            for k, spans in enumerate(part.column("spans").to_pylist()):
                a, b = int(words.docs[k]), int(words.docs[k + 1])
                n = b - a
                if not spans:
                    text = words.data[words.start[a] : words.end[b - 1]].tobytes() if n else b""
                    out.append((n, 0, [], text.decode()))
                    continue
                step = np.zeros(n + 1, np.int64)
                first = np.array([s["first"] for s in spans])
                np.add.at(step, first, 1)
                np.add.at(step, np.array([s["last"] for s in spans]) + SPAN, -1)
                gone = np.cumsum(step)[:n] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                removed = [
                    {"first": int(x), "stop": int(y)} for x, y in zip(edges[::2], edges[1::2])
                ]
                kept = a + np.flatnonzero(~gone)
                data = words.data
                sizes = words.end[kept] + 1 - words.start[kept]
                text = data[ragged(words.start[kept], sizes)][:-1].tobytes()
                out.append((n, int(gone.sum()), removed, text.decode()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.int64()),
                    pa.array(
                        [o[2] for o in out],
                        pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())])),
                    ),
                    pa.array([o[3] for o in out], pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "removed", "kept_text"],
            )
