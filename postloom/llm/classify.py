"""Sampling, learning and scoring shared by the two classifiers on documents.

Learning takes bags of at most ``per_class`` texts for each class, drawn by a hash of doc_id
among the rows to learn from, to one task; of several texts of a doc_id, one by its hash; the driver gets its weights. Everything else, the
shares of the classes and the scores, covers all rows.
"""

from __future__ import annotations

from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.frames import text_column
from postloom.llm.subwords import bags, learn, log_odds, scores, text_bags
from postloom.llm.words import give_back, slices


# Text that is cut into features at once; these take some forty times its bytes.
BAG_BYTES = 1024 * 1024
# Texts of each class in each of the folds that place the cut, at least.
FOLD_LEAST = 5
# Share of the texts called class 1 that are, at the best cut, if any cut has it.
LEAST_PRECISION = 0.5


class Settings(NamedTuple):
    label: str
    lower: bool  # whether features ignore case
    pairs: bool  # whether equal neighbours are a feature
    per_class: int = 1500
    steps: int = 1000
    cut: float | None = None  # score at which the best cut on texts not learned from is to lie


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id's decimal digits, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _one_label(labels: DataFrame, name: str) -> DataFrame:
    """A label per doc_id: the larger of several; rows without id or label don't count."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("_label"))
    rows = rows.filter("doc_id is not null and _label in (0, 1)")
    return rows.groupBy("doc_id").agg(F.max("_label").cast("int").alias("_label"))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, settings: Settings) -> np.ndarray:
    """Weights of a model of the labelled rows for which ``learn_from`` (on doc_id) holds."""
    known = _one_label(labels, settings.label).filter(learn_from)
    known = known.select("doc_id", "_label", F.xxhash64("doc_id").alias("_draw"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    drawn = [
        known.filter(F.col("_label") == c).orderBy("_draw", "doc_id").limit(settings.per_class)
        for c in (0, 1)
    ]
    sample = drawn[0].union(drawn[1]).select("doc_id", "_label")
    # at most 2 * per_class rows of 12 bytes; documents are not shuffled to find them
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs)).join(
        F.broadcast(sample), "doc_id"
    )
    # one text per doc_id, however often it repeats; each task passes on one at most
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text")
    rows = rows.groupBy("doc_id", "_label").agg(first)

    def bag(batches):
        for batch in batches:
            for part in slices(batch, size=BAG_BYTES):
                found = text_bags(bags(part.column("text"), settings.lower, settings.pairs))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("_label"),
                        pa.array([f.tolist() for f, _ in found], pa.list_(pa.int32())),
                        pa.array([n.tolist() for _, n in found], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "_label", "features", "times"],
                )

    schema = "doc_id long, _label int, features array<int>, times array<int>"
    bagged = rows.select("doc_id", "text", "_label").mapInArrow(bag, schema)

    def train(batches):
        table = pa.Table.from_batches(batches)
        batches.clear()
        ids = table["doc_id"].to_pylist()
        bag_list = list(zip(_arrays(table, "features"), _arrays(table, "times")))
        # the same order however the rows arrive
        order = sorted(range(len(ids)), key=lambda k: (ids[k], len(bag_list[k][0])))
        labels = np.array(table["_label"].to_pylist(), np.int64)[order]
        texts = [bag_list[k] for k in order]
        del table, bag_list
        give_back()
        shift = 0.0
        if settings.cut is not None:
            shift = log(settings.cut / (1 - settings.cut)) - best_cut(texts, labels, share, settings)
        weights = learn(texts, labels, share, steps=settings.steps).weights()
        weights[-1] += shift
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.astype("<f8").tobytes()], pa.binary())], names=["weights"]
        )

    def train_some(batches):
        some = [b for b in batches if b.num_rows]
        if some:
            yield from train(some)
            give_back()

    found = bagged.repartition(1).mapInArrow(train_some, "weights binary").collect()
    if not found:
        return learn([], np.empty(0, np.int64), share).weights()
    return np.frombuffer(found[0]["weights"], "<f8")


def best_cut(texts: list, labels: np.ndarray, share: float, settings: Settings) -> float:
    """Log odds from which calling a text class 1 is best: by the F measure, among the cuts at
    which ``LEAST_PRECISION`` of the called texts are of class 1.

    Every third of the texts is scored by a model of the other two, so no text is scored by a
    model that has seen it; classes weigh as in all labels. Zero with too few texts of a class.
    """
    ones = int(labels.sum())
    if min(ones, len(labels) - ones) < 3 * FOLD_LEAST:
        return 0.0
    odds, fold = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for c in (0, 1):
        own = np.flatnonzero(labels == c)
        fold[own] = np.arange(len(own)) % 3
    for k in range(3):
        rest = np.flatnonzero(fold != k)
        model = learn([texts[i] for i in rest], labels[rest], share, steps=settings.steps).weights()
        own = np.flatnonzero(fold == k)
        odds[own] = [log_odds(texts[i], model) for i in own]
    weight = np.where(labels == 1, share / ones, (1 - share) / (len(labels) - ones))
    order = np.argsort(-odds, kind="stable")
    hits, called = np.cumsum((weight * labels)[order]), np.cumsum(weight[order])
    # few labels rank the texts badly; then fewer are called, and most of them rightly
    sound = hits >= LEAST_PRECISION * called
    measure = np.where(sound if sound.any() else True, 2 * hits / (called + share), 0)
    # the middle of all cuts that do nearly as well, each between a text and the next one
    good = np.flatnonzero(measure >= 0.99 * measure.max())
    edge = np.append(odds[order], odds.min())
    return float(np.mean((edge[good] + edge[good + 1]) / 2))


def _arrays(table: pa.Table, name: str) -> list[np.ndarray]:
    return [
        values.values.to_numpy(zero_copy_only=False).astype(np.int32)
        for chunk in table[name].chunks
        for values in chunk
    ]


def with_score(docs: DataFrame, weights: np.ndarray, settings: Settings, name: str = "score") -> DataFrame:
    """``docs`` with all its columns and the probability of label 1 for each whole text.

    One pass without a shuffle; NULL text scores as empty text. A column that is called
    ``name`` already is replaced.
    """
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float64))
    rows = docs.withColumn("__pl_text", F.coalesce(F.col("text").cast("string"), F.lit("")))

    def score(batches):
        for batch in batches:
            for part in slices(batch, "__pl_text", BAG_BYTES):
                found = scores(
                    bags(part.column("__pl_text"), settings.lower, settings.pairs), shared.value
                )
                columns = [part.column(k) for k in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(found, pa.float64())],
                    names=[*part.schema.names[:-1], name],
                )
        give_back()

    schema = docs.schema.add(name, "double")
    return rows.mapInArrow(score, schema)
