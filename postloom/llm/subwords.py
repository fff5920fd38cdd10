"""Subword bags: hashed word and character n-gram features, their learner and scorer.

A text is the bag of its words' features. A word, marked ``<word>``, gives one feature for
itself and one for each run of 3 to 5 bytes; with ``pairs`` each two neighbouring words give
one for whether they are the same word. Features are hashed to a fixed number of vectors.
A text's vector is the mean over its bag, and a softmax over two classes scores it.

Learning is plain numpy on a bounded sample: stochastic gradient steps (scaled by each
weight's past gradients) on vectors and softmax jointly. As the score is linear in the mean,
scoring adds up one number per feature, ``vector . (softmax column 1 - column 0)``, which is
computed once per distinct word of a batch.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from postloom.llm.words import ragged, xxh64

BUCKET_BITS = 18
GRAMS = (3, 4, 5)
# Odd multipliers that spread n-grams over the buckets, one for each length.
SPREAD = {3: 0x9E3779B97F4A7C15, 4: 0xC2B2AE3D27D4EB4F, 5: 0x165667B19E3779F9}


class Bags(NamedTuple):
    """Features per distinct word and words per text of some texts."""

    features: np.ndarray  # of all distinct words
    begins: np.ndarray  # of each distinct word's features, one more entry than words
    words: np.ndarray  # distinct word of each word of the texts
    texts: np.ndarray  # words before each text, one more entry than texts
    same: np.ndarray  # texts' neighbouring words that are equal, or empty without pairs


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


# The two pair features stand behind the buckets.
SAME, OTHER = 1 << BUCKET_BITS, (1 << BUCKET_BITS) + 1
FEATURES = (1 << BUCKET_BITS) + 2
# Neutral features (vector zero) in every text's mean, so a few words prove little.
NEUTRAL = 300
# Texts of the sample that a feature must be in to count, however large the sample.
LEAST = 3
# Added to the past squared gradients of a vector: those of rare features, whose gradients
# stay small, move little. Chosen on a fold of the rows to learn from.
SLACK = 1e-7


def bags(texts: pa.Array, lower: bool, pairs: bool) -> Bags:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    split = pc.ascii_split_whitespace(texts).cast(pa.large_list(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    # white space at either end of a text leaves empty words
    blank = pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    if blank.any():
        solid = ~blank[words]
        before = np.concatenate([[0], np.cumsum(solid)])[before]
        words = words[solid]
    left, right, none = (pa.scalar(x, pa.large_string()) for x in ("<", ">", ""))
    distinct = coded.dictionary.cast(pa.large_string())
    marked = pc.binary_join_element_wise(left, distinct, right, none)
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[: len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], np.uint8) if len(marked) else np.empty(0, np.uint8)
    data = np.concatenate([data[: offsets[-1]], np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    sizes = np.diff(offsets)
    parts, rows = [_buckets(xxh64(data, offsets[:-1], sizes))], [np.arange(len(sizes))]
    with np.errstate(over="ignore"):
        for n in GRAMS:
            each = np.maximum(sizes - n + 1, 0)
            lane = lanes[ragged(offsets[:-1], each)] & np.uint64((1 << 8 * n) - 1)
            parts.append(_buckets(lane * np.uint64(SPREAD[n])))
            rows.append(np.repeat(np.arange(len(sizes)), each))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
    same = np.empty(0, np.int64)
    if pairs:
        equal = np.zeros(len(words) + 1, np.int64)
        inner = np.ones(len(words), dtype=bool)
        inner[before[:-1][np.diff(before) > 0]] = False  # a text's first word has no left one
        equal[1:][1:] = (words[1:] == words[:-1]) & inner[1:] if len(words) else equal[1:][1:]
        total = np.cumsum(equal)
        same = total[before[1:]] - total[before[:-1]]
    return Bags(np.concatenate(parts)[order], begins, words, before, same)


def text_bags(b: Bags) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, how often each) of every text, for learning."""
    out = []
    sizes = np.diff(b.begins)
    for k in range(len(b.texts) - 1):
        words = b.words[b.texts[k] : b.texts[k + 1]]
        found = b.features[ragged(b.begins[words], sizes[words])]
        if len(b.same):
            n = max(0, len(words) - 1)
            found = np.concatenate(
                [found, np.full(b.same[k], SAME), np.full(n - b.same[k], OTHER)]
            )
        out.append(np.unique(found, return_counts=True))
    return out


class Model(NamedTuple):
    vectors: np.ndarray  # (FEATURES, width)
    softmax: np.ndarray  # (width + 1, 2), the last row for the bias

    def weights(self) -> np.ndarray:
        """Per feature, what it adds to the log odds before averaging; then the bias."""
        ahead = self.softmax[:, 1] - self.softmax[:, 0]
        return np.concatenate([self.vectors @ ahead[:-1], ahead[-1:]])


def scores(b: Bags, weights: np.ndarray) -> np.ndarray:
    """Probability of class 1 for each text, from whole bags."""
    total = np.concatenate([[0.0], np.cumsum(weights[b.features])])
    word = total[b.begins[1:]] - total[b.begins[:-1]]
    size = np.diff(b.begins)
    sums = np.concatenate([[0.0], np.cumsum(word[b.words])])
    sums = sums[b.texts[1:]] - sums[b.texts[:-1]]
    counts = np.concatenate([[0], np.cumsum(size[b.words])])
    counts = counts[b.texts[1:]] - counts[b.texts[:-1]]
    if len(b.same):
        n = np.maximum(np.diff(b.texts) - 1, 0)
        sums = sums + b.same * weights[SAME] + (n - b.same) * weights[OTHER]
        counts = counts + n
    odds = np.clip(sums / (counts + NEUTRAL) + weights[-1], -40, 40)
    return 1 / (1 + np.exp(-odds))


def log_odds(text: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> float:
    """Log odds of class 1 for one bag, as ``scores`` has them."""
    features, times = text
    return float((weights[features] * times).sum() / (times.sum() + NEUTRAL) + weights[-1])


class _Batch:
    """The texts of one step, laid out by text and by feature."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray):
        # an empty text stands as feature 0 and is taken out again by ``some``
        bag = [texts[r] if len(texts[r][0]) else (np.zeros(1, np.int64), np.ones(1)) for r in rows]
        sizes = np.array([len(i) for i, _ in bag])
        self.rows = rows
        self.some = np.array([[len(texts[r][0]) > 0] for r in rows], np.float32)
        self.index = np.concatenate([i for i, _ in bag]).astype(np.int32)
        self.weight = np.concatenate([n / (n.sum() + NEUTRAL) for _, n in bag]).astype(np.float32)[:, None]
        self.starts = np.cumsum(sizes) - sizes
        order = np.argsort(self.index, kind="stable")
        # the narrowest whole numbers that hold the values: all batches are kept while learning
        doc = np.repeat(np.arange(len(rows), dtype=np.min_scalar_type(len(rows))), sizes)
        self.doc = doc[order]
        self.weight_sorted = (self.weight * self.some[doc])[order]
        self.seen, firsts = np.unique(self.index[order], return_index=True)
        self.firsts = firsts.astype(np.int32)


def learn(
    texts: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    share: float,
    width: int = 4,
    steps: int = 1000,
    batch: int = 32,
    rate: float = 0.6,
    seed: int = 7,
    least: int = LEAST,
) -> Model:
    """Learns vectors and softmax from bags; ``share`` is class 1's share of all labels.

    Classes count alike while learning; the bias then moves by the log odds of ``share``, so
    scores are probabilities for all labelled texts whatever the sample's mix. With labels of
    one class only, every text scores ``share``. Vectors start at zero and grow with their
    gradients; features in fewer than ``least`` texts stay there, as do those never seen.
    The list ``texts`` is emptied: each bag is held once, as it comes or as part of a batch.
    """
    found_in = np.zeros(FEATURES, np.int64)
    for features, _ in texts:
        found_in[features] += 1
    common = found_in >= least
    texts, given = [], texts
    given.reverse()
    while given:
        features, times = given.pop()
        kept = common[features]
        texts.append((features[kept], times[kept]))
    draw = np.random.default_rng(seed)
    vectors = np.zeros((FEATURES, width), np.float32)
    softmax = np.zeros((width + 1, 2))
    softmax[:-1] = [-0.5, 0.5]
    share = min(max(share, 1e-6), 1 - 1e-6)
    ones = int(labels.sum())
    if 0 < ones < len(labels):
        balance = np.where(labels == 1, 0.5 * len(labels) / ones, 0.5 * len(labels) / (len(labels) - ones))
        past_v, past_s = np.zeros(FEATURES, np.float32), np.full(softmax.shape, 1e-8)
        order = draw.permutation(len(texts))
        batches = []
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            batches.append(_Batch(texts, rows))
            for r in rows:
                texts[r] = None
        rounds = -(-steps // len(batches))
        for turn in range(rounds):
            step = rate * (1 - turn / rounds)
            for k in draw.permutation(len(batches)):
                b = batches[k]
                mean = np.add.reduceat(vectors[b.index] * b.weight, b.starts, axis=0) * b.some
                hidden = np.concatenate([mean, np.ones((len(b.rows), 1))], axis=1)
                logits = hidden @ softmax
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(b.rows)), labels[b.rows]] -= 1
                p *= balance[b.rows][:, None] / len(b.rows)
                back = (p @ softmax[:-1].T).astype(np.float32)
                slope = hidden.T @ p
                past_s += slope**2
                softmax -= step * slope / np.sqrt(past_s)
                grad = np.add.reduceat(back[b.doc] * b.weight_sorted, b.firsts, axis=0)
                past_v[b.seen] += (grad**2).mean(axis=1)
                vectors[b.seen] -= np.float32(step) * grad / np.sqrt(past_v[b.seen] + SLACK)[:, None]
    softmax[-1, 1] += np.log(share / (1 - share))
    return Model(vectors, softmax)
