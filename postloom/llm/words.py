"""Words and hashes of whole batches of texts as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts are UTF-8 bytes of one Arrow column; nothing here
works text by text, so a batch costs a few passes over its bytes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 * 1024 * 1024

# Fixed values of XXH64.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def give_back() -> None:
    """Returns a finished task's memory to the system; Python workers live on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(
    batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // size
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column and the offsets of its texts; NULL is empty."""
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words(NamedTuple):
    data: np.ndarray  # the words, one space after each, and 8 spare bytes
    start: np.ndarray  # of each word
    end: np.ndarray
    docs: np.ndarray  # words before each text, one more entry than texts


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    n = len(data)
    solid = ~SPACE[data]
    gap = np.zeros(n + 1, dtype=bool)  # a word may start at, or end before, this byte
    gap[1:] |= ~solid
    gap[offsets] = True
    first = np.flatnonzero(solid & gap[:n])
    gap = np.zeros(n + 1, dtype=bool)
    gap[:n] = ~solid
    gap[offsets] = True
    last = np.flatnonzero(solid & gap[1:])
    lengths = last + 1 - first
    end = np.cumsum(lengths + 1) - 1
    start = end - lengths
    total = int(end[-1]) + 1 if len(end) else 0
    joined = np.full(total + 8, 0x20, dtype=np.uint8)
    body = np.ones(total, dtype=bool)
    body[end] = False
    kept = data[solid]
    joined[:total][body] = LOWER[kept] if lower else kept
    return Words(joined, start, end, np.searchsorted(first, offsets))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of ``data``, which has 8 spare bytes at its end."""
    n = len(start)
    if n == 0:
        return np.empty(0, np.uint64)
    data = np.ascontiguousarray(data)
    long = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    half = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    at, left = start.astype(np.int64), length.astype(np.int64)
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(n, s + P5, np.uint64)
        wide = np.flatnonzero(left >= 32)
        if len(wide):
            v = [np.full(len(wide), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            p, stripes = at[wide], left[wide] // 32
            on = np.arange(len(wide))
            while len(on):
                for k in range(4):
                    v[k][on] = _turn(v[k][on] + long[p[on] + 8 * k] * P2, 31) * P1
                p[on] += 32
                stripes[on] -= 1
                on = on[stripes[on] > 0]
            x = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for k in range(4):
                x = (x ^ (_turn(v[k] * P2, 31) * P1)) * P1 + P4
            h[wide] = x
            at[wide] = p
        h += left.astype(np.uint64)
        left %= 32
        for _ in range(3):
            on = np.flatnonzero(left >= 8)
            if not len(on):
                break
            x = h[on] ^ (_turn(long[at[on]] * P2, 31) * P1)
            h[on] = _turn(x, 27) * P1 + P4
            at[on] += 8
            left[on] -= 8
        on = np.flatnonzero(left >= 4)
        if len(on):
            x = h[on] ^ (half[at[on]].astype(np.uint64) * P1)
            h[on] = _turn(x, 23) * P2 + P3
            at[on] += 4
            left[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(left > 0)
            if not len(on):
                break
            x = h[on] ^ (data[at[on]].astype(np.uint64) * P5)
            h[on] = _turn(x, 11) * P1
            at[on] += 1
            left[on] -= 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def word_hashes(words: Words, seed: int = 42) -> np.ndarray:
    return xxh64(words.data, words.start, words.end - words.start, seed)


def gram_hashes(hashes: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rolling Karp-Rabin hash of each ``n`` consecutive word hashes, modulo 2**64."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    power = np.uint64(base | 1)
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            out *= power
            out += hashes[k : len(hashes) - n + 1 + k]
        # spread the low bits, which the polynomial mixes least
        out ^= out >> np.uint64(32)
        out *= P2
        out ^= out >> np.uint64(29)
    return out


RANGE_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def range_sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any range of words follows."""
    with np.errstate(over="ignore"):
        terms = hashes * _powers(len(hashes), RANGE_BASE)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(terms)])
        back = _powers(len(hashes) + 1, np.uint64(pow(int(RANGE_BASE), -1, 1 << 64)))
    return sums, back


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def range_hash(sums: np.ndarray, back: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[b] - sums[a]) * back[a])


def hash_longs(*columns: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of long columns, as unsigned numbers."""
    h = np.full(len(columns[0]), 42, np.uint64)
    with np.errstate(over="ignore"):
        for x in columns:
            h = h + P5 + np.uint64(8)
            h = h ^ (_turn(x.astype(np.uint64) * P2, 31) * P1)
            h = _turn(h, 27) * P1 + P4
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            h = h ^ (h >> np.uint64(32))
    return h


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
