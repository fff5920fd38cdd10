"""I-Match fingerprints: terms of a band of document frequency, hashed by lexicon subset.

The lexicon holds the terms in a band of inverse document frequency, counted over all
documents. It is cut at random into SUBSETS parts, and every part has thinner versions that
keep a half, a quarter, and so on of its terms. A document's distinct terms are sorted, and the
ones it has in a part are hashed together; it uses the version in which it has about a term
for every third part, and the next thinner ones, so that two texts meet in the version of the
longer one whatever their lengths are. Parts with equal hashes, of those in which either text has a
term, tell how alike two texts are.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.frames import shuffle_partitions, store, text_column
from postloom.llm.words import SLICE_BYTES, give_back, mix, slices, split_words, text_bytes, word_hashes

# Shares of all documents between which a term's document frequency lies. The share from
# below bounds the lexicon: by a document's mean number of distinct terms, over LEAST_SHARE.
MOST_SHARE = 0.1
LEAST_SHARE = 0.0005
# The lexicon is a bitmap of hashed terms, 8 MB whatever the data. A term outside the band
# that shares a bit is kept, in every document alike.
LEXICON_BITS = 26
SUBSETS = 64
VERSIONS = 4
FEW_TERMS = 16  # with fewer terms of the band all terms are compared
BLOCKS_PER_PARTITION = 4
SAMPLED = 16  # sampled keys for each block's start
SEED = np.uint64(0x6A09E667F3BCC909)

TERM = np.full(256, 0x20, dtype=np.uint8)
TERM[0x80:] = np.arange(0x80, 0x100)
TERM[0x30:0x3A] = np.arange(0x30, 0x3A)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = np.arange(0x61, 0x7B)


# ---- terms -----------------------------------------------------------------------------------


def distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms of each text, sorted by text and hash, and their texts.

    A term is a run of digits, letters (A-Z in lower case) and characters beyond ASCII.
    """
    data, offsets = text_bytes(texts)
    words = split_words(TERM[data], offsets)
    hashes = word_hashes(words)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.docs))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, documents) of all terms, by hash."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                term, n = np.unique(distinct_terms(part.column("text"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"]
                )
        give_back()

    found = docs.select("text").mapInArrow(run, "term long, n long")
    return found.groupBy("term").agg(F.sum("n").alias("documents"))


def lexicon_bits(counts: DataFrame, documents: int) -> np.ndarray:
    """The band as packed bits, by the first bits of the terms' hashes."""
    # a term of a single document stays in tables too small for the band
    most = max(1.0, MOST_SHARE * documents)
    band = counts.filter(F.col("documents").between(LEAST_SHARE * documents, most))
    place = F.shiftrightunsigned("term", 64 - LEXICON_BITS)
    rows = (
        band.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("row"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        .toArrow()  # at most 2**(LEXICON_BITS - 6) rows of 16 bytes
    )
    bits = np.zeros(1 << (LEXICON_BITS - 6), np.int64)
    bits[rows["row"].to_numpy()] = rows["bits"].to_numpy()
    return bits


def in_lexicon(bits: np.ndarray, terms: np.ndarray) -> np.ndarray:
    place = (terms >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


# ---- fingerprints ------------------------------------------------------------------------------


def _hashed(terms: np.ndarray, text: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, slot, 16 bits) of the sorted terms that share text and slot."""
    order = np.argsort(text * SUBSETS + slot, kind="stable")
    terms, text, slot = terms[order], text[order], slot[order]
    new = np.ones(len(terms), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (slot[1:] != slot[:-1])
    begin = np.flatnonzero(new)
    if not len(begin):
        return text, slot, np.empty(0, np.uint16)
    rank = np.arange(len(terms)) - begin[np.cumsum(new) - 1]
    with np.errstate(over="ignore"):
        value = np.add.reduceat(mix(terms + rank.astype(np.uint64) * SEED), begin)
        return text[begin], slot[begin], (mix(value) >> np.uint64(48)).astype(np.uint16)


def _sections(terms: np.ndarray, text: np.ndarray, n: int) -> list[tuple]:
    """For each text its version, and the parts' hashes in it and in the next thinner ones."""
    counts = np.bincount(text, minlength=n)
    # 16 to 31 terms for 64 parts
    version = np.floor(np.log2(np.maximum(counts, 16) / 16)).astype(np.int64)
    with np.errstate(over="ignore"):
        place = mix((terms ^ SEED) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)
    slot, thin = place & (SUBSETS - 1), (place >> 6) & ((1 << 50) - 1)
    levels = []
    for more in range(VERSIONS):
        mask = (np.int64(1) << (version[text] + more)) - 1
        kept = (thin & mask) == 0
        at, part, value = _hashed(terms[kept], text[kept], slot[kept])
        rows = np.stack([part.astype(np.uint8), value >> 8, value & 0xFF], axis=1).astype(np.uint8)
        ends = np.searchsorted(at, np.arange(n + 1))
        levels.append([rows[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])])
    return list(zip(version.tolist(), *levels))


def fingerprints(texts: pa.Array, bits: np.ndarray) -> list[str]:
    """One line for each text: of the band's terms and of all terms, version and hashes."""
    n = len(texts)
    terms, text = distinct_terms(texts)
    band = in_lexicon(bits, terms)
    few = np.bincount(text[band], minlength=n) < FEW_TERMS
    none = np.bincount(text, minlength=n) == 0
    out = []
    both = zip(_sections(terms[band], text[band], n), _sections(terms, text, n))
    for k, sections in enumerate(both):
        if none[k]:
            whole = hashlib.sha256((texts[k].as_py() or "").encode()).hexdigest()
            out.append("t." + whole[:16])
            continue
        parts = ["a" if few[k] else "b"]
        for version, *levels in sections:
            parts.append(f"{version:x}")
            parts += [b64encode(level).decode() for level in levels]
        out.append(".".join(parts))
    return out


def _read(fingerprint: str) -> tuple:
    kind, *parts = fingerprint.split(".")
    if kind == "t":
        return kind, []
    sections = []
    for k in (0, VERSIONS + 1):
        maps = []
        for part in parts[k + 1 : k + 1 + VERSIONS]:
            raw = b64decode(part)
            maps.append({raw[i]: raw[i + 1 : i + 3] for i in range(0, len(raw), 3)})
        sections.append((int(parts[k], 16), maps))
    return kind, sections


def likeness(one: str, other: str) -> float:
    """0 to 1 from two fingerprints: 1 for equal ones, about 0.5 where half the terms agree.

    The share of equal hashes among the parts in which either text has a term estimates the
    terms in common over the terms of either; it is given as a share of both texts' terms.
    Texts with numbers of terms that differ more than eight- to sixteenfold are not alike.
    """
    if one == other:
        return 1.0
    (kind, a), (kind2, b) = _read(one), _read(other)
    if "t" in (kind, kind2):
        return 0.0
    # all terms, where either text has few of the band
    number = 0 if kind == kind2 == "b" else 1
    (v, levels), (w, levels2) = a[number], b[number]
    top = max(v, w)
    if top - min(v, w) >= VERSIONS:
        return 0.0
    x, y = levels[top - v], levels2[top - w]
    either = len(x.keys() | y.keys())
    equal = sum(y.get(k) == h for k, h in x.items())
    share = equal / either if either else 0.0
    return 2 * share / (1 + share)


# ---- neighbours ------------------------------------------------------------------------------------


def _cuts(docs: DataFrame, documents: int) -> list[tuple[int, int]]:
    """Sorted (place, hash) of some rows, at which blocks of the order begin.

    A sample of bounded size; it decides only how the rows are dealt to tasks.
    """
    blocks = BLOCKS_PER_PARTITION * shuffle_partitions(docs.sparkSession)
    share = min(1.0, SAMPLED * blocks / max(documents, 1))
    draw = F.pmod(F.xxhash64("hash", "place"), F.lit(1 << 30)) < int(share * (1 << 30))
    keys = docs.select("place", "hash")
    rows = [tuple(r) for r in keys.filter(draw).distinct().collect()]
    if not rows:
        least = keys.agg(F.min(F.struct("place", "hash")).alias("k")).first()["k"]
        rows = [tuple(least)] if least else []
    rows.sort()
    return rows[:: max(1, -(-len(rows) // blocks))]


def _dealt(docs: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """Rows with their block and place in it; a block ends with a copy of the next one's first.

    The order is a ring: rows before the first cut follow the last ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    def run(batches):
        cuts = shared.value
        firsts = np.array([p for p, _ in cuts], np.int64)
        for batch in batches:
            place, hashed = (batch.column(c).to_numpy() for c in ("place", "hash"))
            block = np.searchsorted(firsts, place, "right") - 1
            is_cut = np.zeros(len(place), dtype=bool)
            for k in np.flatnonzero(np.isin(place, firsts)).tolist():
                key = (int(place[k]), int(hashed[k]))
                block[k] = bisect_right(cuts, key) - 1
                is_cut[k] = bisect_left(cuts, key) == block[k]
            turn = (block < 0).astype(np.int8)
            own = np.where(block < 0, len(cuts) - 1, block)
            more = np.flatnonzero(is_cut)
            rows = np.concatenate([np.arange(len(place)), more])
            out = batch.take(pa.array(rows))
            block = np.concatenate([own, (own[more] - 1) % len(cuts)]).astype(np.int32)
            turn = np.concatenate([turn, np.full(len(more), 2, np.int8)])
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(block), pa.array(turn.astype(np.int32))],
                names=[*out.schema.names, "block", "turn"],
            )

    schema = "doc_id long, place long, hash long, text string, block int, turn int"
    dealt = docs.select("doc_id", "place", "hash", "text").mapInArrow(run, schema)
    return dealt.repartition("block").sortWithinPartitions("block", "turn", "place", "hash")


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the following text's beginning as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Each row of ``docs`` (doc_id, text) with the fingerprints of its text and of its edited
    text, whose last half is the beginning of the next document's, and how like its
    fingerprint is to the edited text's and to the next document's. Documents follow by doc_id
    (NULL as the smallest), those of one doc_id by a hash of their text, and the first follows
    the last; a table of one row is its own next.

    NULL text is empty. Empty texts and texts without letters or digits are like equal texts
    only. Repeated rows follow each other. Other columns are ignored, texts of any length are
    taken whole, and an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs))
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = rows.withColumns({"place": place, "hash": F.xxhash64("text")})
    documents = docs.count()
    bits = lexicon_bits(store(term_counts(rows), "terms"), documents)
    cuts = _cuts(rows, documents)
    if not cuts:
        return docs.sparkSession.createDataFrame([], RESULT)
    lexicon = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        held = None  # the row before, without its successor yet
        block, ended = None, False
        ids, texts, nexts = [], [], []

        def flush():
            n = len(texts)
            changed = [edited(a, b) for a, b in zip(texts, nexts)]
            # each text's successor is mostly the next text; other successors come last
            other = [k for k in range(n) if k + 1 == n or texts[k + 1] is not nexts[k]]
            lines = fingerprints(
                pa.array(texts + changed + [nexts[k] for k in other], pa.large_string()), lexicon.value
            )
            own, new, after = lines[:n], lines[n : 2 * n], lines[1 : n + 1]
            for k, line in zip(other, lines[2 * n :]):
                after[k] = line
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array(own),
                    pa.array(new),
                    pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(own, after)], pa.float64()),
                ],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

        size = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "block", "turn"))):
                doc_id, text, now, turn = r
                if now != block:
                    held, block, ended = None, now, False
                if ended:
                    continue  # further copies of one row
                if held is not None:
                    ids.append(held[0])
                    texts.append(held[1])
                    nexts.append(text)
                    size += len(held[1])
                    if size > SLICE_BYTES // 4:
                        yield flush()
                        ids, texts, nexts, size = [], [], [], 0
                held, ended = (doc_id, text), turn == 2
        if texts:
            yield flush()
        give_back()

    return _dealt(rows, cuts).mapInArrow(run, RESULT)
