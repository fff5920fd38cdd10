"""Tokens, packing, fingerprints, repeats, tiles and secrets against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postloom.llm import blob_ledger, decontaminate, packing, queries, repeats, simhash, words
from postloom.llm.frames import components, running_start
from postloom.llm.token_files import EliasFano, token_file_round_trip
from postloom.llm.tokens import WordIds

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, _group int, score double, hit string"
ODD = [
    (5, None), (4, ""), (3, " \n\t"), (2, "a"), (1, "Don't STOP naïve <|endoftext|> x　y ÉÀ 12"),
    (9, "é İ ﬁ µ"), (None, "no id here"), (7, "same text"), (7, "same text"), (8, "same text"),
]


def rows(spark, pairs):
    return spark.createDataFrame([(d, t, 1, 0.5, "z") for d, t in pairs], DOCS)


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- words and hashes ---------------------------------------------------------------------------


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é　\x0b\x1c\n中", max_size=30)), max_size=6))
def test_words_and_hashes(values):
    found = words.split_words(*words.text_bytes(pa.array(values, pa.string())))
    hashes = words.word_hashes(found).tolist()
    for k, value in enumerate(values):
        expected = WORD.findall(value or "")
        at = range(found.docs[k], found.docs[k + 1])
        got = [found.data[found.start[i] : found.end[i]].tobytes().decode() for i in at]
        assert got == expected
        assert [hashes[i] for i in at] == [xxhash.xxh64_intdigest(w, 42) for w in expected]


def test_xxh64_of_any_length():
    data = np.random.default_rng(1).integers(0, 256, 1000).astype(np.uint8)
    start, length = np.arange(200), np.arange(200)
    got = words.xxh64(np.concatenate([data, np.zeros(8, np.uint8)]), start, length)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + a].tobytes(), 42) for a in range(200)]


def test_hash_longs(spark):
    df = spark.createDataFrame([(1, -2), (2**40, 7)], "a long, b long")
    expected = [r[0] for r in df.select(F.xxhash64("a", "b")).collect()]
    columns = [np.array(x, np.int64).view(np.uint64) for x in ((1, 2**40), (-2, 7))]
    assert words.hash_longs(*columns).view(np.int64).tolist() == expected


def test_range_hash():
    values = np.random.default_rng(2).integers(0, 2**63, 40).astype(np.uint64)
    both = np.concatenate([values, values])
    sums, back = words.range_sums(both)
    a = np.array([3, 43, 4])
    h = words.range_hash(sums, back, a, a + 9)
    assert h[0] == h[1] != h[2]


# ---- frames ---------------------------------------------------------------------------------------


def test_running_start(spark):
    df = spark.createDataFrame([(k * 3, k) for k in range(40)], "o long, v long")
    got = {r["o"]: r["s"] for r in running_start(df, "o", "v", "s", width=7).collect()}
    assert got == {k * 3: sum(range(k)) for k in range(40)}


def test_components(spark):
    chain = [(k, k + 1) for k in range(20)] + [(50, k) for k in range(60, 70)] + [(5, 5)]
    df = spark.createDataFrame(chain + chain, "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {k: 0 for k in range(21)} | {k: 50 for k in [50, *range(60, 70)]}
    assert components(df.limit(0)).count() == 0


def test_components_of_ids_at_both_ends(spark):
    low, high = -(2**63), 2**63 - 1
    chain = [(high - k, high - k - 1) for k in range(6)] + [(low, low + 1), (low + 2, low + 1)]
    df = spark.createDataFrame(chain, "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {high - k: high - 6 for k in range(7)} | {low + k: low for k in range(3)}


@pytest.mark.parametrize("start", [2**63 - 7, -(2**63)])
def test_simhash_of_large_ids(spark, start):
    text = "one two three four five six seven eight nine ten eleven twelve"
    df = rows(spark, [(start + k, text + " " * k) for k in range(6)])
    found = simhash.simhash_components(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {start + k: start for k in range(6)}


# ---- tokens, packing, files ------------------------------------------------------------------------


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="aB'st.é!7 　İﬁ中<|endoftext|>", max_size=40))
def test_word_ids_are_the_tokenizers(value):
    encoder = WordIds(queries.tokenizer_path())
    ids, begins = encoder.batch(pa.array([value, None]), 0)
    expected = encoder.tokenizer.encode(value, add_special_tokens=False).ids
    assert ids.tolist() == [*expected, 0, 0] and begins.tolist() == [0, len(expected) + 1, len(expected) + 2]


@given(st.dictionaries(st.integers(1, 30), st.integers(0, 6), max_size=12))
def test_plan_places_all(counts):
    bins = packing.plan_bins(counts, 30)
    used = {}
    for items, n in bins:
        assert n > 0 and sum(s * e for s, e in items) <= 30
        for s, e in items:
            used[s] = used.get(s, 0) + e * n
    assert used == {s: n for s, n in counts.items() if n}


def fewest(sizes, capacity):
    """Fewest bins, by trying every partition."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for j, room in enumerate(bins):
            if room >= sizes[k] and room not in bins[:j]:
                place(k + 1, [*bins[:j], room - sizes[k], *bins[j + 1 :]])
        place(k + 1, [*bins, capacity - sizes[k]])

    place(0, [])
    return best


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_reduction_keeps_the_optimum(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    fixed, left = packing.reduce_instance(counts, 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(b.count for b in fixed) + fewest(sorted(rest, reverse=True), 20) == fewest(
        sorted(sizes, reverse=True), 20
    )


def check_packing(found, expected):
    held, bins = {}, {}
    for r in found:
        ids = expected[r["doc_id"]]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * r["piece"], len(part), crc(part))
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    return held, len(bins)


def test_op1(spark, data, texts, tokenizer):
    expected = {
        d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()
    }
    held, bins = check_packing(queries.op1_best_fit_packing(spark, data).collect(), expected)
    assert held == {d: len(ids) for d, ids in expected.items()}
    assert bins <= 1.02 * sum(held.values()) / 2048 + 1


def test_packing_odd_rows(spark, tokenizer):
    pairs = [*ODD, (11, "word " * 5000)]
    found = packing.pack_documents(rows(spark, pairs), queries.tokenizer_path()).collect()
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs)
    assert sum(r["length"] for r in found) == total
    assert [r["length"] for r in found if r["doc_id"] == 11 and r["piece"] < 2] == [2048, 2048]
    assert packing.pack_documents(rows(spark, []), queries.tokenizer_path()).count() == 0


@given(st.lists(st.integers(0, 5000), max_size=3000), st.data())
def test_elias_fano(values, draw):
    values = np.sort(np.array(values, np.int64))
    ef = EliasFano.of(values)
    first = draw.draw(st.integers(0, len(values)))
    last = draw.draw(st.integers(first, len(values)))
    assert ef.select(first, last).tolist() == values[first:last].tolist()
    if len(values):
        bits = 8 * (len(ef.low) + len(ef.high))
        assert bits <= len(values) * (3 + max(0, np.log2(values[-1] / len(values) + 1))) + 16


def test_op2(spark, data, texts, tokenizer):
    at = 0
    found = {r["doc_id"]: r for r in queries.op2_token_files(spark, data).collect()}
    for d in sorted(texts):
        ids = [*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 1]
        assert (found[d]["start"], found[d]["n_tokens"], found[d]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(found) == len(texts)


def test_token_files_odd_rows(spark, tokenizer, monkeypatch):
    monkeypatch.setattr("postloom.llm.token_files.SHARD_IDS", 8)
    path = queries.tokenizer_path()
    found = token_file_round_trip(rows(spark, ODD), path, 49_408).sort("start").collect()
    assert [r["doc_id"] for r in found] == [None, 1, 2, 3, 4, 5, 7, 7, 8, 9]
    by_id = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in ODD}
    assert [r["ids_crc32"] for r in found] == [crc(by_id[r["doc_id"]]) for r in found]
    assert [r["start"] for r in found] == [0, *itertools.accumulate(r["n_tokens"] for r in found)][:-1]
    assert token_file_round_trip(rows(spark, []), path, 49_408).count() == 0


# ---- SimHash -----------------------------------------------------------------------------------------


def plain_fingerprint(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    found = re.findall(rb"[^\x20\x09-\x0D]+", low)
    shingles = [b" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [b" ".join(found)]
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes):
    """Smallest doc_id reachable over close fingerprints, by spreading the smallest."""
    ids = sorted(codes)
    bits = np.array([codes[d] for d in ids], np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3
    root = np.arange(len(ids))
    while True:
        new = np.where(near, root[None, :], len(ids)).min(axis=1)
        if (new == root).all():
            return {d: ids[r] for d, r in zip(ids, root)}
        root = new


def test_op4(spark, data, texts):
    codes = {d: plain_fingerprint(t) for d, t in texts.items()}
    found = queries.op4_simhash(spark, data).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {d: f"{c:016x}" for d, c in codes.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == plain_components(codes)
    assert len(found) == len(texts)


def test_simhash_odd_rows(spark):
    found = simhash.simhash_components(rows(spark, ODD)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in found) == [
        (0, None), (1, 1), (2, 2), (3, 3), (4, 3), (5, 3), (7, 7), (7, 7), (8, 7), (9, 9)
    ]
    assert simhash.simhash_components(rows(spark, [])).count() == 0
    kept = simhash.keep_first(rows(spark, ODD))
    assert kept.columns == ["doc_id", "text", "_group", "score", "hit"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 7, 7, 9]


def near_codes(n, seed):
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(4)]
    out = {0}
    while len(out) < n:
        code = draw.choice(centres)
        for b in draw.sample(range(64), draw.randint(0, 5)):
            code ^= 1 << b
        out.add(code)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_gray_index(seed):
    codes = np.array(near_codes(200, seed), np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    got = simhash.GrayIndex(codes, np.zeros(len(codes), np.int64)).components(3)
    expected = plain_components(dict(enumerate(codes.tolist())))
    assert got.tolist() == [expected[k] for k in range(len(codes))]


def test_full_keys_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "KEY_ROWS", 20)
    codes = near_codes(300, 9)
    signed = [(c - (1 << 64) if c >> 63 else c, k) for k, c in enumerate(codes)]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "bits long, node long"))
    got = {r["node"]: r["root"] for r in components(links).collect()}
    expected = plain_components(dict(enumerate(codes)))
    assert {k: got.get(k, k) for k in expected} == expected


# ---- repeats ---------------------------------------------------------------------------------------------


def plain_repeats(pairs):
    """(n_words, n_removed, kept words) of each document, window by window."""
    found = {d: WORD.findall(t or "") for d, t in pairs}
    first = {}
    for d in sorted(found):
        for i in range(len(found[d]) - 49):
            first.setdefault(tuple(found[d][i : i + 50]), d)
    out = {}
    for d, w in found.items():
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_op9(spark, data, texts):
    expected = plain_repeats(texts.items())
    found = queries.op9_substring_dedup(spark, data).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == {
        d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in expected.items()
    }


@pytest.mark.parametrize("seed", range(3))
def test_repeats_in_small_alphabets(spark, seed):
    """Many overlapping repeats: few words, pasted passages, shared anchors, periodic texts."""
    draw = random.Random(seed)
    passages = [[draw.choice("abcdefgh") for _ in range(draw.randint(40, 90))] for _ in range(4)]
    pairs = []
    for d in range(25):
        w = []
        for _ in range(draw.randint(0, 4)):
            w += draw.choice(passages)[draw.randint(0, 20) :]
            w += [draw.choice("xyz") for _ in range(draw.randint(0, 15))]
        pairs.append((d, "  ".join(w) + "\n"))
    pairs += [(30, "q " * 300), (31, "q " * 120), (32, "q\t" * 49), (33, None)]
    found = repeats.remove_repeats(rows(spark, pairs)).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in found}
    assert got == plain_repeats(pairs)
    for r in found:
        assert sum(s["stop"] - s["first"] for s in r["removed"]) == r["n_removed"]


def test_repeats_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60))
    pairs = [*ODD, (20, long), (20, long), (21, long + " tail"), (None, long)]
    found = repeats.remove_repeats(rows(spark, pairs)).collect()
    removed = sorted((r["doc_id"] or 0, r["n_removed"]) for r in found if r["n_words"] >= 50)
    assert removed == [(0, 0), (20, 0), (20, 0), (21, 60)]
    assert len(found) == len(pairs)
    assert repeats.remove_repeats(rows(spark, [])).count() == 0


# ---- decontamination ----------------------------------------------------------------------------------------


def plain_tiles(item, doc, least=5):
    """Greedy string tiling by comparing every two places."""
    used_i, used_d, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (
                    i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                    and i + n not in used_i and d + n not in used_d
                ):
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, d, n)
        if best is None:
            return out
        i, d, n = best
        used_i.update(range(i, i + n))
        used_d.update(range(d, d + n))
        out.append(best)


@settings(deadline=None, max_examples=60)
@given(
    st.lists(st.integers(1, 4), max_size=25), st.lists(st.integers(1, 4), max_size=40)
)
def test_tiles(item, doc):
    value = lambda x: words.mix(np.array(x, np.uint64) * np.uint64(7919))
    got = decontaminate.tiles(value(item), value(doc))
    assert [tuple(t) for t in got] == plain_tiles(item, doc)


def test_op5(spark, data, texts):
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    expected = set()
    for d, t in texts.items():
        w = plain(t)
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for k, item in items.items():
            if any(tuple(item[i : i + 5]) in grams for i in range(len(item) - 4)):
                covered = sum(n for _, _, n in plain_tiles(item, w))
                if covered >= 0.8 * len(item):
                    expected.add((d, k, len(item), covered))
    found = queries.op5_decontamination(spark, data).collect()
    assert {(r["doc_id"], r["item_id"], r["n_words"], r["covered"]) for r in found} == expected
    assert len(found) == len(expected) > 0


def test_reordered_passages_and_odd_rows(spark, monkeypatch):
    item = [f"w{k}" for k in range(30)]
    turned = " ".join([*item[15:], "between", *item[:15]]).upper()
    most = " ".join(item[:26])
    some = " ".join(item[:20])
    pairs = [*ODD, (20, turned), (21, "x, " + most + "!"), (22, some), (23, turned), (None, turned)]
    bench = [(1, " ".join(item)), (2, None), (3, "too short"), (None, most), (4, " ".join(item))]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 50):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        found = decontaminate.contaminated(rows(spark, pairs), benchmark).collect()
        assert sorted((r["doc_id"] or 0, r["item_id"], r["covered"]) for r in found) == [
            (d, k, n) for d, n in ((0, 30), (20, 30), (21, 26), (23, 30)) for k in (1, 4)
        ]
        tile = next(r for r in found if r["doc_id"] == 20)["tiles"][1]
        assert (tile["item_start"], tile["doc_start"], tile["length"]) == (15, 0, 15)
        kept = decontaminate.keep_clean(rows(spark, pairs), benchmark)
        assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 7, 8, 9, 22]
    assert decontaminate.contaminated(rows(spark, []), benchmark).count() == 0
    assert decontaminate.contaminated(rows(spark, pairs), benchmark.limit(0)).count() == 0


# ---- secrets --------------------------------------------------------------------------------------------------


def plain_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(blob_ledger.ASSIGN, text, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(blob_ledger.ACCESS, text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(blob_ledger.HEX, text) if len(m[0]) >= 16]
    return ",".join(f"{blob_ledger.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_op8(spark, data, texts):
    for r in queries.op8_secret_ledger(spark, data).collect():
        expected = plain_spans(texts[r["doc_id"]])
        assert r["spans"] == expected
        assert r["base_sha256"] == hashlib.sha256(expected.encode()).hexdigest()
        counts = [sum(x.startswith(k) for x in expected.split(",")) for k in blob_ledger.KINDS]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts


SECRETS = [
    (30, "é Password : 'abcdefghijkl' end"), (31, "secret: password: abcdefghijklmn"),
    (32, "AKIA" + "A1" * 7 + " AKIA" + "B" * 13), (33, "token=" + "0af" * 6 + " paſſword=abcdefghijklmnop"),
    (34, "0123456789abcdef" * 3), (35, "é Password : 'abcdefghijkl' end"),
]


def test_ledger_scans_new_blobs_only(spark):
    pairs = [*ODD, *SECRETS]
    found, ledger = blob_ledger.scan_documents(rows(spark, pairs))
    got = {r["doc_id"]: r["t"] for r in found.select("doc_id", blob_ledger.digest(F.col("spans")).alias("t")).collect()}
    assert got == {d: plain_spans(t) for d, t in pairs} and found.count() == len(pairs)
    assert ledger.count() == len({t or "" for _, t in pairs})
    assert blob_ledger.scan_new(rows(spark, pairs), ledger).count() == 0
    more = [*pairs, (40, "api-key is new"), (41, "apikey=zzzzzzzzzzzzz")]
    found, grown = blob_ledger.scan_documents(rows(spark, more), ledger)
    assert grown.count() == ledger.count() + 2 and found.count() == len(more)
    older = ledger.withColumn("rule_version", F.lit("older"))
    assert blob_ledger.scan_new(rows(spark, pairs), older).count() == ledger.count()
    assert blob_ledger.scan_documents(rows(spark, []))[0].count() == 0


def test_redact(spark):
    df = rows(spark, [*ODD, *SECRETS]).withColumn("n_chars", F.length("text"))
    out = blob_ledger.redact(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[30]["text"] == got[35]["text"] == "é [secret]' end" and got[30]["n_chars"] == 15
    assert got[33]["text"] == "[secret] paſſword=abcdefghijklmnop"
    assert got[5]["text"] is None and got[1]["text"] == ODD[4][1] and out.count() == 16


def test_short_and_unspaced_items_are_found(spark):
    items = [(1, "Name the capital, please"), (2, "日本の首都はどこですか"), (3, "one"), (4, "!?"), (5, "twice twice"), (6, "ไทยแลนด์ ดินแดน")]
    docs = [
        (10, "Q: name the capital PLEASE!"), (11, "name the other capital please"), (12, "さて、日本の首都はどこですか？東京"),
        (13, "日本の首都は東京です"), (14, "bone ones"), (15, "it is one. And one!"), (16, "twice"), (17, "Twice, twice, twice"),
        (18, "ไทยแลนด์ ดินแดน แห่ง"), (19, None),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(rows(spark, docs), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(10, 1), (12, 2), (15, 3), (17, 5), (18, 6)]
    assert all(r["covered"] == r["n_words"] for r in found if r["item_id"] != 6)
    kept = decontaminate.keep_clean(rows(spark, docs), benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == [11, 13, 14, 16, 19]


def test_clean_documents_of_many_blocks(spark, documents, data, monkeypatch):
    """The same documents stay however many passes; the last plan has no task with two of them."""
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    docs = documents.union(documents.limit(20)).withColumn("_place", F.lit(1)).withColumn("a", F.lit("x"))
    expected = decontaminate.keep_clean(docs, benchmark)
    assert 0 < expected.count() < docs.count()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    found = decontaminate.keep_clean(docs, benchmark)
    assert found.columns == docs.columns
    assert found.exceptAll(expected).count() == 0 and expected.exceptAll(found).count() == 0
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
