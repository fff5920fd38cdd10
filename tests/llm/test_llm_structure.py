"""Spelling variants, document fingerprints and conversation repair against plain versions."""

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postloom.llm import imatch, turns, variants

DOCS = "doc_id long, text string, word string, n long, place int, hash string, block int"
CONVERSATIONS = "conv_id long, turn long, role string, text string, k1 string, gone int, audit string"


def documents(spark, pairs):
    return spark.createDataFrame([(d, t, "x", 1, 2, "y", 3) for d, t in pairs], DOCS)


# ---- spelling variants -----------------------------------------------------------------------


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(pairs):
    counts = Counter()
    for doc_id, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "a" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    near = {
        w: [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if is_near(w, x)] for w in words
    }
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def found_variants(df):
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in variants.spelling_variants(df).select(columns).collect())


def test_variants_of_the_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    expected = plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found_variants(docs) == expected
    assert sum(form is not None for _, form, *_ in expected) > 100


def test_variants_of_odd_rows(spark):
    long = "abcdefghij" * 40
    words = {
        "house": 20, "hous": 4, "houses": 10, "hxuse": 9, "mouse": 5, "aabbb": 3, "abbbb": 7,
        "aaabbb": 3, "Ünder": 3, "ünder": 8, "straße×": 4, "straŸe": 3, "écoles": 3, "école": 3,
        long: 3, long[:-1]: 6, "b" + long: 3, long[:200] + "z" + long[201:]: 12,
    }
    pairs = [(9, " ".join([w] * n)) for w, n in words.items()]
    pairs += [(None, "House,HOUSE　house—house"), (None, None), (1, ""), (2, "\n\t"), (3, "a" * 70_000)]
    pairs += [(7, "repeated rows differ"), (7, "repeated rows differ"), (7, "repeated rows differ")]
    pairs += [(2**62, "Typing typing typing typo"), (-(2**63), "typng typng typng typng")]
    assert found_variants(documents(spark, pairs)) == plain_variants(pairs)
    assert found_variants(documents(spark, [])) == []
    assert found_variants(documents(spark, [(1, None)])) == []


def test_groups_of_long_words_are_split(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 3)
    base = "q" * 400
    texts = [base[:k] + x + base[k + 1 :] for k, x in zip(range(100, 120), "abcdefghijklmnoprstu")]
    texts += [base[:100] + x + base[101:] for x in "ghijkl"] + [base, base[1:]]
    pairs = [(5, f"{t} {t} {t}") for t in texts]
    assert found_variants(documents(spark, pairs)) == plain_variants(pairs)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(alphabet="abÿ", min_size=5, max_size=9), min_size=2, max_size=12, unique=True))
def test_tiles_find_single_edits(words):
    left, right, length = variants.matrices(words)
    p, q = np.triu_indices(len(words), 1)
    prefix, suffix = variants.common(left, right, p, q)
    limit = np.minimum(length[p], length[q])
    prefix, suffix = np.minimum(prefix, limit), np.minimum(suffix, limit)
    longer = np.maximum(length[p], length[q])
    found = (prefix + suffix >= longer - 1) & (longer - limit <= 1)
    assert found.tolist() == [is_near(words[i], words[j]) for i, j in zip(p, q)]


@given(st.lists(st.tuples(st.binary(max_size=200), st.binary(max_size=9)), max_size=8))
def test_crc32_of_ranges(values):
    data = np.frombuffer(b"".join(v for v, _ in values) + bytes(8), np.uint8)
    length = np.array([len(v) for v, _ in values], np.int64)
    before = np.array([zlib.crc32(b) for _, b in values], np.uint32)
    got = variants.crc32_of(data, np.cumsum(length) - length, length, before)
    assert got.tolist() == [zlib.crc32(b + v) for v, b in values]


# ---- document fingerprints ---------------------------------------------------------------------


def check_rows(pairs, rows):
    """Everything but the fingerprints themselves, of documents with different ids."""
    assert [r["doc_id"] for r in rows] == [d for d, _ in pairs]
    lines = {}
    for k, r in enumerate(rows):
        text, following = (pairs[i % len(pairs)][1] or "" for i in (k, k + 1))
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert lines.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert lines.setdefault(new, r["edited_fingerprint"]) == r["edited_fingerprint"]
        after = rows[(k + 1) % len(rows)]["fingerprint"]
        assert r["near_next"] == imatch.likeness(r["fingerprint"], after)
        assert r["near_edited"] == imatch.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1


def in_order(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"]))


@pytest.mark.parametrize("blocks", [1, 4])
def test_fingerprints_of_the_documents(spark, data, monkeypatch, blocks):
    monkeypatch.setattr(imatch, "BLOCKS_PER_PARTITION", blocks)
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(5)
    pairs = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    rows = in_order(imatch.document_fingerprints(docs).collect())
    check_rows(pairs, rows)
    edited = np.array([r["near_edited"] for r in rows])
    following = np.array([r["near_next"] for r in rows])
    assert (edited > following).mean() > 0.95
    assert 0.35 < np.median(edited) < 0.6 and np.median(following) < 0.1


def test_likeness_follows_the_terms_in_common(spark):
    none = np.zeros(1 << (imatch.LEXICON_BITS - 6), np.int64)
    parts = (0, 0.25, 0.5, 1)
    for size in (60, 600, 6000):
        got = []
        for draw in range(12):
            words = [f"w{draw}x{k}" for k in range(2 * size)]
            starts = [0, *(round(size * part) for part in parts)]
            texts = [" ".join(words[at : at + size]) for at in starts]
            lines = imatch.fingerprints(pa.array(texts), none)
            got.append([imatch.likeness(lines[0], line) for line in lines[1:]])
        same, most, half, other = np.mean(got, axis=0)
        assert same == 1 and abs(most - 0.72) < 0.08 and abs(half - 0.46) < 0.08 and other < 0.05


def test_lexicon_keeps_the_band(spark, monkeypatch):
    monkeypatch.setattr(imatch, "LEAST_SHARE", 0.02)
    pairs = [(k, f"common half{k % 2} twelfth{k % 12} rare{k}") for k in range(100)]
    docs = documents(spark, pairs)
    bits = imatch.lexicon_bits(imatch.term_counts(docs), 100)
    terms = imatch.distinct_terms(pa.array(["common", "half1", "twelfth3", "rare7"]))[0]
    assert imatch.in_lexicon(bits, terms).tolist() == [False, False, True, False]


def test_fingerprints_of_odd_rows(spark):
    pairs = [(-(2**62), "a b c"), (1, None), (2, ""), (3, "!?"), (4, "!?"), (5, "word"), (6, "Straße Ñandú 12"),
             (7, "long text " * 30_000), (2**62, "x" * 100_000)]
    rows = in_order(imatch.document_fingerprints(documents(spark, pairs)).collect())
    check_rows(pairs, rows)
    assert rows[1]["near_next"] == 1 and rows[2]["near_next"] == 0 and rows[3]["near_next"] == 1
    tied = [(None, "no id"), (7, "same"), (7, "same"), (7, "same"), (7, "other"), (8, "last")]
    rows = imatch.document_fingerprints(documents(spark, tied)).collect()
    assert sorted(r["n_chars"] for r in rows) == [4, 4, 4, 4, 5, 5]
    assert sum(r["near_next"] == 1 for r in rows) == 2
    alone = imatch.document_fingerprints(documents(spark, [(1, "one text")])).collect()
    assert [r["near_next"] for r in alone] == [1.0]
    assert imatch.document_fingerprints(documents(spark, [])).collect() == []


# ---- conversations -------------------------------------------------------------------------------


def cheapest(symbols):
    """Least cost and ASCII-least audit, by search over (rows done, state) from the start."""
    def steps(at, state):
        yield "I", turns.ADD, at, turns.AFTER[state]
        if at == len(symbols):
            return
        initial, must_go, cut = symbols[at]
        yield "D", 3, at + 1, state
        if must_go:
            return
        yield "R", 2 + cut, at + 1, turns.AFTER[state]
        if initial == "s" and state == 0:
            yield "K", cut, at + 1, 1
        elif initial == "uuau"[state]:
            yield "K", cut, at + 1, turns.AFTER[state]

    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(symbols) and state in (0, 3):
            return cost, audit
        if (at, state) not in done:
            done.add((at, state))
            for letter, price, to, after in steps(at, state):
                heapq.heappush(heap, (cost + price, audit + letter, to, after))


def plain_repairs(rows):
    conversations = defaultdict(list)
    shown = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        conversations[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        known = [t for t, _, _ in kept if t is not None]
        gaps = min(max(known) - min(known) + 1 - len(set(known)), 2**63 - 1) if known else 0
        faults, seen, symbols = Counter(), set(), []
        for _, role, text in kept:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = ""
            if not solid:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif solid[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            faults[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = cheapest(symbols)
        lines, at, state = [], 0, 0
        for letter in audit:
            role = "user" if turns.NEEDED[state] == "u" else "assistant"
            if letter == "I":
                lines.append(f"{role}:")
            elif letter == "R":
                lines.append(f"{role}:{kept[at][2]}")
            elif letter == "K":
                lines.append(f"{kept[at][1]}:{kept[at][2]}")
                if kept[at][1][:1] == "s":
                    state, at = 1, at + 1
                    continue
            if letter != "D":
                state = turns.AFTER[state]
            at += letter != "I"
        initials = "".join(line[0] for line in lines)
        assert re.fullmatch("(s?(ua)+)?", initials)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults[f] for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def found_repairs(df):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = turns.repair_conversations(df).select(columns).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "K") for r in rows], CONVERSATIONS)


def test_repairs_of_the_conversations(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet").repartition(3)
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()]
    expected = plain_repairs(rows)
    assert found_repairs(table) == expected
    assert {letter for r in expected for letter in r[7]} == set("DIKR")


def test_repairs_of_made_up_conversations(spark):
    draw = np.random.default_rng(5)
    roles = ["system", "user", "assistant", "tool", "", None, "User", "admin"]
    texts = ["Done.", "what now", " \n", None, "yes!", "", "no?", "é.", "　", "x "]
    rows = [
        (int(c), int(t) if t or c % 3 else None, roles[draw.choice(8, p=[0.1, 0.35, 0.35] + [0.04] * 5)],
         texts[draw.integers(len(texts))] if draw.random() < 0.3 else f"text {c} {t}{'.' if draw.random() < 0.7 else ''}")
        for c in range(300) for t in range(draw.integers(1, 14))
    ]
    assert found_repairs(conversations(spark, rows)) == plain_repairs(rows)


def test_repairs_of_odd_rows(spark):
    big = 2**63 - 1
    # turn 9 of conversation 0 is dropped, so nothing is left of it
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:9".encode()) % 20 == 0)
    rows = [
        (gone, 9, "user", "Only row."), (None, None, None, None), (None, 3, "user", "Hi there."),
        (None, 4, "assistant", "Hello."), (2**62, -5, "assistant", "First."), (2**62, big, "user", "Last."),
        (-(2**63), 1, "system", "s." * 50_000), (-(2**63), 1, "system", "s." * 50_000),
        (7, 1, "user", "same."), (7, 2, "user", "same."), (7, 2, "user", "same."), (7, 2, "assistant", "same."),
    ]
    assert found_repairs(conversations(spark, rows)) == plain_repairs(rows)
    nothing = [r for r in found_repairs(conversations(spark, rows)) if r[0] == gone]
    assert nothing == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert found_repairs(conversations(spark, [])) == []


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(alphabet="suaoSUAOd", max_size=12), min_size=1, max_size=8))
def test_audits_are_the_cheapest(signatures):
    ends = turns.Suffixes()
    for backwards in sorted(s[::-1] for s in signatures):
        symbols = [(c.lower(), c == "d", int(c.isupper())) for c in backwards[::-1]]
        assert ends.audit(backwards) == cheapest(symbols)
    assert len(ends.costs) < 100  # classes, however many ends there are
