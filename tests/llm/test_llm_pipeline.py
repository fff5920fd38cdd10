"""The pipeline against plain versions of its stages, and the SQL of op7 on planted rows."""

import math
import re

import duckdb
import numpy as np
import pytest
from test_llm_models import near_vectors, plain_features, plain_links
from test_llm_texts import check_packing, plain_components, plain_fingerprint, plain_spans, plain_tiles

import corpus_pipeline
from postloom.llm import queries, subwords
from postloom.llm.classify import fit, remainder
from postloom.llm.quality import FOLDS, HELD_OUT, SETTINGS, THRESHOLD
from pyspark.sql import functions as F


def plain_clean(text, items):
    """Whether no item of the benchmark covers itself to 0.8 or more by tiles in the text."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    for item in items:
        if any(tuple(item[i : i + 5]) in grams for i in range(len(item) - 4)):
            if sum(n for _, _, n in plain_tiles(item, words)) >= 0.8 * len(item):
                return False
    return True


def plain_redacted(text):
    """The text with each run of overlapping spans as one mark."""
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in plain_spans(text).split(",") if s)
    runs = []
    for start, stop in spans:
        if runs and start < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    for start, stop in reversed(runs):
        text = text[:start] + "[secret]" + text[stop:]
    return text


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, data):
    """Each stage's input and output, the last one's rows, by name."""
    out, docs = {}, spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, data).cache()
        out[name] = (docs, after)
        docs = after
    return out


def test_stage_names(stages):
    assert list(stages) == ["quality", "near_copies", "leaked_tests", "secrets", "packing"]
    for before, after in list(stages.values())[:-1]:
        assert after.schema == before.schema


def test_quality(spark, data, stages):
    """The learned weights, applied word by word; the test of the operator holds its accuracy."""
    before, after = map(rows_of, stages["quality"])
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    weights = fit(docs, labels, remainder(F.col("doc_id"), FOLDS) != HELD_OUT, SETTINGS)

    def score(text):
        found = plain_features(text or "", SETTINGS.lower, SETTINGS.pairs)
        odds = np.sum(weights[found]) / (len(found) + subwords.NEUTRAL) + weights[-1]
        return 1 / (1 + math.exp(-odds))

    assert after == {d: r for d, r in before.items() if score(r["text"]) >= THRESHOLD}
    assert 0 < len(after) < len(before)


def test_near_copies(stages):
    before, after = map(rows_of, stages["near_copies"])
    root = plain_components({d: plain_fingerprint(r["text"]) for d, r in before.items()})
    assert after == {d: r for d, r in before.items() if root[d] == d}
    assert len(after) < len(before)


def test_leaked_tests(spark, data, stages):
    before, after = map(rows_of, stages["leaked_tests"])
    bench = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in bench]
    assert after == {d: r for d, r in before.items() if plain_clean(r["text"], items)}
    assert len(after) < len(before)


def test_secrets(stages):
    before, after = map(rows_of, stages["secrets"])
    for d, r in before.items():
        text = None if r["text"] is None else plain_redacted(r["text"])
        kept = r.asDict() | {"text": text}
        if text != r["text"]:
            kept["n_chars"] = len(text)
        assert after[d].asDict() == kept
    assert after.keys() == before.keys() and after != before


def test_packing(spark, data, stages):
    from tokenizers import Tokenizer

    before, packed = stages["packing"]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    expected = {
        d: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for d, r in rows_of(before).items()
    }
    held, bins = check_packing(packed.collect(), expected)
    assert held == {d: len(ids) for d, ids in expected.items()}
    assert bins <= 1.02 * sum(held.values()) / 2048 + 1
    assert corpus_pipeline.run(spark, data).count() == packed.count()


def test_op7_sql_on_planted_vectors(spark):
    """The SQL finds the links of hand-made vectors, as the comparison of every two rows does."""
    rows = near_vectors(150, 4) + [
        (200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [None] + [1.0] * 15, 1),
        (204, [float("inf")] * 16, 1), (205, [1.0] * 16, None), (206, [1.0] * 16, None),
        (207, [1.0, 2.0], 0), (208, [2.0, 4.0], 0),
    ]
    engine = duckdb.connect()
    engine.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    engine.executemany("insert into embeddings values (?, ?, ?)", rows)
    found = engine.execute(queries.ORACLES["op7_vector_dedup"]).fetchall()
    assert {i: (n, root) for i, n, root, _ in found} == plain_links(rows)
    assert all(kept == (i == root) for i, _, root, kept in found) and len(found) == len(rows)
