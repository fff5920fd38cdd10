"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. The ledger holds the
findings of each (blob, rule version) pair that was ever scanned; a run scans the blobs that it
lacks, each once, and joins the findings back to all paths that hold the blob.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.frames import key_filter, store, with_hit
from postloom.llm.words import slices

# The kinds of secrets, in their order, and their patterns.
RULE_VERSION = "2026-1"
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")
LEDGER = (
    "blob string, rule_version string, "
    "spans array<struct<kind:string,start:long,stop:long>>"
)


class Rule(NamedTuple):
    kind: str
    pattern: str
    flags: int
    group: int  # whose length counts
    least: int
    hint: str  # matches every text with a match, and some others


RULES = (
    Rule("assign", ASSIGN, re.IGNORECASE | re.ASCII, 2, 12, "(?i)password|passwd|secret|token|api_?key"),
    Rule("access", ACCESS, 0, 0, 18, "AKIA"),
    Rule("hex", HEX, 0, 0, 16, "[0-9a-f]{16}"),
)


def spans_of(texts: pa.Array) -> list[list[dict]]:
    """Spans of each text, in code points, by start and then kind."""
    found: list[list[tuple]] = [[] for _ in range(len(texts))]
    for order, rule in enumerate(RULES):
        search = re.compile(rule.pattern, rule.flags).finditer
        maybe = pc.match_substring_regex(texts, rule.hint).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(maybe).tolist():
            for m in search(texts[k].as_py()):
                if len(m[rule.group]) >= rule.least:
                    found[k].append((m.start(), order, m.end()))
    return [
        [{"kind": KINDS[o], "start": a, "stop": b} for a, o, b in sorted(spans)] for spans in found
    ]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def scan_new(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows for the blobs of ``docs`` that ``ledger`` lacks in this rule version."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("path"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("blob", blob_id(F.col("text")))
    new = rows.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob")
        new = new.join(known, "blob", "left_anti")
    # one path stands for each unseen blob, found again by a filter so that texts stay put;
    # what the filter lets through besides is dropped by the join on the blob
    new = store(new.withColumn("key", F.xxhash64("blob", "path")), "unseen")
    marked = with_hit(
        rows.withColumn("key", F.xxhash64("blob", "path")), "key", key_filter(new, "key"), "hit"
    )

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("blob"),
                        pa.array(
                            spans_of(part.column("text")),
                            pa.list_(
                                pa.struct(
                                    [("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]
                                )
                            ),
                        ),
                    ],
                    names=["blob", "spans"],
                )

    schema = "blob string, spans array<struct<kind:string,start:long,stop:long>>"
    scanned = marked.filter("hit").select("blob", "text").mapInArrow(scan, schema)
    scanned = scanned.groupBy("blob").agg(F.any_value("spans").alias("spans"))
    scanned = scanned.join(new.select("blob"), "blob")
    return scanned.select("blob", F.lit(RULE_VERSION).alias("rule_version"), "spans")


def scan_documents(
    docs: DataFrame, ledger: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Findings of every path, and the ledger with this run's blobs added.

    ``docs`` needs doc_id (the path) and text; other columns are ignored. The findings are
    doc_id, blob and spans (kind, start, stop in code points, by start and then kind), one row
    per row of ``docs``. NULL text is the empty blob. Repeated rows stay; a NULL doc_id stays
    NULL and its text is scanned as any other. An empty table gives no rows and adds nothing.
    Texts of any length are scanned whole. Pass the ledger of earlier runs to scan only what it
    lacks; a new rule version scans everything once more.
    """
    added = store(scan_new(docs, ledger), "ledger")
    whole = added if ledger is None else ledger.select(added.columns).union(added)
    spans = whole.filter((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0))
    paths = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), blob_id(F.col("text")).alias("blob")
    )
    found = paths.join(spans.select("blob", "spans"), "blob", "left").select(
        "doc_id", "blob", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans")
    )
    return found, whole


def digest(spans: Column) -> Column:
    """kind:start:stop of all spans, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``, and n_chars, if there, made to fit.

    All rows and columns stay. Overlapping spans are replaced as one.
    """
    added = store(scan_new(docs), "ledger")
    spans = added.filter(F.size("spans") > 0).select(F.col("blob").alias("__pl_blob"), F.col("spans").alias("__pl_spans"))
    marked = docs.withColumn("__pl_blob", blob_id(F.col("text")))
    marked = with_hit(marked, "__pl_blob", key_filter(spans, "__pl_blob"), "__pl_hit")
    clear = marked.filter("not __pl_hit").select(docs.columns)
    maybe = marked.filter("__pl_hit").join(spans, "__pl_blob", "left")

    def replace(batches):
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts = batch.column(place).to_pylist()
            for k, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                parts, at = [], 0
                for s in found or ():
                    if s["stop"] <= at:
                        continue
                    if s["start"] >= at:
                        parts += [texts[k][at : s["start"]], mark]
                    at = s["stop"]
                if parts:
                    texts[k] = "".join(parts) + texts[k][at:]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    mended = maybe.select(*docs.columns, "__pl_spans").mapInArrow(replace, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        mended = mended.withColumn("n_chars", F.length("text").cast(kind))
    return clear.union(mended.select(docs.columns))
