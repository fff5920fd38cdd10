"""The corpus pipeline: poor texts, near copies, leaked tests and secrets out, then packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postloom.llm.blob_ledger import redact
from postloom.llm.decontaminate import keep_clean
from postloom.llm.frames import store
from postloom.llm.packing import pack_documents
from postloom.llm.quality import keep_good
from postloom.llm.queries import table, tokenizer_path
from postloom.llm.simhash import keep_first


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    return keep_first(docs)


def leaked_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark items."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blots out secrets; all documents stay."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("leaked_tests", leaked_tests),
    ("secrets", secrets),
    ("packing", packing),
]

# A learned classifier, 64-bit text hashes and a tokenizer are beyond SQL; the tests compare
# each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
