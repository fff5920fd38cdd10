"""The registered queries of this subpackage, with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import quality, toxicity
from postloom.llm.blob_ledger import digest, scan_documents
from postloom.llm.classify import remainder
from postloom.llm.decontaminate import contaminated
from postloom.llm.imatch import document_fingerprints
from postloom.llm.packing import pack_documents
from postloom.llm.pages import extract_pages
from postloom.llm.repeats import remove_repeats
from postloom.llm.simhash import hexadecimal, simhash_components
from postloom.llm.token_files import token_file_round_trip
from postloom.llm.turns import repair_conversations
from postloom.llm.variants import spelling_variants
from postloom.llm.vector_links import link_vectors
from postloom.session import use_utc

VOCABULARY = 49_408
Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_file_round_trip(docs, tokenizer_path(), VOCABULARY)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return _judged(scored, "quality_score", quality)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal("bits").alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan_documents(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.withColumn("spans_text", digest(F.col("spans"))).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.col("spans_text").cast("binary"), 256).alias("base_sha256"),
        F.col("spans_text").alias("spans"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return cut.select("doc_id", "n_words", "n_removed", digest)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return _judged(scored, "toxic_score", toxicity)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def _judged(scored: DataFrame, score: str, kind) -> DataFrame:
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), kind.FOLDS) == kind.HELD_OUT).alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= kind.THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_files": op2_token_files,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_main_text": op6_main_text,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_secret_ledger": op8_secret_ledger,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_conversation_repair": op13_conversation_repair,
}

# All pairs of a label, closed by a recursion.
VECTOR_LINKS_SQL = """
with recursive e as (
    select vec_id, label, embedding::double[] as v from embeddings
    where label is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs as (
    select a.vec_id as a, b.vec_id as b
    from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where list_cosine_similarity(a.v, b.v) >= 0.98
),
reach(node, root) as (
    select vec_id, vec_id from embeddings
    union
    select pairs.b, reach.root from reach join pairs on pairs.a = reach.node
    where reach.root < pairs.b
),
links as (select a as vec_id, count(*) as n from pairs group by a),
roots as (select node as vec_id, min(root) as root from reach group by node)
select vec_id, coalesce(n, 0)::bigint as n_links, root::bigint as component_id,
       vec_id = root as kept
from embeddings left join links using (vec_id) join roots using (vec_id)
"""

# A row per window of 50 words.
REPEATS_SQL = r"""
with d as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
),
starts as (select doc_id, words, unnest(range(1, len(words) - 48)) as i from d),
windows as (select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as h from starts),
firsts as (select h, min(doc_id) as least from windows group by h),
gone as (
    select doc_id, list(distinct p) as gone
    from (
        select doc_id, unnest(range(i, i + 50)) as p
        from windows join firsts using (h) where least < doc_id
    )
    group by doc_id
),
kept as (
    select doc_id, len(words) as n, coalesce(len(gone), 0) as n_gone,
           list_filter(words, lambda w, p: gone is null or not list_contains(gone, p)) as words
    from d left join gone using (doc_id)
)
select doc_id, n::bigint as n_words, n_gone::bigint as n_removed,
       sha256(array_to_string(words, ' ')) as kept_sha256
from kept
"""

# The others tokenize, learn, tile, or hash by XXH64 or CRC-32, which DuckDB does not offer.
ORACLES: dict[str, str] = {
    "op7_vector_dedup": VECTOR_LINKS_SQL,
    "op9_substring_dedup": REPEATS_SQL,
}
