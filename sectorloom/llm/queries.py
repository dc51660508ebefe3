"""The queries over the given tables, one for each text operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorloom.llm.byte_bpe import bpe_decode, bpe_encode
from sectorloom.llm.common import table
from sectorloom.llm.embedding_dedup import near_vectors
from sectorloom.llm.html_text import extract_text
from sectorloom.llm.jaccard_join import jaccard_components
from sectorloom.llm.licenses import scan_licenses
from sectorloom.llm.mixing import mix_sources
from sectorloom.llm.oracles import JACCARD, QUALITY, VECTORS
from sectorloom.llm.pii import find_pii
from sectorloom.llm.quality_rules import quality
from sectorloom.llm.sharding import record_size, shard_documents
from sectorloom.llm.toxicity import fit_toxicity, held_out, score_toxicity


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=5, percent=75)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe_decode(bpe_encode(table(spark, sf_dir, "documents")))
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("license.families", ",").alias("families"), "license.n_paragraphs", "license.score")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long")
    return rows.select("doc_id", record_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "pii.n_email", "pii.n_ip", "pii.n_card", "pii.n_phone", F.sha2("pii.base", 256).alias("base_sha256"), "pii.spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_html_text": op3_html_text,
    "op4_license_scan": op4_license_scan,
    "op5_sharding": op5_sharding,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_embedding_dedup": op10_embedding_dedup,
}

#: SQL can't express the seeded hashes and draws, the classifiers, the parsers and the BPE merges; tests hold those against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": JACCARD,
    "op9_quality_rules": QUALITY,
    "op10_embedding_dedup": VECTORS,
}
