"""The queries opN_<name> over whole tables, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.llm import bpe, license_scan, line_dedup, minhash, mixing, oracle, quality_classifier, quality_rules, simhash, token_orc, toxicity
from shelfgraph.llm.shared import map_batches


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs, bpe.digests(tokenizer_path("word_bpe_49k.json")), schema)


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_digests(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.sha2("text", 256).alias("text_sha256"))


def _fold(m: int):
    """crc32 of the id as text, mod m; rows without an id are in no held-out fold, and no label is theirs."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(m))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, share = toxicity.training_rows(docs, labels.where(_fold(4) != 2), "toxic")
    model = toxicity.fit([t for t, _ in rows], [y for _, y in rows], share=share)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_classifier.score_documents(docs, labels.where(_fold(5) != 0))
    return scored.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_minhash_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_with_next(_documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score_documents(_documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle_sql(), "op10_quality_rules": oracle.quality_rules_sql()}
