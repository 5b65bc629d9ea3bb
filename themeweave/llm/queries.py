"""Registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themeweave.llm import suffix_array, suffix_tree
from themeweave.llm.columns import span_list
from themeweave.llm.decontamination import find_leaks
from themeweave.llm.hard_negatives import ANCHOR_STEP, mine_hard_negatives, whole_numbers
from themeweave.llm.html_extraction import extract_text
from themeweave.llm.language_model import score_documents
from themeweave.llm.minhash_dedup import near_copies
from themeweave.llm.mixing import mix_sources
from themeweave.llm.ngram_join import ngram_components
from themeweave.llm.pii import KINDS, find_pii
from themeweave.llm.quality import quality_rules
from themeweave.llm.secret_scan import scan_secrets
from themeweave.llm.token_alignment import align_tokenizers
from themeweave.runtime import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _digest(spans: str, kinds: tuple[str, ...]) -> Column:
    return F.sha2(span_list(F.filter(spans, lambda s: s["kind"].isin(*kinds))), 256).alias("base_sha256")


def op1_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_text(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("assign", "access", "hex")
    found = scan_secrets(table(spark, sf_dir, "documents"))
    counts = [_count("secrets", kind) for kind in base]
    return found.select("doc_id", *counts, _digest("secrets", base), span_list(F.col("secrets")).alias("spans"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_array.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.withColumnRenamed("key", "doc_id")


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_tree.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [_count("pii", kind) for kind in KINDS]
    return found.select("doc_id", *counts, _digest("pii", KINDS), span_list(F.col("pii")).alias("spans"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source", "copies")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are every fiftieth vector; every seventh has its label moved on by one of ten."""
    rows = whole_numbers(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % ANCHOR_STEP == 0)


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_extract_text": op1_extract_text,
    "op2_secret_scan": op2_secret_scan,
    "op3_suffix_array": op3_suffix_array,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_pii": op6_pii,
    "op7_ngram_join": op7_ngram_join,
    "op8_language_model": op8_language_model,
    "op9_mix_sources": op9_mix_sources,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_minhash_dedup": op13_minhash_dedup,
}
