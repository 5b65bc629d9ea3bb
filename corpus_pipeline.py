"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from themeweave.llm.decontamination import drop_leaks
from themeweave.llm.mixing import mix_sources
from themeweave.llm.ngram_join import ngram_components
from themeweave.llm.quality import keep_good
from themeweave.llm.queries import table
from themeweave.llm.secret_scan import redact_secrets
from themeweave.runtime import new_run_folder, store, without_keys


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, and what has no id or no words."""
    groups = ngram_components(docs).where("doc_id != component_id").select("doc_id").distinct()
    copies = store(groups, f"{new_run_folder(spark)}/copies")
    return without_keys(docs, copies, "doc_id").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets."""
    clean = F.col("_redacted")
    length = F.length(clean).cast(docs.schema["n_chars"].dataType)
    out = redact_secrets(docs, "_redacted").withColumns(
        {"text": F.coalesce(clean, F.col("text")), "n_chars": F.when(clean.isNotNull(), length).otherwise(F.col("n_chars"))}
    )
    return out.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix takes."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("mixing sources", mixing_stage),
]

#: SQL can't express the hashed ratios and the seeded draws; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``."""
    folder = new_run_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = store(stage(spark, docs, sf_dir), f"{folder}/stage-{number}")
    return docs
