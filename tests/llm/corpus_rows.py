"""Rows of the document table for small tests."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text_Length int, size string, kept int"


def rows_of(texts, source="s"):
    """Document rows with two extra columns whose names clash with results."""
    return [(i, t, "en", source, None if t is None else len(t), 1, "x", 5) for i, t in texts]


def documents(spark, texts, source="s"):
    return spark.createDataFrame(rows_of(texts, source), SCHEMA)
