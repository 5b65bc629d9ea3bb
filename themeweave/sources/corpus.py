from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from themeweave.functions.vectors import uniform
from themeweave.runtime import spread


def corpus_scan(
    table: DataFrame,
    doc_id: str | Column = "doc_id",
    text: str | Column = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Any table as a corpus ``<doc_id, text, *keep>``; a null text counts as empty.

    ``doc_id`` must be unique and gives the document order. Only the named columns
    reach the scan.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    corpus = table.select(
        as_column(doc_id).cast("long").alias("doc_id"),
        F.coalesce(as_column(text), F.lit("")).alias("text"),
        *keep,
    )
    return spread(corpus)


def noise_rows(ids: DataFrame, noise_dim: int, seed: int = 0, id_col: str = "row_id") -> DataFrame:
    """One row of ``noise_dim`` uniform numbers in [0, 1) per id."""
    coordinates = F.transform(
        F.sequence(F.lit(0), F.lit(noise_dim - 1)),
        lambda i: uniform(F.col(id_col), i, F.lit(seed)),
    )
    return ids.select(id_col, coordinates.alias("noise"))
