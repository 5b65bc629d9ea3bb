"""Joins on keys that a third of all rows may share."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, functions as F

#: Most keys that are looked up by broadcast: those with at least one in so many of all rows.
HOT_KEYS = 1000


def join_weighted(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` joined to a table with one row per key, whose ``weight`` counts the key's rows.

    Keys with at least ``total / HOT_KEYS`` rows are at most ``HOT_KEYS``, so their part of the table is
    broadcast. All others meet in a shuffle, where no key has more than that share. ``rows`` is
    read twice, so pass a written table or little work on one.
    """
    limit = max(1, ceil(total / HOT_KEYS))
    hot = F.broadcast(table.where(F.col(weight) >= limit))
    others = rows.join(F.broadcast(table.where(F.col(weight) >= limit).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(others.join(table.where(F.col(weight) < limit), keys))
