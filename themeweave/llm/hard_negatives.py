"""Hard negatives: for anchors and their positives, the best rows of other labels inside a window of scores.

Vectors become whole numbers, so scores are exact inner products and ties are real. Anchors and
candidates are dealt into blocks, and every pair of blocks is one tile:

1. A tile's scores are one product of int64 matrices by Strassen's recursion. Odd sizes are padded with
   zeros. Its additions may wrap around in 64 bits; the scores fit, so they come out exact.
2. First pass: each tile keeps the best ``positives`` candidates of an anchor's own label.
3. Second pass: each tile keeps, per anchor and positive score, the best ``negatives`` candidates of other
   labels within the window.
4. The short lists of all tiles are merged by rank; each task merges what it holds before rows are shuffled.

A pair of blocks moves ``2 / BLOCK`` rows per score, far less than the product costs, at any size.

Defined results: rows with a null label, a null vector or a component that is null or not finite take no
part. Every other row stands for itself: equal rows and rows with the same id are candidates and
anchors one by one, and "other rows" leaves out the row itself only. A null id is no anchor and comes after
all ids in a tie. Shorter vectors count as padded with zeros. Equal scores go by id. An empty table, or one
without anchors, gives no rows. Extra columns are not used. If a score could leave 64 bits, the
call fails with a message before any tile is worked on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from themeweave.runtime import new_run_folder, store

SCALE, ANCHOR_STEP, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: Window of negative scores, in percent of the positive score.
LOW_PERCENT, HIGH_PERCENT = 50, 95
#: Rows of a block of candidates or anchors.
BLOCK = 8192
#: Anchors of a tile scored at a time.
STRIP = 512
#: A matrix with a side no longer than this is multiplied directly.
LEAF = 16
#: Ends of a tie: an id that is null.
NO_ID = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min

TOP = "row long, vec_id long, score long, other long"
IN_WINDOW = "row long, positive_score long, score long, other long"


def _even(x: np.ndarray) -> np.ndarray:
    """Zeros added so that both sides can be halved."""
    rows, columns = (n % 2 for n in x.shape)
    return np.pad(x, ((0, rows), (0, columns))) if rows or columns else x


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` in int64, by seven products of halves instead of eight."""
    m, n = len(a), len(b)
    if min(m, n, a.shape[1]) <= LEAF:
        return a @ b.T
    a, b = _even(a), _even(b)
    i, j, k = len(a) // 2, len(b) // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    # b is held transposed: its rows are the columns of the product
    b11, b21, b12, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * j), dtype=np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def best(scores: np.ndarray, allowed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``count`` highest allowed scores of each row; in a tie the first column."""
    left = np.where(allowed, scores, LOWEST)
    every = np.arange(len(left))
    rows, columns = [], []
    for _ in range(min(count, left.shape[1])):
        at = left.argmax(axis=1)
        found = left[every, at] != LOWEST
        rows.append(every[found])
        columns.append(at[found])
        left[every, at] = LOWEST
    return np.concatenate(rows or [every[:0]]), np.concatenate(columns or [every[:0]])


class Block:
    """Rows of one side of a tile, by id."""

    def __init__(self, table: pa.Table, width: int):
        column = lambda name: table.column(name).to_numpy().astype(np.int64)
        vec_id = table.column("vec_id").fill_null(NO_ID).to_numpy().astype(np.int64)
        order = np.lexsort((column("row"), vec_id))
        self.row, self.vec_id, self.label = column("row")[order], vec_id[order], column("label")[order]
        lists = table.column("x").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        x = np.zeros((len(sizes), max(1, width)), dtype=np.int64)
        filled = np.arange(x.shape[1]) < sizes[:, None]
        x[filled] = lists.flatten().to_numpy(zero_copy_only=False)
        self.x, self.order = x[order], order


def _width(*tables: pa.Table) -> int:
    lengths = [t.column("x").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) for t in tables]
    return int(max((n.max() for n in lengths if len(n)), default=0))


def _table(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts) if parts else [[]] * 4)]
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(names, columns)})


def _top_of_tile(positives: int):
    def work(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        parts, width = [], _width(candidates, anchors)
        if candidates.num_rows and anchors.num_rows:
            these, those = Block(candidates, width), Block(anchors, width)
            for label in np.unique(those.label):
                mine, all_anchors = np.flatnonzero(these.label == label), np.flatnonzero(those.label == label)
                for at in range(0, len(all_anchors), STRIP):
                    who = all_anchors[at : at + STRIP]
                    scores = strassen(those.x[who], these.x[mine])
                    i, j = best(scores, those.row[who][:, None] != these.row[mine], positives)
                    parts.append((those.row[who[i]], those.vec_id[who[i]], scores[i, j], these.vec_id[mine[j]]))
        return _table(parts, ["row", "vec_id", "score", "other"])

    return work


def _window_of_tile(negatives: int):
    def work(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        parts, width = [], _width(candidates, anchors)
        if candidates.num_rows and anchors.num_rows:
            these, those = Block(candidates, width), Block(anchors, width)
            wanted = [anchors.column("wanted")[int(i)].as_py() for i in those.order]
            deepest = max(map(len, wanted))
            for at in range(0, len(those.row), STRIP):
                who = np.arange(at, min(at + STRIP, len(those.row)))
                scores = strassen(those.x[who], these.x)
                other = those.label[who][:, None] != these.label
                for k in range(deepest):
                    has = np.array([len(wanted[i]) > k for i in who])
                    score = np.array([wanted[i][k] if len(wanted[i]) > k else 0 for i in who], dtype=np.int64)[:, None]
                    inside = (LOW_PERCENT * score <= 100 * scores) & (100 * scores <= HIGH_PERCENT * score)
                    i, j = best(scores, other & inside & has[:, None], negatives)
                    parts.append((those.row[who[i]], score[i, 0], scores[i, j], these.vec_id[j]))
        return _table(parts, ["row", "positive_score", "score", "other"])

    return work


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``<vec_id, label, x>`` of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    taking_part = vectors.where("label IS NOT NULL AND embedding IS NOT NULL").where(~bad)
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c))
    return taking_part.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("x"))


def _check_range(rows: DataFrame) -> None:
    largest = F.aggregate("x", F.lit(0.0), lambda acc, c: F.greatest(acc, F.abs(c.cast("double"))))
    found = rows.agg(F.max(largest).alias("largest"), F.max(F.size("x")).alias("width")).first()
    if found.width and 100.0 * found.width * found.largest**2 >= 2.0**62:
        raise ValueError(f"vectors of {found.width} components up to {found.largest:,.0f} have scores beyond 64 bits")


def _dealt(rows: DataFrame, into: Column | int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(into)).cast("int")


def _numbers(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def _tiles(candidates: DataFrame, anchors: DataFrame, chunks: int, blocks: int, work, schema: str) -> DataFrame:
    """Every chunk of candidates with every block of anchors, each pair in a group of its own."""
    left = candidates.select("*", _dealt(candidates, chunks).alias("chunk"), _numbers(blocks).alias("block"))
    right = anchors.select("*", _dealt(anchors, blocks).alias("block"), _numbers(chunks).alias("chunk"))
    key = ("chunk", "block")
    sides = [side.repartition(chunks * blocks, *key).groupBy(*key) for side in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(work, schema)


def _merged(lists: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The best ``count`` of the short lists of all tiles, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine_hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    block: int = BLOCK,
    folder: str | None = None,
) -> DataFrame:
    """``<anchor_id, positive_id, rank, negative_id, positive_score, negative_score>``.

    ``vectors`` is ``<vec_id, label, x>`` with whole numbers, ``anchor`` a condition on ``vec_id``.
    """
    folder = folder or new_run_folder(vectors.sparkSession)
    _check_range(vectors)
    rows = store(vectors.select(F.monotonically_increasing_id().alias("row"), "*"), f"{folder}/rows")
    anchors = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows").where(anchor)  # a side of its own
    counted = rows.agg(F.count("*").alias("n"), F.count(F.when(anchor, 1)).alias("anchors")).first()
    chunks, blocks = (max(1, -(-n // block)) for n in (counted.n, counted.anchors))

    tops = _tiles(rows, anchors, chunks, blocks, _top_of_tile(positives), TOP)
    best_rows = store(_merged(tops, ["row"], positives).drop("rank"), f"{folder}/positives")
    wanted = best_rows.groupBy("row").agg(F.array_sort(F.collect_set("score")).alias("wanted"))
    found = _tiles(rows, anchors.join(wanted, "row"), chunks, blocks, _window_of_tile(negatives), IN_WINDOW)
    inside = _merged(found, ["row", "positive_score"], negatives)
    real = lambda name: F.when(F.col(name) != NO_ID, F.col(name))
    pairs = best_rows.select(
        "row", F.col("vec_id").alias("anchor_id"), real("other").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return pairs.join(inside, ["row", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", real("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
