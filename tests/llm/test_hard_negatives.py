"""Hard negatives against all pairs in plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeweave.llm.hard_negatives import LEAF, best, mine_hard_negatives, strassen, whole_numbers

SCHEMA = "vec_id long, embedding array<float>, label int, row int, x string, score double"


@pytest.mark.parametrize("m,n,k", [(1, 1, 1), (3, 70, 64), (65, 130, 64), (40, 41, 39), (129, 257, 33), (20, 2, 1)])
def test_strassen_is_exact(m, n, k):
    rng = np.random.default_rng(m * n)
    a, b = (rng.integers(-(1 << 20), 1 << 20, (rows, k)) for rows in (m, n))
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
    assert strassen(a, b).tolist() == want
    assert m <= LEAF or strassen(a, b).dtype == np.int64


def test_wrapping_additions_still_give_exact_scores():
    a = np.full((64, 64), 1 << 28, dtype=np.int64)
    assert (strassen(a, a) == 64 << 56).all()


def test_ties_take_the_first_columns():
    scores = np.array([[5, 7, 7, 7], [1, 1, 1, 1]])
    allowed = np.array([[True, True, False, True], [False, False, True, False]])
    rows, columns = best(scores, allowed, 2)
    assert sorted(zip(rows.tolist(), columns.tolist())) == [(0, 1), (0, 3), (1, 2)]


def brute(rows, positives, negatives):
    """Rows ``(vec_id, vector, label)`` as the result's tuples, sorted."""
    finite = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and finite(v)]
    by_score = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))
    out = []
    for at, (anchor, a, label) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        scored = [(sum(p * q for p, q in zip(a, v)), i, y) for k, (i, v, y) in enumerate(kept) if k != at]
        for score, positive, _ in by_score([s for s in scored if s[2] == label])[:positives]:
            window = [s for s in scored if s[2] != label and 50 * score <= 100 * s[0] <= 95 * score]
            for rank, (negative_score, negative, _) in enumerate(by_score(window)[:negatives], 1):
                out.append((anchor, positive, rank, negative, score, negative_score))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(out, key=key), key


def check(spark, rows, **how):
    table = spark.createDataFrame([(i, v, y, 1, "x", 0.0) for i, v, y in rows], SCHEMA)
    found = mine_hard_negatives(whole_numbers(table.repartition(5)), F.col("vec_id") % 50 == 0, **how)
    want, key = brute(rows, how.get("positives", 5), how.get("negatives", 3))
    assert sorted([tuple(r) for r in found.collect()], key=key) == want
    return want


@pytest.mark.parametrize("block", [7, 64, 8192])
def test_equals_all_pairs(spark, block):
    rng = random.Random(block)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], rng.choice([0, 0, 0, 1, 2])) for i in range(0, 800, 5)]
    assert check(spark, rows, block=block)


def test_ties_repeats_and_broken_rows(spark):
    same = [0.5, 0.25, 0.125]
    rows = [(i, same, i % 3) for i in range(0, 300, 10)]  # every score ties
    rows += [(i, [0.4, 0.2, 0.1], 7) for i in range(1, 40)] + [(50, same, 2), (50, same, 2), (100, [0.5, 0.5, 0.5], 1)]
    rows += [(None, same, 0), (None, [0.4, 0.3, 0.1], 1), (150, None, 0), (200, same, None), (250, [], 1), (3, [0.5], 1)]
    rows += [(350, [0.1, None, 0.2], 1), (400, [float("nan"), 0.0, 0.0], 1), (450, [float("inf"), 0.0, 0.0], 1)]
    assert check(spark, rows, block=11)


def test_nothing_to_mine(spark):
    assert check(spark, []) == []
    assert check(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert check(spark, [(0, [1.0], 0)]) == []
    assert check(spark, [(0, [], 0), (1, [], 0), (2, [], 1)]) == [(0, 1, 1, 2, 0, 0)]


def test_scores_beyond_64_bits_are_refused(spark):
    table = spark.createDataFrame([(0, [1e30], 0, 1, "x", 0.0)], SCHEMA)
    with pytest.raises(ValueError, match="64 bits"):
        mine_hard_negatives(whole_numbers(table), F.col("vec_id") % 50 == 0)
