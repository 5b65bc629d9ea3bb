"""Alignment against the plain recurrence, and planted copies of benchmark items."""

from __future__ import annotations

import random

import numpy as np
from .corpus_rows import documents

from themeweave.llm import decontamination as dc

ITEMS = "item_id long, text string, score int"


def plain_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            step = dc.SAME if x == y else dc.OTHER
            h[i][j] = max(0, h[i - 1][j - 1] + step, h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
    return max(map(max, h))


def test_alignment_equals_the_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(1, 25)) for _ in range(2))
        score, first, last = dc.align(a, b)
        assert score == plain_score(a, b)
        assert plain_score(a, b[first:last]) == score


def planted(seed=2):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(900)]
    items = [[rng.choice(words) for _ in range(rng.randint(20, 50))] for _ in range(12)]
    texts, holds = [], set()
    for doc in range(120):
        body = [rng.choice(words) for _ in range(rng.randint(5, 300))]
        if doc % 3 == 0:
            k = doc % 12
            copy = list(items[k])
            for _ in range(doc % 4):
                copy[rng.randrange(len(copy))] = "changed"
            if doc % 2:
                copy.insert(9, "inserted")
            body[3:3] = [w.upper() + "," for w in copy]
            holds.add((doc, k))
        texts.append((doc, " ".join(body)))
    return texts, [(k, " ".join(i), 0) for k, i in enumerate(items)], holds


def test_planted_copies(spark, monkeypatch):
    texts, items, holds = planted()
    docs, benchmark = documents(spark, texts), spark.createDataFrame(items, ITEMS)
    found = {(r.key, r.item_id) for r in dc.find_leaks(docs, benchmark).collect()}
    assert found == holds
    monkeypatch.setattr(dc, "BLOCK_GRAMS", 100)
    assert {(r.key, r.item_id) for r in dc.find_leaks(docs, benchmark).collect()} == holds
    kept = dc.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - {d for d, _ in holds}


def test_awkward_rows(spark, awkward):
    docs = documents(spark, awkward + [(None, "a short item of words"), (None, "A short item, of words!"), (None, None)])
    items = [(1, None, 0), (2, "", 0), (None, "short item of words", 0), (3, "one", 0), (3, "one", 0), (4, awkward[6][1], 0)]
    benchmark = spark.createDataFrame(items, ITEMS)
    found = [(r.key, r.item_id) for r in dc.find_leaks(docs, benchmark).collect()]
    assert found.count((None, None)) == 2 and (6, 4) in found and (7, 4) in found and (3, 3) in found
    assert dc.find_leaks(documents(spark, []), benchmark).count() == 0
    none = dc.drop_leaks(docs, spark.createDataFrame([], ITEMS))
    assert none.count() == docs.count()
