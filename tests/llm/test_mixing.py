"""Targets against a plain reckoning; what the rounding must keep."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from .corpus_rows import SCHEMA, rows_of

from themeweave.llm.mixing import mix_sources


def plain_targets(sizes, weights=(5.0, 2.0, 1.0)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, words = set(), sum(sizes.values())
    while True:
        rest = words - sum(3.0 * sizes[s] for s in full)
        parts = sum(weight[s] for s in order if s not in full)
        share = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / parts for s in order}
        above = {s for s in order if s not in full and share[s] > 3 * sizes[s]}
        if not above:
            return share
        full |= above


def corpus():
    rng = random.Random(8)
    rows, doc = [], 0
    for source, n in ((None, 40), ("a", 700), ("b", 25), ("c", 300), ("É", 3), ("z", 160), ("empty", 2)):
        for _ in range(n):
            size = 0 if source == "empty" else rng.choice([0, 3, 20, 20, 60, 300])
            rows += rows_of([(doc, "w " * size if size else rng.choice([None, " \n"]))], source)
            doc += 1
    return rows + [rows[50], rows[50]]


def test_targets_and_taken_words(spark):
    rows = corpus()
    out = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.source, r.size) for r in out if r.source) == sorted((d, s, size(t)) for d, t, _, s, *_ in rows if s)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    targets = plain_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source], source


def test_reruns_and_layouts_agree(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    taken = lambda frame: sorted((r.doc_id, r.taken) for r in mix_sources(frame).collect())
    assert taken(docs.repartition(3)) == taken(docs.repartition(11, "text"))


def test_awkward_tables(spark, awkward):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = rows_of([*awkward, awkward[-1], (None, "no id")])
    assert mix_sources(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)
