"""Counts and base scores against a plain model; what the trained net must do."""

from __future__ import annotations

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from .corpus_rows import documents

from themeweave.llm import language_model, recurrent_model as net
from themeweave.llm.language_model import Lookup, count_tokens, score_documents


def tokens(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", folded), None]


def is_held_out(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def plain(rows):
    counts = Counter(t for i, text in rows if not is_held_out(i) for t in tokens(text))
    total, size = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    for i, text in rows:
        ts = tokens(text)
        base = sum(math.log10((counts[t] + 1) / size) for t in ts)
        yield i, is_held_out(i), len(ts), sum(counts[t] > 0 for t in ts), total, base


@pytest.mark.parametrize("head", [65_536, 40])
def test_counts_and_base(spark, awkward, monkeypatch, head):
    monkeypatch.setattr(language_model, "HEAD_WORDS", head)
    rows = [*awkward, (None, "no id here"), (3, "one"), awkward[-1]]
    got = score_documents(documents(spark, rows)).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, r[5])
    want = sorted(plain(rows), key=order)
    got = sorted((tuple(r) for r in got), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(g[6] < 0 and math.isfinite(g[6]) for g in got)


def test_empty_and_untrained(spark):
    assert score_documents(documents(spark, [])).count() == 0
    only = next(i for i in range(100) if is_held_out(i))
    row = score_documents(documents(spark, [(only, "a b")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
    assert math.isfinite(row.score)


def test_held_out_beats_base(spark):
    text = "the cat sat on the mat and the dog lay by the door "
    rows = [(i, text * 12 + f"w{i % 50}") for i in range(600)]
    held = [r for r in score_documents(documents(spark, rows)).collect() if r.held_out]
    gain = np.mean([(r.score - r.base_score) / r.n_tokens for r in held])
    assert gain > 0.2, gain


def test_scores_do_not_depend_on_the_layout(spark, awkward, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 2500)
    docs = documents(spark, [*awkward, awkward[-1], (None, "no id here")])

    def scores(frame):
        return sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.score) for r in score_documents(frame).collect())

    first, other = scores(docs.repartition(2, "text")), scores(docs.orderBy(F.desc("doc_id")).repartition(7))
    assert [x[:3] for x in first] == [x[:3] for x in other]
    np.testing.assert_allclose([x[3] for x in first], [x[3] for x in other], rtol=1e-5)


def test_gradients_equal_finite_differences(monkeypatch):
    rng = np.random.default_rng(6)
    weights = {k: rng.normal(0, 0.5, shape) for k, shape in net.shapes(3, 4, 5).items()}
    batch = next(net.windows(enumerate([rng.integers(0, 12, n) for n in (3, 20, 9, 1, 30)]), 12))
    grads = {}
    monkeypatch.setattr(net.Network, "_step", lambda self, found, n: grads.update(found))
    net.Network(weights).learn(batch)

    def loss(name, at, by):
        moved = {k: v.copy() for k, v in weights.items()}
        moved[name][at] += by
        return -net.Network(moved).log_probs(batch).sum()

    for name, values in weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in values.shape)
            slope = (loss(name, at, 1e-4) - loss(name, at, -1e-4)) / 2e-4
            assert grads[name][at] == pytest.approx(slope, rel=2e-3, abs=2e-4), (name, at)


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(3)
    weights = net.start_weights(np.arange(1.0, 13.0), 3, 5, 1)
    weights = {k: v + rng.normal(0, 0.4, v.shape).astype(np.float32) for k, v in weights.items()}
    prefix = rng.integers(0, 12, 70)
    whole = [math.exp(sum(x for _, x in net.score(weights, [(0, np.append(prefix, s))]))) for s in range(12)]
    before = math.exp(sum(x for _, x in net.score(weights, [(0, prefix)])))
    assert sum(whole) == pytest.approx(before, rel=1e-4)


def test_state_is_carried_and_lanes_do_not_mix(monkeypatch):
    rng = np.random.default_rng(4)
    weights = net.start_weights(np.ones(12), 3, 5, 2)
    weights = {k: v + rng.normal(0, 0.5, v.shape).astype(np.float32) for k, v in weights.items()}
    texts = [rng.integers(0, 12, n) for n in (1, 32, 33, 200, 64, 5, 97)]

    def totals():
        out = np.zeros(len(texts))
        for i, log in net.score(weights, enumerate(texts)):
            out[i] += log
        return out

    together = totals()
    monkeypatch.setattr(net, "LANES", 2)
    np.testing.assert_allclose(totals(), together, rtol=1e-5)
    monkeypatch.setattr(net, "WINDOW", 500)
    np.testing.assert_allclose(totals(), together, rtol=1e-5)


def test_windows_take_their_memory_again():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 2048, 3 * net.WINDOW) for _ in range(net.LANES)]
    network = net.Network(net.start_weights(np.ones(2048), 32, 24, 1))
    first, *others = net.windows(enumerate(texts), network.start_symbol)
    network.learn(first)
    tracemalloc.start()
    for batch in others:
        network.learn(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 << 20, peak


def test_lanes_that_are_done_stay_out():
    sizes = [3, net.WINDOW, 5 * net.WINDOW + 1, 1, 2 * net.WINDOW] * 60
    texts = [np.arange(n) + i for i, n in enumerate(sizes)]
    found = {i: [] for i in range(len(texts))}
    for batch in net.windows(enumerate(texts), 2048):
        for lane, owner in enumerate(batch.owner):
            assert batch.fresh[lane] == (not found[owner])
            found[owner] += batch.symbols[batch.inside[:, lane], lane].tolist()
    assert [found[i] for i in range(len(texts))] == [t.tolist() for t in texts]


def test_long_documents_cross_the_stretch_a_lane_holds(monkeypatch):
    monkeypatch.setattr(net, "STRETCH", 2 * net.WINDOW)
    sizes = [7 * net.WINDOW + 3, 2 * net.WINDOW, 4 * net.WINDOW, 1] * 90
    texts = [np.arange(n) + 1 for n in sizes]
    found = {i: [] for i in range(len(texts))}
    for batch in net.windows(enumerate(texts), 5000):
        for lane, owner in enumerate(batch.owner):
            before = batch.before[batch.inside[:, lane], lane].tolist()
            assert before == [found[owner][-1] if found[owner] else 5000, *batch.symbols[: len(before) - 1, lane].tolist()]
            found[owner] += batch.symbols[batch.inside[:, lane], lane].tolist()
    assert [found[i] for i in range(len(texts))] == [t.tolist() for t in texts]


def test_words_are_looked_up_where_a_search_finds_them():
    rng = np.random.default_rng(9)
    top = np.iinfo(np.uint64).max
    for n in (1, 2, 3, 1000):
        hashes = np.unique(np.concatenate([rng.integers(0, top, n, np.uint64), np.arange(n // 2, dtype=np.uint64)]))
        wanted = np.concatenate([hashes, hashes + np.uint64(1), rng.integers(0, top, 500, np.uint64), np.array([0, top], np.uint64)])
        expected = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        assert Lookup(hashes).places(wanted).tolist() == expected.tolist()


def test_counting_holds_little_beside_the_text():
    texts = ["".join(rng_word) for rng_word in np.random.default_rng(3).choice(["ab ", "c ", "defgh "], (64, 30_000))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    list(count_tokens(iter([batch])))
    tracemalloc.start()
    n = sum(sum(b.column("n").to_pylist()) for b in count_tokens(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 64 * 30_001
    assert peak < 120 << 20, peak
