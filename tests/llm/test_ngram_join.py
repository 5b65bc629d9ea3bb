"""Groups of linked n-gram sets against comparison of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from .corpus_rows import documents

from themeweave.llm import ngram_join


def shingles(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = lower.split()
    k = min(3, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def plain_components(texts, percent=90):
    sets = {d: shingles(t) for d, t in texts}
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def found(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def chained(seed=3):
    """Near copies at every distance, and a chain whose ends don't link."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(150)]
    texts, now = [], list(base)
    for step in range(40):
        now = list(now)
        now[rng.randrange(len(now))] = f"edit{step}"
        texts.append(" ".join(now))
    for edits in range(0, 12):
        copy = list(base)
        for at in rng.sample(range(150), edits):
            copy[at] = f"other{edits}-{at}"
        texts += [" ".join(copy), " ".join(copy[: 150 - edits])]
    rng.shuffle(texts)
    return texts


def test_awkward_texts(spark, awkward):
    texts = awkward + list(enumerate(chained(), start=1000))
    assert found(ngram_join.ngram_components(documents(spark, texts))) == plain_components(texts)


def test_repeated_rows_missing_ids_and_empty_table(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text), (5, text), (7, text), (None, text), (None, None), (9, None)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(documents(spark, rows)).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == [(None, 0, None), (None, 38, None), (5, 38, 5), (5, 38, 5), (7, 38, 5), (9, 0, 9)]
    assert ngram_join.ngram_components(documents(spark, [])).count() == 0


@pytest.mark.parametrize("percent", [60, 90])
def test_tree_equals_plain_comparison(percent):
    rng = np.random.default_rng(4)
    for _ in range(300):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(12)]
        pivot, members = sets[0], list(enumerate(sets[1:]))
        plain = [i for i, s in members if 100 * len(np.intersect1d(pivot, s)) >= percent * len(np.union1d(pivot, s))]
        assert sorted(ngram_join.links_of_pivot(pivot, members, percent)) == plain


def test_parity_maps_never_refuse_a_link():
    rng = np.random.default_rng(5)
    for _ in range(300):
        whole = rng.integers(0, 1 << 63, rng.integers(1, 700)).astype(np.uint64)
        a, b = (np.unique(whole[rng.random(len(whole)) < share]) for share in (0.97, rng.random()))
        unlike = len(np.setxor1d(a, b))
        assert ngram_join.map_distance(ngram_join.parity_map(a), ngram_join.parity_map(b)) <= unlike
        needed = 100 * len(np.intersect1d(a, b)) >= 90 * max(1, len(np.union1d(a, b)))
        near = ngram_join.near_by_maps((len(a), ngram_join.parity_map(a)), [(7, len(b), ngram_join.parity_map(b))], 90)
        assert near == [7] or not needed


@pytest.mark.parametrize("rows_a_batch", [7, 1000])
def test_unlike_sets_of_one_shingle_make_no_rows(rows_a_batch):
    rng = np.random.default_rng(6)
    rows, linked = [], set()
    for token in (-3, 5, 9):
        base = np.unique(rng.integers(0, 1 << 63, 420).astype(np.uint64))
        sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(380, 420)).astype(np.uint64)) for _ in range(150)]
        sets += [base[4:], base[:-3], base[:-1], base[:8]]
        for k, s in enumerate(sets):
            node = token * 1000 + k
            # the last but one is of the first one's group, so they need no look
            rows.append((token, token * 1000 + min(k, 150) if k == 152 else node, node, len(s), 0, ngram_join.parity_map(s)))
        first, second, third = (token * 1000 + k for k in (150, 151, 152))
        linked |= {(first, second), (second, third)}
    rows.sort(key=lambda r: r[:3])
    names = ["token", "label", "node", "n", "place", "content"]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
    arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    table = pa.Table.from_arrays(arrays, names=names)
    got = [p for b in ngram_join._group_pairs(90)(iter(table.to_batches(rows_a_batch))) for p in zip(*b.to_pydict().values(), strict=True)]
    assert {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in linked}


def test_nearest_pairs_of_a_shingle_are_no_more_than_two_a_row():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    sets = [np.delete(base, rng.integers(0, 400, 3)) for _ in range(120)]
    columns = [[5] * 120, range(120), range(120), [len(s) for s in sets], [0] * 120, [ngram_join.parity_map(s) for s in sets]]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
    batch = pa.RecordBatch.from_arrays(arrays, names=["token", "label", "node", "n", "place", "content"])

    def pairs(nearest):
        return [p for b in ngram_join._group_pairs(90, nearest)(iter([batch])) for p in zip(*b.to_pydict().values(), strict=True)]

    assert len(pairs(False)) == 120 * 119 // 2
    assert len(pairs(True)) <= 2 * 120 and {k for p in pairs(True) for k in p} == set(range(120))


def test_short_maps_are_half_as_long_and_lose_no_pair():
    rng = np.random.default_rng(4)
    for n in (3, 200, 400, 700, 3000):
        one = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        other = np.unique(np.concatenate([one[n // 12 :], rng.integers(0, 1 << 63, n // 20, np.uint64)]))
        apart = len(np.setxor1d(one, other))
        maps = [ngram_join.parity_map(x) for x in (one, other)]
        short = [ngram_join.short_map(x) for x in maps]
        assert [len(x) for x in short] == [max(32, len(x) // 2) for x in maps]
        assert ngram_join.map_distance(*short) <= ngram_join.map_distance(*maps) <= apart
