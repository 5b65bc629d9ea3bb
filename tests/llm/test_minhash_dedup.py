"""Near copies against comparison of all pairs; sketches against what they promise."""

from __future__ import annotations

import random

import numpy as np
import pytest

from themeweave.llm import minhash_dedup
from themeweave.llm.hot_keys import join_weighted
from themeweave.llm.minhash_dedup import BINS, bands, near_copies, set_name, sketch

from .corpus_rows import documents
from .test_ngram_join import chained, plain_components


def found(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def expected(texts):
    return {d: (n, c, d == c) for d, (n, c) in plain_components(texts, 85).items()}


def drawn_set(rng, n):
    return rng.integers(1, 1 << 62, n).astype(np.uint64)


@pytest.mark.parametrize("n", [1, 2, 7, 40, 128, 900, 20_000])
def test_every_coordinate_is_filled(n):
    rng = np.random.default_rng(n)
    one = sketch([drawn_set(rng, n)])
    assert one.shape == (1, BINS) and (one != minhash_dedup._EMPTY).all()


def test_a_sketch_depends_on_its_set_alone():
    rng = np.random.default_rng(1)
    sets = [drawn_set(rng, n) for n in (3, 50, 5000)]
    together = sketch(sets)
    for k, s in enumerate(sets):
        assert (sketch([s[::-1]])[0] == together[k]).all()


@pytest.mark.parametrize("size", [20, 200, 3000])
@pytest.mark.parametrize("share", [0.3, 0.85])
def test_equal_coordinates_estimate_the_similarity(size, share):
    rng = np.random.default_rng(size)
    errors = []
    for _ in range(60):
        items = drawn_set(rng, size)
        cut = round(size * share)
        a, b = sketch([items[: (size + cut) // 2], np.concatenate([items[:cut], items[(size + cut) // 2 :]])])
        errors.append((a == b).mean() - cut / size)
    assert abs(np.mean(errors)) < 0.03
    assert np.max(np.abs(errors)) < 5 * np.sqrt(share * (1 - share) / BINS) + 0.02


def test_similar_sets_always_share_a_band_and_look_alike():
    rng = np.random.default_rng(4)
    for size in (7, 20, 100, 700):
        for _ in range(100):
            items = drawn_set(rng, size)
            pair = sketch([items, items[: -max(1, int(0.15 * size))]])
            keys = bands(pair)
            assert (keys[0] == keys[1]).any()
            assert (pair[0].astype(np.uint8) == pair[1].astype(np.uint8)).sum() >= minhash_dedup.LIKELY


def test_leading_bits_never_count_too_few(monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SHORT_SET", 100)
    rng = np.random.default_rng(6)
    sets = [np.unique(drawn_set(rng, n)) for n in (3, 60, 90, 100, 101, 130, 700)]
    sets += [np.unique(np.concatenate([sets[3][:80], drawn_set(rng, n)])) for n in (10, 20, 60)]
    short = [minhash_dedup.leading_bits(s) for s in sets]
    assert {s.dtype for s in short} == {np.dtype(np.uint16), np.dtype(np.uint32)}
    for i, one in enumerate(sets):
        counts = minhash_dedup.most_shared(short[i], short)
        for other, count in zip(sets, counts):
            assert len(np.intersect1d(one, other)) <= count <= len(other)
        assert counts[i] == len(one)


def test_names_of_sets():
    a = np.array([1, 2, 3], dtype=np.uint64)
    assert set_name(a) == set_name(a[::-1]) != set_name(a[:2])


def test_chains_equal_all_pairs(spark):
    texts = [(10 * i + 3, t) for i, t in enumerate(chained())]
    assert found(near_copies(documents(spark, texts).repartition(4))) == expected(texts)


@pytest.mark.parametrize("tile", [4, 1024])
def test_groups_that_share_buckets_equal_all_pairs(spark, monkeypatch, tile):
    """Many texts around one passage: most pairs are below the limit, some above."""
    monkeypatch.setattr(minhash_dedup, "TILE", tile)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    rng = random.Random(tile)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for i in range(60):
        own = [f"o{i}-{k}" for k in range(rng.choice([2, 4, 8, 12, 30]))]
        texts.append((i, " ".join(passage[rng.randrange(3) :] + own)))
    texts += [(100 + i, texts[i % 7][1].upper()) for i in range(20)]
    assert found(near_copies(documents(spark, texts).repartition(4))) == expected(texts)


def test_awkward_texts_equal_all_pairs(spark, awkward):
    assert found(near_copies(documents(spark, awkward).repartition(5))) == expected(awkward)


def test_missing_and_repeated_ids(spark):
    texts = [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (None, "only here now"), (None, None), (7, "x y"), (7, "a b c d")]
    rows = sorted(near_copies(documents(spark, texts)).collect(), key=str)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows]
    want = [(4, 2, 4, True), (4, 2, 4, True), (7, 2, 4, False), (None, 2, 4, False), (None, 1, None, True), (None, 0, None, True), (7, 1, 7, True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert near_copies(documents(spark, [])).count() == 0


def test_weighted_join_keeps_every_row(spark):
    rows = spark.range(5000).selectExpr("IF(id < 3000, 1, id) AS k", "id")
    table = rows.groupBy("k").count().where("k % 3 != 0")
    got = join_weighted(rows, table, ["k"], "count", 5000)
    assert got.count() == rows.join(table, "k").count()
    assert got.select("id").distinct().count() == got.count()
