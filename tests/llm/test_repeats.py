"""Byte and word repeats against plain enumeration of all windows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from .corpus_rows import documents

from themeweave.llm import hashing, seeds, suffix_array, suffix_tree


def plain_bytes(texts, width):
    first, out = {}, {}
    for doc, text in sorted(texts):
        raw = (text or "").encode()
        for p in range(len(raw) - width + 1):
            first.setdefault(raw[p : p + width], (doc, p))
    for doc, text in texts:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - width + 1):
            if first[raw[p : p + width]] < (doc, p):
                gone[p : p + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def plain_words(texts, width):
    first, out = {}, {}
    split = {doc: (text or "").encode().split() for doc, text in texts}
    for doc in sorted(split):
        w = split[doc]
        for p in range(len(w) - width + 1):
            first.setdefault(tuple(w[p : p + width]), doc)
    for doc, w in split.items():
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < doc:
                gone[p : p + width] = [True] * width
        out[doc] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def found_bytes(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in frame.collect()}


def found_words(frame):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in frame.collect()}


def test_bytes_equal_enumeration(spark, awkward):
    found = found_bytes(suffix_array.remove_repeats(documents(spark, awkward)))
    assert found == plain_bytes(awkward, 100)


def test_words_equal_enumeration(spark, awkward):
    found = found_words(suffix_tree.remove_repeats(documents(spark, awkward)))
    assert found == plain_words(awkward, 13)


@pytest.mark.parametrize("most", [2, 5])
def test_anchors_with_many_variants(spark, awkward, monkeypatch, most):
    """The way for anchors with many different surroundings gives the same result."""
    plain = seeds.mark_rows
    monkeypatch.setattr(seeds, "mark_rows", lambda same: plain(same, most))
    docs = documents(spark, awkward)
    assert found_bytes(suffix_array.remove_repeats(docs)) == plain_bytes(awkward, 100)
    assert found_words(suffix_tree.remove_repeats(docs)) == plain_words(awkward, 13)


def test_repeated_rows_and_missing_ids(spark):
    text = "the same sentence of more than a hundred characters stands here, and it goes on until it is long enough to count"
    rows = [(1, text), (1, text), (2, text), (None, "other " + text), (None, None)]
    frame = suffix_array.remove_repeats(documents(spark, rows))
    found = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in frame.collect())
    n = len(text)
    assert found == [(-1, 0, 0), (-1, n + 6, 0), (1, n, n), (1, n, n), (2, n, n)]
    words = sorted((r.doc_id or -1, r.n_removed) for r in suffix_tree.remove_repeats(documents(spark, rows)).collect())
    k = len(text.split())
    assert words == [(-1, 0), (-1, 0), (1, k), (1, k), (2, k)]


def test_different_texts_under_one_id(spark):
    first = " ".join(f"word{k} stands" for k in range(40))
    other = " ".join(f"unlike{k} holds" for k in range(40))
    frame = documents(spark, [(1, first), (2, first), (2, other)])
    gone = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_array.remove_repeats(frame).collect()}
    assert gone == {(1, len(first)): 0, (2, len(first)): len(first), (2, len(other)): 0}
    words = sorted((r.doc_id, r.kept) for r in suffix_tree.remove_repeats(frame).collect())
    assert words == [(1, first), (2, ""), (2, other)]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert suffix_array.remove_repeats(docs).count() == 0
    assert suffix_tree.remove_repeats(docs).count() == 0


def test_suffix_order_is_the_sorted_order():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 30))) for _ in range(40)] + [b"aaaa", b"aaaa", b""]
    text, offset, common = suffix_array.suffix_order(texts)
    expected = sorted((texts[t][o:] , t, o) for t in range(len(texts)) for o in range(len(texts[t]) + 1))
    # the end mark is smaller than any byte, as the end of a string is in Python
    assert [(texts[t][o:]) for t, o in zip(text, offset)] == [s for s, _, _ in expected]
    for k in range(1, len(text)):
        a, b = texts[text[k - 1]][offset[k - 1] :], texts[text[k]][offset[k] :]
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        assert common[k] == same


def test_subtrees_of_prefix_groups():
    rng = np.random.default_rng(1)
    suffixes = rng.integers(0, 3, size=(2000, 13))
    groups = suffix_tree.split_by_prefix(suffixes, 50)
    assert sorted(np.concatenate(groups)) == list(range(2000))
    seen = set()
    for rows in groups:
        mine = {tuple(s) for s in suffixes[rows]}
        assert not mine & seen
        seen |= mine


def test_words_of_texts_laid_end_to_end():
    texts = ["ab c", "d", None, "", " e\x0bf ", "g h", "x"]
    got = hashing.Texts(pa.array(texts))
    starts, ends, bounds = got.words()
    words = [bytes(got.bytes[s:e]) for s, e in zip(starts, ends)]
    per_text = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    assert per_text == [(t or "").encode().split() for t in texts]


def test_marking_does_not_depend_on_batches(spark):
    rng = np.random.default_rng(2)
    n = 3000
    rows = {"key": rng.zipf(1.5, n) % 40, "frag": rng.integers(0, 6, n), "doc": rng.integers(0, 90, n), "sub": np.zeros(n, int), "start": rng.integers(0, 50, n), "n": np.ones(n, int)}
    order = np.lexsort([rows[k] for k in ("start", "sub", "doc", "frag", "key")])
    table = pa.RecordBatch.from_pydict({k: pa.array(v[order]) for k, v in rows.items()})

    def marked(size, most):
        parts = [table.slice(a, size) for a in range(0, n, size)]
        out = [tuple(r.values()) for b in seeds.mark_rows(True, most)(iter(parts)) for r in b.to_pylist()]
        return sorted(out)

    for most in (3, 1000):
        assert marked(n, most) == marked(1, most) == marked(7, most)


def test_texts_are_hashed_in_small_pieces():
    """A batch of many texts is not hashed as a whole: its working memory is some dozens of bytes per byte."""
    seen = []

    def symbols(texts):
        seen.append(len(texts.bytes))
        return texts.bytes, texts.bounds

    texts = [random.Random(k).randbytes(50_000).hex() for k in range(40)]
    ids = pa.array(range(40), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["doc", "sub", "text"])
    found = pa.Table.from_batches(seeds.anchor_rows(symbols, 100, 32)(iter([batch])))
    assert sum(seen) == 4_000_000 and max(seen) <= 1 << 20
    whole = seeds.fragments(*symbols(hashing.Texts(batch.column("text"))), 100, 32)
    assert found["key"].to_pylist() == whole["key"].tolist()
    assert found["doc"].to_pylist() == whole["row"].tolist() and found["start"].to_pylist() == whole["start"].tolist()


def test_fragments_that_share_no_window_are_not_put_in_order():
    rng = random.Random(11)
    letters = "".join(rng.choice("abcdefgh ") for _ in range(900))
    shared, phrase = letters[:130], letters[200:275]
    texts = [letters[300 + 60 * k : 340 + 60 * k] + phrase + letters[340 + 60 * k : 360 + 60 * k] * 2 for k in range(8)]
    texts += [f"{k}" * 40 + shared + f"{k}" * 40 for k in range(3)]
    whole = hashing.Texts(pa.array(texts))
    found = seeds.fragments(whole.bytes, whole.bounds, 100, 32)
    begin = whole.bounds[found["row"]] + found["start"]
    contents = suffix_array.byte_contents(whole, begin, begin + found["n"] + 99)
    keep = seeds.around_anchor(100, 32)(found["key"], contents)
    windows = [{c[k : k + 100] for k in range(len(c) - 99)} for c in contents]
    for i, mine in enumerate(windows):
        others = set().union(*(w for k, w in enumerate(windows) if k != i))
        assert keep[i] or not mine & others
    _, same, many = np.unique(found["key"], return_inverse=True, return_counts=True)
    assert keep.any() and keep.sum() < (many[same] > 1).sum()
    assert not keep[found["row"] < 8].any()


def test_blocks_of_whole_anchors_are_small():
    sizes, rng = [], np.random.default_rng(12)

    def compare(contents):
        sizes.append(sum(map(len, contents)))
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    key = np.repeat(np.arange(900), 2)
    zeros, content = [0] * len(key), [rng.bytes(168) for _ in key]
    kinds = [("kind", pa.int32()), ("key", pa.int64()), ("frag", pa.int64()), ("doc", pa.int64()), ("sub", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]
    columns = [zeros, key, zeros, list(range(len(key))), zeros, zeros, [69] * len(key)]
    arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)] + [pa.array(content, pa.binary())]
    batch = pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in kinds] + ["content"])
    list(seeds.compare_rows(True, compare, suffix_array.BLOCK_BYTES)(iter([batch])))
    assert sum(sizes) == 168 * len(key) and max(sizes) <= suffix_array.BLOCK_BYTES + 2 * 168
