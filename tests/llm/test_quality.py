"""Statistics, ratios and verdicts against a plain model."""

from __future__ import annotations

import math
import re

import pytest
import xxhash

from .corpus_rows import documents

from themeweave.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def statistics(text):
    words = words_of(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    inside = {k for places in seen.values() if len(places) > 1 for i in places for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    n_symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), n_symbols, len(lines) - len(set(lines)), len(inside), failed


def buckets(text):
    hashed = lambda w, seed: xxhash.xxh64(w.encode(), seed=seed).intdigest()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    words = words_of(text)
    pairs = [hashed(b, hashed(a, 42)) for a, b in zip(words, words[1:])]
    return [signed(h) % quality.BUCKETS for h in [hashed(w, 42) for w in words] + pairs]


def verdicts(rows, trusted):
    raw, good = [1] * quality.BUCKETS, [1] * quality.BUCKETS
    for doc, text in rows:
        for b in buckets(text):
            raw[b] += 1
            good[b] += doc in trusted
    for doc, text in rows:
        grams = buckets(text)
        logs = [math.log(good[b] / sum(good)) - math.log(raw[b] / sum(raw)) for b in grams] if trusted else [0.0]
        ratio = sum(logs) / len(grams) if grams else 0.0
        stats = statistics(text)
        yield (doc, *stats, ratio, not stats[-1] and ratio >= quality.MIN_RATIO)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")


@pytest.mark.parametrize("good", [(), (14, 17, 50)])
def test_equals_the_plain_model(spark, awkward, good):
    rows = [*awkward, awkward[-1], (None, "no id " * 30), (700, "a b c d e f g h i " * 9 + "# $ |"), (701, "one word " * 20_000)]
    labels = spark.createDataFrame([(d, 1, 0) for d in good] + [(1, 0, 0), (None, 1, 0), (2, None, None)], LABELS)
    out = quality.quality_rules(documents(spark, rows), labels)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=order)
    want = sorted(verdicts(rows, set(good)), key=order)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert [g[7] for g in got] == pytest.approx([w[7] for w in want], abs=1e-9)
    assert [g[8] for g in got] == [w[8] for w in want]
    assert out.columns.count("kept") == 1

    kept = quality.keep_good(documents(spark, rows), labels)
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(w[0] or -1 for w in want if w[8])


def test_empty_tables(spark):
    assert quality.quality_rules(documents(spark, []), spark.createDataFrame([], LABELS)).count() == 0
