from __future__ import annotations

import random

import models
import pytest
from pyspark.sql import functions as F

from themeweave.functions.text import TextOptions
from themeweave.operators.terms import analyze, drop_listed_tokens, explode_terms, term_counts, tokenize_raw
from themeweave.sources import corpus_scan

EDGES = [
    "",
    "a b c",
    None,
    "naïve café x y2 a_b ½¾ x²",
    "हिन्दी भाषा",
    "one",
    "The THE the tHe",
    "don't I'll x's",
    "İstanbul STRASSE ΟΔΟΣ ‿ a‿b",
    "tab\tnew\nline  double",
]


def alphabet_soup(seed: int) -> str:
    rng = random.Random(seed)
    letters = "abAB 12_.,-'é½हि\n "
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))


@pytest.fixture(scope="module")
def corpus(spark):
    texts = EDGES + [alphabet_soup(i) for i in range(300)]
    return corpus_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


@pytest.mark.parametrize(
    "options",
    [
        dict(),
        dict(lowercase=False),
        dict(stopwords=frozenset({"the", "ab", "don", "i", "don't"})),
        dict(ngram_range=(1, 2)),
        dict(ngram_range=(2, 2), stopwords=frozenset({"the"})),
        dict(ngram_range=(1, 4)),
        dict(ngram_range=(3, 3), lowercase=False),
    ],
)
def test_terms_match_model(corpus, options):
    rows = {r.doc_id: r for r in corpus.collect()}
    for row in analyze(corpus, TextOptions(**options)).collect():
        assert row.terms == models.terms(rows[row.doc_id].text, **options)


def test_positions_count_from_zero_and_empty_documents_vanish(corpus):
    got = {}
    for r in explode_terms(analyze(corpus)).collect():
        got.setdefault(r.doc_id, {})[r.pos] = r.term
    for row in corpus.collect():
        assert [got.get(row.doc_id, {})[i] for i in sorted(got.get(row.doc_id, {}))] == models.terms(row.text)


def test_null_text_is_an_empty_document(spark):
    table = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert corpus_scan(table).collect()[0].text == ""


def test_raw_tokens_keep_case_and_stopwords(spark):
    corpus = corpus_scan(spark.createDataFrame([(1, "The Cat the")], "doc_id long, text string"))
    assert [r.token for r in tokenize_raw(corpus).orderBy("pos").collect()] == ["The", "Cat", "the"]


@pytest.mark.parametrize("max_rows", [1_000_000, 0])
def test_stopword_table_equals_stopword_list(spark, corpus, max_rows, monkeypatch):
    from themeweave import runtime

    monkeypatch.setattr(runtime, "BROADCAST_ROWS", max_rows)
    words = spark.createDataFrame([("the",), ("ab",), ("the",)], "word string")
    left = drop_listed_tokens(explode_terms(analyze(corpus), name="token"), words)
    got = {r.doc_id: r.n for r in left.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    listed = analyze(corpus, TextOptions(stopwords=frozenset({"the", "ab"})))
    want = {r.doc_id: len(r.terms) for r in listed.collect() if r.terms}
    assert got == want


def test_term_counts(spark):
    corpus = corpus_scan(spark.createDataFrame([(7, "aa bb aa"), (8, "")], "doc_id long, text string"))
    counts = {(r.doc_id, r.term): r.tf for r in term_counts(analyze(corpus)).collect()}
    assert counts == {(7, "aa"): 2, (7, "bb"): 1}


def test_bad_ngram_range():
    with pytest.raises(ValueError):
        TextOptions(ngram_range=(2, 1))
