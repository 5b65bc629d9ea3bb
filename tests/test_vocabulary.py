from __future__ import annotations

import math
from collections import Counter

import models
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from themeweave.functions.text import TextOptions
from themeweave.operators import dictionary
from themeweave.operators.ordering import batches, with_row_index
from themeweave.operators import vocabulary as vocabulary_module
from themeweave.operators.terms import analyze, counted_terms, term_counts
from themeweave.operators.tfidf import TfidfVectorizer, l2_normalize, tfidf, vector_cells, vocabulary_join
from themeweave.operators.vocabulary import (
    build_vocabulary,
    doc_freq,
    frequency_bound,
    prune_vocab,
    term_totals,
    top_vocab,
)
from themeweave.sources import corpus_scan

TEXTS = ["aa bb aa", "aa cc", "aa bb", "", "zz"]


@pytest.fixture(scope="module")
def corpus(spark):
    return corpus_scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))


def as_dict(totals):
    return {r.term: (r.df, r.cf) for r in totals.collect()}


def test_totals_agree_in_both_forms(corpus):
    want = {"aa": (3, 4), "bb": (2, 2), "cc": (1, 1), "zz": (1, 1)}
    assert as_dict(term_totals(analyze(corpus))) == want
    assert as_dict(doc_freq(term_counts(analyze(corpus)))) == want


def test_totals_on_a_real_corpus(spark, small_docs):
    options = dict(ngram_range=(1, 2))
    corpus = corpus_scan(spark.createDataFrame([d[:2] for d in small_docs], "doc_id long, text string"))
    df, cf = Counter(), Counter()
    for _, text, _ in small_docs:
        found = models.terms(text, **options)
        cf.update(found)
        df.update(set(found))
    got = as_dict(term_totals(analyze(corpus, TextOptions(**options))))
    assert got == {t: (df[t], cf[t]) for t in cf}


def test_whole_numbers_are_counts_and_floats_are_shares(corpus):
    totals = term_totals(analyze(corpus))
    assert set(as_dict(prune_vocab(totals, 5, 1, 1.0))) == {"aa", "bb", "cc", "zz"}
    assert set(as_dict(prune_vocab(totals, 5, 1, 1))) == {"cc", "zz"}
    assert set(as_dict(prune_vocab(totals, 5, 0.4, 1.0))) == {"aa", "bb"}
    assert set(as_dict(prune_vocab(totals, 5, 2, 0.4))) == {"bb"}


def test_bad_bounds(corpus):
    totals = term_totals(analyze(corpus))
    for low, high in ((-1, 1.0), (1, 1.5), (4, 0.2)):
        with pytest.raises(ValueError):
            prune_vocab(totals, 5, low, high)
    assert frequency_bound(0.5, 10) == 5.0


def test_top_vocab_breaks_ties_by_term(corpus):
    assert set(as_dict(top_vocab(term_totals(analyze(corpus)), 3))) == {"aa", "bb", "cc"}


@pytest.mark.parametrize("most", [1, 2, 5, 17, 18, 19, 60, 100, 101, 500])
@pytest.mark.parametrize("ranges", [2, 1024])
def test_top_vocab_equals_sorting(spark, monkeypatch, most, ranges):
    monkeypatch.setattr(vocabulary_module, "_RANGES", ranges)
    rows = [(f"t{k * 37 % 101:03d}", 1, 10**9 if k == 3 else [7, 7, 7, 8, 500, 40_000][k % 6]) for k in range(101)]
    totals = spark.createDataFrame(rows, "term string, df long, cf long")
    want = sorted(rows, key=lambda r: (-r[2], r[0]))[:most]
    assert sorted(map(tuple, top_vocab(totals, most).collect())) == sorted(want)


def test_counts_in_the_row(spark):
    terms = [(1, ["b", "a", "b", "é", "b"]), (2, []), (3, ["z"]), (4, ["q"] * 50)]
    counted = counted_terms(spark.createDataFrame(terms, "doc_id long, terms array<string>")).collect()
    assert {r.doc_id: [tuple(c) for c in r.counts] for r in counted} == {
        1: [("a", 1), ("b", 3), ("é", 1)], 2: [], 3: [("z", 1)], 4: [("q", 50)],
    }


def test_long_documents_are_counted_in_proportion(spark):
    """A sort or a norm per element would take hours here."""
    docs = spark.range(3).selectExpr("id AS doc_id", "transform(sequence(1, 200000), i -> concat('t', i * 7919 % 50021)) AS terms")
    counts = counted_terms(docs).selectExpr("size(counts) AS n", "aggregate(counts, 0L, (a, c) -> a + c.tf) AS total").collect()
    assert [(r.n, r.total) for r in counts] == [(50021, 200000)] * 3
    unit = docs.select(l2_normalize(F.transform("terms", lambda t: F.length(t).cast("double"))).alias("v"))
    norms = unit.selectExpr("aggregate(v, 0D, (a, x) -> a + x * x) AS n").collect()
    assert [r.n for r in norms] == pytest.approx([1.0] * 3)


def test_unit_arrays(spark):
    row = spark.range(1).select(
        l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("a"), l2_normalize(F.array(F.lit(0.0))).alias("b"),
        l2_normalize(F.array().cast("array<double>")).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == ([0.6, 0.8], [0.0], [])


def test_row_index_over_many_partitions(spark):
    table = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("key")).repartition(13)
    rows = with_row_index(table, "key").collect()
    assert len(rows) == 1000 and all(r.row_idx == r.key for r in rows)


def test_batches_are_consecutive_and_the_last_is_short(spark):
    table = spark.range(130).select((F.col("id") * 10).alias("doc_id")).repartition(7)
    got = batches(table, 64, "doc_id").groupBy("batch_id").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
    )
    assert sorted(map(tuple, got.collect())) == [(0, 64, 0, 630), (1, 64, 640, 1270), (2, 2, 1280, 1290)]


def model_weights(texts, idf_by_term):
    for doc_id, text in enumerate(texts):
        counts = Counter(t for t in models.terms(text) if t in idf_by_term)
        row = {t: n * idf_by_term[t] for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in row.values()))
        yield doc_id, {t: x / norm for t, x in row.items()}


@pytest.mark.parametrize("max_rows", [1_000_000, 3, 1])
def test_tfidf_long_form_and_vectors_match_the_model(corpus, max_rows, monkeypatch):
    from themeweave import runtime

    monkeypatch.setattr(runtime, "BROADCAST_ROWS", max_rows)
    vocabulary = build_vocabulary(analyze(corpus), len(TEXTS), 1, 1.0, None)
    table = {r.term: r for r in vocabulary.collect()}
    assert [table[t].idx for t in sorted(table)] == list(range(len(table)))
    assert table["aa"].idf == pytest.approx(math.log(6 / 4) + 1)

    long = {(r.doc_id, r.term): r.tfidf for r in tfidf(analyze(corpus), vocabulary).collect()}
    in_row = {(r.doc_id, r.term): r.tf for r in vocabulary_join(analyze(corpus), vocabulary).collect()}
    assert in_row == {(d, t): n for d, text in enumerate(TEXTS) for t, n in Counter(models.terms(text)).items()}
    vectorizer = TfidfVectorizer.from_table(vocabulary, 10)
    cells = vector_cells(vectorizer.transform(analyze(corpus)).select("doc_id", "features"))
    vectors = {r.doc_id: {vectorizer.vocabulary[c.idx]: c.v for c in r.cells} for r in cells.collect()}
    assert set(vectors) == set(range(len(TEXTS)))
    for doc_id, row in model_weights(TEXTS, {t: r.idf for t, r in table.items()}):
        assert vectors[doc_id] == pytest.approx(row)
        assert {t: v for (d, t), v in long.items() if d == doc_id} == pytest.approx(row)


def test_document_with_pruned_terms_only_keeps_an_empty_row(corpus):
    vocabulary = build_vocabulary(analyze(corpus), len(TEXTS), 2, 1.0, None)
    vectorizer = TfidfVectorizer.from_table(vocabulary, 10)
    cells = vector_cells(vectorizer.transform(analyze(corpus)).select("doc_id", "features"))
    assert {r.doc_id: len(r.cells) for r in cells.collect()} == {0: 2, 1: 1, 2: 2, 3: 0, 4: 0}


def test_vocabulary_size_is_checked(corpus):
    vocabulary = build_vocabulary(analyze(corpus), len(TEXTS), 1, 1.0, None)
    with pytest.raises(ValueError, match="max_features"):
        TfidfVectorizer.from_table(vocabulary, 2)
    with pytest.raises(ValueError, match="no terms"):
        TfidfVectorizer.from_table(vocabulary.filter("df > 100"), 2)


def test_terms_are_looked_up_in_pieces_of_whole_documents(spark, monkeypatch):
    """What a worker holds at a time follows from the number of terms, not from the rows of a batch."""
    monkeypatch.setattr(dictionary, "PIECE_TERMS", 4)
    lists = [["a", "x", "a"], None, [], ["b"], ["x"] * 9 + ["b"], ["a", "b"], []]
    page = pa.table({"term": ["a", "b"]})
    pieces = [*dictionary.occurrences(pa.array(lists, pa.list_(pa.string())), page)]
    assert [(p.first, p.n_docs) for p in pieces] == [(0, 4), (4, 1), (5, 2)]
    found = [(int(p.first + d), int(r)) for p in pieces for d, r in zip(p.doc, p.row)]
    assert found == [(0, 0), (0, 0), (3, 1), (4, 1), (5, 0), (5, 1)]
    assert not [*dictionary.occurrences(pa.array([], pa.list_(pa.string())), page)]
    unknown = [*dictionary.occurrences(pa.array([["x"], None], pa.list_(pa.string())), page)]
    assert [(p.n_docs, len(p.row)) for p in unknown] == [(2, 0)]
