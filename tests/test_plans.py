"""Physical plans: what is read, what is shuffled, what is evaluated twice."""

from __future__ import annotations

import contextlib
import io

import pytest
from conftest import SMALL, plan

from themeweave import runtime
from themeweave.functions.text import TextOptions
from themeweave.operators.scores import doc_topic_sum, nested_scores
from themeweave.operators.terms import analyze, explode_terms, term_counts
from themeweave.operators.tfidf import TfidfVectorizer, tfidf, vocabulary_join
from themeweave.operators.topics import cluster_freq, label_join, top_terms
from themeweave.operators.vocabulary import build_vocabulary, term_totals
from themeweave.runtime import new_run_folder, store
from themeweave.sources import corpus_scan


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A corpus with enough pieces to be left as it is, stored once."""
    path = str(tmp_path_factory.mktemp("corpus") / "docs")
    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(32).write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    yield spark.read.parquet(path)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_only_needed_columns_are_read(stored):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(corpus_scan(stored))


def test_filters_reach_the_scan(stored):
    text = plan(corpus_scan(stored.filter("lang = 'en'")))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in text


def test_a_well_split_corpus_is_not_shuffled(stored):
    assert "Exchange" not in plan(corpus_scan(stored))


def test_a_single_piece_is_spread(spark):
    corpus = corpus_scan(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert corpus.rdd.getNumPartitions() > 8


def test_documents_are_tokenised_once(stored):
    terms = explode_terms(analyze(corpus_scan(stored), TextOptions(ngram_range=(1, 3))))
    simple = io.StringIO()
    with contextlib.redirect_stdout(simple):
        terms.explain()
        term_totals(analyze(corpus_scan(stored))).explain()
    assert simple.getvalue().count("regexp_extract_all") == 2


def test_vectors_need_no_shuffle(stored):
    corpus = corpus_scan(stored)
    vocabulary = build_vocabulary(analyze(corpus), 200, 2, 1.0, 100)
    rows = TfidfVectorizer.from_table(vocabulary, 100).transform(analyze(corpus))
    assert "Exchange" not in plan(rows)


def test_counts_weights_and_scores_need_no_shuffle(spark, stored):
    corpus = corpus_scan(stored)
    analyzed = analyze(corpus)
    vocabulary = store(build_vocabulary(analyzed, 200, 2, 1.0, 100), f"{new_run_folder(spark)}/vocabulary")
    words = spark.createDataFrame([(0, "the", 1.0), (1, "of", 2.0)], "topic int, term string, score double")
    in_row = [
        term_counts(analyzed), tfidf(analyzed, vocabulary), vocabulary_join(analyzed, vocabulary),
        doc_topic_sum(corpus, words), nested_scores(corpus, words, 2),
    ]
    for result in in_row:
        assert "Exchange" not in plan(result)


def test_few_labels_are_broadcast(spark, stored):
    labels = spark.range(200).selectExpr("id AS doc_id", "1 AS cluster")
    text = plan(label_join(corpus_scan(stored), labels))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_totals_shuffle_once_after_combining(stored):
    text = plan(term_totals(analyze(corpus_scan(stored))))
    tree = text.split("\n\n")[0]
    assert tree.count("Exchange") == 1 and tree.count("HashAggregate") == 2


def test_top_terms_prune_before_the_shuffle(stored):
    corpus = corpus_scan(stored, keep=("lang",)).withColumnRenamed("lang", "cluster")
    terms = explode_terms(analyze(corpus), ("cluster", "doc_id"))
    tree = plan(top_terms(cluster_freq(terms), 20)).split("\n\n")[0]
    assert tree.count("WindowGroupLimit") == 2 and tree.count("Exchange") == 3
    assert "SortAggregate" not in tree and "Join" not in tree


def test_checkpoint_folder_comes_from_the_session(spark):
    assert runtime.checkpoint_root(spark).rstrip("/").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))
