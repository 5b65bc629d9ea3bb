"""From documents to terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from themeweave.functions.text import (
    TextOptions,
    longer_grams,
    lowercase,
    remove_stopwords,
    tokenize,
)
from themeweave.functions.vectors import once
from themeweave.runtime import lookup_join


def analyze(corpus: DataFrame, options: TextOptions = TextOptions(), text: str = "text") -> DataFrame:
    """Replace the text column by ``terms``: all its terms in an array.

    Unigrams come first in reading order, then bigrams, and so on. A document is
    one row, so this needs no shuffle. Each n-gram length is its own step because
    Spark would otherwise tokenise again for every use of the tokens.
    """
    low, high = options.ngram_range
    others = [c for c in corpus.columns if c != text]
    words = remove_stopwords(tokenize(lowercase(F.col(text), options.lowercase)), options.stopwords)
    grams = corpus.select(*others, words.alias("_gram1"))
    for n in range(2, high + 1):
        grams = grams.withColumn(f"_gram{n}", longer_grams(F.col(f"_gram{n - 1}"), F.col("_gram1"), n))
    return grams.select(*others, F.concat(*[f"_gram{n}" for n in range(low, high + 1)]).alias("terms"))


def explode_terms(analyzed: DataFrame, keep: tuple[str, ...] = ("doc_id",), name: str = "term") -> DataFrame:
    """``<*keep, pos, term>``, one row per term occurrence.

    The outer form of the generator is used, and its empty row dropped after,
    because the inner form adds a non-empty filter that tokenises a second time.
    """
    exploded = analyzed.select(*keep, F.posexplode_outer("terms").alias("pos", name))
    return exploded.filter(F.col(name).isNotNull())


def tokenize_raw(corpus: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``<*keep, pos, token>`` with the case kept and nothing removed."""
    plain = analyze(corpus.select(*keep, "text"), TextOptions(lowercase=False))
    return explode_terms(plain, keep, name="token")


def drop_listed_tokens(tokens: DataFrame, stopwords: DataFrame, column: str = "token") -> DataFrame:
    """Stop-word removal against a table of words, for lists too long to write out."""
    listed = stopwords.select(F.col(stopwords.columns[0]).alias(column)).distinct()
    return lookup_join(tokens, listed, column, F.xxhash64("doc_id", "pos"), how="left_anti")


def counted_terms(analyzed: DataFrame, terms: str = "terms") -> DataFrame:
    """Replace ``terms`` by ``counts``: ``<term, tf>`` of the document's distinct terms, in order.

    The sorted array is run-length counted in its own row: the places where a run begins,
    and from each to the next. Nothing is shuffled.
    """

    def begins(now: Column) -> Column:
        places = F.slice(F.sequence(F.lit(0), F.size(now)), F.lit(1), F.size(now))
        return F.filter(places, lambda i: (i == 0) | (F.get(now, i) != F.get(now, i - 1)))

    def runs(now: Column, at: Column) -> Column:
        # a document without terms has an end but no beginning
        nexts = F.slice(F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(now))), F.lit(1), F.size(at))
        run = lambda i, j: F.struct(F.get(now, i).alias("term"), (j - i).cast("long").alias("tf"))
        return F.zip_with(at, nexts, run)

    others = [c for c in analyzed.columns if c != terms]
    counts = once(F.sort_array(terms), lambda now: once(begins(now), lambda at: runs(now, at)))
    return analyzed.select(*others, counts.alias("counts"))


def term_counts(analyzed: DataFrame) -> DataFrame:
    """``<doc_id, term, tf>``: how often each term occurs in each document."""
    return counted_terms(analyzed.select("doc_id", "terms")).select("doc_id", F.inline("counts"))
