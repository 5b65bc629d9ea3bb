"""Quality rules: text statistics and a hashed n-gram likelihood ratio, DataFrame functions only.

Every document gets the log-likelihood ratio of its hashed words and word pairs between
two multinomials: one of trusted documents, one of the whole raw corpus. The ratio is
divided by the number of n-grams and held against a fixed threshold.

Raw counts cover all documents. The trusted multinomial is fitted on the labelled rows of
good quality, at most ``max_trusted`` of them (those with the smallest hash of the id), so
that the join with the texts broadcasts a bounded list of ids. Counts are integers and
each document's sum runs in text order, so reruns give the same verdicts.

Defined results: a null text is an empty one and fails the word rule; repeated rows are
judged one by one; without any trusted document every ratio is 0; extra columns pass
through, and those named like a result are replaced by it.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, functions as F

from themeweave.llm.columns import front, tail, text_of, without, words_of

BUCKETS = 1 << 14
#: Mean log ratio per n-gram below which a document is refused.
MIN_RATIO = -0.075
MAX_TRUSTED = 20_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept",
)


def bucket_ids(words: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of the words, then of the pairs of neighbours."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)))
    pairs = F.zip_with(front(words, 1), tail(words, 1), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)))
    return F.concat(single, pairs)


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """At most ``max_trusted`` ids of labelled documents of good quality."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def fit_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of every bucket; ``buckets`` numbers reach the driver, whatever the input.

    ``trusted`` must be bounded, as from :func:`trusted_ids`.
    """
    marked = docs.select("doc_id", words_of(text_of()).alias("_words")).join(
        F.broadcast(trusted.withColumn("_trusted", F.lit(1))), "doc_id", "left"
    )
    grams = marked.select(F.explode(bucket_ids(F.col("_words"), buckets)).alias("bucket"), "_trusted")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_trusted").alias("good")).collect()
    raw, good = [1] * buckets, [1] * buckets
    for row in counts:
        raw[row.bucket] += row.raw
        good[row.bucket] += row.good
    if sum(good) == buckets:
        return [0.0] * buckets
    sum_good, sum_raw = sum(good), sum(raw)
    return [log(g / sum_good) - log(r / sum_raw) for g, r in zip(good, raw, strict=True)]


def _repeated_words(ordered: Column) -> Column:
    """Words inside windows that occur twice or more; ``ordered`` holds ``<hash, place>`` sorted."""
    same = F.zip_with(front(ordered, 1), tail(ordered, 1), lambda a, b: a["hash"] == b["hash"])
    no = F.array(F.lit(False))
    either = F.zip_with(F.concat(same, no), F.concat(no, same), lambda a, b: a | b)
    places = F.zip_with(ordered, either, lambda x, again: F.when(again, x["place"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    covered = F.aggregate(
        F.array_sort(F.filter(places, lambda x: x.isNotNull())),
        start,
        lambda s, x: F.struct(
            (x + WINDOW).alias("end"), (s["total"] + x + WINDOW - F.greatest(s["end"], x)).alias("total")
        ),
        lambda s: s["total"],
    )
    return F.when(F.size(ordered) > 0, covered).otherwise(0)


def text_statistics(docs: DataFrame) -> DataFrame:
    """Add the statistics of the base rules, ``base_failed`` and the helper column ``_words``."""
    words = F.col("_words")
    no_windows = F.expr("CAST(array() AS array<bigint>)")

    def windows_of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) >= WINDOW, hashes).otherwise(no_windows)

    # a lambda's variable is computed once; a column would be split into words again per window
    # wherever the optimizer puts its expression in place
    windows = F.transform(F.array(words), windows_of)[0]
    lines = F.filter(F.split(text_of(), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    pairs = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("hash"), i.alias("place"))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    none = F.expr("CAST(array() AS array<struct<hash:bigint,place:int>>)")
    percent = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return (
        without(docs, *RESULTS)
        .withColumn("_words", words_of(text_of()))
        .withColumn("_lines", lines)
        .withColumn("_windows", windows)
        .withColumn("_ordered", F.when(repeats, pairs).otherwise(none))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(text_of(), r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", _repeated_words(F.col("_ordered")).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | percent)
        .drop("_lines", "_windows", "_ordered")
    )


def judge(docs: DataFrame, ratios: list[float], min_ratio: float = MIN_RATIO) -> DataFrame:
    """Statistics, ``ratio`` (mean log ratio per n-gram) and ``kept`` of every document."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    grams = bucket_ids(F.col("_words"), len(ratios))
    total = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.element_at(table, (b + 1).cast("int")))
    n_grams = 2 * F.col("n_words") - 1
    return (
        text_statistics(docs)
        .withColumn("ratio", F.when(F.col("n_words") > 0, total / n_grams).otherwise(0.0))
        .withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= min_ratio))
        .drop("_words")
    )


def quality_rules(docs: DataFrame, labels: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """Fit the ratios on the corpus and its labels, then judge every document."""
    return judge(docs, fit_ratios(docs, trusted_ids(labels)), min_ratio)


def keep_good(docs: DataFrame, labels: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    The filter also looks at a row number, so that it stays above the statistics; pushed
    below them it would compute each of them several times.
    """
    judged = quality_rules(docs.withColumn("_kept", F.struct(*docs.columns)), labels, min_ratio)
    numbered = judged.select(F.col("_kept").alias("_row"), "kept", F.monotonically_increasing_id().alias("_number"))
    return numbered.where("kept AND _number >= 0").select("_row.*")
