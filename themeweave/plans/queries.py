"""Registered queries over the driver's tables, one per operator or pipeline.

Every query reads its whole tables. ``plans/oracles.py`` holds the SQL twins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from themeweave.functions.text import TextOptions
from themeweave.functions.vectors import cosine_similarity, ward_cost
from themeweave.operators import network
from themeweave.operators.clustering import cluster_summary, fit_clusters, fit_micro_clusters, ward_merges
from themeweave.operators.network import NetShape
from themeweave.operators.ordering import batches, with_row_index
from themeweave.operators.scores import dense_scores, doc_topic_sum, nested_scores, wide_scores
from themeweave.operators.terms import analyze, drop_listed_tokens, explode_terms, term_counts, tokenize_raw
from themeweave.operators.tfidf import TfidfVectorizer, tfidf, vector_cells, vocabulary_join
from themeweave.operators.topics import (
    cluster_freq,
    corpus_freq,
    ids_are_compact,
    label_join,
    nest_topic_words,
    term_score,
    topic_number,
    topics_matrix,
    with_corpus_freq,
)
from themeweave.operators.training import column_norms, epoch_loss_stats
from themeweave.operators.vocabulary import (
    build_vocabulary,
    idf,
    prune_vocab,
    term_totals,
    top_vocab,
    vocab_index,
)
from themeweave.plans.compressor import TextCompressor
from themeweave.plans.extractor import TopicExtractor, TopicModel
from themeweave.runtime import new_run_folder, ship_package, store
from themeweave.sources import corpus_scan, noise_rows

#: Settings shared by the queries and their SQL twins.
STOP = ("the", "of", "and", "to", "in", "der", "die", "und", "le", "la", "de", "el", "que")
MIN_DF, MAX_DF = 15, 0.95
TOP_FEATURES = 500
NUM_TOPICS, NUM_WORDS = 20, 50
BATCH_SIZE = 64
LANG_CLUSTERS = 4
LOG_EPOCHS = 5
MICRO_CLUSTERS, WARD_CLUSTERS = 100, 10

UNIGRAMS = TextOptions(stopwords=frozenset(STOP))
BIGRAMS = TextOptions(stopwords=frozenset(STOP), ngram_range=(1, 2))

#: Layer widths of the nets with closed-form weights.
FIXED_GENERATOR = (64, 64, 16, 64)
FIXED_ENCODER = (64, 8, 4)
#: A decoder that takes whole vectors.
FIXED_DECODER = (64, 8, 64)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    """Register a query under ``name``."""

    def register(run: Query) -> Query:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return run(spark, sf_dir)

        QUERIES[name] = prepared
        return run

    return register


def documents(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return corpus_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=keep)


def by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "lang").withColumnRenamed("lang", "cluster")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")


def pruned_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pruned vocabulary as a written table, since several steps read it."""
    corpus = documents(spark, sf_dir)
    vocabulary = build_vocabulary(analyze(corpus, UNIGRAMS), corpus.count(), MIN_DF, MAX_DF)
    return store(vocabulary, f"{new_run_folder(spark)}/vocabulary")


def side_by_side(*reports: DataFrame) -> DataFrame:
    """One-row reports with different columns as a single row."""
    stacked = reports[0]
    for report in reports[1:]:
        stacked = stacked.unionByName(report, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


# --- documents to terms -----------------------------------------------------------


@query("tokenize")
def tokenize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_terms(analyze(documents(spark, sf_dir)), name="token")


@query("tokenize_raw")
def tokenize_cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_raw(documents(spark, sf_dir))


@query("remove_stopwords")
def remove_stopwords_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(documents(spark, sf_dir), UNIGRAMS).select("doc_id", F.size("terms").alias("n_tokens"))


@query("stopword_anti")
def stopword_anti_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark texts is a stop word."""
    benchmark = corpus_scan(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="item_id")
    listed = explode_terms(analyze(benchmark)).select("term").distinct()
    left = drop_listed_tokens(explode_terms(analyze(documents(spark, sf_dir)), name="token"), listed)
    return left.groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


@query("analyze_ngrams")
def analyze_ngrams_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_terms(analyze(documents(spark, sf_dir), BIGRAMS))


@query("analyze_trigrams")
def analyze_trigrams_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams and trigrams only, as one line of text per document."""
    options = TextOptions(stopwords=frozenset(STOP), ngram_range=(2, 3))
    grams = analyze(documents(spark, sf_dir), options)
    return grams.select(
        "doc_id", F.size("terms").alias("n_terms"), F.md5(F.array_join("terms", "|")).alias("digest")
    )


@query("term_counts")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(analyze(documents(spark, sf_dir), UNIGRAMS))


# --- vocabulary and TF-IDF ----------------------------------------------------------


@query("doc_freq")
def doc_freq_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_totals(analyze(documents(spark, sf_dir), BIGRAMS))


@query("prune_vocab")
def pruned_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir)
    return prune_vocab(term_totals(analyze(corpus, UNIGRAMS)), corpus.count(), MIN_DF, MAX_DF)


@query("prune_vocab_share")
def pruned_vocab_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both bounds as shares of the documents."""
    corpus = documents(spark, sf_dir)
    return prune_vocab(term_totals(analyze(corpus, UNIGRAMS)), corpus.count(), 0.02, 0.5)


@query("top_vocab")
def most_frequent_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir)
    pruned = prune_vocab(term_totals(analyze(corpus, UNIGRAMS)), corpus.count(), MIN_DF, MAX_DF)
    return top_vocab(pruned, TOP_FEATURES)


@query("vocab_index")
def indexed_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir)
    return vocab_index(prune_vocab(term_totals(analyze(corpus, UNIGRAMS)), corpus.count(), MIN_DF, MAX_DF))


@query("idf")
def inverse_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir)
    totals = prune_vocab(term_totals(analyze(corpus, UNIGRAMS)), n := corpus.count(), MIN_DF, MAX_DF)
    return totals.select("term", "df", F.round(idf(F.col("df"), n), 6).alias("idf"))


@query("vocab_join")
def vocab_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary_join(analyze(documents(spark, sf_dir), UNIGRAMS), pruned_vocabulary(spark, sf_dir))


@query("tfidf")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = tfidf(analyze(documents(spark, sf_dir), UNIGRAMS), pruned_vocabulary(spark, sf_dir))
    return weights.select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"))


def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pruned_vocabulary(spark, sf_dir)
    vectorizer = TfidfVectorizer.from_table(vocabulary, vocabulary.count())
    return vector_cells(vectorizer.transform(analyze(documents(spark, sf_dir), UNIGRAMS), keep_terms=False))


@query("tfidf_rows")
def tfidf_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["v"] * c["v"]))
    return tfidf_vectors(spark, sf_dir).select(
        "doc_id", F.size("cells").alias("nnz"), F.round(norm, 6).alias("norm")
    )


@query("tfidf_cells")
def tfidf_cells_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tfidf_vectors(spark, sf_dir).select("doc_id", F.explode_outer("cells").alias("c"))
    return cells.filter("c IS NOT NULL").select("doc_id", F.col("c.idx").alias("idx"), F.round("c.v", 6).alias("value"))


# --- topics and scores --------------------------------------------------------------


@query("corpus_freq")
def corpus_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_freq(explode_terms(analyze(documents(spark, sf_dir), BIGRAMS)))


@query("cluster_freq")
def cluster_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = table.select("doc_id", F.col("source").alias("cluster"))
    labelled = label_join(documents(spark, sf_dir), labels)
    return cluster_freq(explode_terms(analyze(labelled, UNIGRAMS), ("cluster", "doc_id"))).select(
        "cluster", "term", "f"
    )


@query("term_score")
def term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = explode_terms(analyze(by_lang(spark, sf_dir), UNIGRAMS), ("cluster", "doc_id"))
    both = with_corpus_freq(cluster_freq(terms))
    score = term_score(F.col("f"), F.col("cf"))
    return both.select("cluster", "term", F.round(score, 6).alias("score"))


@query("topic_number")
def topic_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return topic_number(table.select("doc_id", F.col("source").alias("cluster")))


def words_by_lang(spark: SparkSession, sf_dir: str, options: TextOptions = BIGRAMS) -> DataFrame:
    labelled = by_lang(spark, sf_dir)
    terms = explode_terms(analyze(labelled, options), ("cluster", "doc_id"))
    return topics_matrix(terms, topic_number(labelled), NUM_WORDS, ids_are_compact(labelled))


@query("topic_words")
def topic_words_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_by_lang(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("topic_words_nested")
def topic_words_nested_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = nest_topic_words(words_by_lang(spark, sf_dir), topic_number(by_lang(spark, sf_dir)))
    total = F.aggregate("words", F.lit(0.0), lambda acc, w: acc + w["score"])
    return nested.select(
        "topic",
        F.size("words").alias("n_terms"),
        F.col("words")[0]["term"].alias("first_term"),
        F.round(total, 6).alias("total_score"),
    )


@query("conversation_topic_words")
def conversation_topic_words_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second corpus: turns of conversations, with the role as the cluster."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    numbered = with_row_index(turns, "conv_id", "turn", name="doc_id")
    corpus = corpus_scan(numbered, keep=("role",)).withColumnRenamed("role", "cluster")
    terms = explode_terms(analyze(corpus, UNIGRAMS), ("cluster", "doc_id"))
    words = topics_matrix(terms, topic_number(corpus), NUM_WORDS, ids_are_compact(corpus))
    return words.withColumn("score", F.round("score", 6))


def stored_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic words as a written table: the scores join it more than once."""
    return store(words_by_lang(spark, sf_dir), f"{new_run_folder(spark)}/topic_words")


@query("topic_scores")
def topic_scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = doc_topic_sum(documents(spark, sf_dir), stored_words(spark, sf_dir))
    return sums.withColumn("score", F.round("score", 6))


@query("topic_scores_dense")
def topic_scores_dense_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = nested_scores(documents(spark, sf_dir), stored_words(spark, sf_dir), LANG_CLUSTERS)
    return dense_scores(nested).withColumn("score", F.round("score", 6))


@query("topic_scores_wide")
def topic_scores_wide_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = nested_scores(documents(spark, sf_dir), stored_words(spark, sf_dir), LANG_CLUSTERS)
    wide = wide_scores(nested, LANG_CLUSTERS)
    return wide.select("doc_id", *[F.round(c, 6).alias(c) for c in wide.columns if c != "doc_id"])


@query("batching")
def batching_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return (
        batches(ids, BATCH_SIZE, "doc_id")
        .groupBy("batch_id")
        .agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"))
    )


# --- clustering ---------------------------------------------------------------------


def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_summary(vectors(spark, sf_dir), group="label", column="features")


@query("cluster_summary")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = label_summary(spark, sf_dir).select(
        F.col("group").alias("label"), "n", F.posexplode("centroid").alias("coordinate", "value")
    )
    return cells.select("label", "n", "coordinate", F.round("value", 6).alias("centroid"))


@query("ward_pair_cost")
def ward_pair_cost_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of merging each label's group with that of the next label."""
    summary = label_summary(spark, sf_dir)
    a = summary.select(F.col("group").alias("label_a"), F.col("n").alias("n_a"), F.col("centroid").alias("a"))
    b = summary.select(F.col("group").alias("label_b"), F.col("n").alias("n_b"), F.col("centroid").alias("b"))
    pairs = a.join(b, F.col("label_b") == F.col("label_a") + 1)
    cost = ward_cost(F.col("n_a"), F.col("a"), F.col("n_b"), F.col("b"))
    return pairs.select("label_a", "label_b", F.round(cost, 6).alias("cost"))


@query("ward_merge_costs")
def ward_merge_costs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All merges of the label groups, cheapest first; each side is named by its smallest label."""
    merges = ward_merges(label_summary(spark, sf_dir))
    return merges.select("step", "left", "right", F.round("cost", 6).alias("cost"))


def latent_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.col("features").alias("latent"))


@query("micro_clusters")
def micro_clusters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro clusters of all vectors: cells of the grid, then one round of nearest means."""
    found = fit_micro_clusters(latent_vectors(spark, sf_dir), MICRO_CLUSTERS, rounds=1)
    cells = found.table.select("group", "n", "spread", F.posexplode("centroid").alias("coordinate", "value"))
    return cells.select(
        "group", "n", F.round("spread", 6).alias("spread"), "coordinate", F.round("value", 6).alias("centroid")
    )


@query("ward_clusters")
def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in ten clusters, through a hundred micro clusters; a cluster is named by its smallest vector."""
    latent = latent_vectors(spark, sf_dir)
    labels = fit_clusters(latent, WARD_CLUSTERS, MICRO_CLUSTERS, rounds=1).label(latent)
    first = F.min("doc_id").over(Window.partitionBy("cluster"))
    return labels.select(F.col("doc_id").alias("vec_id"), first.alias("cluster"))


# --- compression nets ---------------------------------------------------------------


def fixed_weights(spark: SparkSession, decoder: tuple[int, ...] = FIXED_ENCODER[::-1]) -> DataFrame:
    """Closed-form weights: sine kernels over the root of the width, cosine biases."""
    widths = dict(zip(network.GENERATOR, zip(FIXED_GENERATOR, FIXED_GENERATOR[1:])))
    widths |= dict(zip(network.ENCODER, zip(FIXED_ENCODER, FIXED_ENCODER[1:])))
    widths |= dict(zip(network.DECODER, zip(decoder, decoder[1:])))
    unit = F.col("row_idx") + 1
    kernel = F.transform(
        F.sequence(F.lit(1), F.col("n_in")),
        lambda i: F.sin(i * unit + F.col("nth")) / F.sqrt(F.col("n_in").cast("double")),
    )
    bias = F.cos(unit + F.col("nth")) / 10
    return network.output_units(spark, widths).select("net", "layer", "row_idx", kernel.alias("w"), bias.alias("b"))


def fixed_net(spark: SparkSession, **how):
    return network.share(spark, network.load_weights(fixed_weights(spark, **how)))


def cells_of(rows: DataFrame, column: str) -> DataFrame:
    cells = rows.select("vec_id", F.posexplode(column).alias("out_idx", "_value"))
    return cells.select("vec_id", "out_idx", F.round("_value", 6).alias("value"))


@query("encode_fixed")
def encode_fixed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).drop("label")
    return cells_of(network.encode(rows, fixed_net(spark)), "latent")


@query("decode_fixed")
def decode_fixed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector serves as a latent vector."""
    latent = vectors(spark, sf_dir).select("vec_id", F.col("features").alias("latent"))
    return cells_of(network.decode(latent, fixed_net(spark, decoder=FIXED_DECODER)), "decoded")


@query("reconstruct_fixed")
def reconstruct_fixed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).drop("label")
    return cells_of(network.reconstruct(rows, fixed_net(spark)), "decoded")


@query("generate_fixed")
def generate_fixed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector serves as the generator's noise."""
    noise = vectors(spark, sf_dir).select("vec_id", F.col("features").alias("noise"))
    return cells_of(network.generate_samples(noise, fixed_net(spark)), "generated")


def rebuilt(rows: DataFrame, net, column: str) -> DataFrame:
    """``column`` next to its reconstruction ``decoded``."""
    return network.reconstruct(rows.withColumn("_copy", F.col(column)), net, source="_copy")


@query("cosine_similarity")
def reconstruction_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rebuilt(vectors(spark, sf_dir).drop("label"), fixed_net(spark), "features")
    return rows.select("vec_id", F.round(cosine_similarity(F.col("features"), F.col("decoded")), 6).alias("cos"))


def generated_rows(spark: SparkSession, sf_dir: str, net) -> DataFrame:
    noise = vectors(spark, sf_dir).select("vec_id", F.col("features").alias("noise"))
    return rebuilt(network.generate_samples(noise, net), net, "generated")


@query("generator_loss")
def generator_loss_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generated_rows(spark, sf_dir, fixed_net(spark))
    loss = network.generator_loss(F.col("generated"), F.col("decoded"))
    return rows.agg(F.round(loss, 6).alias("loss"))


@query("discriminator_loss")
def discriminator_loss_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real and generated rows go through one aggregate, told apart by a flag."""
    net = fixed_net(spark)
    real = rebuilt(vectors(spark, sf_dir).drop("label"), net, "features")
    fake = generated_rows(spark, sf_dir, net)
    similarity = lambda column: cosine_similarity(F.col(column), F.col("decoded")).alias("cos")
    both = real.select(F.lit(True).alias("is_real"), similarity("features")).unionByName(
        fake.select(F.lit(False).alias("is_real"), similarity("generated"))
    )
    mean = lambda wanted: -F.avg(F.when(F.col("is_real") == wanted, F.col("cos")))
    return both.agg(F.round(network.discriminator_loss(mean(True), mean(False)), 6).alias("loss"))


@query("noise_source")
def noise_source_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred uniform numbers per document."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    noise = noise_rows(ids, 100, seed=7, id_col="doc_id")
    low, high = F.array_min("noise"), F.array_max("noise")
    mean = F.aggregate("noise", F.lit(0.0), lambda acc, x: acc + x) / F.size("noise")
    return noise.agg(
        F.count("*").alias("n_rows"),
        F.max(F.size("noise")).alias("dim"),
        (F.min((low >= 0) & (high < 1))).alias("all_in_unit_interval"),
        F.round(F.avg(mean), 1).alias("mean"),
    )


@query("init_weights")
def initial_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers for the corpus vocabulary, with their widths and a bound check."""
    shape = NetShape(pruned_vocabulary(spark, sf_dir).count(), noise_dim=20, generator_hidden_dim=12, discriminator_hidden_dim=8, latent_dim=4)  # fmt: skip  # noqa: E501
    sized = network.init_weights(spark, shape, seed=3).withColumn("n_in", F.size("w"))
    largest = F.aggregate("w", F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))
    per_layer = sized.groupBy("net", "layer", "n_in").agg(
        F.count("*").alias("n_out"), F.max(largest).alias("largest"), F.max(F.abs("b")).alias("bias")
    )
    in_bounds = (F.col("largest") <= F.sqrt(F.lit(6.0) / (F.col("n_in") + F.col("n_out")))) & (F.col("bias") == 0)
    return per_layer.select("net", "layer", "n_in", "n_out", in_bounds.alias("in_bounds"))


@query("epoch_loss_stats")
def epoch_loss_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training log with a batch per document, whose losses follow from its length."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    length = F.length("text").cast("double")
    log = table.select(
        (F.col("doc_id") % LOG_EPOCHS).cast("int").alias("epoch"), F.lit(0).alias("part"), F.col("doc_id").alias("batch"),
        (-length / (length + 100)).alias("gen_loss"), (-(length + 10) / (length + 50)).alias("discr_loss"),
    )
    stats = epoch_loss_stats(log)
    return stats.select("epoch", *[F.round(c, 6).alias(c) for c in ("gen_mean", "gen_std", "discr_mean", "discr_std")])


@query("column_norms")
def column_norms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest norm of a unit: each label's vectors as the units of a layer."""
    rows = vectors(spark, sf_dir).select(
        F.lit("net").alias("net"), F.col("label").cast("string").alias("layer"), F.col("features").alias("w")
    )
    return column_norms(rows).select("layer", F.round("max_norm", 6).alias("max_norm"))


#: Layer widths of the nets that the queries train.
NARROW = dict(noise_dim=20, generator_hidden_dim=64, discriminator_hidden_dim=64, latent_space_dim=16)


@query("fit_compressor")
def fit_compressor_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nets trained on the TF-IDF rows of all documents, over the whole pruned vocabulary."""
    vocabulary = pruned_vocabulary(spark, sf_dir)
    size = vocabulary.count()
    vectorizer = TfidfVectorizer.from_table(vocabulary, size)
    rows = vectorizer.transform(analyze(documents(spark, sf_dir), UNIGRAMS), keep_terms=False)
    rows = store(rows, f"{new_run_folder(spark)}/features")
    model = TextCompressor(num_epochs=3, seed=1, **NARROW).fit(rows)
    limited = (F.col("net").isin("generator", "decoder")) & (F.col("layer") == "output")
    norms = column_norms(model.weights).filter(limited).agg((F.max("max_norm") <= 1.0).alias("norms_ok"))
    widest = model.weights.agg(F.max(F.size("w")).alias("n_terms"))
    stats = epoch_loss_stats(model.training_log)
    losses = stats.agg(
        F.count("*").alias("n_epochs"),
        F.min(~F.isnan("gen_mean") & ~F.isnan("discr_mean")).alias("loss_finite"),
        (F.max_by("discr_mean", "epoch") < F.min_by("discr_mean", "epoch")).alias("loss_falls"),
    )
    return side_by_side(losses, norms, widest)


# --- whole pipeline -----------------------------------------------------------------


def extract(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TopicModel]:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extractor = TopicExtractor(
        num_topics=NUM_TOPICS,
        max_num_words=NUM_WORDS,
        min_df=MIN_DF,
        max_df=MAX_DF,
        stopwords=set(STOP),
        ngram_range=(1, 2),
        num_epochs=5,
        batch_size=128,
        seed=11,
        **NARROW,
    )
    return table, extractor.fit(table)


@query("extract_topics")
def extract_topics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of all documents: every document labelled, scored against every topic."""
    table, model = extract(spark, sf_dir)
    sizes = model.topics.agg(F.sum("n_docs").alias("n_docs"), F.count("*").alias("n_topics"))
    words = model.topic_words.groupBy("topic").agg(F.count("*").alias("n"), F.max("rank").alias("last"))
    words_ok = words.agg((F.min((F.col("n") == F.col("last")) & (F.col("n") <= NUM_WORDS))).alias("words_per_topic_ok"))
    scores = model.topic_scores_dense(table).agg(F.count("*").alias("n_scores"))
    terms = model.vocabulary.agg(F.count("*").alias("n_terms"))
    return side_by_side(sizes, words_ok, scores, terms)


def extracted_topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return extract(spark, sf_dir)[1].topic_words
