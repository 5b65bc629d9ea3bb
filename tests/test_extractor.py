from __future__ import annotations

import models
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from themeweave import TopicExtractor
from themeweave.streaming import score_stream

TOPIC_TEXTS = {
    "sea": "ship sail harbour wave anchor tide captain deck",
    "oven": "bread flour oven yeast butter sugar dough bake",
    "law": "court judge verdict trial lawyer appeal statute jury",
}
SETTINGS = dict(
    num_topics=3,
    max_num_words=5,
    min_df=2,
    max_df=0.9,
    stopwords={"the"},
    ngram_range=(1, 2),
    num_epochs=4,
    batch_size=16,
    noise_dim=8,
    generator_hidden_dim=16,
    discriminator_hidden_dim=16,
    latent_space_dim=4,
    seed=5,
)


def themed_rows(n=240):
    rows = []
    for i in range(n):
        words = list(TOPIC_TEXTS.values())[i % 3].split()
        rows.append((1000 - i if i < 3 else 1000 + i, "the " + " ".join(words[(i + k * (1 + i % 5)) % 8] for k in range(12))))
    return rows


@pytest.fixture(scope="module")
def themed(spark):
    return spark.createDataFrame(themed_rows(), "doc_id long, text string")


@pytest.fixture(scope="module", params=["exact", "micro"])
def model(request, themed):
    groups = 2000 if request.param == "exact" else 30
    return TopicExtractor(**SETTINGS, max_micro_clusters=groups).fit(themed)


def test_results_follow_from_the_labels(model, themed):
    """Given its cluster labels, the model's words and scores equal the plain model's."""
    texts = {r.doc_id: r.text for r in themed.collect()}
    labels = {r.doc_id: r.cluster for r in model.labels.collect()}
    assert set(labels) == set(texts)
    order = sorted(texts)
    want = models.topic_words(
        [(texts[d], labels[d]) for d in order], 5, stopwords={"the"}, ngram_range=(1, 2)
    )
    assert len(want) == 3
    got = {}
    for r in model.topic_words.orderBy("topic", "rank").collect():
        got.setdefault(r.topic, []).append((r.term, r.score))
    assert got == dict(enumerate(want))
    scores = dict(zip(order, models.doc_scores([texts[d] for d in order], want)))
    for r in model.topic_scores_nested(themed).collect():
        assert r.scores == pytest.approx(scores[r.doc_id])
    assert model.topic_scores_dense(themed).count() == 3 * len(order)
    assert model.topic_scores_wide(themed).columns == ["doc_id", "topic_0", "topic_1", "topic_2"]
    nonzero = sum(1 for row in scores.values() for s in row if s)
    assert model.topic_scores(themed).count() == nonzero


def test_assignment_agrees_with_stored_labels(model, themed):
    again = model.assign(themed).select("doc_id", "cluster")
    assert again.exceptAll(model.labels).isEmpty() and model.labels.exceptAll(again).isEmpty()


def test_topics_count_every_document_and_start_with_the_first(model):
    topics = model.topics.orderBy("topic").collect()
    assert sum(t.n_docs for t in topics) == 240 and [t.topic for t in topics] == [0, 1, 2]
    first = model.labels.orderBy("doc_id").first()
    assert topics[0].cluster == first.cluster


def test_nested_words_and_latent_width(model):
    nested = model.topic_words_nested().collect()
    assert len(nested) == 3 and all(0 < len(r.words) <= 5 for r in nested)
    assert {len(r.latent) for r in model.latent.collect()} == {4}


def test_same_seed_same_topics(themed):
    words = [
        TopicExtractor(**SETTINGS).fit(themed).topic_words.orderBy("topic", "rank").collect() for _ in range(2)
    ]
    assert words[0] == words[1]


def test_works_as_a_pipeline_stage(themed):
    scored = Pipeline(stages=[TopicExtractor(**SETTINGS)]).fit(themed).transform(themed)
    assert scored.count() == 240 and set(scored.columns) == {"doc_id", "scores"}


def test_streamed_documents_get_the_same_scores(spark, themed, tmp_path):
    model = TopicExtractor(**SETTINGS).fit(themed)
    themed.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(themed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    writer = score_stream(stream, model, lambda scores, _: scores.write.mode("append").parquet(out))
    query = writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    streamed = spark.read.parquet(out)
    assert streamed.exceptAll(model.topic_scores_nested(themed)).isEmpty() and streamed.count() == 240


def test_unfitted_extractor_has_no_results():
    extractor = TopicExtractor(num_topics=2)
    assert not any(hasattr(extractor, name) for name in ("topic_words", "topic_scores", "labels"))


def test_bad_settings_and_inputs(spark, themed):
    for bad in (dict(num_topics=0), dict(num_topics=2, max_num_words=0), dict(num_topics=2, max_micro_clusters=0)):
        with pytest.raises(ValueError):
            TopicExtractor(**bad)
    with pytest.raises(ValueError, match="cannot form"):
        TopicExtractor(num_topics=9).fit(themed.limit(4))
    with pytest.raises(ValueError, match="no terms"):
        TopicExtractor(num_topics=2, min_df=1).fit(themed.limit(4).withColumn("text", F.lit("a b")))
    with pytest.raises(ValueError, match="max_features"):
        TopicExtractor(num_topics=2, max_model_mb=1, generator_hidden_dim=5000).fit(themed)
