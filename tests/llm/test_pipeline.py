"""The whole pipeline on planted documents: what each stage must do to its own input."""

from __future__ import annotations

import random

import corpus_pipeline
from themeweave import runtime

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_planted_documents(spark, tmp_path):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = {k: prose(90) for k in range(60)}
    item = prose(40)
    texts[100] = texts[7]  # an exact copy and a near one
    near = (texts[8] + " " + prose(200)).split()
    texts[101], texts[102] = " ".join(near), " ".join([*near[:150], "changed", *near[151:]])
    texts[103] = f"{prose(30)} {item} {prose(30)}"
    texts[104] = f"{prose(40)} password=abcdefghijklmnop {prose(40)}"
    texts[105], texts[106], texts[107] = "too short", None, "again and again and again here now " * 20
    rows = [(d, t, "en", "ab"[d % 2] if d % 9 else None, None if t is None else len(t)) for d, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    # so few documents say nothing about unlabelled ones: their own pairs of words are all that the corpus has
    labels = [(d, 1, 0) for d in texts if d < 105]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, before = corpus_pipeline.table(spark, str(tmp_path), "documents"), set(texts)
    gone = {
        "quality rules": {105, 106, 107}, "n-gram Jaccard join": {100, 102}, "benchmark decontamination": {103},
        "secret scans": set(), "mixing sources": set(),
    }
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path)).checkpoint()
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert before - after == gone[name], name
        assert after <= before, name
        before = after
        if name != "mixing sources":
            assert docs.columns == columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "secret scans":
            kept = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
            assert "abcdefghijklmnop" not in kept[104][0] and kept[104][1] == len(kept[104][0])
            assert all(kept[d][0] == texts[d] for d in kept if d != 104)
    taken = sorted((r.doc_id, r.taken) for r in docs.collect())
    assert taken == sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_secrets_take_one_python_worker_per_task(spark):
    rows = [(1, "a password=abcdefghijklmnop b", "en", "a", 29), (2, "nothing here", "en", "a", 12), (3, None, "en", "a", None)]
    out = corpus_pipeline.secret_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(out.select("doc_id", "text", "n_chars").collect()) == [
        (1, "a [assign] b", 12), (2, "nothing here", 12), (3, None, None),
    ]


def test_near_copies_leave_without_moving_the_texts(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 3)
    text = "one two three four five six seven eight nine ten"
    rows = [(d, text if d < 8 else f"{text} {d} {d + 1} {d + 2}", "en", "a", 1) for d in range(12)] + [(None, text, "en", "a", 1)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).checkpoint()
    out = corpus_pipeline.near_copy_stage(spark, docs, "")
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [0, 8, 9, 10, 11]
    assert out.where("doc_id IS NULL").count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
