"""Formats against Python's expressions, and terms that reveal an entity."""

from __future__ import annotations

import re

from .corpus_rows import documents

from themeweave.llm import pii


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    formats = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(kind, m.start(), m.end()) for kind, p, holds in formats for m in re.finditer(p, text or "") if holds(m)]


ODD = [
    "a@b.c_d@e.f x@y z@@q.r .@a-.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.000255 1.2.3", "4111 1111 1111 1111 4111111111111111-4",
    "é 5500-0000-0000-0004 +49 (30) 123-4567 +1 2 +123456789012345678", "7 " * 30, "9" * 6000, "ñ😀 me@x.org 😀10.0.0.1", "x" * 3000 + "@",
]


def test_formats_and_awkward_rows(spark, awkward):
    texts = awkward + list(enumerate(ODD, start=5000))
    found = pii.find_pii(documents(spark, texts)).collect()
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii if s.kind != "term"] for r in found}
    assert got == {d: plain_spans(t) for d, t in texts}
    assert pii.find_pii(documents(spark, [])).count() == 0


def test_revealing_terms(spark):
    texts = [(k, f"note {k} from Zebulon me@x.org and more{k % 7}") for k in range(6)]
    texts += [(100 + k, f"note {k} from somebody u{k}@y.org and more{k % 7}") for k in range(300)]
    out = pii.find_pii(documents(spark, texts))
    terms = {(r.doc_id, s.value) for r in out.collect() for s in r.pii if s.kind == "term"}
    assert terms == {(k, "Zebulon") for k in range(6)}
    clean = out.where("doc_id = 0").select(pii.sanitise(out["text"], out["pii"])).first()[0]
    assert clean == "note 0 from  [email] and more0"


def found_terms(frame):
    return {(r.doc_id, s.kind, s.value) for r in frame.collect() for s in r.pii if s.kind not in pii.KINDS}


def test_terms_are_whole_words_judged_by_the_whole_corpus(spark):
    """A word of the corpus is no term, even if it stands beside every mention; distance doesn't matter."""
    far = "filler " * 200
    texts = [(k, f"and Zebulonidae {far} n{k} me@x.org and 10.0.0.{k}") for k in range(5)]
    texts += [(50 + k, f"and Quist n{k} me@x.org") for k in range(2)]
    texts += [(100 + k, " ".join(["and filler"] * 25) + f" n{k}") for k in range(500)]
    assert found_terms(pii.find_pii(documents(spark, texts))) == {(k, "term", "Zebulonidae") for k in range(5)}


def test_hints_are_generalised(spark):
    """A word that stands in other documents too, but seldom, is replaced by its class."""
    texts = [(k, f"say Mirelle at me@x.org n{k}") for k in range(6)]
    texts += [(100 + k, f"say Mirelle twice n{k}") for k in range(4)] + [(200 + k, f"say nothing at n{k}") for k in range(800)]
    out = pii.find_pii(documents(spark, texts))
    hints = {x for x in found_terms(out) if x[2] == "Mirelle"}
    assert hints == {(k, "hint", "Mirelle") for k in range(6)}
    assert out.where("doc_id = 0").select(pii.sanitise(out["text"], out["pii"])).first()[0] == "say [name] at [email] n0"


def test_copies_of_one_text_are_no_evidence(spark):
    texts = [(k, "Mirelle wrote from me@x.org") for k in range(50)] + [(100 + k, f"n{k} other words") for k in range(500)]
    assert not found_terms(pii.find_pii(documents(spark, texts)))


def test_rows_without_ids_repeated_rows_and_a_clashing_column(spark):
    rows = [(None, "Mirelle n1 me@x.org", "old"), (None, "Mirelle n2 me@x.org", "old"), (4, "Mirelle n3 me@x.org", "old")]
    rows += [rows[-1], (None, None, None), (6, "", "old")] + [(100 + k, f"n{k} other", "old") for k in range(400)]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, PII string"))
    assert [c for c in out.columns] == ["doc_id", "text", "pii"] and out.count() == len(rows)
    assert sorted(len(r.pii) for r in out.collect())[-5:] == [0, 2, 2, 2, 2]
