"""Two tokenizers side by side, against whole texts tokenised and cut one by one."""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
import pytest

from themeweave.llm.token_alignment import Aligned, Tokenizers, align_texts, align_tokenizers, hot_bound, read_models

from .corpus_rows import documents

ODD = [
    None, "", "  ", "\n a\n\n b  c ", "nul\x00 x", "▁x y", "<|endoftext|> <s> <0x41>", "a  b  c　 d", "日本語 テキスト🙂🙂 é",
    "x" * 350, "=  =" * 200, "don't 's ''s", "a \t b\r\n c", "one  two  three \u0085 four", "à bŠ c",
]


@pytest.fixture(scope="module")
def tools():
    return Tokenizers(*read_models())


def aligned_alone(tools, text):
    """Counts, groups and links of one text, from its whole encodings."""
    if not text:
        return 0, 0, 0, "", Counter()
    raw = (" " + text).encode()
    sides = [tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)]
    ends = []
    for ids, table in zip(sides, (tools.bytes_a, tools.bytes_b)):
        if b"".join(table[i] for i in ids) != raw:
            return 0, 0, 0, "", Counter()
        at, mine = 0, []
        for i in ids:
            at += len(table[i])
            mine.append(at)
        ends.append(mine)
    groups, links, last = [], Counter(), 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        a, b = ([i for i, e in zip(ids, mine) if last < e <= cut] for ids, mine in zip(sides, ends))
        groups.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
        links.update((x, y) for x in a for y in b)
        last = cut
    return len(sides[0]), len(sides[1]), len(groups), ";".join(groups), links


def test_texts_equal_whole_encodings(tools, awkward):
    texts = [t if t is None else t[:3000] for _, t in awkward] + ODD
    known = Aligned()
    for _ in range(2):  # all stretches new, then all known
        for text, (n_a, n_b, n_groups, groups, pairs, links) in zip(texts, align_texts(tools, known, pa.array(texts))):
            want = aligned_alone(tools, text)
            assert (n_a, n_b, n_groups, groups.decode()) == want[:4]
            assert {divmod(int(p), len(tools.bytes_b)): int(n) for p, n in zip(pairs, links)} == dict(want[4])


def test_a_clash_of_hashes_is_found(tools):
    known = Aligned()
    list(align_texts(tools, known, pa.array(["one two"])))
    known.place = {h: 0 for h in known.place}  # every stretch now looks like the first
    assert [r[3].decode() for r in align_texts(tools, known, pa.array(["one two"]))] == [aligned_alone(tools, "one two")[3]]


@pytest.mark.parametrize("hot", [0, 40, 1 << 19])
def test_documents_equal_brute_force(spark, tools, awkward, hot):
    texts = [(None if i == 3 else i, t if t is None else t[:800]) for i, t in awkward] + [(5, "two words"), (900, "two words")]
    texts += [(1000 + k, t) for k, t in enumerate(ODD)]
    got = align_tokenizers(documents(spark, texts).repartition(3), hot_pairs=hot).toPandas()

    alone = [aligned_alone(tools, t) for _, t in texts]
    count = Counter(pair for one in alone for pair in one[4])
    highest: dict[int, int] = {}
    for (a, _), n in count.items():
        highest[a] = max(n, highest.get(a, 0))
    want = []
    for (doc_id, _), (n_a, n_b, n_groups, groups, links) in zip(texts, alone):
        best = sum(n for (a, b), n in links.items() if count[a, b] == highest[a])
        total = sum(n * count[pair] for pair, n in links.items())
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        want.append((-1 if doc_id is None else doc_id, n_a, n_b, n_groups, sum(links.values()), best, total, digest))
    assert sorted(got.fillna({"doc_id": -1}).itertuples(index=False, name=None)) == sorted(want)


def test_empty_table(spark):
    assert align_tokenizers(documents(spark, [])).count() == 0


def test_hot_bound(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1, 1, 2, 3, 9])], "pair long, n long")
    assert [hot_bound(counts, k) for k in (0, 1, 2, 3, 5)] == [16, 4, 4, 2, 1]
