"""Benchmark passages in training texts: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case. The n-grams of the benchmark are
counted over the whole corpus. An item's seeds are its rarer n-grams: those at most ``RARE``
times as frequent as its median one, so a phrase of everyday words starts no
alignment, while an item that very many documents hold keeps its seeds. Where an item and a
text share a seed, the item is aligned with the text around it, word by word, with points for
equal words and a price for other words, extra words and missing words. ``share`` is the
best score over the score of a full copy, so edited and partly rewritten copies score high
too.

The corpus is scanned in place, twice, and no text is shuffled. Benchmark items are a stated
query set: they go to the tasks in blocks of at most ``BLOCK_GRAMS`` n-grams, one pass per block.

Defined results: null or empty texts and items hold nothing; repeated rows are scanned one by
one; items of fewer than ``gram`` words are one n-gram of all their words; an empty
benchmark or corpus gives no rows; extra columns of :func:`drop_leaks` pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeweave.llm.columns import text_of
from themeweave.llm.hashing import slices
from themeweave.runtime import new_run_folder, store

GRAM, RARE = 4, 4
#: Share of an item's full score from which a text counts as holding it.
MIN_SHARE = 0.5
SAME, OTHER, GAP = 2, -1, -1
BLOCK_GRAMS = 1_000_000

WORD = re.compile(r"[^\W_]+")
LEAKS = "key long, item_id long, score int, share double, first_word int, last_word int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams_of(words: list[str], size: int) -> list[str]:
    """n-grams; all words as one if there are fewer."""
    size = min(size, len(words))
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if size else []


class Items:
    """A block of items with the places of their n-grams."""

    def __init__(self, rows: list[tuple[int, str]], gram: int):
        self.words = [(item, words_of(text)) for item, text in rows]
        self.grams: dict[str, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.words):
            for at, text in enumerate(grams_of(words, gram)):
                self.grams.setdefault(text, []).append((k, at))
        self.sizes = sorted({min(gram, len(words)) for _, words in self.words if words})

    def hits(self, words: list[str]) -> Iterator[tuple[int, str]]:
        for size in self.sizes:
            for at in range(len(words) - size + 1):
                text = " ".join(words[at : at + size])
                if text in self.grams:
                    yield at, text

    def keep_rare(self, counts: dict[str, int], rare: int) -> None:
        mine: dict[int, list[int]] = {}
        for text, places in self.grams.items():
            for k, _ in places:
                mine.setdefault(k, []).append(counts.get(text, 0))
        limit = {k: rare * max(1.0, float(np.median(seen))) for k, seen in mine.items()}
        kept = {t: [p for p in places if counts.get(t, 0) <= limit[p[0]]] for t, places in self.grams.items()}
        self.grams = {t: places for t, places in kept.items() if places}


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local score and the stretch of ``text`` that has it, end exclusive (Smith-Waterman)."""
    n = len(text)
    steps = np.arange(n + 1) * GAP
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, first, last = 0, 0, 0
    for word in item:
        diagonal = row[:-1] + np.where(text == word, SAME, OTHER)
        above = row + GAP
        score = np.maximum(above, 0)
        start = np.where(above > 0, begin, np.arange(n + 1))
        better = diagonal > score[1:]
        score[1:] = np.where(better, diagonal, score[1:])
        start[1:] = np.where(better, begin[:-1], start[1:])
        # extra words of the text: the best of all scores to the left less their distance
        lifted = score - steps
        lead = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == lead, np.arange(n + 1), 0))
        row, begin = lead + steps, start[source]
        top = int(row.argmax())
        if row[top] > best:
            best, first, last = int(row[top]), int(begin[top]), top
    return best, first, last


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str]]]:
    for batch in batches:
        for piece in slices(batch):
            for key, text in zip(piece.column("key").to_pylist(), piece.column("text").to_pylist(), strict=True):
                yield key, words_of(text)


def _seed_counts(items: Items):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for _, words in _texts(batches):
            for text in {text for _, text in items.hits(words)}:
                counts[text] = counts.get(text, 0) + 1
        yield pa.RecordBatch.from_pydict({"gram": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    return work


def leaks_of(words: list[str], items: Items, min_share: float) -> Iterator[tuple[int, int, float, int, int]]:
    """``(item_id, score, share, first_word, last_word)`` of every item that a text holds."""
    starts: dict[int, set[int]] = {}
    for at, text in items.hits(words):
        for k, place in items.grams[text]:
            starts.setdefault(k, set()).add(at - place)
    for k, begins in starts.items():
        item, mine = items.words[k]
        numbers = {w: i for i, w in enumerate(dict.fromkeys(mine))}
        pattern = np.array([numbers[w] for w in mine])
        full, found, reach = SAME * len(mine), (0, 0, 0), -1
        # stretches around neighbouring seeds are one stretch
        stretches: list[list[int]] = []
        for begin in sorted(begins):
            first, last = max(0, begin - len(mine)), min(len(words), begin + 2 * len(mine))
            if first <= reach:
                stretches[-1][1] = last
            else:
                stretches.append([first, last])
            reach = last
        for first, last in stretches:
            text = np.array([numbers.get(w, -1) for w in words[first:last]])
            score, start, end = align(pattern, text)
            found = max(found, (score, -first - start, first + end))
        if found[0] >= min_share * full:
            yield item, found[0], found[0] / full, -found[1], found[2]


def _leak_rows(items: Items, min_share: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "item_id", "score", "share", "first_word", "last_word"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for key, words in _texts(batches):
            rows += [(key, *leak) for leak in leaks_of(words, items, min_share)]
            if len(rows) >= 10_000:
                yield out()
                rows = []
        yield out()

    return work


def item_blocks(benchmark: DataFrame, gram: int) -> Iterator[Items]:
    """The items in blocks of about ``BLOCK_GRAMS`` words, one at a time on the driver."""
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).where("text != ''")
    size = known.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"\S+"))), F.lit(0)).alias("n")).first().n
    blocks = max(1, ceil(size / BLOCK_GRAMS))
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        if rows:
            yield Items([(r.item_id, r.text) for r in rows], gram)


def find_leaks(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, rare: int = RARE, min_share: float = MIN_SHARE, key: str = "doc_id") -> DataFrame:
    """``<key, item_id, score, share, first_word, last_word>``: a row per text and item it holds."""
    texts = docs.select(F.col(key).cast("long").alias("key"), text_of().alias("text"))
    found = docs.sparkSession.createDataFrame([], LEAKS)
    for items in item_blocks(benchmark, gram):
        counts = texts.mapInArrow(_seed_counts(items), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        items.keep_rare({r.gram: r.n for r in counts.collect()}, rare)
        found = found.unionByName(texts.mapInArrow(_leak_rows(items, min_share), LEAKS))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item. A row is known by the hash of its text, so ids may be missing."""
    marked = docs.withColumn("_text_key", F.xxhash64(text_of()))
    leaks = find_leaks(marked, benchmark, key="_text_key", **options).select(F.col("key").alias("_text_key")).distinct()
    leaks = store(leaks, f"{new_run_folder(docs.sparkSession)}/leaks")
    return marked.join(leaks, "_text_key", "left_anti").select(*docs.columns)
