"""Scores of whole documents under a recurrent language model trained on the corpus.

Word counts cover all training documents and the whole vocabulary. The network itself knows a
fixed number of symbols: one for each of the most frequent words, and buckets that the other words
fall into by their hash. A word's probability is that of its symbol times its share of the symbol,
which is 1 for a frequent word and follows the exact counts within a bucket.

* Counts of the ``HEAD_WORDS`` most frequent words at most go along with the tasks; rarer ones meet
  theirs by a join on the word's hash, so no very frequent word is a join key.
* Documents become rows of 16-bit symbols once, dealt out by a hash of id and text, so that each shard is a
  mixture of all sources. The same hash orders a shard and deals its documents to the rounds: what the net learns
  does not depend on files, partitions or cores.
* Training takes ``ROUNDS`` jobs over disjoint parts of the training documents, each token once. In
  each, every shard trains its own copy of the net and the copies are averaged, weighted by
  symbols, block by block. The net has the same size for every corpus.

Words are told apart by 64-bit hashes. A null text is empty and a null id counts as an empty one.
Repeated rows are scored each on their own, and take part in the training each; an empty table gives no rows; texts of
any length are scored whole. Words of equal frequency are ordered by their hash. Without training documents the counts are zero. Other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from themeweave.llm import hashing, recurrent_model as net
from themeweave.llm.columns import text_of
from themeweave.runtime import new_run_folder, store

#: The fold held out.
FOLDS, HELD_OUT = 7, 2

#: Documented widths of the net: classes, symbols per class, state, and how many symbols are buckets.
CLASSES, MEMBERS, WIDTH, BUCKETS = 32, 64, 24, 64
HEAD_WORDS = 262_144
ROUNDS = 3
#: Tokens of a shard, and the number of shards from which on each takes more.
SHARD_TOKENS, MAX_SHARDS = 2_000_000, 20_000
SEED = 17

#: Weights of the net are averaged in blocks of so many.
BLOCK = 2048
#: Bytes of text hashed at a time: what that takes stays in the processor's cache.
PIECE_BYTES = 1 << 20
END = np.uint64(0x5D1F0E3B7A92C846)
#: Of symbols that no word has, so that their logarithm exists.
NO_MASS = 1e-3


@dataclass
class Counts:
    """What a task needs to know of the training words; bounded by ``HEAD_WORDS``."""

    total: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    least: int
    masses: np.ndarray


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def tokens_of(texts: hashing.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and where each text's begin."""
    words, bounds = texts.word_hashes(lower=True)
    return np.insert(words, bounds[1:], END), bounds + np.arange(len(bounds))


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in hashing.slices(batch):
            parts = [tokens_of(hashing.Texts(part.column("text")))[0] for part in hashing.slices(piece, size=PIECE_BYTES)]
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["hash", "n"])


def gather(counts: DataFrame) -> Counts:
    """Totals, the most frequent words and the weight of each symbol, from stored ``<hash, n>``."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    # counts fall into under 1,100 steps of a logarithmic scale; whole steps are taken while they fit
    scale = counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    least, room = np.iinfo(np.int64).max, HEAD_WORDS
    for row in sorted(scale.collect(), key=lambda r: -r.step):
        room -= row.words
        if room < 0:
            break
        least = row.least
    head = counts.where(F.col("n") >= F.lit(int(least))).toPandas()
    hashes, n = head["hash"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64)
    order = np.lexsort((hashes, -n))
    own = CLASSES * MEMBERS - BUCKETS
    symbols = own + (hashes % np.uint64(BUCKETS)).astype(np.int64)
    masses = np.full(CLASSES * MEMBERS, NO_MASS)
    masses[: min(own, len(n))] = n[order[:own]] + 1
    buckets = counts.groupBy(F.col("hash").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.sum(F.col("n") + 1).alias("mass"))
    masses[own:] = 1  # a word that was never seen
    for row in buckets.collect():
        masses[own + row.b] += row.mass
    np.subtract.at(masses, symbols[order[:own]], n[order[:own]] + 1)
    symbols[order[:own]] = np.arange(min(own, len(n)))
    by_hash = np.argsort(hashes)
    return Counts(sums.total, sums.distinct, hashes[by_hash], n[by_hash], symbols[by_hash].astype(np.int16), int(least), masses)


class Lookup:
    """Places of numbers in a sorted array of 64-bit hashes: the upper bits tell about where to look."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(1, (len(hashes) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """As ``np.searchsorted``, but at most the last place."""
        last = len(self.hashes) - 1
        place = np.minimum(self.first[(wanted >> self.shift).astype(np.int64)], last)
        behind = np.flatnonzero(self.hashes[place] < wanted)
        while len(behind):
            place[behind] += 1
            behind = behind[place[behind] <= last]
            behind = behind[self.hashes[place[behind]] < wanted[behind]]
        return np.minimum(place, last, out=place)


def encode_rows(counts: Counts):
    own = CLASSES * MEMBERS - BUCKETS
    weight_logs = np.log10(counts.counts + 1.0)
    mass_logs = np.where(np.arange(CLASSES * MEMBERS) >= own, np.log10(counts.masses), 0.0)

    def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, bounds[:-1])  # each text has its end, so none is empty

    def encode(piece: pa.RecordBatch, head: Lookup) -> pa.RecordBatch:
        tokens, bounds = tokens_of(hashing.Texts(piece.column("text")))
        known = np.zeros(len(tokens), bool)
        symbols = (own + (tokens % np.uint64(BUCKETS)).astype(np.int64)).astype(np.int16)
        logs = np.zeros(len(tokens))
        if len(counts.hashes):
            place = head.places(tokens)
            known = counts.hashes[place] == tokens
            symbols = np.where(known, counts.symbols[place], symbols)
            logs = np.where(known, weight_logs[place], 0.0)
        shares = np.where(symbols >= own, logs - mass_logs[symbols], 0.0)
        n = np.diff(bounds)
        rare = np.flatnonzero(~known)
        row = hashing.row_of(bounds, len(tokens))[rare]
        order = np.lexsort((tokens[rare], row))
        row, words = row[order], tokens[rare][order]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (words[1:] != words[:-1]))) if len(row) else row
        items = pa.StructArray.from_arrays(
            [pa.array(words[new].view(np.int64)), pa.array(np.diff(np.append(new, len(row))).astype(np.int32))], names=["hash", "times"]
        )
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[new], np.arange(len(n) + 1)).astype(np.int32)), items)
        blob = pa.array([symbols[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        arrays = [pa.array(n), pa.array(sums(known.astype(np.int64), bounds)), pa.array(sums(logs, bounds)), pa.array(sums(shares, bounds))]
        names = ["doc_id", "row", "draw", "held_out"]
        return pa.RecordBatch.from_arrays(
            [*(piece.column(c) for c in names), *arrays, lists, blob],
            names=[*names, "n_tokens", "n_known", "logs", "shares", "rare", "symbols"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = Lookup(counts.hashes)
        for batch in batches:
            for piece in hashing.slices(batch, size=PIECE_BYTES):
                yield encode(piece, head)

    return work


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("symbols"), strict=True):
            yield shard, np.frombuffer(blob.as_buffer(), dtype=np.int16).astype(np.int32)


def train_rows(flat: np.ndarray):
    """Train a copy of the net on each shard of a task and give it out in weighted blocks."""

    def blocks_of(texts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        weights, n = net.train(net.unpack(flat, CLASSES, MEMBERS, WIDTH), texts)
        if not n:
            return
        packed = net.pack(weights)
        starts = range(0, len(packed), BLOCK)
        blocks = [packed[at : at + BLOCK].tobytes() for at in starts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(blocks))), pa.array(np.full(len(blocks), n)), pa.array(blocks, pa.binary())],
            names=["block", "n", "part"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), key=itemgetter(0)):
            yield from blocks_of(text for _, text in rows)

    return work


def average_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted mean of each block; the rows stream through."""
    sums: dict[int, tuple[np.ndarray, int]] = {}
    for batch in batches:
        for block, n, part in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "part")), strict=True):
            total, weight = sums.get(block, (0.0, 0))
            sums[block] = total + np.frombuffer(part, np.float32).astype(np.float64) * n, weight + n
    means = [(total / weight).astype(np.float32).tobytes() for total, weight in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(means, pa.binary())], names=["block", "part"])


def fit(encoded: DataFrame, masses: np.ndarray) -> np.ndarray:
    """Weights of the net after one pass over all training rows, as one flat array."""
    flat = net.pack(net.start_weights(masses, CLASSES, WIDTH, SEED))
    lessons = encoded.where(~F.col("held_out")).select("draw", "shard", "symbols")
    for turn in range(ROUNDS):
        mine = lessons.where(F.pmod(F.xxhash64("draw"), F.lit(ROUNDS)) == turn).select("shard", "symbols")
        parts = mine.mapInArrow(train_rows(flat), "block long, n long, part binary")
        means = parts.repartition("block").sortWithinPartitions("block", "n", "part").mapInArrow(average_rows, "block long, part binary")
        blocks = sorted(means.collect())
        if blocks:
            flat = np.concatenate([np.frombuffer(row.part, np.float32) for row in blocks])
    return flat


def score_rows(flat: np.ndarray):
    """Add ``model_log``, the log10 probability of each row's symbols."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = net.unpack(flat, CLASSES, MEMBERS, WIDTH)
        for batch in batches:
            column = batch.column("symbols")
            sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
            texts = ((int(i), np.frombuffer(column[int(i)].as_buffer(), np.int16).astype(np.int32)) for i in np.argsort(-sizes, kind="stable"))
            logs = np.zeros(batch.num_rows)
            for row, log in net.score(weights, texts):
                logs[row] += log
            kept = [c for c in batch.schema.names if c != "symbols"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(logs / math.log(10))], names=[*kept, "model_log"]
            )

    return work


def score_documents(docs: DataFrame) -> DataFrame:
    """``<doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score>`` of every row."""
    folder = new_run_folder(docs.sparkSession)
    docs = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    found = docs.where(~F.col("held_out")).select("text").mapInArrow(count_tokens, "hash long, n long")
    table = store(found.groupBy("hash").agg(F.sum("n").alias("n")), f"{folder}/counts")
    counts = gather(table)

    draw = F.xxhash64(F.col("doc_id").cast("string"), "text")
    numbered = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("draw", draw)
    kinds = [numbered.schema[c] for c in ("doc_id", "row", "draw", "held_out")]
    rare = "rare array<struct<hash: long, times: int>>, symbols binary"
    fields = StructType.fromDDL(f"n_tokens long, n_known long, logs double, shares double, {rare}")
    schema = StructType([*kinds, *fields.fields])
    shards = min(max(1, -(-counts.total // SHARD_TOKENS)), MAX_SHARDS)
    # the rows of a shard lie in one file, however many there are, and it is read by one task as long as it fits a split
    dealt = numbered.mapInArrow(encode_rows(counts), schema).withColumn("shard", F.pmod(F.hash("draw"), F.lit(shards)))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "draw", "n_tokens")
    encoded = store(dealt, f"{folder}/symbols")

    words = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.hash", "r.times")
    seen = words.join(table.where(F.col("n") < F.lit(counts.least)), "hash", "left")
    c = F.coalesce("n", F.lit(0))
    rare_sums = seen.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c + 1)).alias("rare_logs"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )

    flat = fit(encoded, counts.masses)
    plain = encoded.drop("rare", "draw", "shard")
    scored = plain.mapInArrow(
        score_rows(flat), StructType([*(f for f in plain.schema if f.name != "symbols"), StructField("model_log", DoubleType())])
    )
    rare_logs, rare_known = (F.coalesce(c, F.lit(0)) for c in ("rare_logs", "rare_known"))
    size = math.log10(counts.total + counts.distinct + 1)
    return scored.join(rare_sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + rare_known).cast(LongType()).alias("n_known"),
        F.lit(counts.total).cast(LongType()).alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * F.lit(size)).alias("base_score"),
        (F.col("model_log") + F.col("shares") + rare_logs).alias("score"),
    )
