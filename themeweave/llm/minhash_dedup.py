"""Near copies by fast similarity sketches, bands, and comparison of the full sets.

Texts become sets of word shingles. Equal sets are one class, told apart by 128 bits; only one row of
a class takes part in the search.

1. A sketch has ``BINS`` coordinates, filled in rounds. In each of the first ``BINS`` rounds every shingle is
   hashed into a bin; a bin that no earlier round filled keeps its smallest hash. In round ``BINS + i``
   all shingles go to bin ``i``, so after ``2 * BINS`` rounds every coordinate is filled. A long text is done
   after a round or two, and the share of equal coordinates is concentrated about the Jaccard similarity.
2. Bands of ``ROWS`` coordinates are the keys of buckets. Sets with a similarity of 0.85 share none of the 32
   bands with probability ``(1 - 0.85 ** 4) ** 32``, less than 1e-10.
3. Each set is compared with the first members of its buckets, at most two of them.
4. Members of a bucket that these links leave in different groups are compared with each other, in tiles of
   bounded size, once per pair: in the first band that both share. Similar sets agree in fewer than
   ``LIKELY`` coordinates with probability below 1e-10. Then the leading bits of all hashes of both sets are
   compared; equal hashes have equal leading bits, so this never counts too few, and only pairs that still
   reach the limit leave the tile, to be compared on the full sets. No bucket is capped.
5. Links join the classes into groups; a document gets the smallest id of its group.

Defined results of :func:`near_copies`: a null or empty text, or one without words, has an empty set and is
linked with nothing. Every row is judged by itself: repeated rows, and rows with the same id, keep a row
each. A row without an id takes the smallest id of its group, null if there is none, and is kept only
if null. Links are exact on sets of 64-bit shingle hashes, a tie at the limit counts as a link. Very long texts
are worked on whole. An empty table gives no rows. Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeweave.llm import hashing
from themeweave.llm.columns import text_of
from themeweave.llm.hot_keys import join_weighted
from themeweave.llm.ngram_join import components, shingle_hashes
from themeweave.runtime import new_run_folder, store

SHINGLE, PERCENT = 3, 85
#: Coordinates of a sketch, and how many make a band.
BINS, ROWS = 128, 4
#: Fewest equal coordinates, of ``BINS``, for a comparison of full sets.
LIKELY = 77
#: Members compared with one first member in a block, and members of a side of a tile.
BLOCK, TILE = 64, 1024
#: Sets of up to this many hashes are told by 16 leading bits in a tile, larger ones by 32.
SHORT_SET = 2048

_BIN_BITS = BINS.bit_length() - 1
_EMPTY = np.uint64(hashing.MASK)

SKETCHES = "doc long, text_key long, high long, low long, n int, bands array<long>, sketch binary"
PAIRS = "a long, b long"


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BINS`` coordinates per non-empty set of hashes."""
    out = np.full((len(sets), BINS), _EMPTY, dtype=np.uint64)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = out.ravel()
    for turn in range(2 * BINS):
        if not len(items):
            break
        salt = hashing.mix(np.array([turn + 1], dtype=np.uint64))
        hashes = hashing.mix(items ^ salt)
        bins = (hashes >> np.uint64(64 - _BIN_BITS)).astype(np.int64) if turn < BINS else turn - BINS
        place = owner * BINS + bins
        free = flat[place] == _EMPTY
        place, hashes = place[free], hashes[free]
        lowest = np.full(len(flat), _EMPTY, dtype=np.uint64)
        np.minimum.at(lowest, place, hashes)
        filled = np.unique(place)
        flat[filled] = np.minimum(hashing.mix(lowest[filled] + salt), _EMPTY - np.uint64(1))
        open_sets = (out == _EMPTY).any(axis=1)
        still = open_sets[owner]
        items, owner = items[still], owner[still]
    return out


def bands(sketches: np.ndarray) -> np.ndarray:
    """The bucket keys of each sketch."""
    parts = sketches.reshape(len(sketches), BINS // ROWS, ROWS)
    key = np.broadcast_to(np.arange(BINS // ROWS, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        key = hashing.mix(key * hashing.MIX1 + parts[:, :, k])
    return key.view(np.int64)


def set_name(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    sums = [x.sum(dtype=np.uint64) + np.uint64(len(x)) for x in (hashes, hashing.mix(hashes ^ hashing.MIX2))]
    return tuple(hashing.mix(np.array(sums, dtype=np.uint64)).view(np.int64).tolist())


def _sketch_rows(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in hashing.slices(batch):
                sets = list(shingle_hashes(piece, size))
                filled = [k for k, s in enumerate(sets) if len(s)]
                made = sketch([sets[k] for k in filled])
                keys: list = [None] * len(sets)
                small: list = [None] * len(sets)
                for k, mine, coordinates in zip(filled, bands(made), made.astype(np.uint8)):
                    keys[k], small[k] = mine, coordinates.tobytes()
                names = [set_name(s) for s in sets]
                columns = [
                    piece.column("doc"), piece.column("text_key"),
                    pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(small, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SKETCHES.split(", ")])

    return work


def _set_rows(size: int):
    """The set of each class once per task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for piece in hashing.slices(batch):
                sets = {set_name(s): s for s in shingle_hashes(piece, size)}
                fresh = [name for name in sets if name not in seen]
                seen.update(fresh)
                names = [pa.array([name[k] for name in fresh], pa.int64()) for k in (0, 1)]
                content = pa.array([sets[name].tobytes() for name in fresh], pa.binary())
                short = pa.array([leading_bits(sets[name]).tobytes() for name in fresh], pa.binary())
                yield pa.RecordBatch.from_arrays([*names, content, short], names=["high", "low", "items", "leading"])

    return work


def leading_bits(hashes: np.ndarray) -> np.ndarray:
    """The first 16 or 32 bits of every hash, in order."""
    if len(hashes) <= SHORT_SET:
        return np.sort((hashes >> np.uint64(48)).astype(np.uint16))
    return np.sort((hashes >> np.uint64(32)).astype(np.uint32))


def most_shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """For each of the others, no fewer elements than it shares with ``one``, from leading bits."""
    here = np.zeros(1 << 16, dtype=bool)
    here[one >> 16 if one.dtype == np.uint32 else one] = True
    found = []
    for other in others:
        if one.dtype == other.dtype == np.uint32:
            at = np.minimum(np.searchsorted(one, other), len(one) - 1)
            found.append(int((one[at] == other).sum()))
        else:
            found.append(int(here[other >> 16 if other.dtype == np.uint32 else other].sum()))
    return np.array(found, dtype=np.int64)


def enough(shared: int | np.ndarray, n: int | np.ndarray, m: int | np.ndarray, percent: int) -> bool | np.ndarray:
    return 100 * shared >= percent * (n + m - shared)


def _linked(first: bytes, other: bytes, percent: int) -> bool:
    a, b = np.frombuffer(first, np.uint64), np.frombuffer(other, np.uint64)
    if not enough(min(len(a), len(b)), len(a), len(b), percent):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return bool(enough(int((a[at] == b).sum()), len(a), len(b), percent))


def _alike(first: bytes, other: bytes, percent: int) -> bool:
    return int((np.frombuffer(first, np.uint8) == np.frombuffer(other, np.uint8)).sum()) >= LIKELY


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _judge_rows(judge, percent: int):
    """Of rows sorted by ``a, block``, the first member's own row first: the pairs that ``judge`` accepts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            found = []
            for a, own, b, content in zip(*[batch.column(c).to_pylist() for c in ("a", "own", "b", "content")]):
                if own:
                    first = content
                elif judge(first, content, percent):
                    found.append((a, b))
            yield _pair_batch(found)

    return work


def judged(pairs: DataFrame, contents: DataFrame, judge, percent: int, folder: str) -> DataFrame:
    """The pairs ``<a, b>`` that ``judge`` accepts, given ``<node, content>``.

    The members of one ``a`` are dealt into blocks; each block gets the content of ``a`` once.
    """
    counts = store(pairs.groupBy("a").agg(F.count("*").alias("members")), f"{folder}-counts")
    total = counts.agg(F.sum("members").alias("n")).first().n or 0
    dealt = join_weighted(pairs, counts, ["a"], "members", total)
    block = F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / BLOCK)).cast("int")
    members = dealt.select("a", block.alias("block"), F.lit(False).alias("own"), "b")
    firsts = members.select("a", "block").distinct().select("a", "block", F.lit(True).alias("own"), F.col("a").alias("b"))
    rows = members.unionByName(firsts).join(contents.withColumnRenamed("node", "b"), "b")
    ordered = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.desc("own"))
    return store(ordered.mapInArrow(_judge_rows(judge, percent), PAIRS), folder)


def _tile_rows(percent: int):
    """Of rows sorted by tile: pairs of different groups that may link, in the first band that they share."""
    names = ("key", "first", "second", "block", "node", "n", "label", "band", "sketch", "bands", "leading")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, one, two), members in groupby(rows(batches), key=lambda r: r[:3]):
            members = list(members)
            block, node, n, label = (np.array([m[k] for m in members], dtype=np.int64) for k in (3, 4, 5, 6))
            if (label == label[0]).all():
                continue
            band = members[0][7]
            drawn = np.stack([np.frombuffer(m[8], np.uint8) for m in members])
            keys = np.array([m[9] for m in members], dtype=np.int64)
            short = [np.frombuffer(m[10], np.uint16 if m[5] <= SHORT_SET else np.uint32) for m in members]
            left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
            found = []
            for i in left:
                fits = (node[right] > node[i]) if one == two else np.ones(len(right), dtype=bool)
                fits &= (label[right] != label[i]) & enough(np.minimum(n[right], n[i]), n[right], n[i], percent)
                some = right[fits]
                if len(some):
                    some = some[(drawn[some] == drawn[i]).sum(axis=1) >= LIKELY]
                    some = some[(keys[some] == keys[i]).argmax(axis=1) == band]
                    some = some[enough(most_shared(short[i], [short[k] for k in some]), n[some], n[i], percent)]
                    found += [(min(int(node[i]), k), max(int(node[i]), k)) for k in node[some].tolist()]
            yield _pair_batch(found)

    return work


def _apart(members: DataFrame, nodes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, folder: str) -> DataFrame:
    """Pairs of a bucket that lie in different groups and may link.

    ``members`` is ``<key, band, node>``, ``labels`` ``<node, label>``, ``sets`` ``<node, leading>``.
    """
    placed = members.select("key", "band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = store(placed, f"{folder}-placed")
    mixed = placed.groupBy("key").agg(F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = store(mixed.where("low != high").select("key", "members"), f"{folder}-mixed")
    total = mixed.agg(F.sum("members").alias("n")).first().n or 0
    rows = join_weighted(placed, mixed, ["key"], "members", total)
    sides = F.ceil(F.col("members") / TILE).cast("int")
    rows = rows.withColumn("sides", sides).withColumn("block", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
    drawn = nodes.select("node", "n", "sketch", "bands").join(sets.select("node", "leading"), "node")
    rows = rows.join(drawn, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    tiled = rows.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    tile = ("key", "first", "second")
    found = tiled.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_tile_rows(percent), PAIRS)
    return store(found, folder)


def near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``<doc_id, n_shingles, component_id, kept>``, a row per row of ``docs``."""
    folder = new_run_folder(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), text_of().alias("text"))
    texts = texts.select("doc", F.xxhash64("text").alias("text_key"), "text")
    drawn = texts.mapInArrow(_sketch_rows(size), SKETCHES).select(F.monotonically_increasing_id().alias("row"), "*")
    drawn = store(drawn, f"{folder}/sketches")
    classes = drawn.where("n > 0").groupBy("high", "low").agg(
        F.min("row").alias("node"), F.min("doc").alias("doc"), F.min("text_key").alias("text_key"), F.count("*").alias("copies")
    )
    classes = store(classes, f"{folder}/classes")
    chosen = drawn.select(F.col("row").alias("node"), "n", "bands", "sketch").join(classes.select("node"), "node", "left_semi")
    nodes = store(chosen, f"{folder}/nodes")

    keyed = nodes.select(F.posexplode("bands").alias("band", "key"), "node")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("first"))
    buckets = store(buckets.where("members > 1"), f"{folder}/buckets")
    total = buckets.agg(F.sum("members").alias("n")).first().n or 0
    members = store(join_weighted(keyed, buckets, ["key"], "members", total), f"{folder}/members")

    # two first members per node; what they leave apart is compared below
    firsts = members.where("node != first").groupBy("node").agg(F.min("first").alias("low"), F.max("first").alias("high"))
    stars = firsts.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("a"), F.col("node").alias("b"))
    stars = store(stars, f"{folder}/stars")
    sketches = nodes.select("node", F.col("sketch").alias("content"))
    likely = judged(stars, sketches, _alike, percent, f"{folder}/likely")

    sets = class_sets(members.select("node").distinct(), classes, texts, size, f"{folder}/sets")
    full = sets.select("node", "content")
    links = judged(likely, full, _linked, percent, f"{folder}/star-links")
    grouped = components(links, f"{folder}/stars-joined")
    apart = _apart(members, nodes, grouped, sets, percent, f"{folder}/apart")
    more = judged(apart, full, _linked, percent, f"{folder}/more-links")
    labels = components(store(links.unionByName(more), f"{folder}/links"), f"{folder}/joined")

    named = store(classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), f"{folder}/named")
    smallest = named.groupBy("label").agg(F.count("*").alias("members"), F.min("doc").alias("component_id"))
    smallest = store(smallest, f"{folder}/smallest")
    placed = join_weighted(named.drop("doc"), smallest, ["label"], "members", classes.count())
    placed = store(placed.select("high", "low", "copies", "component_id"), f"{folder}/placed")
    rows = drawn.where("n > 0").select("high", "low", "doc", "n")
    whole = join_weighted(rows, placed, ["high", "low"], "copies", drawn.count()).select("doc", "n", "component_id")
    empty = drawn.where("n = 0").select("doc", "n", F.col("doc").alias("component_id"))
    return whole.unionByName(empty).select(
        F.col("doc").alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        "component_id",
        F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def class_sets(wanted: DataFrame, classes: DataFrame, texts: DataFrame, size: int, folder: str) -> DataFrame:
    """``<node, content, leading>`` of the wanted classes. Only texts of these are read again.

    The joins are shuffled at any size, so that what they cost follows the input.
    """
    wanted = store(wanted.join(classes, "node").select("node", "high", "low", "text_key"), f"{folder}-wanted")
    again = texts.join(wanted.select("text_key").distinct().hint("shuffle_hash"), "text_key", "left_semi").select("text")
    made = again.mapInArrow(_set_rows(size), "high long, low long, items binary, leading binary")
    made = made.join(wanted.hint("shuffle_hash"), ["high", "low"])
    one = made.groupBy("node").agg(F.first("items").alias("content"), F.first("leading").alias("leading"))
    return store(one, folder)
