"""Jaccard join of n-gram sets over prefix trees, and the groups that its links make.

Texts become sets of word shingles, and each distinct set is one class, so exact copies cost
a row each and no comparison. Shingles have one order for the whole corpus: by how often
their hash bucket occurs, then by hash, the rare first.

1. Two sets that link share a shingle among the first ``n - ceil(t * n) + 1`` of each. Sets that
   share such a shingle and have fitting sizes meet at a pivot, the smallest of them, so a
   large group of near copies makes at most two pairs per member, not all pairs.
2. Each set has a parity map, a bit or two per shingle, more for short texts. Two maps differ in at most as many bits as the
   sets differ in shingles, so pairs whose maps differ in more can't link; only the sets of the others
   are made and moved.
3. The members of a pivot, in blocks of ``BLOCK``, are stored in a prefix tree. The
   pivot runs down the tree: what it shares with a stretch of tree is counted once for all sets
   below, and a subtree is left as soon as the shingles that remain can't make up the rest.
4. Pairs whose ends the links of the pivots already connect need no look. Each set first meets its
   nearest of another group at a shingle, as far as parity maps tell; the links of these join most groups. All other
   pairs that share a shingle of step 1 and pass the size and place bounds are compared by their parity
   maps, folded once, where the shingle lies, and become rows only if these leave them; those are compared
   the same way, by whole maps first, so no link between different groups is lost.

Defined results of :func:`ngram_components`: a null or empty text has an empty set and is linked
with nothing; rows with the same id are one document, each row with its own set size;
rows without an id take no part, and their group is null; extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from themeweave.llm import hashing
from themeweave.llm.columns import text_of
from themeweave.runtime import lookup_join, new_run_folder, store

SHINGLE, PERCENT = 3, 90
#: Buckets of the frequency table that gives the order of shingles; its size is the same for any corpus.
BUCKET_BITS = 16
#: Bits of an ordered shingle that hold its frequency level.
LEVEL_BITS = 6
#: Members of a pivot compared in one block.
BLOCK = 64
#: Bytes of text worked on at a time; running sums and powers take about a hundred times as much.
PIECE_BYTES = 1 << 20
#: Fewest bits of a parity map.
MAP_BITS = 256
#: Pairs of one token compared at a time.
CHUNK = 1 << 17

CLASSES = "doc long, node long, n int, content binary, short binary"
CONTENT = "node long, n int, content binary"
PREFIXES = "token long, node long, n int, place int"
PAIRS = "a long, b long"


def shingle_hashes(piece: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text; all words as one shingle if they are fewer."""
    words, bounds = hashing.Texts(piece.column("text")).word_hashes(lower=True)
    sums = hashing.running(words)
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        width = min(size, last - first)
        if not width:
            yield np.zeros(0, np.uint64)
            continue
        at = np.arange(first, last - width + 1)
        yield np.unique(hashing.mix(hashing.stretch(sums, at, at + width) + np.uint64(width)))


def node_of(hashes: np.ndarray) -> int:
    """Number of the class of a set."""
    return int(hashing.mix(np.array([hashes.sum(dtype=np.uint64) + np.uint64(len(hashes))]))[0].view(np.int64))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from hashing.slices(batch, size=PIECE_BYTES)


def parity_map(hashes: np.ndarray) -> bytes:
    """A bit per place, set where an odd number of shingles fall; at least as many places as shingles."""
    places = max(MAP_BITS, 1 << max(0, len(hashes) - 1).bit_length())
    at = (hashes & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(content: bytes, words: int) -> np.ndarray:
    """A parity map of ``words`` 64-bit words, made of one at least as long."""
    x = np.frombuffer(content, np.uint64)
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def short_map(content: bytes) -> bytes:
    """A parity map folded once, unless it has the fewest bits."""
    return folded(content, max(MAP_BITS // 64, len(content) // 16)).tobytes()


def map_distance(a: bytes, b: bytes) -> int:
    """Places in which two parity maps differ, the longer one folded to the other's length."""
    words = min(len(a), len(b)) // 8
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


def _class_rows(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            sets = list(shingle_hashes(piece, size))
            nodes = pa.array([node_of(s) for s in sets], pa.int64())
            counts = pa.array([len(s) for s in sets], pa.int32())
            maps = [parity_map(s) for s in sets]
            arrays = [piece.column("doc"), nodes, counts, pa.array(maps, pa.binary()), pa.array([short_map(m) for m in maps], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "node", "n", "content", "short"])

    return work


def _bucket_rows(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for piece in _pieces(batches):
            for hashes in shingle_hashes(piece, size):
                counts += np.bincount((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    return work


def frequency_levels(texts: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Level of every bucket; the driver gets one number per bucket, whatever the corpus."""
    rows = texts.mapInArrow(_bucket_rows(size), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    levels = np.zeros(1 << BUCKET_BITS, dtype=np.uint64)
    base = sum(r.n for r in rows) / len(levels) + 1
    for row in rows:
        levels[row.bucket] = min((1 << LEVEL_BITS) - 1, int(8 * log2(1 + row.n / base)))
    return levels


def ordered(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles as numbers in the order of the corpus."""
    level = levels[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    return np.sort((level << np.uint64(64 - LEVEL_BITS)) | (hashing.mix(hashes) >> np.uint64(LEVEL_BITS)))


def prefix_length(n: int, percent: int) -> int:
    """Sets that link share one of their first so many shingles."""
    return n - -(-n * percent // 100) + 1


def overlap_needed(n: int | np.ndarray, m: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Smallest intersection that links sets of these sizes: ``100 i >= percent (n + m - i)``."""
    return -(-percent * (n + m) // (100 + percent))


def _prefix_rows(size: int, percent: int, levels: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for piece in _pieces(batches):
            tokens, nodes, counts, places = [], [], [], []
            for hashes in shingle_hashes(piece, size):
                node = node_of(hashes)
                if not len(hashes) or node in seen:
                    continue
                seen.add(node)
                mine = ordered(hashes, levels)[: prefix_length(len(hashes), percent)]
                tokens.append(mine.view(np.int64))
                nodes.append(np.full(len(mine), node))
                counts.append(np.full(len(mine), len(hashes), np.int32))
                places.append(np.arange(len(mine), dtype=np.int32))
            if tokens:
                arrays = [pa.array(np.concatenate(x)) for x in (tokens, nodes, counts, places)]
                yield pa.RecordBatch.from_arrays(arrays, names=["token", "node", "n", "place"])

    return work


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(x).to_pylist() for x in names], strict=True)


def _pair_batches(pairs: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    out: set[tuple[int, int]] = set()
    for pair in pairs:
        out.add(pair)
        if len(out) >= 100_000:
            yield pa.RecordBatch.from_pydict({"a": [p[0] for p in out], "b": [p[1] for p in out]})
            out.clear()
    if out:
        yield pa.RecordBatch.from_pydict({"a": [p[0] for p in out], "b": [p[1] for p in out]})


def _may_link(n: int, i: int, m: int, j: int, percent: int) -> bool:
    """Bound by sizes and by the places of a shared shingle."""
    return min(i, j) + min(n - i, m - j) >= overlap_needed(n, m, percent)


def _pivot_pairs(percent: int):
    """Of rows sorted by ``token, n, node``: each with the smallest set of its token that fits its size."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        token = pivot = None
        for now, node, n, place in _rows(batches, ("token", "node", "n", "place")):
            if now != token or 100 * pivot[1] < percent * n:
                token, pivot = now, (node, n, place)
            elif pivot[0] != node and _may_link(pivot[1], pivot[2], n, place, percent):
                yield pivot[0], node

    return lambda batches: _pair_batches(pairs(batches))


def map_distances(maps: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`map_distance` of many pairs, given by their places in ``maps``."""
    sizes = np.array([len(x) // 8 for x in maps], dtype=np.int64)
    width = np.minimum(sizes[a], sizes[b])
    out = np.zeros(len(a), dtype=np.int64)
    for words in np.unique(width):
        mine = width == words
        used = np.zeros(len(maps), dtype=bool)
        used[a[mine]] = used[b[mine]] = True
        flat = np.stack([folded(maps[i], int(words)) for i in np.flatnonzero(used)])
        place = np.cumsum(used) - 1
        out[mine] = np.bitwise_count(flat[place[a[mine]]] ^ flat[place[b[mine]]]).sum(axis=1)
    return out


def _whole_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by token, all of a token's rows together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column("token").to_numpy()
        first = int(np.searchsorted(token, token[-1]))  # the last token may go on
        if held and (first or token[-1] != last) or first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
        last = token[-1]
    if held:
        yield pa.Table.from_batches(held)


def _first_of_least(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each key, the place of the first of its least values."""
    order = np.lexsort((values, keys))
    return order[np.append(True, keys[order][1:] != keys[order][:-1])[: len(order)]]


def _group_pairs(percent: int, nearest: bool = False):
    """Of rows sorted by ``token, label, node``: pairs of different groups that may link, as far as sizes,
    places and parity maps tell. Pairs are compared where their token lies, and only those that pass become rows.
    ``nearest`` gives, for each row, only the one with the closest map among those behind it, and among those before it.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        for table in _whole_tokens(batches):
            token, node, n, place, label = (table.column(x).to_numpy() for x in ("token", "node", "n", "place", "label"))
            n, place = n.astype(np.int64), place.astype(np.int64)
            new_token = np.append(True, token[1:] != token[:-1])
            new_label = new_token | np.append(True, label[1:] != label[:-1])
            tokens, labels = np.flatnonzero(new_token), np.flatnonzero(new_label)
            end_token = np.append(tokens[1:], len(token))[np.cumsum(new_token) - 1]
            end_label = np.append(labels[1:], len(token))[np.cumsum(new_label) - 1]
            # each row meets the rows of its token's groups behind its own
            behind = end_token - end_label
            total = np.cumsum(behind)
            if not total[-1]:
                continue
            maps, first = table.column("content").to_pylist(), 0
            while first < len(token):
                before = total[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(total, before + CHUNK, side="right")))
                mine = behind[first:last]
                a = np.repeat(np.arange(first, last), mine)
                b = np.arange(len(a)) + np.repeat(end_label[first:last] - (total[first:last] - mine - before), mine)
                first = last
                fits = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
                a, b = a[fits], b[fits]
                needed = overlap_needed(n[a], n[b], percent)
                fits = np.minimum(place[a], place[b]) + np.minimum(n[a] - place[a], n[b] - place[b]) >= needed
                a, b, needed = a[fits], b[fits], needed[fits]
                unlike = map_distances(maps, a, b)
                near = unlike <= n[a] + n[b] - 2 * needed
                a, b, unlike = a[near], b[near], unlike[near]
                if nearest:
                    best = np.union1d(_first_of_least(a, unlike), _first_of_least(b, unlike))
                    a, b = a[best], b[best]
                # the smaller set first, as pivots have it
                turned = (n[a] > n[b]) | ((n[a] == n[b]) & (node[a] > node[b]))
                yield from zip(node[np.where(turned, b, a)].tolist(), node[np.where(turned, a, b)].tolist(), strict=True)

    return lambda batches: _pair_batches(pairs(batches))


def _set_rows(size: int, levels: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            sets = list(shingle_hashes(piece, size))
            nodes = pa.array([node_of(s) for s in sets], pa.int64())
            counts = pa.array([len(s) for s in sets], pa.int32())
            content = pa.array([ordered(s, levels).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([nodes, counts, content], names=["node", "n", "content"])

    return work


def links_of_pivot(pivot: np.ndarray, members: list[tuple[int, np.ndarray]], percent: int) -> list[int]:
    """Members that link with the pivot: one run over the prefix tree of the members.

    The tree is the sorted list of sets with their common prefixes; ``hits[d]`` is what
    the pivot shares with the first ``d`` shingles of the path at hand.
    """
    members = sorted(members, key=lambda m: m[1].astype(">u8").tobytes())
    linked, before, pruned = [], np.zeros(0, np.uint64), None
    hits = np.zeros(1, np.int64)
    left = np.full(1, len(pivot))  # shingles of the pivot beyond the path's depth
    for node, mine in members:
        needed = overlap_needed(len(pivot), len(mine), percent)
        same = min(len(mine), len(before))
        differs = np.flatnonzero(mine[:same] != before[:same])
        depth = int(differs[0]) if len(differs) else same
        if pruned is not None and depth >= pruned and hits[pruned] + min(left[pruned], len(mine) - pruned) < needed:
            continue
        rest = mine[depth:]
        at = np.searchsorted(pivot, rest)
        found = pivot[np.minimum(at, len(pivot) - 1)] == rest
        hits = np.concatenate([hits[: depth + 1], hits[depth] + np.cumsum(found)])
        left = np.concatenate([left[: depth + 1], len(pivot) - at - found])
        before, pruned = mine, None
        if hits[-1] >= needed:
            linked.append(node)
            continue
        # the first depth from which this set can't reach the overlap any more
        short = hits + np.minimum(left, len(mine) - np.arange(len(hits))) < needed
        pruned = int(short.argmax())
    return linked


def links_by_sets(pivot: tuple[int, bytes], members: list[tuple[int, int, bytes]], percent: int) -> list[int]:
    """Members whose sets link with the pivot's; content is the ordered shingles."""
    sets = [(node, np.frombuffer(content, np.uint64)) for node, _, content in members]
    return links_of_pivot(np.frombuffer(pivot[1], np.uint64), sets, percent)


def near_by_maps(pivot: tuple[int, bytes], members: list[tuple[int, int, bytes]], percent: int) -> list[int]:
    """Members that may link with the pivot as far as parity maps tell."""
    n, mine = pivot
    return [
        node for node, m, content in members
        if map_distance(mine, content) <= n + m - 2 * overlap_needed(n, m, percent)
    ]


def _compared_rows(percent: int, compare):
    """Of blocks sorted by ``a, block, b``, the pivot's own row first: the pairs that ``compare`` keeps."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        key, pivot, members = None, None, []
        for a, block, own, b, n, content in _rows(batches, ("a", "block", "own", "b", "n", "content")):
            if (a, block) != key:
                if members:
                    yield from ((key[0], m) for m in compare(pivot, members, percent))
                key, pivot, members = (a, block), None, []
            if own:
                pivot = (n, content)
            else:
                members.append((b, n, content))
        if members:
            yield from ((key[0], m) for m in compare(pivot, members, percent))

    return lambda batches: _pair_batches(pairs(batches))


def kept_pairs(pairs: DataFrame, contents: DataFrame, percent: int, compare) -> DataFrame:
    """The pairs ``<a, b>`` that ``compare`` keeps; ``contents`` is ``<node, n, content>``, a row per node."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = lookup_join(pairs, sizes, "a", F.col("b")).withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    members = blocks.select("a", "block", F.lit(False).alias("own"), "b")
    pivots = members.select("a", "block").distinct().select("a", "block", F.lit(True).alias("own"), F.col("a").alias("b"))
    rows = members.unionByName(pivots).join(contents.withColumnRenamed("node", "b"), "b")
    order = ("a", "block", F.desc("own"), "b")
    return rows.repartition("a", "block").sortWithinPartitions(*order).mapInArrow(_compared_rows(percent, compare), PAIRS)


def components(links: DataFrame, folder: str) -> DataFrame:
    """``<node, label>``: the smallest node of each group of linked nodes.

    Each round takes the smallest label of the neighbours, then the label of the label. Rounds
    are written to the shared folder; a label that very many nodes share joins by broadcast or
    salted.
    """
    ways = store(links.union(links.select("b", "a")).distinct(), f"{folder}/ways")
    labels = store(ways.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), f"{folder}/labels-0")
    turn, changed = 0, True
    while changed:
        turn += 1
        near = lookup_join(ways, labels.select(F.col("node").alias("b"), "label"), "b", F.col("a"))
        lower = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        joined = labels.join(lower, "node").select("node", F.least("label", "near").alias("via"), F.col("label").alias("old"))
        jumped = lookup_join(joined, labels.select(F.col("node").alias("via"), "label"), "via", F.col("node"))
        labels = store(jumped.select("node", F.least("via", "label").alias("label"), "old"), f"{folder}/labels-{turn}")
        changed = not labels.where("label < old").isEmpty()
        labels = labels.drop("old")
    return labels


def ngram_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``<doc_id, n_shingles, component_id>``, a row per document."""
    folder = new_run_folder(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), text_of().alias("text"))
    known = texts.where("doc IS NOT NULL")
    classes = store(texts.mapInArrow(_class_rows(size), CLASSES), f"{folder}/classes")
    levels = frequency_levels(texts, size)

    # a row per set, with the document that stands for it
    of_set = classes.where("doc IS NOT NULL AND n > 0").groupBy("node")
    one_each = of_set.agg(F.min("doc").alias("doc"), F.min("n").alias("n"), F.first("content").alias("content"), F.first("short").alias("short"))
    maps = store(one_each, f"{folder}/maps")

    def linked_pairs(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose sets link; sets are made for those that the parity maps leave."""
        near = store(kept_pairs(pairs, maps.select("node", "n", "content"), percent, near_by_maps), f"{folder}/{name}-near")
        nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = store(nodes.join(maps.select("node", "doc"), "node").select("doc").distinct(), f"{folder}/{name}-wanted")
        made = known.join(wanted, "doc").mapInArrow(_set_rows(size, levels), CONTENT).dropDuplicates(["node"])
        return kept_pairs(near, store(made, f"{folder}/{name}-sets"), percent, links_by_sets)

    order = ("token", "n", "node")
    rows = known.mapInArrow(_prefix_rows(size, percent, levels), PREFIXES).repartition("token")
    # a row per set and shingle, made where the shingle's rows lie: copies of a set agree in every column
    prefixes = rows.groupBy("token", "node").agg(F.min("n").alias("n"), F.min("place").alias("place"))
    # sizes that fit are neighbours in the order of sizes, so every set of any pair is at a
    # token that two sets of fitting sizes share; the other rows go no further
    shared = prefixes.select("token", "node", "n", "place").sortWithinPartitions(*order).mapInArrow(_shared_rows(percent), PREFIXES)
    shared = store(shared, f"{folder}/shared")
    # two pivots per set, whatever the number of its tokens; what they leave apart is compared below
    by_token = shared.repartition("token").sortWithinPartitions(*order)
    pivots = by_token.mapInArrow(_pivot_pairs(percent), PAIRS).groupBy("b").agg(F.min("a").alias("low"), F.max("a").alias("high"))
    stars = store(pivots.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("a"), "b"), f"{folder}/stars")

    links = store(linked_pairs(stars, "stars"), f"{folder}/star-links")
    labels = components(links, f"{folder}/stars-joined")

    def between_groups(labels: DataFrame, nearest: bool) -> DataFrame:
        # a map is moved to each shingle of its set, so it is the short one; pairs that it leaves meet the whole maps
        known_by = maps.select("node", F.col("short").alias("content")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        grouped = shared.join(known_by, "node").repartition("token").sortWithinPartitions("token", "label", "node")
        return grouped.mapInArrow(_group_pairs(percent, nearest), PAIRS).distinct()

    # first a pair or two per row, which join most groups that belong together; then all pairs of those still apart
    bridges = store(between_groups(labels, True).join(stars, ["a", "b"], "left_anti"), f"{folder}/bridges")
    if not bridges.isEmpty():
        links = store(links.unionByName(linked_pairs(bridges, "bridges")), f"{folder}/bridge-links")
        labels = components(links, f"{folder}/bridges-joined")
        seen = stars.unionByName(bridges)
        rest = store(between_groups(labels, False).join(seen, ["a", "b"], "left_anti"), f"{folder}/rest")
        links = links.unionByName(linked_pairs(rest, "rest"))
    # rows with one id are one document, whatever their sets
    one = Window.partitionBy("doc")
    ties = classes.where("doc IS NOT NULL AND n > 0").select("node", F.min("node").over(one).alias("a"))
    ties = ties.where("node != a").select("a", F.col("node").alias("b"))
    links = store(links.unionByName(ties), f"{folder}/links")
    labels = components(links, f"{folder}/joined")

    full = classes.where("n > 0").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = full.groupBy("label").agg(F.min("doc").alias("component_id"))
    placed = lookup_join(full, smallest, "label", F.col("doc"))
    mine = F.when(F.col("doc").isNotNull(), F.col("component_id"))
    out = placed.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), mine.alias("component_id"))
    empty = classes.where("n = 0").select(F.col("doc").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.col("doc").alias("component_id"))
    return out.unionByName(empty)


def _shared_rows(percent: int):
    """Of rows sorted by ``token, n, node``: those with a neighbour of their token that fits their size."""
    names = ("token", "node", "n", "place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            token, n = (table.column(x).to_numpy() for x in ("token", "n"))
            if not len(token):
                continue
            pair = (token[1:] == token[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:])
            keep = np.concatenate([[False], pair]) | np.concatenate([pair, [False]])
            # the last two rows go round again: they give the next batch its neighbour
            cut = max(0, len(token) - 1)
            fresh = keep[:cut].copy()
            if held is not None and len(fresh):
                fresh[0] |= held_kept
            yield from table.slice(0, cut).filter(pa.array(fresh)).select(names).to_batches()
            held_kept = bool(keep[cut]) or (cut == 0 and held is not None and held_kept)
            held = table.slice(cut).combine_chunks().to_batches()[0]
        if held is not None and held_kept:
            yield held.select(list(names))

    return work
