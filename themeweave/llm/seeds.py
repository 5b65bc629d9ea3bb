"""Finding windows that occur more than once, by content-chosen anchors.

Every window of ``width`` symbols names one of its ``gram``-symbol stretches, the one with the
smallest hash, as its anchor. Equal windows name equal anchors, so windows whose anchors occur
once need not be looked at. Neighbouring windows with one anchor form a fragment. Fragments meet
by the hash of their anchor:

* equal fragments of an anchor are one group: all but the first are repeats as a whole;
* different fragments of an anchor may share some windows: their contents are compared by the
  calling operator, in blocks of bounded size;
* an anchor with more than ``MAX_VARIANTS`` different fragments (the edge of a passage that very
  many documents share) meets again window by window, each under the hash of the whole window.

The rows of an anchor stream through a task in sorted order and are never gathered. An anchor
takes few rows from any document, so that even a passage shared by all documents
makes no partition much larger than the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themeweave.llm import hashing
from themeweave.llm.columns import text_of
from themeweave.runtime import store

MAX_VARIANTS = 1000

WHOLE, COMPARE, WINDOWED = 0, 1, 2
#: Rows out of a task at a time.
OUT_ROWS = 200_000
#: Bytes of text worked on at a time: hashing a byte takes some dozens of bytes of working memory.
PIECE_BYTES = 1 << 20

ANCHORS = "key long, frag long, doc long, sub long, start int, n int"
MARKED = "key long, doc long, sub long, start int, n int, state int"
PIECES = "kind int, key long, frag long, doc long, sub long, start int, n int, content binary"
REPEATS = "doc long, sub long, start int, n int"

Symbols = Callable[[hashing.Texts], tuple[np.ndarray, np.ndarray]]


#: Stands for a missing id.
NO_ID = -(2**63)


def id_of(doc: int) -> int | None:
    return None if doc == NO_ID else doc


def document_key(docs: DataFrame) -> DataFrame:
    """``<doc, sub, text>``. Rows without an id come first; rows that share an id are told apart by the hash of their text."""
    sub = F.xxhash64(text_of())
    first = F.lit(NO_ID)
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), first).alias("doc"), sub.cast("long").alias("sub"), text_of().alias("text")
    )


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _batches(columns: dict[str, np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    arrays = [pa.array(columns[f.name], type=f.type) for f in schema]
    for at in range(0, len(arrays[0]), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([a.slice(at, OUT_ROWS) for a in arrays], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def fragments(symbols: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Fragments of texts laid end to end: ``key, frag, row, start, n``, starts counted in the text."""
    empty = {name: np.zeros(0, np.int64) for name in ("key", "frag", "row", "start", "n")}
    if len(symbols) < width:
        return empty
    sums = hashing.running(symbols)
    at = np.arange(len(symbols) - gram + 1)
    grams = hashing.mix(hashing.stretch(sums, at, at + gram))
    anchor = hashing.sliding_min(grams, width - gram + 1)
    rows = hashing.row_of(bounds, len(symbols))
    windows = np.arange(len(anchor))
    inside = rows[windows] == rows[windows + width - 1]
    windows, anchor = windows[inside], anchor[inside]
    if not len(windows):
        return empty
    row = rows[windows]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(windows)))
    start, place = windows[first], anchor[first]
    frag = hashing.mix(hashing.stretch(sums, start, start + n - 1 + width) + (place - start).astype(np.uint64))
    return {
        "key": grams[place].view(np.int64), "frag": frag.view(np.int64), "row": row[first],
        "start": (start - bounds[row[first]]).astype(np.int32), "n": n.astype(np.int32),
    }


def anchor_rows(symbols: Symbols, width: int, gram: int):
    schema = _schema(ANCHORS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in hashing.slices(batch, size=PIECE_BYTES):
                found = fragments(*symbols(hashing.Texts(piece.column("text"))), width, gram)
                row = found.pop("row")
                found |= {"doc": _longs(piece, "doc")[row], "sub": _longs(piece, "sub")[row]}
                yield from _batches(found, schema)

    return work


class Marker:
    """Tells repeats among rows sorted by ``key, frag, doc, sub, start``, batch after batch.

    ``same_document`` tells whether an earlier start in the same document makes a repeat.
    """

    def __init__(self, same_document: bool):
        self.same_document = same_document
        self.key = self.frag = self.first = None

    def mark(self, c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which rows repeat the first of their key and fragment; where keys and fragments begin."""
        key, frag = c["key"], c["frag"]
        new_key = np.ones(len(key), dtype=bool)
        new_key[0] = self.key is None or key[0] != self.key
        new_key[1:] = key[1:] != key[:-1]
        new_frag = new_key.copy()
        new_frag[0] |= self.frag is None or frag[0] != self.frag
        new_frag[1:] |= frag[1:] != frag[:-1]
        lead = np.maximum.accumulate(np.where(new_frag, np.arange(len(key)), -1))
        old = lead < 0
        first = [c[name][lead] for name in ("doc", "sub", "start")]
        if old.any():
            for values, known in zip(first, self.first, strict=True):
                values[old] = known
        repeats = (c["doc"] != first[0]) | (c["sub"] != first[1])
        if self.same_document:
            repeats |= c["start"] != first[2]
        self.key, self.frag, self.first = key[-1], frag[-1], [values[-1] for values in first]
        return repeats, new_key, new_frag


class _Open:
    """The anchor that the next batch may continue, with its rows that are not yet given out."""

    def __init__(self):
        self.rows: dict[str, np.ndarray] | None = None
        self.variants, self.many = 0, False


def mark_rows(same_document: bool, max_variants: int = MAX_VARIANTS):
    """Function over sorted rows, each anchor in one task: what has to be done with each row.

    Of the anchor at hand at most ``max_variants`` variants are held back.
    """
    schema = _schema(MARKED)
    names = ("key", "doc", "sub", "start", "n")

    def out(rows: dict[str, np.ndarray], state: int) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows | {"state": np.full(len(rows["key"]), state, np.int32)}, schema)

    def close(anchor: _Open) -> Iterator[pa.RecordBatch]:
        if anchor.rows is not None and anchor.variants > 1 and not anchor.many:
            yield from out(anchor.rows, COMPARE)

    def extend(anchor: _Open, rows: dict[str, np.ndarray], variants: int) -> Iterator[pa.RecordBatch]:
        anchor.variants += variants
        if anchor.rows is not None:
            rows = {k: np.concatenate([anchor.rows[k], rows[k]]) for k in names}
        anchor.many |= anchor.variants > max_variants
        if anchor.many:
            yield from out(rows, WINDOWED)
            rows = {k: v[:0] for k, v in rows.items()}
        anchor.rows = rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker, anchor = Marker(same_document), _Open()
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {name: _longs(batch, name) for name in (*names, "frag")}
            repeats, new_key, new_frag = marker.mark(c)
            rows = {name: c[name] for name in names}
            yield from out({k: v[repeats] for k, v in rows.items()}, WHOLE)

            starts = np.flatnonzero(new_key)
            head = slice(0, starts[0] if len(starts) else len(new_key))
            if head.stop:
                fresh = {k: v[head][~repeats[head]] for k, v in rows.items()}
                yield from extend(anchor, fresh, int(new_frag[head].sum()))
            if not len(starts):
                continue
            yield from close(anchor)
            # anchors that lie wholly in this batch, then the one that may go on
            sizes = np.diff(np.append(starts, len(new_key)))
            variants = np.repeat(np.add.reduceat(new_frag.astype(np.int64), starts), sizes)
            inner = slice(starts[0], starts[-1])
            count = variants[: inner.stop - inner.start]
            for state, wanted in ((COMPARE, (count > 1) & (count <= max_variants)), (WINDOWED, count > max_variants)):
                wanted = wanted & ~repeats[inner]
                yield from out({k: v[inner][wanted] for k, v in rows.items()}, state)
            anchor, tail = _Open(), slice(starts[-1], len(new_key))
            fresh = {k: v[tail][~repeats[tail]] for k, v in rows.items()}
            yield from extend(anchor, fresh, int(new_frag[tail].sum()))
        yield from close(anchor)

    return work


def repeated_windows(
    docs: DataFrame, folder: str, symbols: Symbols, width: int, gram: int, same_document: bool, compare, contents,
    block_bytes: int | None = None, pick=None,
) -> DataFrame:
    """``<doc, sub, start, n>``: ``n`` windows from ``start`` on that also occur earlier.

    ``docs`` is ``<doc, sub, text>``. ``contents`` cuts the fragments to compare out of a text and
    ``compare`` takes the contents of a block and gives, for every window that occurs twice or more
    in it, its group, its fragment and its place there; ``block_bytes`` is the size of a block. ``pick``
    tells which fragments may share a window at all, given their anchors and contents.
    """
    anchors = docs.mapInArrow(anchor_rows(symbols, width, gram), ANCHORS)
    order = ("key", "frag", "doc", "sub", "start")
    marked = anchors.repartition("key").sortWithinPartitions(*order).mapInArrow(mark_rows(same_document), MARKED)
    marked = store(marked, f"{folder}/marked")

    item = F.struct("start", "n", "key", "state")
    open_items = marked.where(F.col("state") != WHOLE).groupBy("doc", "sub").agg(F.collect_list(item).alias("items"))
    pieces = docs.join(open_items, ["doc", "sub"]).mapInArrow(piece_rows(symbols, width, contents), PIECES)
    compared = (
        pieces.repartition("key")
        .sortWithinPartitions("kind", *order)
        .mapInArrow(compare_rows(same_document, compare, block_bytes or COMPARE_BYTES, pick), REPEATS)
    )
    whole = marked.where(F.col("state") == WHOLE).select("doc", "sub", "start", "n")
    return whole.unionByName(compared)


def piece_rows(symbols: Symbols, width: int, contents):
    """Cut fragments to compare, and hash the windows of those that meet window by window."""
    schema = _schema(PIECES)

    def rows_of(piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = hashing.Texts(piece.column("text"))
        values, bounds = symbols(texts)
        sums = hashing.running(values)
        items = piece.column("items")
        flat, offsets = items.flatten(), items.offsets.to_numpy()
        row = hashing.row_of(offsets - offsets[0], len(flat))
        start, n, key, state = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        doc, sub = _longs(piece, "doc"), _longs(piece, "sub")
        fits = start.astype(np.int64) + n - 1 + width <= np.diff(bounds)[row]  # an id may wrongly stand for two texts
        mine = np.flatnonzero((state == COMPARE) & fits)
        begin = bounds[row[mine]] + start[mine]
        cut = contents(texts, begin, begin + n[mine] - 1 + width)
        arrays = {
            "kind": np.zeros(len(mine), np.int32), "key": key[mine], "frag": np.zeros(len(mine), np.int64), "doc": doc[row[mine]],
            "sub": sub[row[mine]], "start": start[mine], "n": n[mine], "content": cut,
        }
        yield from _batches(arrays, schema)
        mine = np.flatnonzero((state == WINDOWED) & fits)
        many = n[mine]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row_w = np.repeat(row[mine], many)
        start_w = np.repeat(start[mine], many) + step.astype(np.int32)
        begin = bounds[row_w] + start_w
        windows = hashing.mix(hashing.stretch(sums, begin, begin + width)).view(np.int64)
        arrays = {
            "kind": np.ones(len(windows), np.int32), "key": windows, "frag": np.zeros(len(windows), np.int64), "doc": doc[row_w],
            "sub": sub[row_w], "start": start_w, "n": np.ones(len(windows), np.int32), "content": [None] * len(windows),
        }
        yield from _batches(arrays, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in hashing.slices(batch, size=PIECE_BYTES):
                yield from rows_of(piece)

    return work


def _runs(doc: np.ndarray, sub: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """Neighbouring windows as runs."""
    order = np.lexsort((start, sub, doc))
    doc, sub, start = doc[order], sub[order], start[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return {"doc": doc[first], "sub": sub[first], "start": start[first], "n": start[last] - start[first] + 1}


#: Bytes of fragments brought together at a time; an anchor's fragments always stay together.
COMPARE_BYTES = 512 << 10


def around_anchor(width: int, gram: int):
    """Which byte fragments share, with another of their anchor, what a common window must have around it.

    The anchor lies at most ``width - gram`` symbols into a window. For each step of that place, all windows
    have some symbols before and behind the anchor in common, four fifths of the window or more together.
    """
    slack = width - gram
    step = max(1, slack // 4)

    def pick(key: np.ndarray, contents: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(contents), dtype=np.uint8)
        bounds = np.append(0, np.cumsum([len(x) for x in contents]))
        sums = hashing.running(data)
        at = np.arange(len(data) - gram + 1)
        row = hashing.row_of(bounds, len(data))[: len(at)]
        inside = at + gram <= bounds[row + 1]
        hits = at[inside & (hashing.mix(hashing.stretch(sums, at, at + gram)).view(np.int64) == key[row])]
        found, first = np.unique(row[hits], return_index=True)
        place = np.full(len(contents), -1)
        place[found] = hits[first]
        keep = place < 0
        for before in range(0, slack + 1, step):
            behind = gram + max(0, slack - before - step + 1)
            fits = np.flatnonzero((place - before >= bounds[:-1]) & (place + behind <= bounds[1:]))
            mark = hashing.stretch(sums, place[fits] - before, place[fits] + behind) + hashing.mix(key[fits].view(np.uint64))
            _, same, many = np.unique(mark, return_inverse=True, return_counts=True)
            keep[fits[many[same] > 1]] = True
        return keep

    return pick


def compare_rows(same_document: bool, compare, block_bytes: int = COMPARE_BYTES, pick=None):
    """Compare the fragments of whole anchors, block by block, then mark windows by their hash."""
    schema = _schema(REPEATS)
    names = ("key", "doc", "sub", "start", "n")

    def run(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if pick is not None:
            key = np.array([row[0] for row in rows], dtype=np.int64)
            rows = [row for row, kept in zip(rows, pick(key, [row[-1] for row in rows]), strict=True) if kept]
        block, size = [], 0
        for row in rows:
            if size > block_bytes and row[0] != block[-1][0]:
                yield from compared_block(block)
                block, size = [], 0
            block.append(row)
            size += len(row[-1])
        if block:
            yield from compared_block(block)

    def compared_block(block: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, sub, start, n = (np.array([row[i] for row in block], dtype=np.int64) for i in range(1, 5))
        group, member, offset = compare([row[-1] for row in block])
        place = start[member] + offset
        order = np.lexsort((place, sub[member], doc[member], group))
        mine = {"key": group[order], "frag": np.zeros(len(order)), "doc": doc[member][order], "sub": sub[member][order], "start": place[order]}
        repeats = Marker(same_document).mark(mine)[0] if len(order) else np.zeros(0, bool)
        yield from _batches(_runs(*(mine[k][repeats] for k in ("doc", "sub", "start"))), schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = Marker(same_document)
        block: list[tuple] = []
        size = 0
        for batch in batches:
            kinds = _longs(batch, "kind")
            split = int(np.searchsorted(kinds, 1))
            compared, windows = batch.slice(0, split), batch.slice(split)
            if compared.num_rows:
                for row in zip(*[compared.column(x).to_pylist() for x in (*names, "content")], strict=True):
                    if size > COMPARE_BYTES and row[0] != block[-1][0]:
                        yield from run(block)
                        block, size = [], 0
                    block.append(row)
                    size += len(row[-1])
            if windows.num_rows:
                c = {name: _longs(windows, name) for name in (*names, "frag")}
                repeats, _, _ = marker.mark(c)
                yield from _batches({f.name: c[f.name][repeats] for f in schema}, schema)
        if block:
            yield from run(block)

    return work


def repeats_by_document(repeats: DataFrame) -> DataFrame:
    """``<doc, sub, runs>``: the repeated windows of each document, in a list bounded by its length."""
    return repeats.groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def covered(runs: pa.StructArray, length: int, width: int) -> np.ndarray:
    """Which of ``length`` symbols lie in a repeated window."""
    marks = np.zeros(length + 1, dtype=np.int32)
    start = runs.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = start + runs.field(1).to_numpy(zero_copy_only=False) - 1 + width
    np.add.at(marks, np.minimum(start, length), 1)
    np.add.at(marks, np.minimum(end, length), -1)
    return np.cumsum(marks[:-1]) > 0
