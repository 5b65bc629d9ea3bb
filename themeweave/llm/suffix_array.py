"""Repeated byte stretches by column-wise construction of a collection's suffix order.

The Burrows-Wheeler transform of a collection of texts is built without sorting suffixes. Round
``j`` puts the suffix of length ``j`` of every text in its place, all texts at once: the
symbol in front of the shorter suffix and its rank give the new rank, and the transform, the
common prefixes and the places of the suffixes are each read once from front to back and written
anew with one more entry per text. Suffixes that share a prefix of ``width`` bytes end up
next to each other, with common prefixes of at least that length between them.

Collections are the blocks of fragments that :mod:`seeds` brings together: every 100-byte
string that occurs in two places meets itself in one block. A block is about 64 KB, and
whole anchors, so its sequences stay in a processor's cache and need no files on the machine.

Defined results of :func:`remove_repeats`: a null or empty text has no bytes; repeated rows
(same id, same text) are one document and get the same result each; different texts under one
id are documents of their own, in the order of their hashes; rows without an id come before all others, told apart
in the same way; an empty table gives no rows; texts of any length are read whole; extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from themeweave.llm import hashing, seeds
from themeweave.runtime import new_run_folder

WIDTH, GRAM = 100, 32
#: Bytes of fragments whose suffixes are put in order at a time; every round passes over all of a block.
BLOCK_BYTES = 64 << 10
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def suffix_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, offset and common prefix with the one before, for all suffixes in order.

    Texts end in distinct marks, smaller than any byte and ordered like the texts.
    """
    m = len(texts)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    columns = int(lengths.max(initial=0)) + 1
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    used = np.unique(data)
    code = np.zeros(256, dtype=np.uint8 if len(used) < 256 else np.uint16)
    code[used] = np.arange(1, len(used) + 1)
    ends = np.cumsum(lengths)
    # symbol ``j`` from the end of each text; 0 where the text is over
    back = np.zeros((columns, m), dtype=code.dtype)
    owner = np.repeat(np.arange(m), lengths)
    back[ends[owner] - 1 - np.arange(len(data)), owner] = code[data]

    transform, common = back[0].copy(), np.zeros(m, dtype=np.int16 if columns < 1 << 15 else np.int32)
    active, rank = np.arange(m), np.arange(m)
    for j in range(1, columns):
        going = lengths[active] >= j
        active, rank = active[going], rank[going]
        order, place = _places(transform)
        ended = int(np.count_nonzero(transform == 0))
        mine = place[rank].astype(np.int64)
        new = mine - ended + m
        symbol = transform[rank]
        before = order[np.maximum(mine - 1, 0)]
        after = order[np.minimum(mine + 1, len(order) - 1)]
        has_before = (mine > 0) & (transform[before] == symbol)
        has_after = (mine + 1 < len(order)) & (transform[after] == symbol)
        with_before = np.where(has_before, 1 + _least(common, np.where(has_before, before, rank - 1) + 1, rank + 1), 0)
        with_after = 1 + _least(common, rank + 1, np.where(has_after, after, rank + 1) + 1)

        kept = np.ones(len(order) + len(new), dtype=bool)
        kept[new] = False
        transform = _insert(transform, kept, new, back[j, active])
        common = _insert(common, kept, new, with_before)
        common[new[has_after] + 1] = with_after[has_after]
        rank = new

    # the finished transform leads from each suffix to the one longer by a symbol, so texts and offsets need no writing anew
    text, offset = np.empty(len(transform), dtype=np.int32), np.empty(len(transform), dtype=np.int32)
    place = _places(transform)[1]
    active = rank = np.arange(m)
    for j in range(columns):
        going = lengths[active] >= j
        active, rank = active[going], rank[going]
        text[rank], offset[rank] = active, lengths[active] - j
        rank = place[rank]
    return text, offset, common


def _places(transform: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the symbols, and the place of each in it."""
    order = np.argsort(transform, kind="stable")
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return order, place


def _insert(old: np.ndarray, kept: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(kept), dtype=old.dtype)
    out[kept] = old
    out[at] = values
    return out


def _least(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of ``values[start:end]`` for many ranges, none of them empty."""
    if not len(start):
        return np.zeros(0, dtype=values.dtype)
    order = np.argsort(start, kind="stable")
    cuts = np.empty(2 * len(start), dtype=np.int64)
    cuts[0::2], cuts[1::2] = start[order], end[order]
    padded = np.append(values, [np.iinfo(values.dtype).max] * 2)
    out = np.empty(len(start), dtype=values.dtype)
    out[order] = np.minimum.reduceat(padded, cuts)[0::2]
    return out


def repeated_in_block(width: int):
    def compare(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, offset, common = suffix_order(contents)
        group = np.cumsum(common < width)
        sizes = np.bincount(group)
        again = sizes[group] > 1
        return group[again], text[again], offset[again].astype(np.int64)

    return compare


def byte_symbols(texts: hashing.Texts) -> tuple[np.ndarray, np.ndarray]:
    return texts.bytes, texts.bounds


def byte_contents(texts: hashing.Texts, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    whole = texts.bytes.tobytes()
    return [whole[b:e] for b, e in zip(begin, end, strict=True)]


def _kept_rows(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in hashing.slices(batch, size=seeds.PIECE_BYTES):
                rows = []
                runs = piece.column("runs")
                texts = piece.column("text").cast(pa.binary()).to_pylist()
                for i, (doc, text) in enumerate(zip(piece.column("doc").to_pylist(), texts, strict=True)):
                    removed = spans = 0
                    kept = text
                    if runs[i].is_valid:
                        gone = seeds.covered(runs[i].values, len(text), width)
                        removed = int(gone.sum())
                        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
                        kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                    rows.append((seeds.id_of(doc), len(text), removed, spans, kept))
                columns = zip(*rows, strict=True)
                kinds = [pa.int64()] * 4 + [pa.binary()]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
                arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return work


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``<doc_id, n_bytes, n_removed, n_spans, kept>`` without bytes that repeat an earlier string of ``width``."""
    folder = new_run_folder(docs.sparkSession)
    keyed = seeds.document_key(docs)
    repeats = seeds.repeated_windows(
        keyed, folder, byte_symbols, width, gram, True, repeated_in_block(width), byte_contents,
        BLOCK_BYTES, seeds.around_anchor(width, gram),
    )
    joined = keyed.join(seeds.repeats_by_document(repeats), ["doc", "sub"], "left")
    return joined.select("doc", "text", "runs").mapInArrow(_kept_rows(width), KEPT)
