"""Repeated word windows by prefix-partitioned suffix trees.

Suffixes of word sequences are split by their first words. A prefix with more suffixes than
fit a group is lengthened by one word, again and again, and small prefixes share a group. Each
group's subtree is built on its own: its suffixes are ordered, and the common prefixes of
neighbours give the internal nodes. The leaves below an internal node of depth ``width`` or
more are the places of one repeated window.

The suffixes are those of the fragments that :mod:`seeds` brings together: every window that
occurs in two documents meets itself in one block of bounded size.

Defined results of :func:`remove_repeats`: a null or empty text has no words; repeated rows
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

WIDTH, GRAM = 13, 5
#: Suffixes in one subtree.
GROUP = 1 << 14
KEPT = "doc_id long, n_words long, n_removed long, kept string"


def split_by_prefix(suffixes: np.ndarray, most: int = GROUP) -> list[np.ndarray]:
    """Rows of ``suffixes`` (one suffix of word numbers each) in groups of whole prefixes.

    Only suffixes that agree in all words can make a group larger than ``most``.
    """
    groups: list[np.ndarray] = []
    open_group: list[np.ndarray] = []
    size = 0
    todo = [(np.arange(len(suffixes)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) > most and depth < suffixes.shape[1]:
            word = suffixes[rows, depth]
            order = np.argsort(word, kind="stable")
            cuts = np.flatnonzero(np.diff(word[order])) + 1
            todo += [(part, depth + 1) for part in np.split(rows[order], cuts)]
            continue
        if size + len(rows) > most and open_group:
            groups.append(np.concatenate(open_group))
            open_group, size = [], 0
        open_group.append(rows)
        size += len(rows)
    if open_group:
        groups.append(np.concatenate(open_group))
    return groups


def subtree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in order, and the depth of the node that joins each leaf to the one before."""
    order = np.lexsort(suffixes.T[::-1])
    ordered = suffixes[order]
    depth = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        same = ordered[1:] == ordered[:-1]
        depth[1:] = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))
    return order, depth


def repeated_in_block(width: int, most: int = GROUP):
    def compare(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = [content.split(b" ") for content in contents]
        numbers: dict[bytes, int] = {}
        flat = np.array([numbers.setdefault(w, len(numbers)) for text in words for w in text], dtype=np.int32)
        lengths = np.array([len(text) for text in words])
        begins = np.cumsum(lengths) - lengths
        windows = np.maximum(lengths - width + 1, 0)
        member = np.repeat(np.arange(len(words)), windows)
        offset = np.arange(len(member)) - np.repeat(np.cumsum(windows) - windows, windows)
        if not len(member):
            return member, member, offset
        suffixes = flat[(begins[member] + offset)[:, None] + np.arange(width)]
        found, last = [], 0
        for rows in split_by_prefix(suffixes, most):
            order, depth = subtree(suffixes[rows])
            node = np.cumsum(depth < width)
            again = np.bincount(node)[node] > 1
            found.append((node[again] + last, rows[order][again]))
            last += len(rows)
        group = np.concatenate([f[0] for f in found])
        leaf = np.concatenate([f[1] for f in found])
        return group, member[leaf], offset[leaf]

    return compare


def word_symbols(texts: hashing.Texts) -> tuple[np.ndarray, np.ndarray]:
    return texts.word_hashes()


def word_contents(texts: hashing.Texts, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    starts, ends, _ = texts.words()
    whole = texts.bytes.tobytes()
    return [b" ".join(whole[starts[b] : ends[e - 1]].split()) for b, e in zip(begin, end, strict=True)]


def _kept_rows(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in hashing.slices(batch, size=seeds.PIECE_BYTES):
                ids, counts, removed, kept = [], [], [], []
                runs = piece.column("runs")
                texts = piece.column("text").cast(pa.binary()).to_pylist()
                for i, (doc, text) in enumerate(zip(piece.column("doc").to_pylist(), texts, strict=True)):
                    words = text.split()
                    ids.append(seeds.id_of(doc))
                    counts.append(len(words))
                    if runs[i].is_valid:
                        gone = seeds.covered(runs[i].values, len(words), width)
                        words = [words[k] for k in np.flatnonzero(~gone)]
                    removed.append(counts[-1] - len(words))
                    kept.append(b" ".join(words))
                arrays = [pa.array(c, pa.int64()) for c in (ids, counts, removed)]
                arrays.append(pa.array(kept, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept"])

    return work


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``<doc_id, n_words, n_removed, kept>`` without words in windows that an earlier document has."""
    folder = new_run_folder(docs.sparkSession)
    keyed = seeds.document_key(docs)
    repeats = seeds.repeated_windows(
        keyed, folder, word_symbols, width, gram, False, repeated_in_block(width), word_contents
    )
    joined = keyed.join(seeds.repeats_by_document(repeats), ["doc", "sub"], "left")
    return joined.select("doc", "text", "runs").mapInArrow(_kept_rows(width), KEPT)
