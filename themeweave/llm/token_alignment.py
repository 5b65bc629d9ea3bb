"""Alignment of two tokenizers over the same texts.

Side A is a byte-level BPE over a blank and the text, side B a piece model that puts the blank
itself, so the tokens of both tile the same bytes.

1. Texts are cut into stretches, before a blank that follows visible text. Neither side has a
   token across such a place (the piece table is checked for it), so each distinct
   stretch is tokenised and aligned once per worker and looked up afterwards, with its bytes compared.
2. Per batch, ``pandas.merge_asof`` keyed by the stretch of a document finds for each
   token start the token of the other side that covers it. The union of both directions are the
   overlaps; overlapping tokens with equal ends close a group.
3. All pairs of A and B tokens of a group are links. A document keeps its distinct id pairs with
   how often each occurs; documents per pair are counted over the corpus.
4. Counts come back to the documents in two ways that always both run: the most frequent pairs, at most
   ``HOT_PAIRS``, by a broadcast table, all others by a join on the pair, where none is frequent.

Defined results: a null or empty text, or one whose tokens don't give back its bytes, has no
tokens: zeros and an empty digest. Rows are judged one by one, so repeated rows and ids, and a null
id, keep a row each, and each row counts as a document. Ties for the highest count are all best. Very
long texts are worked on whole. An empty table gives no rows. Extra columns are not used.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from themeweave.llm import hashing
from themeweave.runtime import new_run_folder

BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
TOKENIZER_FOLDER = "/opt/tokenizers"

#: Pairs whose counts every executor holds; all others are joined.
HOT_PAIRS = 1 << 19
#: A worker forgets its stretches beyond this many, or this many bytes of them.
MEMO_STRETCHES, MEMO_BYTES = 300_000, 8 << 20
#: Bytes of text aligned at a time.
SLICE_BYTES = 1 << 20

# The blank, and first bytes of characters beyond ASCII that may be white space.
BLANK = 0x20
_OPEN_PAIR, _OPEN_TRIPLES = 0xC2, (0xE1, 0xE2, 0xE3)
#: Pairs of a group are written out at once up to this many; larger groups count equal ids first.
PLAIN_PAIRS = 64


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes: printable ones for themselves, the others follow U+00FF in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def piece_bytes(piece: str) -> bytes:
    """A piece as text: U+2581 is a blank, ``<0xHH>`` a byte."""
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Table:
    """The bytes of every token, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(x) for x in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)


class Tokenizers:
    """Both sides, from the contents of their files."""

    def __init__(self, byte_model: bytes, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(byte_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        alphabet = byte_alphabet()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(alphabet.get(c, 0) for c in names.get(i, "")) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [piece_bytes(p) for p in pieces]
        self.table_a, self.table_b = Table(self.bytes_a), Table(self.bytes_b)
        self.numerals = Numerals(max(len(self.bytes_a), len(self.bytes_b)))
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece runs across a blank; stretches cannot be tokenised alone")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides for texts that begin with a blank."""
        made = self.a.encode_batch_fast(texts, add_special_tokens=False)
        return [e.ids for e in made], self.b.encode([t[1:] for t in texts], num_threads=1)


@cache
def _loaded(byte_model: bytes, piece_model: bytes) -> Tokenizers:
    return Tokenizers(byte_model, piece_model)


def read_models(folder: str = TOKENIZER_FOLDER) -> tuple[bytes, bytes]:
    """Both files, read where the job is started; tasks get their contents."""
    return Path(folder, BYTE_FILE).read_bytes(), Path(folder, PIECE_FILE).read_bytes()


def token_frame(side: str, flat: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    """``<doc, start, end, at, id>``: tokens in order. Offsets run on over all documents."""
    ends = np.cumsum(sizes)
    names = {"doc": doc, "start": ends - sizes, f"end_{side}": ends, side: np.arange(len(flat)), f"id_{side}": flat}
    return pd.DataFrame(names)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """``<a, b, end_a, end_b>``: tokens of both sides that share a byte, from token frames over the same bytes."""
    columns = ["a", "b", "end_a", "end_b"]
    sides = [pd.merge_asof(left, right, on="start", by="doc")[columns] for left, right in ((a, b), (b, a))]
    return pd.concat(sides, ignore_index=True).drop_duplicates(["a", "b"])


def group_tokens(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Group number of every token of each side, and the number of groups."""
    found = overlaps(a, b)
    closing = found[found["end_a"] == found["end_b"]]
    numbers = []
    for side, rows in (("a", a), ("b", b)):
        closes = np.zeros(len(rows), dtype=np.int64)
        closes[closing[side].to_numpy()] = 1
        numbers.append(np.cumsum(closes) - closes)
    return numbers[0], numbers[1], len(closing)


def spans_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each span, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.add.reduceat(values, head)


def group_links(a: pd.DataFrame, b: pd.DataFrame, group_a: np.ndarray, group_b: np.ndarray, n_groups: int, pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc``, ``id_a * pieces + id_b`` and number of links, for each document and id pair."""
    in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    first_b = np.cumsum(in_b) - in_b
    id_a, id_b, doc_a = (x.to_numpy() for x in (a["id_a"], b["id_b"], a["doc"]))
    plain = (in_a * in_b <= PLAIN_PAIRS)[group_a]
    group = group_a[plain]
    pair = np.repeat(id_a[plain], in_b[group]) * pieces + id_b[spans_of(first_b[group], in_b[group])]
    doc, links = np.repeat(doc_a[plain], in_b[group]), np.ones(int(in_b[group].sum()), dtype=np.int64)
    if not plain.all():
        large = (in_a * in_b > PLAIN_PAIRS)[group_b]
        left = pd.DataFrame({"group": group_a[~plain], "doc": doc_a[~plain], "a": id_a[~plain]})
        left = left.groupby(["group", "doc", "a"], sort=False).size().rename("n_a").reset_index()
        right = pd.DataFrame({"group": group_b[large], "b": id_b[large]}).groupby(["group", "b"], sort=False).size().rename("n_b").reset_index()
        more = left.merge(right, on="group")
        doc = np.concatenate([doc, more["doc"].to_numpy()])
        pair = np.concatenate([pair, more["a"].to_numpy() * pieces + more["b"].to_numpy()])
        links = np.concatenate([links, (more["n_a"] * more["n_b"]).to_numpy()])
    most = int(pair.max()) + 1 if len(pair) else 1
    keys, links = summed(doc * most + pair, links)
    return *np.divmod(keys, most), links


class Numerals:
    """Numbers from zero as text, each with room for one sign after it."""

    def __init__(self, count: int):
        text = [b"%d," % i for i in range(count)]
        self.sizes = np.array([len(x) for x in text], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(text), dtype=np.uint8)


def group_text(numerals: Numerals, a: pd.DataFrame, b: pd.DataFrame, group_a: np.ndarray, group_b: np.ndarray, n_groups: int) -> tuple[bytes, np.ndarray]:
    """All groups as ``a1,a2|b1;`` one after the other, and where each begins."""
    in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    total_a, total_b = np.cumsum(in_a), np.cumsum(in_b)
    place_a = np.arange(len(group_a)) + (total_b - in_b)[group_a]
    place_b = np.arange(len(group_b)) + total_a[group_b]
    ids, signs = np.zeros(len(a) + len(b), dtype=np.int64), np.full(len(a) + len(b), ord(","), dtype=np.uint8)
    ids[place_a], ids[place_b] = a["id_a"].to_numpy(), b["id_b"].to_numpy()
    signs[place_a[total_a - 1]] = ord("|")
    signs[place_b[total_b - 1]] = ord(";")
    sizes = numerals.sizes[ids]
    out = numerals.bytes[spans_of(numerals.starts[ids], sizes)]
    ends = np.cumsum(sizes)
    out[ends - 1] = signs
    return out.tobytes(), np.concatenate([[0], ends[place_b[total_b - 1]]]).astype(np.int64)


class Growing:
    """A list of numbers, or of rows of numbers, that grows in place."""

    def __init__(self, kind: type, first: tuple = ()):
        self._held, self._size = np.zeros(1024, dtype=kind), len(first)
        self._held[: len(first)] = first

    def add(self, values: np.ndarray) -> None:
        size = self._size + len(values)
        if size > len(self._held):
            wider = np.zeros(2 * size, dtype=self._held.dtype)
            wider[: self._size] = self._held[: self._size]
            self._held = wider
        self._held[self._size : size] = values
        self._size = size

    @property
    def values(self) -> np.ndarray:
        return self._held[: self._size]


class Aligned:
    """Aligned stretches: offsets into flat lists of bytes and of id pairs."""

    def __init__(self) -> None:
        self.place: dict[int, int] = {}
        self.groups: list[bytes] = []
        self.whole = Growing(np.bool_)
        self.counts = [Growing(np.int32) for _ in range(3)]  # tokens of A, of B, groups
        self.text, self.text_at = Growing(np.uint8), Growing(np.int64, (0,))
        self.pair, self.links, self.pair_at = Growing(np.int64), Growing(np.int64), Growing(np.int64, (0,))

    def add(self, tools: Tokenizers, stretches: list[bytes], hashes: list[int]) -> None:
        last = len(stretches)
        lengths = np.array([len(s) for s in stretches], dtype=np.int64)
        text = np.frombuffer(b"".join(stretches), np.uint8)
        encoded = tools.encode([s.decode() for s in stretches])
        sides, whole = [], np.ones(last, dtype=bool)
        for ids, table in zip(encoded, (tools.table_a, tools.table_b)):
            per = np.array([len(x) for x in ids], dtype=np.int64)
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(per.sum()))
            doc = np.repeat(np.arange(last), per)
            whole &= given_back(table, flat, doc, text, lengths)
            sides.append((flat, doc, per))
        frames, per_side = [], []
        for name, (flat, doc, per), table in zip("ab", sides, (tools.table_a, tools.table_b)):
            kept = whole[doc]
            frames.append(token_frame(name, flat[kept], doc[kept], table.sizes[flat[kept]]))
            per_side.append(np.where(whole, per, 0))
        a, b = frames
        group_a, group_b, n_groups = group_tokens(a, b)
        grouped, group_at = group_text(tools.numerals, a, b, group_a, group_b, n_groups)
        doc_of_group = np.zeros(n_groups, dtype=np.int64)
        doc_of_group[group_a] = a["doc"].to_numpy()
        cuts = np.searchsorted(doc_of_group, np.arange(last + 1))
        doc, pair, links = group_links(a, b, group_a, group_b, n_groups, len(tools.bytes_b))

        first = len(self.groups)
        self.place.update(zip(hashes, range(first, first + last)))
        at = group_at[cuts].tolist()
        self.groups += [grouped[i:j] for i, j in zip(at, at[1:])]
        self.whole.add(whole)
        for held, per in zip(self.counts, (*per_side, np.diff(cuts))):
            held.add(per)
        self.text_at.add(self.text_at.values[-1] + np.cumsum(lengths))
        self.text.add(text)
        self.pair_at.add(self.pair_at.values[-1] + np.cumsum(np.bincount(doc, minlength=last)))
        self.pair.add(pair)
        self.links.add(links)

    def is_full(self) -> bool:
        return len(self.groups) > MEMO_STRETCHES or len(self.text.values) > MEMO_BYTES


def given_back(table: "Table", flat: np.ndarray, doc: np.ndarray, text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which texts equal the bytes of their tokens joined."""
    made = np.bincount(doc, table.sizes[flat], len(lengths)).astype(np.int64)
    fits = made == lengths
    kept = fits[doc]
    joined = table.bytes[spans_of(table.starts[flat[kept]], table.sizes[flat[kept]])]
    starts = np.cumsum(lengths) - lengths
    differs = joined != text[spans_of(starts[fits], lengths[fits])]
    owner = np.repeat(np.flatnonzero(fits), lengths[fits])
    fits[owner[differs]] = False
    return fits


def cut_stretches(texts: hashing.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every stretch."""
    data, bounds = texts.bytes, texts.bounds
    cut = np.zeros(len(data) + 1, dtype=bool)
    # after white space a blank goes on with it; beyond ASCII, leave alone what might be white space
    before = np.concatenate([np.zeros(3, np.uint8), data[:-1]])
    one, two, three = before[2:], before[1:-1], before[:-2]
    open_end = (two == _OPEN_PAIR) | np.isin(three, _OPEN_TRIPLES)
    visible = ((one > BLANK) & (one < 0x7F)) | ((one >= 0x80) & ~open_end)
    cut[:-1] = (data == BLANK) & visible[: len(data)]
    cut[bounds] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def _row(tools: Tokenizers, text: str) -> tuple:
    """One text aligned as a whole."""
    alone = Aligned()
    alone.add(tools, [(" " + text).encode()], [0])
    counts = [int(c.values[0]) for c in alone.counts]
    return (*counts, alone.groups[0][:-1], alone.pair.values, alone.links.values)


def align_texts(tools: Tokenizers, known: Aligned, column: pa.Array) -> Iterator[tuple]:
    """Per text: tokens of A and B, groups, the groups as text, distinct id pairs and the links of each."""
    given = pc.fill_null(column, "")
    padded = pc.if_else(pc.equal(pc.binary_length(given), 0), given, pc.binary_join_element_wise(" ", given, ""))
    texts = hashing.Texts(padded)
    starts, ends = cut_stretches(texts)
    sizes = ends - starts
    hashes = hashing.mix(hashing.stretch(hashing.running(texts.bytes), starts, ends) + sizes.astype(np.uint64))
    codes, distinct = pd.factorize(hashes)
    first = np.zeros(len(distinct), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    fresh = [k for k, h in enumerate(distinct.tolist()) if h not in known.place]
    if fresh:
        raw = texts.bytes.tobytes()
        some = [raw[starts[i] : ends[i]] for i in first[fresh]]
        known.add(tools, some, [int(h) for h in distinct[fresh]])
    unit = np.array([known.place[h] for h in distinct.tolist()], dtype=np.int64)[codes] if len(codes) else codes

    n = len(padded)
    at = np.searchsorted(starts, texts.bounds)
    doc = hashing.row_of(at, len(starts))
    # a stretch with the hash of another, or one that its tokens don't give back: align the whole text
    text_at, pair_at = known.text_at.values, known.pair_at.values
    same = text_at[unit + 1] - text_at[unit] == sizes
    odd = np.zeros(n, dtype=bool)
    odd[doc[~(same & known.whole.values[unit])]] = True
    checked = np.flatnonzero(same)
    there, here = spans_of(text_at[unit[checked]], sizes[checked]), spans_of(starts[checked], sizes[checked])
    differs = np.flatnonzero(known.text.values[there] != texts.bytes[here])
    odd[np.searchsorted(texts.bounds, here[differs], side="right") - 1] = True

    counts = [np.bincount(doc, held.values[unit], n).astype(np.int64) for held in known.counts]
    grouped, places, cuts = known.groups, unit.tolist(), at.tolist()
    once, times = np.unique(doc * max(1, len(known.groups)) + unit, return_counts=True)
    owner, mine = np.divmod(once, max(1, len(known.groups)))
    per = pair_at[mine + 1] - pair_at[mine]
    rows = spans_of(pair_at[mine], per)
    width = len(tools.bytes_a) * len(tools.bytes_b)
    keys, links = summed(np.repeat(owner, per) * width + known.pair.values[rows], known.links.values[rows] * np.repeat(times, per))
    whose, pair = np.divmod(keys, width)
    ends = np.searchsorted(whose, np.arange(n + 1))
    for i in range(n):
        if odd[i]:
            yield _row(tools, given[i].as_py())
            continue
        text = b"".join([grouped[k] for k in places[cuts[i] : cuts[i + 1]]])
        yield (*(int(c[i]) for c in counts), text[:-1], pair[ends[i] : ends[i + 1]], links[ends[i] : ends[i + 1]])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def _align_rows(byte_model: bytes, piece_model: bytes, kind: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, known = _loaded(byte_model, piece_model), Aligned()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(sizes) // SLICE_BYTES
            for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1):
                if not len(rows):
                    continue
                piece = batch.slice(rows[0], len(rows))
                found = list(align_texts(tools, known, piece.column("text")))
                digests = [hashlib.sha256(r[3]).hexdigest() if r[3] else "" for r in found]
                columns = [pa.array([int(r[k]) for r in found], pa.int64()) for k in range(3)]
                columns += [pa.array([int(r[5].sum()) for r in found], pa.int64()), pa.array(digests, pa.string())]
                columns += [_lists([r[4] for r in found], kind), _lists([r[5] for r in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], names=_ALIGNED_NAMES)
                if known.is_full():
                    known = Aligned()

    return work


_ALIGNED_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{}>, links array<long>"
_SCORED_NAMES = ["row", *_ALIGNED_NAMES[:6], "n_best", "count_sum", "pairs", "links"]
_SCORED = "row long, " + _ALIGNED.replace("pairs array", "n_best long, count_sum long, pairs array")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def align_documents(docs: DataFrame, byte_model: bytes, piece_model: bytes, folder: str) -> DataFrame:
    """``<row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links>`` as a written table.

    ``pairs`` holds each id pair of the document once, as ``id_a * pieces + id_b``; ``links`` how often.
    """
    tools = _loaded(byte_model, piece_model)
    small = len(tools.bytes_a) * len(tools.bytes_b) < 1 << 31
    shared = docs.sparkSession.sparkContext.broadcast((byte_model, piece_model))
    kind = pa.int32() if small else pa.int64()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _align_rows(*shared.value, kind)(batches)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.mapInArrow(work, _ALIGNED.format("int" if small else "long"))
    return _stored(rows.select(F.monotonically_increasing_id().alias("row"), "*"), f"{folder}/aligned")


def pair_counts(aligned: DataFrame, n_pieces: int, folder: str) -> DataFrame:
    """``<pair, n, best>``: documents that hold the pair linked, and whether no pair of its A id has more.

    The highest counts are one row per A id, so their table is no larger than the vocabulary.
    """
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = _stored(counts, f"{folder}/pairs")
    id_a = F.floor(F.col("pair") / F.lit(n_pieces))
    highest = counts.groupBy(id_a.alias("id_a")).agg(F.max("n").alias("most"))
    both = counts.withColumn("id_a", id_a).join(F.broadcast(highest), "id_a")
    return _stored(both.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), f"{folder}/counts")


def hot_bound(counts: DataFrame, most: int) -> int:
    """The smallest power of two so that no more than ``most`` pairs are in as many documents."""
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    tally = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    held, at = 0, max(tally, default=0) + 1
    while at > 0 and held + tally.get(at - 1, 0) <= most:
        at -= 1
        held += tally.get(at, 0)
    return 1 << at


def _score_rows(shared, kind: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts, best = shared.value
        for batch in batches:
            lists = [batch.column(c) for c in ("pairs", "links")]
            sizes = pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False)
            pair, links = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(hot, pair), max(0, len(hot) - 1))
            is_hot = hot[at] == pair if len(hot) else np.zeros(len(pair), dtype=bool)
            value = np.zeros((2, len(pair)), dtype=np.int64)
            value[:, is_hot] = [links[is_hot] * best[at[is_hot]], links[is_hot] * counts[at[is_hot]]]
            sums = []
            for v in value:
                total = np.concatenate([[0], np.cumsum(v)])
                ends = np.cumsum(sizes)
                sums.append(pa.array(total[ends] - total[ends - sizes], pa.int64()))
            cuts = np.searchsorted(doc[~is_hot], np.arange(len(sizes) + 1)).astype(np.int32)
            cold = [
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[~is_hot]).cast(t))
                for x, t in ((pair, kind), (links, pa.int64()))
            ]
            same = [batch.column(c) for c in _SCORED_NAMES[:7]]
            yield pa.RecordBatch.from_arrays([*same, *sums, *cold], names=_SCORED_NAMES)

    return work


def align_tokenizers(docs: DataFrame, folder: str = TOKENIZER_FOLDER, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``<doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256>``, a row per row of ``docs``."""
    byte_model, piece_model = read_models(folder)
    tools = _loaded(byte_model, piece_model)
    spark, run = docs.sparkSession, new_run_folder(docs.sparkSession)
    aligned = align_documents(docs, byte_model, piece_model, run)
    counts = pair_counts(aligned, len(tools.bytes_b), run)
    bound = hot_bound(counts, hot_pairs)
    hot = counts.where(F.col("n") >= bound).orderBy("pair").toArrow()
    columns = [hot.column(c).to_numpy().astype(np.int64) for c in ("pair", "n", "best")]
    shared = spark.sparkContext.broadcast(tuple(columns))
    kind = aligned.schema["pairs"].dataType.elementType.simpleString()
    arrow = pa.int32() if kind == "int" else pa.int64()
    scored = _stored(aligned.mapInArrow(_score_rows(shared, arrow), _SCORED.format(kind)), f"{run}/scored")

    rare = scored.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", "p.pairs", "p.links")
    found = rare.join(counts.where(F.col("n") < bound), rare["pairs"] == counts["pair"])
    more = found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"),
        F.sum(F.col("links") * F.col("n")).alias("more_sum"),
    )
    total = lambda name, rest: (F.col(name) + F.coalesce(rest, F.lit(0))).cast("long").alias(name)
    return scored.join(more, "row", "left").select(
        *_ALIGNED_NAMES[:5], total("n_best", "more_best"), total("count_sum", "more_sum"), "groups_sha256"
    )
