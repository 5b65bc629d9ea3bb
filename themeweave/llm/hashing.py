"""Words, rolling hashes and winnowing over whole texts, in NumPy.

Texts of a batch are laid end to end and worked on together. A hash of a stretch is a
polynomial modulo 2**64 with an odd base, taken from running sums, so the hash of any
stretch costs two look-ups. Equal stretches always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# An odd base, and the multipliers of a 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15 | 1
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes of text worked on at a time.
BLOCK_BYTES = 8 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 ... base ** (n - 1)`` modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, dtype=np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


def running(values: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`stretch` takes the hash of any stretch."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(INVERSE, len(values)), out=sums[1:])
    return sums


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hash of ``values[start:end]``; depends on the values alone."""
    return (sums[end] - sums[start]) * powers(BASE, len(sums))[start]


class Texts:
    """Whole texts end to end. ``bounds[i]:bounds[i + 1]`` are the bytes of text ``i``."""

    def __init__(self, column: pa.Array):
        binary = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1]
        data = binary.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]]
        self.bounds = offsets - offsets[0]
        self._words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and where each text's words begin (one more at the end)."""
        if self._words is not None:
            return self._words
        gap = np.ones(len(self.bytes) + 2, dtype=bool)
        gap[1:-1] = IS_SPACE[self.bytes]
        inside = ~gap
        starts = np.flatnonzero(inside[1:] & gap[:-1])
        ends = np.flatnonzero(inside[:-1] & gap[1:])
        # a text may begin inside a run that the one before it left open
        cuts = self.bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(self.bytes))]
        cuts = np.unique(cuts[~gap[cuts] & ~gap[cuts + 1]]) if len(cuts) else cuts
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
        self._words = starts, ends, np.searchsorted(starts, self.bounds)
        return self._words

    def word_hashes(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """A hash per word, and where each text's words begin. ``lower`` folds A to Z."""
        starts, ends, bounds = self.words()
        return mix(stretch(running(LOWER[self.bytes] if lower else self.bytes), starts, ends)), bounds


def slices(
    table: pa.Table | pa.RecordBatch, text: str = "text", size: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``size`` bytes of text, one row at least."""
    sizes = pa.compute.binary_length(table.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + size, side="right")))
        yield table.slice(start, end - start)
        start = end


def row_of(bounds: np.ndarray, n: int) -> np.ndarray:
    """The text that each of ``n`` items belongs to, given where each text's items begin."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of every window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at, span = np.arange(len(values), dtype=np.int64), 1
    best = values
    while span * 2 <= width:
        left, right = best[: len(best) - span], best[span:]
        take = right < left
        at = np.where(take, at[span:], at[: len(at) - span])
        best = np.where(take, right, left)
        span *= 2
    rest = width - span
    if rest:
        left, right = best[: len(best) - rest], best[rest:]
        at = np.where(right < left, at[rest:], at[: len(at) - rest])
    return at[:n]
