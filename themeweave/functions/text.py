"""Text expressions: lower-casing, tokens, stop words, word n-grams."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Fixed value: a token is a run of two or more letters, numbers or underscores.
# Java's own \w is ASCII only, and its Unicode form also takes combining marks.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


@dataclass(frozen=True)
class TextOptions:
    """How documents become terms."""

    lowercase: bool = True
    stopwords: frozenset[str] = frozenset()
    ngram_range: tuple[int, int] = (1, 1)

    def __post_init__(self) -> None:
        object.__setattr__(self, "stopwords", frozenset(self.stopwords or ()))
        low, high = self.ngram_range
        if not 1 <= low <= high:
            raise ValueError(f"ngram_range must satisfy 1 <= low <= high, got {self.ngram_range}")


def lowercase(text: Column, enabled: bool = True) -> Column:
    return F.lower(text) if enabled else text


def tokenize(text: Column) -> Column:
    """All tokens of the text in reading order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def remove_stopwords(tokens: Column, words: Iterable[str]) -> Column:
    """Drop the listed words; the words are compared as given."""
    listed = sorted(words)
    return F.filter(tokens, lambda token: ~token.isin(listed)) if listed else tokens


def longer_grams(shorter: Column, words: Column, n: int) -> Column:
    """Word ``n``-grams from the ``n - 1``-grams of the same words.

    Pass plain columns, not long expressions: both arguments are used twice.
    """
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    return F.zip_with(
        F.slice(shorter, F.lit(1), count),
        F.slice(words, F.lit(n), count),
        lambda head, tail: F.concat_ws(" ", head, tail),
    )
