"""Column expressions shared by the operators that stay in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A word is a run of characters outside blank and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def text_of(name: str = "text") -> Column:
    """The text, a null counting as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def tail(items: Column, skip: int) -> Column:
    """``items`` without its first ``skip`` elements."""
    return F.slice(items, F.lit(skip + 1), F.greatest(F.size(items) - skip, F.lit(0)))


def front(items: Column, skip: int) -> Column:
    """``items`` without its last ``skip`` elements."""
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - skip, F.lit(0)))


def match_spans(text: Column, pattern: str, keep, kind: str) -> Column:
    """``array<struct<kind, start, end, value>>`` of the matches that ``keep`` accepts.

    The pieces between the matches give the offsets, in code points, end exclusive.
    Matches are leftmost and do not overlap; a match that ``keep`` refuses still
    uses up its characters.
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(front(pieces, 1), F.length)
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("value"))
    none = F.expr("CAST(array() AS array<struct<kind:string,start:int,end:int,value:string>>)")

    def step(state: Column, match: Column) -> Column:
        start = state["at"] + match["gap"]
        end = start + F.length(match["value"])
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), match["value"].alias("value")
        )
        return F.struct(
            end.alias("at"),
            F.when(keep(match["value"]), F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(steps, start, step, lambda s: s["out"])).otherwise(none)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names an operator needs for its own results, in any case."""
    taken = {name.lower() for name in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
