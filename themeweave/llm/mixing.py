"""Mixing sources to target weights by pivotal dependent rounding, DataFrame functions only.

Each source has a target number of words. A document's fair number of copies is
``target / size of its source``; its whole part is taken outright and the fraction is
rounded. Two documents with fractions meet, and words move from one to the other, in a
random direction chosen so that each document's expected copies stay as they were, until
one fraction is 0 or 1. The sum of fractional words of a source never changes, so at the end
one document is left over, usually a large one. Large documents are therefore rounded first
(three classes by size) and the smaller ones get what is then missing from the target: the
words taken differ from it by about 1/64 of the source's largest document.

The pairing is a reduction tree: hashed blocks of about ``BLOCK`` documents are rounded
each in a row, the one left over from each block goes up a level, and so on. A source with a
third of all documents has as many more blocks. Draws come from hashes of the ids, so
reruns agree.

Defined results: a null text has size 0 and is never moved; a null source is a source of its
own, last in order; repeated rows are documents of their own; an empty table gives no
rows; other columns of the input are not used.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from themeweave.llm.columns import WORD_PATTERN, text_of
from themeweave.runtime import lookup_join, new_run_folder, store

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
BLOCK = 128
#: Size classes of a source: over 1/8 of its largest document, over 1/64, the rest.
CLASS_STEP, CLASSES = 8, 3

_ITEM = "struct<size:bigint,draw:bigint,doc_id:bigint,p:double,whole:int>"
_TAKEN = "array<struct<doc_id:bigint,size:bigint,copies:int>>"


def document_sizes(docs: DataFrame) -> DataFrame:
    """``<doc_id, source, size>``: words per document."""
    size = F.regexp_count(text_of(), F.lit(WORD_PATTERN)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``<_key, source, source_size, largest, target>``, one row per source.

    The targets share all words by weight. A source stops at ``max_copies`` times its size and
    the excess goes to the others: with sources ordered by the level at which they stop, a
    running sum tells which of them do, and the rest share one level.
    """
    totals = sizes.groupBy("_key", "source").agg(
        F.sum("size").alias("source_size"), F.max("size").alias("largest")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)
    stop = Window.orderBy("_level", F.col("source").asc_nulls_last())
    before = stop.rowsBetween(Window.unboundedPreceding, -1)
    after = stop.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    words = F.sum("source_size").over(everything)
    rest = words - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    full = F.col("_full")
    return (
        totals.withColumn("_weight", weight)
        .withColumn("_most", F.col("source_size") * float(max_copies))
        .withColumn("_level", F.col("_most") / F.col("_weight"))
        .withColumn("_full", F.col("_level") < rest / F.sum("_weight").over(after))
        .withColumn("_words", words)
        .withColumn("_given", F.coalesce(F.sum(F.when(full, F.col("_most"))).over(everything), F.lit(0.0)))
        .withColumn("_open", F.sum(F.when(~full, F.col("_weight"))).over(everything))
        .withColumn(
            "target",
            F.when(full, F.col("_most")).otherwise(
                (F.col("_words") - F.col("_given")) * F.col("_weight") / F.col("_open")
            ),
        )
        .select("_key", "source", "source_size", "largest", "target")
    )


def _size_class() -> Column:
    """0 for the largest documents of a source; the last class holds all the small and empty ones."""
    step = F.floor(F.log(float(CLASS_STEP), F.col("largest") / F.col("size")))
    return F.when(F.col("size") > 0, F.least(step, F.lit(CLASSES - 1))).otherwise(CLASSES - 1)


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    low = F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1))
    return low / F.lit(float(1 << 52))


def _pair(state: Column, item: Column, seed: int) -> Column:
    """Move words between the carried document and the next until one of them is settled."""
    held, out = state["held"], state["out"]
    ratio = item["size"] / held["size"]
    up = F.least(1 - held["p"], item["p"] * ratio)
    down = F.least(held["p"], (1 - item["p"]) * ratio)
    rises = _uniform(held["draw"], item["draw"], F.lit(seed)) * (up + down) < down
    held_full = rises & (1 - held["p"] <= item["p"] * ratio)
    item_none = rises & (1 - held["p"] >= item["p"] * ratio)
    held_none = ~rises & (held["p"] <= (1 - item["p"]) * ratio)
    item_full = ~rises & (held["p"] >= (1 - item["p"]) * ratio)
    held_p = F.when(held_full, 1.0).when(held_none, 0.0).when(rises, held["p"] + up).otherwise(held["p"] - down)
    item_p = (
        F.when(item_full, 1.0)
        .when(item_none, 0.0)
        .when(rises, item["p"] - up / ratio)
        .otherwise(item["p"] + down / ratio)
    )

    def settled(x: Column, p: Column) -> Column:
        return F.array(F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), (x["whole"] + p.cast("int")).alias("copies")))

    def holding(x: Column, p: Column) -> Column:
        return F.struct(
            x["size"].alias("size"), x["draw"].alias("draw"), x["doc_id"].alias("doc_id"), p.alias("p"), x["whole"].alias("whole")
        )

    held_done, item_done = held_full | held_none, item_full | item_none
    nobody = F.expr(f"CAST(NULL AS {_ITEM})")
    return (
        F.when(held.isNull(), F.struct(item.alias("held"), out.alias("out")))
        .when(
            held_done & item_done,
            F.struct(nobody.alias("held"), F.concat(out, settled(held, held_p), settled(item, item_p)).alias("out")),
        )
        .when(held_done, F.struct(holding(item, item_p).alias("held"), F.concat(out, settled(held, held_p)).alias("out")))
        .otherwise(F.struct(holding(held, held_p).alias("held"), F.concat(out, settled(item, item_p)).alias("out")))
    )


def _round_level(items: DataFrame, level: int, seed: int) -> DataFrame:
    """``<_key, n_docs, held, out>`` per block of the level."""
    blocks = F.ceil(F.col("n_docs") / float(BLOCK ** (level + 1)))
    block = F.pmod(F.xxhash64("item.draw", F.lit(level)), blocks)
    start = F.struct(F.expr(f"CAST(NULL AS {_ITEM})").alias("held"), F.expr(f"CAST(array() AS {_TAKEN})").alias("out"))
    rounded = F.aggregate("_items", start, lambda s, x: _pair(s, x, seed))
    return (
        items.groupBy("_key", "n_docs", block.alias("_block"))
        .agg(F.sort_array(F.collect_list("item"), asc=False).alias("_items"))
        .select("_key", "n_docs", rounded.alias("_rounded"))
        .select("_key", "n_docs", "_rounded.held", "_rounded.out")
    )


def _round_fractions(shared: DataFrame, folder: str, seed: int) -> DataFrame:
    """``<_key, doc_id, size, copies>`` of documents with their fair number of copies ``fair``."""
    whole = F.floor("fair").cast("int")
    open_p = F.col("fair") - whole
    is_open = (open_p > 0) & (F.col("size") > 0)
    draw = F.xxhash64("doc_id", F.lit(seed))
    item = F.struct("size", draw.alias("draw"), "doc_id", open_p.alias("p"), whole.alias("whole"))
    settled = shared.where(~is_open).select("_key", "doc_id", "size", whole.alias("copies"))

    items = shared.where(is_open).select("_key", "n_docs", item.alias("item"))
    largest = shared.agg(F.max("n_docs").alias("n")).first().n or 0
    level, blocks = 0, largest
    while blocks > 1 or level == 0:
        blocks = ceil(largest / BLOCK ** (level + 1))
        done = store(_round_level(items, level, seed + level), f"{folder}/level-{level}")
        settled = settled.unionByName(done.select("_key", F.inline("out")))
        items = done.where("held IS NOT NULL").select("_key", "n_docs", F.col("held").alias("item"))
        level += 1
    last = F.col("item.whole") + (_uniform(F.col("item.draw"), F.lit(seed + level)) < F.col("item.p")).cast("int")
    return settled.unionByName(items.select("_key", "item.doc_id", "item.size", last.alias("copies")))


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 7) -> DataFrame:
    """``<doc_id, source, size, source_size, target, copies, taken>``, one row per document."""
    folder = new_run_folder(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    sizes = store(document_sizes(docs).withColumn("_key", key), f"{folder}/sizes")
    targets = store(source_targets(sizes, weights, max_copies).coalesce(1), f"{folder}/targets")

    by_class = [F.when(_size_class() == c, F.col("size")).otherwise(0) for c in range(CLASSES)]
    limits = targets.select("_key", "largest")
    classed = lookup_join(sizes, limits, "_key", F.col("doc_id")).groupBy("_key").agg(
        *[F.sum(x).alias(f"_words{c}") for c, x in enumerate(by_class)],
        *[F.count(F.when(x > 0, 1)).alias(f"_docs{c}") for c, x in enumerate(by_class)],
    )
    state = store(targets.select("_key", "target", "largest").join(classed, "_key").coalesce(1), f"{folder}/classes")
    given = F.lit(0)
    parts = []
    for c in range(CLASSES):
        left = sum((F.col(f"_words{k}") for k in range(c, CLASSES)), F.lit(0))
        fair = F.least(F.greatest((F.col("target") - given) / left, F.lit(0.0)), F.lit(float(max_copies)))
        fairs = state.select(
            "_key", "largest", F.col(f"_docs{c}").alias("n_docs"), F.when(left > 0, fair).otherwise(0.0).alias("fair")
        )
        members = lookup_join(sizes.drop("source"), fairs, "_key", F.col("doc_id")).where(_size_class() == c)
        rounded = _round_fractions(members.drop("largest"), f"{folder}/class-{c}", seed + 100 * c)
        parts.append(store(rounded, f"{folder}/rounded-{c}"))
        words = parts[-1].groupBy("_key").agg(F.sum(F.col("copies") * F.col("size")).alias(f"_taken{c}"))
        state = store(state.join(words, "_key", "left").na.fill(0, [f"_taken{c}"]).coalesce(1), f"{folder}/after-{c}")
        given = given + F.col(f"_taken{c}")

    taken = parts[0]
    for part in parts[1:]:
        taken = taken.unionByName(part)
    facts = targets.select("_key", "source", "source_size", "target")
    return (
        lookup_join(taken, facts, "_key", F.col("doc_id"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    )
