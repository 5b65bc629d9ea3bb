"""Personal data: known formats, and terms that reveal them; DataFrame functions only.

E-mail addresses, IP addresses, payment cards and phone numbers are protected entities. Terms are
the whole words of a document outside of its entities, in lower case. How strongly a term
reveals an entity is estimated from co-occurrence in the whole corpus: with document shares ``p``,

    pmi = log2(p(entity, term) / (p(entity) * p(term))),    information = -log2(p(entity))

The shares of words come from all documents, with or without entities. A term discloses
``pmi / information`` of an entity, 1 if it stands only in documents that hold the entity. It must
stand beside the entity in at least ``MIN_SEEN`` different texts and give at least ``MIN_BITS``. From
``REMOVE`` on it is a span of kind ``term``, from ``GENERALISE`` on one of kind ``hint``, wherever it stands in a
document with that entity. :func:`sanitise` removes terms, puts a class of words in place of hints
and the kind in place of entities.

Words are counted with partial sums, so a very frequent word or entity costs a row per task. Only
entities seen in ``MIN_SEEN`` texts are paired with words. Of the texts, only those that hold an entity
are shuffled, to meet their terms, with salt for texts that many rows share; a table of terms is broadcast only
below the size that Spark itself allows (10 MB by default).

Defined results: a null or empty text has no spans; an empty table gives no rows; texts of any
length are read whole; a word that qualifies as term and as hint is a term, and spans with the same start are told apart
by kind; repeated rows count as documents each and get the same spans, but as one text;
missing ids and repeated ids make no difference; extra columns pass through, one named ``pii`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from themeweave.llm.columns import match_spans, text_of, without
from themeweave.runtime import JOIN_SALTS, new_run_folder, store

KINDS = ("email", "ip", "card", "phone")
MIN_SEEN, MIN_BITS, REMOVE, GENERALISE = 3, 4.0, 0.9, 0.75

TERM = r"[\p{L}\p{M}\p{N}_]+"

# The formats. Possessive runs and the look-behind only save repeated attempts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip_holds(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _luhn_holds(value: Column) -> Column:
    turned = F.reverse(_digits(value))
    size = F.length(turned)

    def digit(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    places = F.sequence(F.lit(1), F.least(size, F.lit(19)))
    total = F.aggregate(places, F.lit(0), lambda s, i: s + digit(i))
    return F.when(size.between(13, 19), total % 10 == 0).otherwise(False)


def entity_spans(text: Column) -> Column:
    """Spans of the four formats, by kind, then start."""
    return F.concat(
        match_spans(text, EMAIL, lambda v: F.lit(True), "email"),
        match_spans(text, IP, _ip_holds, "ip"),
        match_spans(text, CARD, _luhn_holds, "card"),
        match_spans(text, PHONE, lambda v: F.length(_digits(v)).between(9, 15), "phone"),
    )


def _masked(text: Column, pii: Column) -> Column:
    """``text`` with blanks in place of entities, of the same length."""
    ordered = F.array_sort(F.transform(pii, lambda s: F.struct(s["start"], s["end"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = F.greatest(x["start"], s["at"])
        more = F.concat(s["out"], F.substring(text, s["at"] + 1, begin - s["at"]), F.repeat(F.lit(" "), x["end"] - begin))
        return F.when(x["end"] > s["at"], F.struct(x["end"].alias("at"), more.alias("out"))).otherwise(s)

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(pii) > 0, F.aggregate(ordered, start, step, rest)).otherwise(text)


def _terms_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _holders(texts: DataFrame, folder: str) -> DataFrame:
    """``<key, entity, n_entity, words>`` of every row and each of its entities that ``MIN_SEEN`` texts hold."""
    found = texts.select("text", entity_spans(F.col("text")).alias("pii")).where(F.size("pii") > 0)
    entities = F.array_distinct(F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    words = _terms_in(_masked(F.col("text"), F.col("pii")))
    held = found.select(F.md5("text").alias("key"), entities.alias("entities"), words.alias("words"))
    held = store(held, f"{folder}/held")
    seen = held.select("key", F.explode("entities").alias("entity")).groupBy("entity")
    counts = seen.agg(F.count("*").alias("n_entity"), F.count_distinct("key").alias("texts")).where(F.col("texts") >= MIN_SEEN)
    counts = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1)))).drop("texts")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(JOIN_SALTS)).cast("int")
    by_entity = held.withColumn("_salt", salt).select("key", "words", "_salt", F.explode("entities").alias("entity"))
    return store(by_entity.join(counts, ["entity", "_salt"]).drop("_salt"), f"{folder}/holders")


def _revealing(texts: DataFrame, holders: DataFrame) -> DataFrame:
    """``<entity, term, kind>``: terms that disclose enough of an entity."""
    total = texts.count()
    terms = texts.select(F.explode(_terms_in(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    pairs = holders.select("entity", "n_entity", "key", F.explode("words").alias("term")).groupBy("entity", "n_entity", "term")
    pairs = pairs.agg(F.count("*").alias("both"), F.count_distinct("key").alias("texts")).where(F.col("texts") >= MIN_SEEN)
    joined = pairs.join(terms.where(F.col("n_term") >= MIN_SEEN), "term")
    bits = F.log2(F.col("both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    disclosed = F.col("bits") / F.log2(F.lit(float(total)) / F.col("n_entity"))
    shown = joined.withColumn("bits", bits).where(F.col("bits") >= MIN_BITS).where(disclosed >= GENERALISE)
    return shown.select("entity", "term", F.when(disclosed >= REMOVE, "term").otherwise("hint").alias("kind"))


def find_pii(docs: DataFrame) -> DataFrame:
    """Add ``pii: array<struct<kind, start, end, value>>``: entities by kind and start, then hints, then terms by start."""
    folder = new_run_folder(docs.sparkSession)
    columns = [c for c in docs.columns if c.lower() != "pii"]
    kept = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    texts = without(docs, "pii").select(kept, text_of().alias("text"))
    holders = _holders(texts.select("text"), folder)
    shown = store(_revealing(texts.select("text"), holders), f"{folder}/revealing")
    # "term" comes after "hint", so that the greater of two kinds is the stronger one
    words = holders.select("key", "entity", F.explode("words").alias("term")).join(shown, ["entity", "term"])
    words = words.groupBy("key", "term").agg(F.max("kind").alias("kind"))
    by_text = words.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds"))
    by_text = by_text.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))

    found = texts.select("row", "text", entity_spans(F.col("text")).alias("pii"))
    clean = found.where(F.size("pii") == 0).select("row.*", F.expr(f"CAST(array() AS {SPANS})").alias("pii"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(JOIN_SALTS)).cast("int")
    holding = found.where(F.size("pii") > 0).withColumn("key", F.md5("text")).withColumn("_salt", salt)
    joined = holding.join(by_text, ["key", "_salt"], "left")
    kind_of = lambda v: F.element_at(F.col("kinds"), F.lower(v))
    placed = match_spans(_masked(F.col("text"), F.col("pii")), TERM, lambda v: kind_of(v).isNotNull(), "term")
    named = F.transform(placed, lambda s: s.withField("kind", kind_of(s["value"])))
    terms = F.when(F.col("kinds").isNotNull(), F.array_sort(named)).otherwise(F.expr(f"CAST(array() AS {SPANS})"))
    return clean.unionByName(joined.select("row.*", F.concat("pii", terms).alias("pii")))


def _class_of(word: Column) -> Column:
    """What stands in place of a hint."""
    return F.when(word.rlike(r"\p{N}"), "[number]").when(word.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")


def sanitise(text: Column, pii: Column) -> Column:
    """``text`` without terms, with a class of words in place of hints and the kind in place of entities.

    Of overlapping spans the first counts.
    """
    ordered = F.array_sort(F.transform(pii, lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        kind = F.concat(F.lit("["), x["kind"], F.lit("]"))
        mark = F.when(x["kind"] == "term", "").when(x["kind"] == "hint", _class_of(x["value"])).otherwise(kind)
        more = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), mark)
        return F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), more.alias("out"))).otherwise(s)

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.aggregate(ordered, start, step, rest)
