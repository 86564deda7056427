"""Personal data: pattern spans plus information-theoretic disclosure of terms.

Base spans come from four patterns (email, ip, card, phone) with their checks.
Every distinct base value is a protected entity. Terms are letter runs of at
least TERM_LETTERS letters, lower-cased. Corpus co-occurrence says how strongly
a term reveals an entity: over distinct texts, with c texts in which the term
stands within CONTEXT characters of the entity (and no further than the next
value of its kind), df(t) and df(e) texts that hold
either and N texts in all,

    posterior(e | t) = c / df(t)        bits(t; e) = log2(c * N / (df(t) * df(e)))

A term with c >= SUPPORT, posterior >= POSTERIOR and bits >= BITS discloses the
entity: its occurrences become spans of kind ``term`` in every document (unless
they overlap a base span), to be generalised or removed like the base ones.

Only DataFrame and SQL operations are used. Patterns are possessive and anchored
to the start of their character run, so long runs cost linear time and no stack,
and places come from sums of sums, so many matches cost hardly more than few.

Defined results: a null text counts as empty and has no spans; repeated rows get
the same spans and count as one text in the statistics; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import BROADCAST_KEYS, cut, small_side

KINDS = ("email", "ip", "card", "phone")
#: Fixed formats of the base kinds, in possessive form. Shorter runs of digits can't be cards, so they don't match at all.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CONTEXT = 80
#: Elements that are summed at a time.
CHUNK = 64
TERM_LETTERS = 4
SUPPORT = 5
POSTERIOR = 0.6
BITS = 6.0

SPAN = "array<struct<start:int,ord:int,end:int,value:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of digits, every second from the right doubled, is a multiple of ten."""
    at = F.sequence(F.lit(1), F.length(digits))

    def part(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(at, part), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        small = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return x.rlike(rf"^{small}\.{small}\.{small}\.{small}$")
    if kind == "card":
        d = _digits(x)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; inside a lambda a plain column would be worked out again for each element."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _before(steps: Column, levels: int = 3) -> Column:
    """Exclusive prefix sums of an array of integers. Sums of CHUNK elements are summed first, so n elements take about n * CHUNK steps."""

    def total(values: Column, start: Column, n) -> Column:
        return F.aggregate(F.slice(values, start, n), F.lit(0), lambda a, v: a + v)

    if not levels:
        return F.transform(steps, lambda v, i: total(steps, F.lit(1), i))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda c: total(steps, c * CHUNK + 1, F.lit(CHUNK)))
    at = lambda i: F.floor(i / CHUNK).cast("int")
    return _let(
        _let(chunks, lambda c: _before(c, levels - 1)),
        lambda sums: F.transform(steps, lambda v, i: F.element_at(sums, at(i) + 1) + total(steps, at(i) * CHUNK + 1, i % CHUNK)),
    )


def _placed(text: Column, pattern: Column, context: int = 0) -> Column:
    """array<struct(start, end, value, left, right)> of all matches. Text between matches and the matches alternate, so lengths give places.

    left and right hold up to ``context`` characters beside the match, as far as
    the matches beside it, without a word that this cuts.
    """
    fields = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
    found = F.regexp_extract_all(text, pattern, F.lit(0))

    def of(parts: Column) -> Column:
        lengths = F.transform(parts["found"], lambda x, i: F.struct(F.length(F.element_at(parts["gaps"], i + 1)).alias("gap"), F.length(x).alias("own")))
        return _let(lengths, lambda n: _let(_before_of(n), lambda at: F.transform(parts["found"], lambda x, i: one(parts, n, at, x, i))))

    def _before_of(n: Column) -> Column:
        return _let(F.transform(n, lambda x: x["gap"] + x["own"]), _before)

    def one(parts: Column, n: Column, at: Column, x: Column, i: Column) -> Column:
        size = F.element_at(n, i + 1)
        start = F.element_at(at, i + 1) + size["gap"]
        left, right = F.lit(""), F.lit("")
        if context:
            gap, after = F.element_at(parts["gaps"], i + 1), F.element_at(parts["gaps"], i + 2)
            left = F.when(size["gap"] > context, F.regexp_replace(F.substring(gap, size["gap"] - context, F.lit(context + 1)), r"\A\p{L}+", "")).otherwise(gap)
            right = F.when(F.length(after) > context, F.regexp_replace(F.substring(after, F.lit(1), F.lit(context + 1)), r"\p{L}+\z", "")).otherwise(after)
        return F.struct(start.alias("start"), (start + size["own"]).alias("end"), x.alias("value"), left.alias("left"), right.alias("right"))

    placed = _let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")), of)
    return F.when(F.regexp_like(text, pattern), placed).otherwise(F.array().cast(fields))


def _found(text: Column, kind: str, context: int = 0) -> Column:
    """Valid matches of one kind, placed."""
    checked = F.filter(_placed(text, F.lit(PATTERNS[kind]), context), lambda s: valid(kind, s["value"]))
    if NEEDS[kind] is None:
        return checked
    return F.when(F.contains(text, F.lit(NEEDS[kind])), checked).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>"))


def base_spans(text: Column, kind: str) -> Column:
    """Valid spans of one kind, as SPAN."""
    order = KINDS.index(kind)
    return F.transform(_found(text, kind), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["end"].alias("end"), s["value"].alias("value"))).cast(SPAN)


def with_base(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base): text non-null, base sorted by start and kind."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return out.withColumn("base", F.sort_array(F.concat(*[base_spans(F.col("text"), k) for k in KINDS])))


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{%d,}+" % TERM_LETTERS), F.lit(0)))


def surroundings(text: Column) -> Column:
    """array<struct(entity, terms)> of every base span: its kind and lower-cased value, and the terms within CONTEXT characters, as far as the next value of its kind."""

    def one(order: int, s: Column) -> Column:
        entity = F.struct(F.lit(order).alias("ord"), F.lower(s["value"]).alias("value"))
        return F.struct(entity.alias("entity"), words(_strip(F.concat(s["left"], F.lit(" "), s["right"]))).alias("terms"))

    return F.concat(*[F.transform(_found(text, kind, CONTEXT), lambda s, order=order: one(order, s)) for order, kind in enumerate(KINDS)])


def disclosing_terms(
    based: DataFrame, support: int = SUPPORT, posterior: float = POSTERIOR, bits: float = BITS
) -> DataFrame:
    """(term, kind_ord, entity, c, df_term, df_entity, bits) of the terms above the thresholds, from (doc_id, text, base) rows."""
    holding = based.where(F.size("base") > 0).select("text").distinct()
    near = cut(holding.select(F.xxhash64("text").alias("t64"), F.explode(surroundings(F.col("text"))).alias("s")).select("t64", "s.*"))
    df_entity = near.groupBy("entity").agg(F.count_distinct("t64").alias("df_entity")).where(F.col("df_entity") >= support)
    joint = (
        near.join(df_entity, "entity")
        .select("t64", "entity", "df_entity", F.explode("terms").alias("term"))
        .distinct()
        .groupBy("entity", "df_entity", "term")
        .agg(F.count("*").alias("c"))
        .where(F.col("c") >= support)
    )
    # texts with the term beside any entity are at most df(t): pairs that fail against them fail against df(t) too
    beside = near.select("t64", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("least_df"))
    joint = cut(joint.join(beside, "term").where(F.col("c") >= posterior * F.col("least_df")).drop("least_df"))
    terms = joint.select("term").distinct()
    count = terms.count()
    if count:
        seen = based.select(F.xxhash64("text").alias("t64"), F.explode(words(F.col("text"))).alias("term"))
        df_term = seen.join(small_side(terms, count, BROADCAST_KEYS // 4), "term").distinct().groupBy("term").agg(F.count("*").alias("df_term"))
        total = based.select(F.xxhash64("text").alias("t64")).distinct().count()
    else:
        df_term, total = terms.withColumn("df_term", F.lit(0).cast("long")), 1
    information = F.log2(F.col("c") * F.lit(float(total)) / (F.col("df_term") * F.col("df_entity")))
    found = joint.join(df_term, "term").withColumn("bits", information)
    return found.where((F.col("c") >= posterior * F.col("df_term")) & (F.col("bits") >= bits)).select("term", F.col("entity.ord").alias("kind_ord"), F.col("entity.value").alias("entity"), "c", "df_term", "df_entity", "bits")


def _strip(text: Column) -> Column:
    """Text without e-mail addresses, whose parts are no terms."""
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]*+", " ")


def sensitive_spans(docs: DataFrame, **thresholds) -> DataFrame:
    """(doc_id, text, base, terms) of every row; terms holds the spans of disclosing terms outside the base spans, in the same form, ord 4."""
    based = with_base(docs)
    terms = cut(disclosing_terms(based, **thresholds).select("term").distinct())
    count = terms.count()
    empty = F.array().cast(SPAN)
    if not count:
        return based.withColumn("terms", empty)
    keyed = based.withColumn("row", F.xxhash64("doc_id", "text"))
    held = (
        keyed.select("row", F.explode(words(F.col("text"))).alias("term"))
        .join(small_side(terms, count, BROADCAST_KEYS // 4), "term")
        .distinct()
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("term")).alias("found"))  # distinct words of one text
    )
    held = cut(held)
    joined = keyed.join(small_side(held, held.count(), BROADCAST_KEYS // 10), "row", "left")
    text = F.col("text")

    def placed(term: Column) -> Column:
        return _placed(text, F.concat(F.lit(r"(?iu)(?<!\p{L})"), term, F.lit(r"(?!\p{L})")))

    every = F.flatten(F.transform(F.col("found"), placed))
    apart = F.filter(every, lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    spans = F.transform(apart, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("ord"), s["end"].alias("end"), s["value"].alias("value")))
    return joined.withColumn("terms", F.when(F.col("found").isNotNull(), F.sort_array(spans)).otherwise(F.array()).cast(SPAN)).drop("found", "row")


def count_of(spans: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["ord"] == order)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of all spans by start, then kind, joined by commas."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "term")]), s["ord"] + 1)
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(found: DataFrame) -> DataFrame:
    """``found`` with a column clean: base values generalised to their kind, disclosing terms removed; of overlapping spans the first counts."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        mark = F.element_at(F.array(F.lit("<EMAIL>"), F.lit("<IP>"), F.lit("<CARD>"), F.lit("<PHONE>"), F.lit("")), s["ord"] + 1)
        more = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), mark)
        return F.when(s["start"] >= a["at"], F.struct(more.alias("out"), s["end"].alias("at"))).otherwise(a)

    folded = F.aggregate(F.sort_array(F.concat("base", "terms")), start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return found.withColumn("clean", folded)
