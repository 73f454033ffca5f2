"""Personal data by patterns, and information-theoretic sanitisation of the terms that reveal it.

Everything on the executors is DataFrame functions. The offsets of matches come from splitting the text at the matches:
the lengths of the pieces and of the matches add up to the places. Possessive quantifiers keep the patterns linear and
without recursion; a match may start where the last one ended or where no character of its first class stands before.

A term in a document with an entity c (an e-mail address, say) reveals it as far as it makes it likelier: with the
counts of all documents, PMI(c; t) = log(n(c, t) N / (n(c) n(t))) is the information that t gives about c, and IC(c) = -log(n(c) / N)
all there is. Terms with PMI >= disclosure * IC are spans too wherever they stand in documents with c: generalised to a tag, or
removed where PMI >= removal * IC. There is no least number of texts; instead, chance must not explain n(c, t): of the
l = n(c) n(t) / N documents expected with both, k or more come with a chance of exp(-(k log(k / l) - k + l)) at most
(Chernoff's bound), which must be exp(-bound) or less.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, words

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the kind's pattern.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
PUNCTUATION = ".,;:!?\"'()[]{}<>"
_SPAN = "array<struct<s:bigint,e:bigint,v:string>>"
_TERMS = "array<struct<s:bigint,e:bigint,share:double>>"
#: Items and characters that are gone through at once; no results depend on them.
BLOCK, CHUNK = 256, 1024


@dataclass(frozen=True)
class Disclosure:
    """Terms reveal an entity from this share of its information on; bound: against chance."""

    disclosure: float = 0.9
    removal: float = 0.97
    bound: float = 6.9


def _value(kind: str, m: Column) -> Column:
    """The match in normal form, or null if it fails the kind's test."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lower(m)
    if kind == "ip":
        fits = F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*+(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])?$"))
        return F.when(fits, m)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19) & F.call_function("luhn_check", digits), digits)
    return F.when(F.length(digits).between(10, 15), digits)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f refers to it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _scan(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """step(state, item) -> (state, value), from the first item to the last: the array of the values, of a type.

    An aggregate copies its array for every item that it appends, so it goes over blocks of BLOCK items.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, value = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(value)).alias("out"))

    def over(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(all_) - 1) / BLOCK), F.lit(0)).cast("int")), lambda i: F.slice(all_, i * BLOCK + 1, BLOCK))
        first = F.array(F.struct(zero.alias("state"), none.alias("out")))
        done = F.aggregate(blocks, first, lambda acc, block: F.concat(acc, F.array(F.aggregate(block, F.struct(F.element_at(acc, -1)["state"].alias("state"), none.alias("out")), one))))
        return F.flatten(F.transform(done, lambda x: x["out"]))

    return _let(items, over)


def spans_of(text: Column, kind: str) -> Column:
    """Array of (s, e, v): the leftmost non-overlapping matches of a kind that pass its test, code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)  # one more than matches: the last item has no match
    both = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("n"), _value(kind, m).alias("v")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + x["g"]
        return s + x["n"], F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["v"].alias("v"))

    found = F.filter(_scan(both, F.lit(0).cast("long"), "struct<s:bigint,e:bigint,v:string>", step), lambda x: x["v"].isNotNull())
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Array of (s, k, e, v) by start, then kind as listed; k is the kind's number."""
    def of(k: int) -> Column:
        return F.transform(spans_of(text, KINDS[k]), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v")))

    return F.sort_array(F.concat(*map(of, range(len(KINDS)))))


def _replaced(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """The text with fill(span, place) for each of the spans (s, e, ...), sorted by s; the place is where the spans before end.

    Pieces of the text are taken from chunks of CHUNK characters, as to find a place in a string is to go there from its start.
    """
    def piece(chunks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
        head = F.substring(F.element_at(chunks, i + 1), (a - i * CHUNK + 1).cast("int"), F.least(b - a, F.lit(CHUNK)).cast("int"))
        more = F.concat(head, F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), F.substring(F.element_at(chunks, j + 1), F.lit(1), (b - j * CHUNK).cast("int")))
        return F.when(b <= a, "").when(i == j, head).otherwise(more)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        return F.greatest(at, x["e"]), F.struct(at.alias("a"), F.greatest(at, x["s"]).alias("b"), fill(x, at).alias("w"))

    gaps = _scan(spans, F.lit(0).cast("long"), "struct<a:bigint,b:bigint,w:string>", step)
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def whole(x: Column) -> Column:
        # spans overlap in any way, so the end is the greatest one
        last = F.struct(F.array_max(F.transform(spans, lambda y: y["e"])).alias("a"), F.length(text).cast("long").alias("b"), F.lit("").alias("w"))
        return F.array_join(F.transform(F.concat(x["gaps"], F.array(last)), lambda g: F.concat(piece(x["chunks"], g["a"], g["b"]), g["w"])), "")

    return F.when(F.size(spans) > 0, _let(F.struct(gaps.alias("gaps"), chunks.alias("chunks")), whole)).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces for the spans (s, k, e, v); all places stay."""
    return _replaced(text, spans, lambda x, at: F.repeat(F.lit(" "), F.greatest(x["e"] - F.greatest(at, x["s"]), F.lit(0)).cast("int")))


def _terms(held: DataFrame) -> DataFrame:
    """held (key, m, text, base) -> (key, m, t, s, e): the words outside the base spans, trimmed of punctuation; t: of the lower case."""
    text = held.select("key", "m", _blanked(F.col("text"), F.col("base")).alias("text"))
    tokens = text.select("key", "m", F.posexplode(F.split("text", r"[\x20\x09-\x0D]", -1)).alias("i", "w"))
    before = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # the words of one document
    left, both = F.ltrim("w", F.lit(PUNCTUATION)), F.trim("w", F.lit(PUNCTUATION))
    at = F.coalesce(F.sum(F.length("w") + 1).over(before), F.lit(0)) + F.length("w") - F.length(left)
    out = tokens.select("key", "m", F.lower(both).alias("w"), at.cast("long").alias("s"), F.length(both).alias("n")).filter("n > 0")
    return out.select("key", "m", F.xxhash64("w").alias("t"), "s", (F.col("s") + F.col("n")).alias("e"))


def _marked(df: DataFrame) -> DataFrame:
    """df (doc_id, text) with the base spans; th tells rows of equal doc_id apart."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return df.select("doc_id", t.alias("text"), F.xxhash64(t).alias("th")).withColumn("base", base_spans(F.col("text")))


def disclosing_terms(df: DataFrame, marked: DataFrame, p: Disclosure) -> DataFrame:
    """(doc_id, th, base, terms) of each document with base spans, once; terms: the spans (s, e, share) of revealing terms.

    marked: doc_id, th, base, held (the text where there are base spans); df: all documents, for the counts.
    """
    # repeated rows are one with their number m
    held = marked.filter(F.size("base") > 0).groupBy(F.struct("doc_id", "th").alias("key")).agg(F.count("*").alias("m"), F.first("held").alias("text"), F.first("base").alias("base"))
    held = materialise(held, "held")
    spans = held.select(F.col("key.doc_id").alias("doc_id"), F.col("key.th").alias("th"), "base", "key")
    if held.isEmpty():
        return spans.select("doc_id", "th", "base", F.array().cast(_TERMS).alias("terms"))
    terms = materialise(_terms(held), "terms")
    of = held.select("key", "m", F.explode(F.array_distinct(F.transform("base", lambda x: F.xxhash64(x["v"])))).alias("c"))
    entities = of.groupBy("c").agg(F.sum("m").alias("n_c"))
    together = materialise(terms.select("key", "t").distinct().join(of, "key"), "together")
    pairs = together.groupBy("c", "t").agg(F.sum("m").alias("n_ct"))
    # each document counts a term once; the counts are summed up within tasks before they are exchanged
    seen = df.select(F.explode(F.array_distinct(F.transform(words(F.col("text")), lambda w: F.xxhash64(F.lower(F.trim(w, F.lit(PUNCTUATION))))))).alias("t")).groupBy("t").agg(F.count("*").alias("n_t"))
    total = df.agg(F.count("*").alias("n"))
    scored = pairs.join(entities, "c").join(seen, "t").crossJoin(F.broadcast(total))  # total: one row
    known = F.log(F.col("n") / F.col("n_c"))
    share = F.when(known > 0, F.log(F.col("n_ct") * F.col("n") / (F.col("n_c") * F.greatest("n_t", "n_ct"))) / known)
    expected = F.col("n_c") * F.greatest("n_t", "n_ct") / F.col("n")
    against = F.col("n_ct") * F.log(F.col("n_ct") / expected) - F.col("n_ct") + expected
    revealing = scored.withColumn("share", share).filter((F.col("share") >= p.disclosure) & (against >= p.bound)).select("c", "t", "share")
    found = together.join(revealing, ["c", "t"]).groupBy("key", "t").agg(F.max("share").alias("share"))
    listed = terms.join(found, ["key", "t"]).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "e", "share"))).alias("terms"))
    return spans.join(listed, "key", "left").select("doc_id", "th", "base", F.coalesce("terms", F.array().cast(_TERMS)).alias("terms"))


def _find(df: DataFrame, p: Disclosure) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th) of every row, and disclosing_terms() as a table."""
    mine = df.select("doc_id", "text")
    marked = materialise(_marked(mine).select("doc_id", "th", "base", F.when(F.size("base") > 0, F.col("text")).alias("held")), "pii")
    found = materialise(disclosing_terms(mine, marked, p), "spans")
    return marked.select("doc_id", "th"), found.select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), "base", "terms")


def find_pii(df: DataFrame, p: Disclosure = Disclosure()) -> DataFrame:
    """One row per row of df (doc_id, text): counts of the base spans by kind, their digest, and all spans as a string.

    Null and empty texts have no spans. Repeated rows give repeated rows. Where spans of several kinds share a start
    they come in the order of the kinds, terms last. Other columns of df aren't read; an empty df gives no rows.
    """
    rows, found = _find(df, p)
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h")), "left")
    kinds = F.array(*map(F.lit, (*KINDS, "term")))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")

    base = F.transform(F.coalesce("base", F.array().cast("array<struct<s:bigint,k:int,e:bigint,v:string>>")), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    more = F.transform(F.coalesce("terms", F.array().cast(_TERMS)), lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("k"), x["e"].alias("e")))

    def count(k: int) -> Column:
        return F.size(F.filter(base, lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = map(count, range(len(KINDS)))
    return out.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.sort_array(F.concat(base, more))).alias("spans"), F.size(more).cast("long").alias("n_term"))


def sanitise(df: DataFrame, p: Disclosure = Disclosure()) -> DataFrame:
    """df with its texts sanitised: base spans and revealing terms become tags, the most revealing terms go.

    Overlapping spans become the tag of the first. Null texts stay null; all other columns (n_chars as well) stay.
    """
    _, found = _find(df, p)
    t = F.coalesce(F.col("text"), F.lit(""))
    held = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), t.alias("_text"), F.xxhash64(t).alias("_th"))
    out = held.join(found, F.col("_row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h")), "left")
    kinds = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(kinds, x["k"] + 1).alias("tag")))
    more = F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["share"] >= p.removal, "").otherwise("<TERM>").alias("tag")))
    none = F.array().cast("array<struct<s:bigint,e:bigint,tag:string>>")
    clean = _let(F.coalesce(F.sort_array(F.concat(base, more)), none), lambda spans: _replaced(F.col("_text"), spans, lambda x, at: F.when(x["s"] >= at, x["tag"]).otherwise("")))
    return out.select(*(F.when(F.col("_row.text").isNotNull(), clean).alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in df.columns))
