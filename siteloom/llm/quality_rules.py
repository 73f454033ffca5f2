"""Heuristic quality rules, compiled from a threshold table into one projection.

Every statistic is a built-in column expression, so the whole operator is a scan and a projection:
no shuffle, no user function, memory bounded by one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, words, zero

#: Frequent function words of the languages of the corpus (fixed values).
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are at from or an "
    "de la el en que y los se del las un por con una su para es al lo como "
    "le et les des est dans qui une sur pas au par pour ce il ne "
    "der die und das den von zu mit sich ist im dem nicht ein eine auf für als auch"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes where low <= metric <= high; a null bound is open."""

    metric: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (F.col(self.metric) >= F.lit(float(self.low)))
        if self.high is not None:
            out = out & (F.col(self.metric) <= F.lit(float(self.high)))
        return out


#: The production table. Ratios are per word, but for the line ratios, which are per line with a word.
RULES = (
    Rule("n_words", low=50),
    Rule("mean_word_chars", low=2, high=15),
    Rule("symbol_ratio", high=0.10),
    Rule("exclamation_ratio", high=0.30),
    Rule("stop_word_ratio", low=0.03),
    Rule("dup_line_ratio", high=0.50),
    Rule("repeat_word_ratio", high=0.50),
)


def _erased(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _sorted_places(hashes: Column) -> Column:
    """(hash, place) pairs in order of the hash: equal 3-word windows come side by side."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the statistics of its text as columns; null texts count as empty.

    Empty texts give zeros. The names written are replaced where df has them already; others are kept.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({"_w": words(F.col(text)), "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": (F.length(t) - _erased(t, SPACE_CHARS)).cast("long"),
        "n_symbols": _erased(t, "#*$%&|<>"),
        "_exclamations": _erased(t, "!"),
        "_n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_stop": F.size(F.filter("_w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
        "_h": F.transform("_w", lambda x: F.xxhash64(x)),
    })
    n = F.size("_h")
    two = F.zip_with(F.slice("_h", F.lit(1), F.greatest(n - 2, F.lit(0))), F.slice("_h", F.lit(2), F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn("_g", F.zip_with(two, F.slice("_h", F.lit(3), F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("_p", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), _sorted_places(F.col("_g"))))
    m = F.size("_p")
    out = out.withColumn("_at", F.when(F.col("_p").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(
        F.zip_with(F.slice("_p", F.lit(1), m - 1), F.slice("_p", F.lit(2), m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))))))
    k = F.size("_at")
    gaps = F.zip_with(F.slice("_at", F.lit(1), k - 1), F.slice("_at", F.lit(2), k - 1), lambda a, b: F.least(b - a, F.lit(3)))
    out = out.withColumn("n_repeat_words", F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).cast("long"))
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return out.withColumns({
        "n_words": F.col("n_words") + zero(),
        "mean_word_chars": F.col("word_chars") / per_word,
        "symbol_ratio": F.col("n_symbols") / per_word,
        "exclamation_ratio": F.col("_exclamations") / per_word,
        "stop_word_ratio": F.col("_stop") / per_word,
        "repeat_word_ratio": F.col("n_repeat_words") / per_word,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
    }).drop("_w", "_lines", "_h", "_g", "_p", "_at", "_stop", "_exclamations", "_n_lines")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rule table as one boolean expression over the statistics."""
    out = F.lit(True)
    for rule in rules:
        out = out & rule.passes()
    return out


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document of df (doc_id, text): statistics, base_failed and kept.

    Null texts count as empty, have no words and fail. Repeated rows stay repeated. Other columns of df are not read,
    so clashing names do no harm. An empty df gives no rows.
    """
    out = statistics(df.select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"),
        *(F.round(F.col(x), 6).alias(x) for x in ("symbol_ratio", "stop_word_ratio", "dup_line_ratio")),
    )


def keep_good(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that pass both the base rule and the table, with df's columns."""
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col("text").alias("text"))
    out = statistics(own)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.filter(~failed & verdict(rules)).select("_row.*")
