"""Document quality by a sparse ensemble of rules.

Boosted trees over the statistics of a text give conjunctive rules, one for each path from the root; a logistic model
with an L1 penalty keeps few of them; those become one Spark column expression. Trees and weights are fitted in numpy on
a bounded sample of labelled rows; statistics and scores are built-in functions over every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, materialise, words, zero
from .quality_rules import STOP_WORDS

FEATURES = ("n_words", "mean_word_chars", "symbol_ratio", "exclamation_ratio", "pipe_ratio", "upper_ratio", "digit_ratio", "stop_word_ratio", "distinct_word_ratio", "distinct_line_ratio", "words_per_line", "punctuation_ratio")


@dataclass(frozen=True)
class Settings:
    """sample: how many labelled rows are learned from at most."""

    sample: int = 20_000
    trees: int = 30
    depth: int = 3
    cuts: int = 32
    shrinkage: float = 0.3
    penalty: float = 0.002
    steps: int = 400
    seed: int = 11


Condition = tuple[int, bool, float]  # feature, whether it is to be at most the value, value
Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for feature, below, value in rule:
                c = F.col(FEATURES[feature])
                holds = holds & ((c <= F.lit(value)) if below else (c > F.lit(value)))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights):
            z += weight * covers(rule, x)
        return 1 / (1 + np.exp(-z))


def statistics(df: DataFrame) -> DataFrame:
    """df (doc_id, text) -> doc_id and the features; null texts count as empty, whose ratios are 0."""
    t = F.coalesce(F.col("text"), F.lit(""))
    out = df.select("doc_id", t.alias("_t"), words(F.col("text")).alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    chars = F.length(F.translate("_t", SPACE_CHARS, ""))

    def count(chars_: str) -> Column:
        return F.length("_t") - F.length(F.translate("_t", chars_, ""))

    per_word = F.greatest(F.size("_w"), F.lit(1))
    per_char = F.greatest(chars, F.lit(1))
    per_line = F.greatest(F.size("_lines"), F.lit(1))
    return out.select(
        "doc_id",
        (F.size("_w") + zero()).cast("double").alias("n_words"),
        (chars / per_word).alias("mean_word_chars"),
        (count("#*$%&<>@^~=_\\{}") / per_word).alias("symbol_ratio"),
        (count("!?") / per_word).alias("exclamation_ratio"),
        (count("|") / per_word).alias("pipe_ratio"),
        (count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / per_char).alias("upper_ratio"),
        (count("0123456789") / per_char).alias("digit_ratio"),
        (F.size(F.filter("_w", lambda x: F.lower(x).isin(STOP_WORDS))) / per_word).alias("stop_word_ratio"),
        (F.size(F.array_distinct("_w")) / per_word).alias("distinct_word_ratio"),
        (F.size(F.array_distinct("_lines")) / per_line).alias("distinct_line_ratio"),
        (F.size("_w") / per_line).alias("words_per_line"),
        (count(".,;:") / per_word).alias("punctuation_ratio"),
    )


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for feature, below, value in rule:
        out &= (x[:, feature] <= value) if below else (x[:, feature] > value)
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule, out: list[Rule], value: np.ndarray) -> None:
    """One node of a tree that fits -g / h; every node but the root is a rule."""
    if path:
        out.append(path)
    gain, split = 1e-9, None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if depth:
        for f, at in enumerate(cuts):
            if not len(at):
                continue
            cell = np.searchsorted(at, x[rows, f], "left")
            gl, hl = (np.cumsum(np.bincount(cell, v[rows], len(at) + 1))[:-1] for v in (g, h))
            nl = np.cumsum(np.bincount(cell, minlength=len(at) + 1))[:-1]
            ok = (nl >= 5) & (nl <= len(rows) - 5)
            score = np.where(ok, gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1), -1)
            k = int(score.argmax())
            if score[k] > gain:
                gain, split = score[k], (f, float(at[k]))
    if split is None:
        value[rows] = -total_g / (total_h + 1)
        return
    f, at = split
    left = x[rows, f] <= at
    _grow(x, g, h, rows[left], cuts, depth - 1, (*path, (f, True, at)), out, value)
    _grow(x, g, h, rows[~left], cuts, depth - 1, (*path, (f, False, at)), out, value)


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Ensemble:
    """Rules and weights from rows of statistics and labels 0 and 1; without both labels, the (smoothed) share of label 1."""
    prior = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if len(set(y.tolist())) < 2:
        return Ensemble((), (), bias)
    rng = np.random.default_rng(s.seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, s.cuts + 2)[1:-1])) for f in range(x.shape[1])]
    z, rules = np.full(len(y), bias), []
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.sort(rng.permutation(len(y))[: max(10, len(y) // 2)])
        value = np.zeros(len(y))
        grown: list[Rule] = []
        _grow(x, p - y, p * (1 - p), rows, cuts, s.depth, (), grown, value)
        # rows that the tree hasn't seen take the values of its leaves too
        leaves = [r for r in grown if not any(q[: len(r)] == r and q != r for q in grown)]
        for r in leaves:
            c = covers(r, x)
            z[c] += s.shrinkage * float(np.median(value[rows][covers(r, x[rows])]))
        rules += grown
    unique: dict[bytes, Rule] = {}
    for r in sorted(set(rules), key=lambda r: (len(r), r)):
        c = covers(r, x)
        if 0 < c.sum() < len(c):
            unique.setdefault(min(c.tobytes(), (~c).tobytes()), r)  # of rules alike on the sample the shortest
    rules = list(unique.values())
    a = np.stack([covers(r, x) for r in rules], 1).astype(np.float64)
    spread = np.maximum(a.std(0), 0.05)
    a = a / spread
    # accelerated proximal gradient steps on the logistic loss with an L1 penalty
    w, b, v, vb, t = np.zeros(a.shape[1]), bias, np.zeros(a.shape[1]), bias, 1.0
    rate = 4 / (np.linalg.norm(a, 2) ** 2 / len(y) + 1)
    for _ in range(s.steps):
        r = 1 / (1 + np.exp(-(a @ v + vb))) - y
        new = v - rate * (a.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * s.penalty, 0)
        new_b = vb - rate * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    keep = np.flatnonzero(w)
    return Ensemble(tuple(rules[k] for k in keep), tuple(float(w[k] / spread[k]) for k in keep), float(b))


def score_quality(df: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """One row per row of df (doc_id, text): held_out, score and predicted; labels has doc_id and quality.

    Learned from labelled rows whose crc32(doc_id as text) mod 4 isn't 2: at most s.sample of them, those of the least
    hashes. Null texts count as empty; they get a score too. Null labels are left out. Without labels the score is 0.5.
    Other columns aren't read; repeated rows give repeated rows.
    """
    stats = materialise(statistics(df.select("doc_id", "text")), "statistics")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    known = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").alias("_d"), "quality").filter(F.crc32(F.col("_d").cast("string")) % 4 != 2)
    n = known.count()
    h = F.pmod(F.xxhash64("_d", F.lit(s.seed)), F.lit(1 << 30))
    drawn = known.withColumn("h", h).filter(F.col("h") <= int(min(1.0, 1.2 * s.sample / max(1, n)) * (1 << 30)))
    rows = drawn.join(stats, F.col("_d") == F.col("doc_id")).select("h", "doc_id", "quality", *FEATURES).orderBy("h", "doc_id", "quality", *FEATURES).limit(s.sample).collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    ensemble = fit(x, np.array([r["quality"] for r in rows], float), s)
    score = ensemble.column()
    return stats.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"))
