"""Toxicity by non-negative learning from positive and unlabelled texts.

Confirmed toxic texts are the positive sample, all texts are the unlabelled one: no text is taken for clean. With p the
class prior, R+ the loss of the positive sample as positives, R- that as negatives, and U the loss of the unlabelled
sample as negatives, the risk is p R+ + max(0, U - p R-): U holds the toxic texts too, whose part p R- takes out again.
That part can't be less than nothing; where a batch makes it so, the step goes back up instead (Kiryo et al., 2017).

The classifier is logistic over the presence of words and of beginnings of words: those that are spread over the two
samples more unevenly than chance explains. Near copies of a text would pass their rare words off as such, so they count
once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, materialise, mix
from .shingles import shingle_sets

LETTERS = re.compile(r"[^\W\d_]+")
#: Characters that are searched for words at once.
PIECE = 1 << 20
#: The lengths of beginnings. A whole word has END after it.
SHORTEST, LONGEST, END = 3, 8, " "


@dataclass(frozen=True)
class Settings:
    """positive, unlabelled: how many texts of each sample at most; signs: how many words and beginnings are used at most.

    least: one is used if so many texts of the sample that has more of it have it; apart: and if its shares of the samples
    are so many standard deviations apart. prior: the share of toxic texts in the unlabelled sample; if it isn't given, the
    share among those of its texts that have a label, and UNKNOWN_PRIOR where there is no label 0. slack, back: a batch
    whose negative part is below -slack takes a step back of that size. decay: of the weights' squares.
    """

    positive: int = 4_000
    unlabelled: int = 12_000
    signs: int = 400
    least: int = 4
    apart: float = 5.0
    prior: float | None = None
    epochs: int = 400
    batch: int = 20_000
    rate: float = 0.05
    decay: float = 1e-4
    slack: float = 0.0
    back: float = 1.0
    seed: int = 5


UNKNOWN_PRIOR = 0.1


@dataclass(frozen=True)
class Model:
    signs: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.weights + self.bias)))


def _losses(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logistic loss of scores as positives and as negatives, and the probability of the positive class."""
    return np.logaddexp(0, -z), np.logaddexp(0, z), 1 / (1 + np.exp(-z))


def risk(z_positive: np.ndarray, z_unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive and the negative part of the risk; the estimate is the first plus the second, but for that at least 0."""
    as_positive, as_negative, _ = _losses(z_positive)
    return float(prior * as_positive.mean()), float(_losses(z_unlabelled)[1].mean() - prior * as_negative.mean())


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Weights and bias from rows of features; batches hold both samples in the same shares throughout. Adam steps."""
    rng = np.random.default_rng(s.seed)
    w = np.zeros(unlabelled.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    p, u = (np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1) for x in (positive, unlabelled))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    batches = max(1, -(-(len(p) + len(u)) // s.batch))
    for epoch in range(s.epochs):
        # parts of equal size, so that every row is in one batch
        for a, b in zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches)):
            if not len(a) or not len(b):
                a, b = np.arange(len(p)), np.arange(len(u))
            zp, zu = p[a] @ w, u[b] @ w
            qp, qu = _losses(zp)[2], _losses(zu)[2]
            up = p[a].T @ (qp - 1) * (prior / len(a))  # the gradient of p R+
            down = u[b].T @ qu / len(b) - p[a].T @ qp * (prior / len(a))  # of U - p R-
            g = up + down if risk(zp, zu, prior)[1] >= -s.slack else -s.back * down
            g[:-1] += s.decay * w[:-1]
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= s.rate * (1 - epoch / s.epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def pieces(text: str) -> Iterator[str]:
    """A text in parts that end with white space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and LETTERS.match(text[end]):
            end += 1
        yield text[at:end]
        at = end


def signs_of(word: str) -> list[str]:
    """A word as a whole, and its beginnings."""
    return [word + END, *(word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def _finder(known: tuple[str, ...]) -> Callable[[str | None], list[int]]:
    """text -> the places of the known signs that it has."""
    place = {w: k for k, w in enumerate(known)}
    starts = {w.rstrip(END)[:SHORTEST] for w in known}

    def found(text: str | None) -> list[int]:
        out: set[str] = set()
        for part in pieces(text or ""):
            for w in set(LETTERS.findall(part.lower())):
                if w[:SHORTEST] in starts:
                    out.update(signs_of(w))
        return sorted(place[x] for x in out & place.keys())

    return found


def _marker(known: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _finder(known)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([found(t.as_py()) for t in batch.column(2)], pa.list_(pa.int32()))], ["h", "sample", "found"])

    return run


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, sample, text) -> (sign, a, b): in how many positive and unlabelled texts it is, by parts of the sample."""
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        signs = list(held[0].keys() | held[1].keys())
        done = pa.RecordBatch.from_arrays([pa.array(signs, pa.string()), *(pa.array([held[k][x] for x in signs], pa.int64()) for k in (1, 0))], ["sign", "a", "b"])
        held[0].clear(), held[1].clear()
        return done

    for batch in batches:
        for of, text in zip(batch.column(1).to_pylist(), batch.column(2)):
            signs: set[str] = set()
            for part in pieces(text.as_py() or ""):
                for w in set(LETTERS.findall(part.lower())):
                    signs.update(signs_of(w))
            held[of].update(signs)
            if len(held[0]) + len(held[1]) > 300_000:
                yield out()
    yield out()


def _scorer(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _finder(model.signs)
        for batch in batches:
            z = np.array([model.weights[found(t.as_py())].sum() for t in batch.column(2)]) + model.bias
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-z)), pa.float64())], ["doc_id", "held_out", "score"])

    return run


def _held(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two least hashes of a text's shingles of five words; near copies share them more often than not."""
    for batch in batches:
        sets = [x if len(x) else np.zeros(1, U) for x in shingle_sets(batch.column(1).to_pylist(), 5)]
        k1, k2 = (pa.array([int(mix(x ^ U(salt)).min().view(np.int64)) for x in sets], pa.int64()) for salt in (1, 2))
        yield pa.RecordBatch.from_arrays([*batch.columns, k1, k2], ["h", "text", "toxic", "k1", "k2"])


def _least(df: DataFrame, n: int, seed: int) -> DataFrame:
    """df (text, toxic) -> (h, text, toxic) for the n texts of least hash, copies and most near copies once.

    Some more than n of all are looked at. Of copies with different labels the greatest holds.
    """
    total = df.count()
    drawn = df.withColumn("h", F.xxhash64("text", F.lit(seed)))
    most = int(min(1.0, (1.2 * n + 50) / max(1, total)) * 2**64) - 2**63
    drawn = drawn.filter(F.col("h") < most) if most < 2**63 else drawn
    drawn = drawn.groupBy("h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("h", "text", "toxic").mapInArrow(_sketch, "h long, text string, toxic int, k1 long, k2 long")
    for key in ("k1", "k2"):
        drawn = drawn.groupBy(key).agg(F.min(F.struct("h", "text", "toxic", *({"k1", "k2"} - {key}))).alias("x")).select("x.*", key)
    return drawn.select("h", "text", "toxic").orderBy("h").limit(n)


def learn(df: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """The classifier of score_toxicity()."""
    known = labels.filter("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("_d"), F.col("toxic").cast("int").alias("toxic")).filter(~_held(F.col("_d"))).groupBy("_d").agg(F.max("toxic").alias("toxic"))
    texts = df.filter(~_held(F.col("doc_id"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, F.col("doc_id") == F.col("_d"), "left").select("text", "toxic")
    both = _least(texts.filter("toxic = 1"), s.positive, s.seed).withColumn("sample", F.lit(1)).unionByName(_least(texts, s.unlabelled, s.seed).withColumn("sample", F.lit(0)))
    sample = materialise(both.select("h", "sample", "text", "toxic"), "toxicity-sample")
    size, with_label = {}, [0, 0]
    for r in sample.groupBy("sample", "toxic").agg(F.count("*").alias("n")).collect():
        size[r["sample"]] = size.get(r["sample"], 0) + r["n"]
        if not r["sample"] and r["toxic"] is not None:
            with_label[r["toxic"]] += r["n"]
    prior = s.prior if s.prior is not None else with_label[1] / sum(with_label) if with_label[0] else UNKNOWN_PRIOR
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if len(size) < 2:
        return Model((), np.zeros(0), float(np.log(prior / (1 - prior))))
    # how far a sign's share of the positive sample is from its share of the unlabelled one, in standard deviations
    a, b = (F.col(x) / size[k] for x, k in (("a", 1), ("b", 0)))
    both = (F.col("a") + F.col("b")) / (size[0] + size[1])
    apart = F.abs(a - b) / F.sqrt(both * (1 - both) * (1 / size[0] + 1 / size[1]) + F.lit(1e-12))
    signs = (sample.mapInArrow(_counter, "sign string, a long, b long").groupBy("sign").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
             .filter(F.when(a > b, F.col("a")).otherwise(F.col("b")) >= s.least).select("sign", apart.alias("apart")).filter(F.col("apart") >= s.apart).orderBy(F.desc("apart"), "sign").limit(s.signs).collect())
    names = tuple(r["sign"] for r in signs)
    rows = sample.mapInArrow(_marker(names), "h long, sample int, found array<int>").collect()
    x = {k: np.zeros((size[k], len(names)), np.float32) for k in (0, 1)}
    at = {0: 0, 1: 0}
    for r in sorted(rows, key=lambda r: (r["sample"], r["h"])):
        x[r["sample"]][at[r["sample"]], r["found"]] = 1
        at[r["sample"]] += 1
    weights, bias = train(x[1], x[0], prior, s)
    keep = np.flatnonzero(weights)
    return Model(tuple(names[k] for k in keep), weights[keep], bias)


def score_toxicity(df: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """One row per row of df (doc_id, text): held_out, score and predicted; labels has doc_id and toxic.

    Learned from texts whose crc32(doc_id as text) mod 3 isn't 1: at most s.positive ones with label 1 and at most s.unlabelled of
    all, those of the least hashes of the text; copies count once. Label 0 serves for the class
    prior only; of several labels of a doc_id the greatest holds. Words are runs of letters, lower-cased. All of every text is scored; null and empty texts, and texts
    without known signs, get the bias' score. Without toxic texts to learn from that is the prior. Null labels are left out, other
    columns aren't read, repeated rows give repeated rows, an empty table none.
    """
    model = learn(df, labels, s)
    scored = df.select(F.col("doc_id").cast("long").alias("doc_id"), _held(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
