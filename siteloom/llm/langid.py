"""Language identification by a convolutional network over bytes, trained and applied in numpy.

Filters of several widths run over the bytes; each filter's greatest value in a window goes through a softmax layer. A
filter over embedded bytes is a sum of one table lookup per place, so applying it needs no multiplication. Every text is
cut in windows of a fixed length, all of them are scored in batches, and a document's language is that of the greatest
mean probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD = 256
#: Windows scored at once, however long the text.
WINDOWS = 4096
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """window: bytes; at most `sample` documents of each language, each with `piece` characters, are learned from."""

    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    embedding: int = 8
    window: int = 128
    sample: int = 400
    piece: int = 512
    epochs: int = 10
    rate: float = 0.01
    batch: int = 64
    seed: int = 7


class Network:
    def __init__(self, classes: list[str], s: Settings):
        rng = np.random.default_rng(s.seed)
        self.classes, self.s = classes, s
        n = s.filters * len(s.widths)
        self.w = {"bytes": rng.normal(0, 0.5, (257, s.embedding)), "out": rng.normal(0, 0.1, (n, len(classes))), "out_bias": np.zeros(len(classes))}
        for k in s.widths:
            self.w[f"filter{k}"] = rng.normal(0, 1 / np.sqrt(k * s.embedding), (k, s.embedding, s.filters))
            self.w[f"bias{k}"] = np.zeros(s.filters)
        self.w["bytes"][PAD] = 0

    def _pool(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """x: (windows, bytes) -> the greatest value of each filter, and where."""
        e, f = self.w["bytes"], self.w[f"filter{k}"]
        n = x.shape[1] - k + 1
        value = np.zeros((len(x), n, self.s.filters))
        for j in range(k):
            value += (e @ f[j])[x[:, j : j + n]]
        at = value.argmax(1)
        return np.take_along_axis(value, at[:, None], 1)[:, 0] + self.w[f"bias{k}"], at

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The loss of a batch and its gradients."""
        pooled = {k: self._pool(x, k) for k in self.s.widths}
        raw = np.concatenate([pooled[k][0] for k in self.s.widths], 1)
        h = np.maximum(raw, 0)
        z = h @ self.w["out"] + self.w["out_bias"]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        loss = -np.log(p[np.arange(len(y)), y] + 1e-12).mean()
        d = p
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": h.T @ d, "out_bias": d.sum(0), "bytes": np.zeros_like(self.w["bytes"])}
        dh = (d @ self.w["out"].T) * (raw > 0)
        rows, c = np.arange(len(x))[:, None], self.s.filters
        for i, k in enumerate(self.s.widths):
            dk, at, f = dh[:, i * c : (i + 1) * c], pooled[k][1], self.w[f"filter{k}"]
            g[f"bias{k}"] = dk.sum(0)
            gf = np.zeros_like(f)
            for j in range(k):
                byte = x[rows, at + j]  # (windows, filters)
                gf[j] = np.einsum("nce,nc->ec", self.w["bytes"][byte], dk)
                np.add.at(g["bytes"], byte.ravel(), (dk[:, :, None] * f[j].T[None]).reshape(-1, f.shape[1]))
            g[f"filter{k}"] = gf
        g["bytes"][PAD] = 0
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Network":
        rng = np.random.default_rng(self.s.seed + 1)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(a) for k, a in self.w.items()}
        t = 0
        for _ in range(self.s.epochs):
            order = rng.permutation(len(x))
            for start in range(0, len(x), self.s.batch):
                take = order[start : start + self.s.batch]
                _, g = self.step(x[take], y[take])
                t += 1
                for k in self.w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.w[k] -= self.s.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> list[tuple[int, list[np.ndarray]]]:
        return [(k, [(self.w["bytes"] @ self.w[f"filter{k}"][j]).astype(np.float32) for j in range(k)]) for k in self.s.widths]


def windows_of(text: str, s: Settings) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    out = np.full(-(-max(1, len(raw)) // s.window) * s.window, PAD)
    out[: len(raw)] = raw
    return out.reshape(-1, s.window)


def train(rows: list[tuple[str, str]], s: Settings = Settings()) -> Network | None:
    """A network from (text, language) pairs; None without pairs. Windows of under 16 bytes teach nothing, so a language of shorter texts alone is a class without a sample."""
    classes = sorted({y for _, y in rows})
    if not classes:
        return None
    x, y = [], []
    for text, lang in rows:
        for w in windows_of(text, s):
            if np.count_nonzero(w != PAD) >= min(16, s.window):
                x.append(w), y.append(classes.index(lang))
    net = Network(classes, s)
    return net.fit(np.stack(x), np.array(y)) if len(classes) > 1 and x else net


class Scorer:
    """Mean class probabilities of whole texts."""

    def __init__(self, net: Network):
        self.s, self.classes = net.s, net.classes
        self.tables = net.tables()
        self.bias = np.concatenate([net.w[f"bias{k}"] for k in net.s.widths]).astype(np.float32)
        self.out, self.out_bias = net.w["out"].astype(np.float32), net.w["out_bias"].astype(np.float32)

    def many(self, texts: list[bytes]) -> np.ndarray:
        """(texts, classes). Windows follow each other; the filters see the next window of the same text, and padding after its end."""
        w, tail = self.s.window, max(self.s.widths) - 1
        sizes = np.array([-(-(len(t) + tail) // w) for t in texts])
        ends = np.cumsum(sizes) * w
        stream = np.full(ends[-1] + tail, PAD, np.int16)
        for t, n, end in zip(texts, sizes, ends):
            at = end - n * w
            stream[at : at + len(t)] = np.frombuffer(t, np.uint8)
        # these places hold padding; what follows is another text
        last = np.sort((ends[:, None] - np.arange(1, tail + 1)).ravel())
        found = []
        for a in range(0, int(ends[-1]), WINDOWS * w):
            b = min(a + WINDOWS * w, int(ends[-1]))
            padding = last[slice(*np.searchsorted(last, [a, b]))] - a
            pooled = []
            for k, table in self.tables:
                value = table[0].take(stream[a:b], axis=0)
                for j in range(1, k):
                    value += table[j].take(stream[a + j : b + j], axis=0)
                value[padding] = sum(t[PAD] for t in table)
                pooled.append(value.reshape(-1, w, self.s.filters).max(1))
            h = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
            z = h @ self.out + self.out_bias
            z -= z.max(1, keepdims=True)
            z = np.exp(z)
            found.append(z / z.sum(1, keepdims=True))
        p = np.concatenate(found)
        return np.add.reduceat(p, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]


def _predictor(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                texts, n = [], 0
                end = start
                while end < batch.num_rows and (n < 400_000 or end == start):
                    t = batch.column(2)[end].as_py() if batch.column(3)[end].as_py() else None
                    texts.append(t.encode("utf-8", "surrogatepass") if t else None)
                    n += len(t or "")
                    end += 1
                has = [k for k, t in enumerate(texts) if t is not None]
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if scorer and has:
                    p = scorer.many([texts[k] for k in has])
                    best = p.argmax(1)
                    for k, c, v in zip(has, best.tolist(), p.max(1).tolist()):
                        lang[k], score[k] = scorer.classes[c], min(1.0, v)
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
                start = end

    return run


def identify(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per row of df (doc_id, text, lang): held_out, lang_pred and score.

    Learned from rows with a text and a language whose crc32(doc_id as text) mod 4 isn't 2: for each language a sample of
    at most s.sample documents, those of the least hashes, s.piece characters of each from a place that the hash gives.
    Texts that are null or have no letter give "und" and 0, as does a table to learn nothing from. All of every text is
    scored. Other columns aren't read; repeated rows give repeated rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    known = df.filter(~held & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").count().collect()  # one row for each language
    h = F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(1 << 30))
    share = F.element_at(F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, 2 * s.sample / r["count"] + 50 / r["count"]) * (1 << 30)))))), F.col("lang")) if counts else F.lit(0)
    span = F.greatest(F.length("text") - s.piece, F.lit(0)) + 1
    drawn = known.withColumn("h", h).filter(F.col("h") <= share).select("lang", "h", F.expr("try_cast(doc_id AS bigint)").alias("d"), F.substring(F.col("text"), (1 + F.pmod(F.xxhash64("doc_id"), span)).cast("int"), F.lit(s.piece)).alias("piece"))
    rows = drawn.orderBy("h", "d", "piece").limit(4 * s.sample * max(1, len(counts))).collect()
    taken: dict[str, list] = {}
    for r in rows:
        if len(taken.setdefault(r["lang"], [])) < s.sample:
            taken[r["lang"]].append((r["piece"], r["lang"]))
    net = train([x for k in sorted(taken) for x in taken[k]], s)
    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return own.mapInArrow(_predictor(net), "doc_id long, held_out boolean, lang_pred string, score double")
