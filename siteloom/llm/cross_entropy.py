"""Cross-entropy difference of documents under a target and a background n-gram model.

Tokens are words, and both models share one vocabulary: the distinct words of all documents, and one for all others. The
target's counts come from the documents that are labelled good, the background's from all documents; the latter are
scaled to the target's size, so that both are smoothed alike. Each order interpolates the one below with a fixed weight
(Dirichlet smoothing): pairs of words, then words. A document's own counts are left out of both models when it is
scored, so no document is scored by what it taught.

Counts are exact and over all documents. Documents are dealt to blocks of some BLOCK bytes by a hash. Each block sends its
distinct n-grams, with their counts, to buckets by code; a bucket adds them up and answers each block with the totals of
what it asked for, in its order. What occurs but once in all is answered with 0: without its own document it is unseen.
Blocks and their answers then meet again and are scored. So nothing is broadcast but three totals, a task holds a block
or a bucket, and a frequent n-gram is one entry for each block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, materialise, mix, release
from .shingles import word_hashes

ORDER = 2
WEIGHT = 4.0
#: Bytes of text in a block, on average.
BLOCK = 4 << 20
#: Blocks for each bucket; a bucket has some SHARE blocks' n-grams.
SHARE = 4
_SALTS = tuple(U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_ASKED = "bucket long, block long, size int, codes binary, n binary, t binary"
_ANSWER = "block long, bucket long, size int, n binary, t binary, vocabulary long, words long, good_words long, good long"


class Grams:
    """The n-grams of some texts: for each order, the code that ends at each word (there only if its text has enough words before)."""

    def __init__(self, texts: list[str | None]):
        h, self.sizes = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
        starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(h)) - np.repeat(starts, self.sizes)
        self.codes = [mix(h + _SALTS[0])]
        for k in range(1, ORDER):
            code = np.zeros_like(h)
            code[1:] = mix((self.codes[-1][:-1] ^ _SALTS[k]) * _SALTS[0] + h[1:])
            self.codes.append(code)

    def runs(self, k: int) -> tuple[np.ndarray, ...]:
        """Order k: the places sorted by code, then document; the start of each run of equal ones; and the code's start among the runs."""
        at = np.flatnonzero(self.place >= k)
        at = at[np.argsort(self.codes[k][at], kind="stable")]
        code, doc = self.codes[k][at], self.doc[at]
        new = np.concatenate([[True], code[1:] != code[:-1]]) if len(at) else np.empty(0, bool)
        run = np.flatnonzero(new | np.concatenate([[True], doc[1:] != doc[:-1]])) if len(at) else np.empty(0, np.int64)
        return at, run, np.flatnonzero(new[run])


def _packed(x: np.ndarray, kind: type) -> bytes:
    return zlib.compress(x.astype(kind).tobytes(), 1)


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def _gaps(codes: np.ndarray) -> bytes:
    """Sorted codes as their differences: the five low bytes as they are, the others, nearly all 0, packed."""
    each = np.diff(codes, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return each[:, :5].tobytes() + zlib.compress(each[:, 5:].T.tobytes(), 1)


def _codes(x: bytes, n: int) -> np.ndarray:
    each = np.empty((n, 8), np.uint8)
    each[:, :5] = np.frombuffer(x, np.uint8, 5 * n).reshape(n, 5)
    each[:, 5:] = np.frombuffer(zlib.decompress(x[5 * n :]), np.uint8).reshape(3, n).T
    return np.cumsum(each.view("<u8").reshape(-1), dtype=U)


def _good(rows: pa.Table, good: pa.Table) -> np.ndarray:
    """1 for the rows whose document is in the target, else 0."""
    ids = set(good.column("good").drop_null().to_pylist())
    return np.array([x in ids for x in rows.column("doc_id").to_pylist()], np.int64)


def _asker(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's rows and target -> its distinct n-grams by bucket and size, sorted, counted, and counted in the target."""

    def ask(rows: pa.Table, target: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        if rows.num_rows:
            grams, good, block = Grams(rows.column("text").to_pylist()), _good(rows, target), rows.column("block")[0].as_py()
            for k in range(ORDER):
                at, run, first = grams.runs(k)
                if not len(at):
                    continue
                starts = run[first]
                codes = grams.codes[k][at[starts]]
                n = np.diff(np.concatenate([starts, [len(at)]]))
                t = np.add.reduceat(good[grams.doc[at]], starts)
                bucket = _bucket(codes, buckets)
                cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(codes)]])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    for c, v in zip(out, (int(bucket[a]), block, k, _gaps(codes[a:b]), _packed(n[a:b], np.uint32), _packed(t[a:b], np.uint32))):
                        c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3)
        return pa.table([pa.array(c, x) for c, x in zip(out, kinds)], ["bucket", "block", "size", "codes", "n", "t"])

    return ask


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of codes, by their upper half."""
    return ((codes >> U(32)) * U(buckets)) >> U(32)


def _answer(rows: pa.Table) -> pa.Table:
    """A bucket's rows -> the totals of the n-grams of each of them, 0 for those that occur once; and the bucket's words, as block -1."""
    size = np.array(rows.column("size").to_pylist())
    counts = [[_unpacked(x, np.uint32) for x in rows.column(c).to_pylist()] for c in ("n", "t")]
    sizes = np.array([len(x) for x in counts[0]])
    n, t = map(np.concatenate, counts)
    codes = [_codes(x, k) for x, k in zip(rows.column("codes").to_pylist(), sizes.tolist())]
    _, first, which = np.unique(np.concatenate(codes), return_index=True, return_inverse=True)
    n, t = (np.bincount(which, x, len(first)).astype(np.int64) for x in (n, t))  # sums below 2**53 are exact
    words = np.repeat(size == 0, sizes)[first]
    out: list[list] = [[-1], [None], [None], [None], [None], [int(words.sum())], [int(n[words].sum())], [int(t[words].sum())]]
    once = n < 2
    n, t = np.where(once, 0, n), np.where(once, 0, t)
    ends = np.cumsum(sizes)
    for k, (a, e) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
        row = (rows.column("block")[k].as_py(), rows.column("bucket")[k].as_py(), int(size[k]), _packed(n[which[a:e]], np.int64), _packed(t[which[a:e]], np.int64), None, None, None)
        for c, v in zip(out, row):
            c.append(v)
    kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 2, *[pa.int64()] * 3)
    names = ["block", "bucket", "size", "n", "t", "vocabulary", "words", "good_words"]
    return pa.table([*(pa.array(c, x) for c, x in zip(out, kinds)), pa.nulls(len(out[0]), pa.int64())], [*names, "good"])


def _scorer(vocabulary: int, words: int, good_words: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    scale = good_words / words if words else 0.0

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        grams, good = Grams(rows.column("text").to_pylist() if rows.num_rows else []), _good(rows, answers)
        totals: dict[int, list] = {k: [] for k in range(ORDER)}
        for bucket, size, n, t in zip(*(answers.column(c).to_pylist() for c in ("bucket", "size", "n", "t"))):
            if bucket is not None:
                totals[size].append((bucket, n, t))
        mine = good[grams.doc]
        every, target = words - grams.sizes[grams.doc], good_words - mine * grams.sizes[grams.doc]
        p = q = before = None  # probabilities under the target and the background, and the counts of the order below
        for k in range(ORDER):
            at, run, first = grams.runs(k)
            all_, good_ = (np.zeros(len(grams.doc)) for _ in range(2))
            if len(at):
                n, t = (np.concatenate([_unpacked(x[c], np.int64) for x in sorted(totals[k])]) for c in (1, 2))
                held = np.diff(np.concatenate([run, [len(at)]]))  # a document's own
                runs = np.diff(np.concatenate([first, [len(run)]]))  # documents of each code
                all_[at] = scale * np.repeat(np.maximum(np.repeat(n, runs) - held, 0), held)
                good_[at] = np.repeat(np.maximum(np.repeat(t, runs) - held * good[grams.doc[at[run]]], 0), held)
            if k == 0:
                p = (good_ + 1) / (target + vocabulary + 1)
                q = (all_ + 1) / (scale * every + vocabulary + 1)
            else:
                here = grams.place >= k
                context_all, context_good = (np.concatenate([[0.0], x])[: len(x)] for x in before)
                p = np.where(here, (good_ + WEIGHT * p) / (context_good + WEIGHT), p)
                q = np.where(here, (all_ + WEIGHT * q) / (context_all + WEIGHT), q)
            before = (all_, good_)
        n_docs, some = len(grams.sizes), grams.sizes > 0
        losses = [np.bincount(grams.doc, -np.log(x), n_docs)[:n_docs] / np.maximum(grams.sizes, 1) for x in (p, q)]
        values = [*losses, losses[0] - losses[1]]
        return pa.table([rows.column("doc_id"), pa.array(grams.sizes), *(pa.array(x, mask=~some) for x in values)], ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    return score


def cross_entropy_difference(df: DataFrame, good: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of df (doc_id, text): words, mean loss per word under both models (nats), and the target's less the background's.

    good has the doc_ids of the target; a document in it is left out of the target as well as of the background while it is
    scored. The lower the difference, the more a text is like the target. Null, empty and blank texts have no words and
    null losses. Without a target both models are even. Repeated rows count repeatedly and give repeated rows; rows
    without a doc_id are in the background only. Other columns aren't read; an empty df gives no rows.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    buckets = max(1, blocks // SHARE)

    def dealt(key: Column) -> Column:
        return F.pmod(key, F.lit(blocks)).alias("block")

    # the target goes where its documents are; rows without a doc_id are dealt by their text
    rows = docs.select("doc_id", "text", dealt(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text"))))
    target = good.select(F.col("doc_id").cast("long").alias("good")).filter("good is not null").distinct().select(dealt(F.xxhash64("good")), "good")
    def asked() -> DataFrame:
        return rows.groupBy("block").cogroup(target.groupBy("block")).applyInArrow(_asker(buckets), _ASKED)

    answers = materialise(asked().groupBy("bucket").applyInArrow(_answer, _ANSWER), "answers")
    sums = answers.filter("block = -1").agg(F.sum("vocabulary"), F.sum("words"), F.sum("good_words")).first()
    release(df.sparkSession)
    score = _scorer(*(x or 0 for x in sums))
    back = answers.filter("block >= 0").unionByName(target, allowMissingColumns=True)
    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, schema)
