"""Approximate alignment by seeds: where a sequence lies on others, without an aligner.

The seeds of a sequence are its minimizers: of each window of w successive k-grams the one of least hash. Sequences that
share a stretch of w + k - 1 letters share a seed. Seeds meet in an equi-join; a hit votes for a diagonal, the place on the
target less that on the query, and hits on neighbouring diagonals make a chain. This tells places, strands and how many of
a query's seeds agree; it doesn't align letters, and places are missed where differences leave no window whole.

A seed of a query that is frequent on the targets isn't used, as long as `least` others are left; else the query's `least`
rarest ones are. So a query makes no more hits than its rare seeds have, and none is lost for having frequent ones only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
#: Letters of a sequence whose seeds are found at once.
PIECE = 1 << 20
_COMPLEMENT = {ord(a): ord(b) for a, b in zip("ACGTacgt", "TGCAtgca")}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x9FB21C651E98DF25)
    h = (h ^ (h >> _U(28))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _grams(letters: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k letters, put together from those of 1, 2, 4, ... letters."""
    total = len(letters)
    if total < k:
        return np.empty(0, _U)
    part, size, out, done = letters + _U(1), 1, None, 0
    while size <= k:
        if k & size:
            n = total - done - size + 1
            out = part[:n] if out is None else out[:n] + part[done : done + n] * _U(pow(int(_BASE), done, 1 << 64))
            done += size
        part = part[:-size] + part[size:] * _U(pow(int(_BASE), size, 1 << 64))
        size *= 2
    return _mix(out)


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Of each w successive hashes the place of the least, the leftmost of equal ones; windows of 2, 4, ... make wider ones."""
    value, place, size = h, np.arange(len(h)), 1
    while size < w:
        step = min(size, w - size)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.minimum(value[step:], value[:-step])
        size += step
    return place


def minimizers(text: str, k: int, w: int, strands: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, place, reverse) of a sequence: of equal hashes in a window the leftmost. strands: a k-gram and its reverse complement are one seed, reverse where the latter gives it."""
    found: list[tuple[np.ndarray, ...]] = []
    last = -1
    for start in range(0, max(1, len(text) - k - w + 2), PIECE):
        part = text[start : start + PIECE + k + w - 2]
        letters = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
        with np.errstate(over="ignore"):
            h = _grams(letters, k)
            back = np.zeros(len(h), bool)
            if strands and len(h):
                other = np.frombuffer(part.translate(_COMPLEMENT)[::-1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
                g = _grams(other, k)[::-1]
                back = g < h
                h = np.minimum(g, h)
        if not len(h):
            continue
        place = _least(h, min(w, len(h)))  # shorter sequences are one window; places never fall
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
        place = place[place + start > last]
        if len(place):
            last = int(place[-1]) + start
            found.append((h[place], place + start, back[place]))
    if not found:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def _finder(k: int, w: int, strands: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batch: pa.RecordBatch, of: list[int], found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        seed, at, back = (np.concatenate(x) for x in zip(*found))
        names = pa.array(np.repeat(of, [len(x[0]) for x in found]))
        for a in range(0, len(seed), 50_000):
            s = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(names[s]), pa.array(seed[s].view(np.int64)), pa.array(at[s].astype(np.int64)), pa.array(back[s])], ["id", "seed", "place", "reverse"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found, n = [], [], 0
            for i, text in enumerate(batch.column(1)):
                of.append(i), found.append(minimizers(text.as_py() or "", k, w, strands))
                n += len(found[-1][0])
                if n >= 50_000:
                    yield from rows(batch, of, found)
                    of, found, n = [], [], 0
            if n:
                yield from rows(batch, of, found)

    return run


def seeds(df: DataFrame, k: int = 15, w: int = 10, strands: bool = True) -> DataFrame:
    """df (id, seq) -> (id, seed, place, reverse). Null and empty sequences, and those of fewer than k letters, have none."""
    kind = dict(df.select("id").dtypes)["id"]
    return df.select("id", "seq").mapInArrow(_finder(k, w, strands), f"id {kind}, seed long, place long, reverse boolean")


def chosen(queries: DataFrame, targets: DataFrame, most: int, least: int) -> DataFrame:
    """The seeds of queries that are used: those found up to `most` times on the targets, or a query's `least` rarest if these are fewer; with n_seeds, how many of each query.

    Seeds that no target has count as used: a query's share is of all of them.
    """
    counts = targets.groupBy(F.col("seed").alias("_s")).agg(F.count("*").alias("_n"))
    rows = queries.join(counts, F.col("seed") == F.col("_s"), "left").withColumn("_n", F.coalesce("_n", F.lit(0))).drop("_s")
    w = Window.partitionBy("id")
    ranked = rows.withColumn("_rank", F.row_number().over(w.orderBy("_n", "seed", "place")))
    used = ranked.filter((F.col("_n") <= most) | (F.col("_rank") <= least))
    return used.withColumn("n_seeds", F.count("*").over(w)).drop("_rank", "_n")


def hits(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """chosen() and seeds() -> (id, target, reverse, diagonal, n_seeds, n): how many of a query's seeds vote for a diagonal of a target.

    The diagonal is the place on the target less that on the query, on the other strand their sum.
    """
    t = targets.select(F.col("id").alias("target"), F.col("seed").alias("_s"), F.col("place").alias("_p"), F.col("reverse").alias("_r"))
    both = queries.join(t, F.col("seed") == F.col("_s"))
    back = F.col("reverse") != F.col("_r")
    diagonal = F.when(back, F.col("_p") + F.col("place")).otherwise(F.col("_p") - F.col("place"))
    return both.groupBy("id", "target", back.alias("reverse"), diagonal.alias("diagonal"), "n_seeds").agg(F.count("*").alias("n"))


def chains(votes: DataFrame, gap: int) -> DataFrame:
    """hits() -> (id, target, reverse, first, last, n, share): diagonals no more than gap apart as one chain, with the votes on it and their share of the query's seeds (1 at most)."""
    key = ["id", "target", "reverse"]
    w = Window.partitionBy(*key).orderBy("diagonal")
    rows = votes.withColumn("_new", F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= gap, 0).otherwise(1)).withColumn("_k", F.sum("_new").over(w))
    out = rows.groupBy(*key, "_k").agg(F.min("diagonal").alias("first"), F.max("diagonal").alias("last"), F.sum("n").alias("n"), F.max("n_seeds").alias("n_seeds")).drop("_k")
    return out.withColumn("share", F.least(F.col("n") / F.col("n_seeds"), F.lit(1.0))).drop("n_seeds")


def met(queries: DataFrame, targets: DataFrame, k: int, w: int, strands: bool) -> tuple[DataFrame, DataFrame]:
    """The seeds of queries, and those of targets that a query has too: found once, and dealt once. Others are neither counted nor hit."""
    q = written(seeds(queries, k, w, strands), "query-seeds")
    # the queries' seeds are hashed, so that those of the targets pass by unsorted
    return q, written(seeds(targets, k, w, strands).join(q.select("seed").distinct().hint("shuffle_hash"), "seed", "left_semi").select("id", "seed", "place", "reverse"), "target-seeds")


def placed(queries: DataFrame, targets: DataFrame, k: int = 15, w: int = 10, strands: bool = True, gap: int = 20, share: float = 0.3, most: int = 200, least: int = 3) -> DataFrame:
    """queries and targets (id, seq) -> chains() with that share of the query's seeds or more: approximate places of each query."""
    q, t = met(queries, targets, k, w, strands)
    return chains(hits(chosen(q, t, most, least), t), gap).filter(F.col("share") >= share)


def exact_places(queries: DataFrame, targets: DataFrame, k: int = 15, w: int = 10, most: int = 200, least: int = 3) -> DataFrame:
    """queries and targets (id, seq) -> (id, target, place): all places where a query's sequence stands on a target, letter by letter.

    All used seeds vote for such a place's diagonal, so none is missed; what they vote for is compared. Queries of fewer than
    w + k - 1 letters have none.
    """
    long = queries.filter(F.length("seq") >= w + k - 1)
    q, t = met(long, targets, k, w, False)
    found = hits(chosen(q, t, most, least), t).filter("n = n_seeds")
    texts = targets.select(F.col("id").alias("_t"), F.col("seq").alias("_seq"))
    both = found.join(long.select(F.col("id").alias("_q"), F.col("seq").alias("_query")), F.col("id") == F.col("_q")).join(texts, F.col("target") == F.col("_t"))
    same = F.substring(F.col("_seq"), (F.col("diagonal") + 1).cast("int"), F.length("_query")) == F.col("_query")
    return both.filter((F.col("diagonal") >= 0) & same).select("id", "target", F.col("diagonal").alias("place"))
