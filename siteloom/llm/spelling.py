"""Spelling variants: words that one inserted, deleted or replaced letter sets apart.

A word is a point: its rank among the words of its length in forward order, and its rank by their reversals. Words that
differ from a word at place i only share the i letters before it, an interval of the first order, and the letters after
it, an interval of the second; the points in that rectangle are reported by a wavelet tree. A word with one letter more
is found in the same way among the words of the next length; seen from there, that letter is deleted.

The points are dealt to blocks twice, by the first and by the second half of the word. A query with its place in the
second half goes to where its first half is, and the other way round, so it asks one block and no pair is found twice.
Halves that too many words share are split into a grid of points and queries.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

LETTERS = re.compile(r"[a-zÀ-ÿ]+")
#: Words of at least so many letters, seen so often.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A run is altered where this divides its check sum.
EVERY = 97
#: Points of a block, about; entries that a task counts in before it hands them on; characters searched at once.
BLOCK, HELD, PIECE = 1 << 14, 300_000, 1 << 20
#: Items of queries that are followed through a tree at once.
QUERIES = 1 << 18
_LOWER = {c: c + 32 for c in range(65, 91)}


def altered(doc_id: str, run: str) -> str:
    """A lower-cased run, without one of its letters where the check sum of the document and the run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def runs(text: str) -> Iterator[list[str]]:
    """The lower-cased runs of letters of a text, some at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and LETTERS.match(text[end].translate(_LOWER)):  # not within a run
            end += 1
        yield LETTERS.findall(text[at:end].translate(_LOWER))
        at = end


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        nonlocal held
        done, held = held, {}
        return pa.RecordBatch.from_arrays([pa.array(list(done), pa.string()), pa.array(list(done.values()), pa.int64())], ["word", "n"])

    crc = zlib.crc32
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            text, doc_id = text.as_py(), doc_id.as_py() or ""
            if not text:
                continue
            start = crc(f"{doc_id}:".encode())
            for some in runs(text):
                for run in some:
                    # the check sum is the same for every occurrence; it goes on from that of the document's part
                    if len(run) >= LEAST_LETTERS:
                        h = crc(run.encode(), start)
                        if not h % EVERY:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < LEAST_LETTERS:
                                continue
                        held[run] = held.get(run, 0) + 1
                if len(held) > HELD:
                    yield out()
    if held:
        yield out()


class WaveletTree:
    """Reports the places of a permutation within a range of places and a range of values."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # how many zeros stand before each place, by level
        for bit in range(self.levels - 1, -1, -1):
            ones = (values >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - ones)]))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for all values in [least, most) at the places [lo, hi) of each query."""
        query, base = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.levels - 1 - level)
            a, b = zeros[lo], zeros[hi]
            # left children hold the values [base, base + half), right ones the next half
            left = (a < b) & (least[query] < base + half) & (most[query] > base)
            right = (lo - a < hi - b) & (least[query] < base + 2 * half) & (most[query] > base + half)
            lo, hi = np.concatenate([a[left], zeros[-1] + (lo - a)[right]]), np.concatenate([b[left], zeros[-1] + (hi - b)[right]])
            query, base = np.concatenate([query[left], query[right]]), np.concatenate([base[left], base[right] + half])
        return query, base


class Order:
    """Some rows of letters in order, and the interval of those that share a prefix."""

    def __init__(self, letters: np.ndarray, is_point: np.ndarray):
        n, width = letters.shape
        order = np.argsort(np.ascontiguousarray(letters).view(f"S{width}").ravel(), kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        rows = letters[order]
        apart = rows[1:] != rows[:-1]
        shared = np.where(apart.any(1), apart.argmax(1), width) if n > 1 else np.empty(0, np.int64)
        #: The letters shared by rows next to each other; least of runs of 1, 2, 4, ... of them.
        self.shared = [shared.astype(np.int64)]
        while 2 << (len(self.shared) - 1) <= n - 1:
            x, step = self.shared[-1], 1 << (len(self.shared) - 1)
            self.shared.append(np.minimum(x[:-step], x[step:]))
        edge = np.concatenate([[-1], shared, [-1]])
        self.most = np.maximum(edge[:-1], edge[1:])[self.place]
        self.before = np.concatenate([[0], np.cumsum(is_point[order])])  # points before a place
        self.points = order[is_point[order]]

    def interval(self, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points that share the first n letters with a row, as ranks among points."""
        lo, hi = self.place[row], self.place[row]
        for k in range(len(self.shared) - 1, -1, -1):
            x, step = self.shared[k], 1 << k
            at = np.minimum(hi, len(x) - 1)
            hi = hi + step * ((hi < len(x)) & (x[at] >= n))
            at = np.maximum(lo - step, 0)
            lo = lo - step * ((lo >= step) & (x[np.minimum(at, len(x) - 1)] >= n))
        return self.before[lo], self.before[hi + 1]


def _pairs(letters: np.ndarray, short: np.ndarray, is_point: np.ndarray, is_query: np.ndarray, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one width -> (row, point) that differ at one place of first .. last; short rows lack a letter there.

    The letters of a row are filled up with zeros at the end. Each pair comes once.
    """
    n, width = letters.shape
    if n < 2:
        return
    forward = Order(letters, is_point)
    turned = letters[:, ::-1].copy()
    turned[short] = np.roll(turned[short], -1, axis=1)
    backward = Order(turned, is_point)
    if not len(forward.points):
        return
    rank = np.empty(n, np.int64)
    rank[backward.points] = np.arange(len(backward.points))
    tree = WaveletTree(rank[forward.points])
    rows = np.flatnonzero(is_query)
    # beyond what a row shares with its neighbours in an order there's no point to find
    lo = np.maximum(first, width - 1 - backward.most[rows])
    hi = np.minimum(last, forward.most[rows])
    size = np.maximum(hi - lo + 1, 0)
    ends = np.cumsum(size)
    for start in range(0, int(ends[-1]) if len(ends) else 0, QUERIES):
        item = np.arange(start, min(start + QUERIES, int(ends[-1])))
        k = np.searchsorted(ends, item, "right")
        row, at = rows[k], lo[k] + item - (ends[k] - size[k])
        f0, f1 = forward.interval(row, at)
        b0, b1 = backward.interval(row, width - 1 - at)
        own = (is_point & ~short)[row]  # such a row finds itself too
        keep = (f1 - f0 > own) & (b1 - b0 > own)
        row, at = row[keep], at[keep]
        query, value = tree.report(f0[keep], f1[keep], b0[keep], b1[keep])
        row, at, point = row[query], at[query], backward.points[value]
        # the same letter just before would give the same word
        again = short[row] & (at > 0) & (letters[row, at - 1] == letters[point, at])
        keep = ~again & (row != point)
        yield row[keep], point[keep]


def _near(group: pa.Table) -> pa.Table:
    """The rows of one block -> for words with near ones how many, and the one of largest count (of equal ones the least)."""
    word, n = group["word"].to_pylist(), group["n"].to_numpy()
    side, width, role = (group[k].to_numpy() for k in ("side", "width", "role"))
    names = sorted(set(word))
    name = {w: k for k, w in enumerate(names)}
    ids = np.array([name[w] for w in word])
    count = np.zeros(len(names), np.int64)
    count[ids] = n
    by_count = np.lexsort((np.arange(len(names)), -count))  # the preferred ones first
    preferred = np.empty(len(names), np.int64)
    preferred[by_count] = np.arange(len(names))
    near, best = np.zeros(len(names), np.int64), np.full(len(names), len(names))
    for s, w in sorted(set(zip(side.tolist(), width.tolist()))):
        rows = np.flatnonzero((side == s) & (width == w))
        # in a grid a word comes as a point and as a query
        own, where = np.unique(ids[rows], return_inverse=True)
        bits = np.zeros(len(own), np.int64)
        np.bitwise_or.at(bits, where, role[rows])
        letters = np.zeros((len(own), w), np.uint8)
        short = np.zeros(len(own), bool)
        for k, i in enumerate(own.tolist()):
            raw = names[i].encode("latin-1")
            letters[k, : len(raw)] = np.frombuffer(raw, np.uint8)
            short[k] = len(raw) < w
        half = w // 2
        for row, point in _pairs(letters, short, (bits & 1 > 0) & ~short, bits & 2 > 0, *((half, w - 1) if s else (0, half - 1))):
            x, y = own[row], own[point]
            np.add.at(near, x, 1)
            np.minimum.at(best, x, preferred[y])
            x, y = x[short[row]], y[short[row]]
            np.add.at(near, y, 1)
            np.minimum.at(best, y, preferred[x])
    some = np.flatnonzero(near)
    top = by_count[best[some]]
    return pa.table({"word": pa.array([names[k] for k in some], pa.string()), "n_near": pa.array(near[some], pa.int64()), "best_n": pa.array(count[top], pa.int64()), "best": pa.array([names[k] for k in top], pa.string())})


def _dealt(words: DataFrame, block: int) -> DataFrame:
    """words (word, n) -> a row for each block that a word goes to: side, width, word, n, role (1 point, 2 query, 3 both) and block."""
    length, w = F.length("word"), F.col("word")

    def row(side: int, more: int) -> Column:
        width = length + more
        half = F.floor(width / 2).cast("int")
        key = F.substring(w, F.lit(1), half) if side else F.substring(w, half + 1 - more, length)
        return F.struct(F.lit(side).alias("side"), width.alias("width"), key.alias("half"), F.lit(2 if more else 3).alias("role"))

    rows = words.select("word", "n", F.explode(F.array(*(row(s, m) for s in (1, 0) for m in (0, 1)))).alias("x")).select("word", "n", "x.*")
    total = words.count()
    key = ["side", "width", "half"]
    # few rows: no more than one for each block's worth of them
    hot = rows.groupBy(*key).agg(F.count("*").alias("size")).filter(F.col("size") > block).withColumn("parts", F.ceil(F.col("size") / block))
    rows = rows.join(hot.select(*key, "parts"), key, "left")
    every = max(1, math.ceil(4 * total / block))
    own = F.pmod(F.xxhash64(*key), F.lit(every))
    cold = rows.filter("parts is null").select("side", "width", "word", "n", "role", F.struct(own.alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(-1).cast("long").alias("c")).alias("block"))
    # cell (i, j) of a grid holds the points dealt to i and the queries dealt to j
    grid = rows.filter("parts is not null").withColumn("i", F.pmod(F.xxhash64("word"), "parts")).withColumn("j", F.pmod(F.xxhash64("word", F.lit(1)), "parts"))
    lots = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    cells = F.concat(
        F.when(F.col("role") == 3, F.transform(lots, lambda j: F.struct(F.lit(1).alias("role"), F.col("i").alias("b"), j.alias("c")))).otherwise(F.array().cast("array<struct<role:int,b:bigint,c:bigint>>")),
        F.transform(lots, lambda i: F.struct(F.lit(2).alias("role"), i.alias("b"), F.col("j").alias("c"))))
    split = grid.select("side", "width", "half", "word", "n", F.explode(cells).alias("x")).select("side", "width", "word", "n", "x.role", F.struct(F.xxhash64(*key).alias("a"), "x.b", "x.c").alias("block"))
    return cold.unionByName(split)


def count_words(df: DataFrame) -> DataFrame:
    """df (doc_id, text) -> (word, n): the words of at least five letters that occur at least three times."""
    found = df.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_counter, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """words (word, n) -> (word, n_near, best_n, best) for the words that have near ones."""
    found = _dealt(words, block).groupBy("block").applyInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def spelling_variants(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each word of df (doc_id, text): form, root, n, n_near and form_n.

    Words are runs of letters of whole texts, A-Z lower-cased, one letter of some deleted as altered() says, of at least
    five letters and seen at least three times. The form is the near word of largest count, of equal ones the first in
    code-point order, if its count is at least twice the word's; the root is the last form from word to form. Counts at
    least double from a word to its form, so ways have no circles. Null and empty texts have no words; a null doc_id counts
    as an empty one; repeated rows count each; other columns aren't read; an empty table gives no rows. block: how many
    words that share a half are held against each other at once; results don't depend on it.
    """
    words = materialise(count_words(df), "words")
    near = near_words(words, block)
    good = F.col("best_n") >= 2 * F.col("n")
    all_words = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    all_words = materialise(all_words, "forms")
    # a step's root is the root of the root before: ways of 1, 2, 4, ... forms
    roots = all_words.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        roots = materialise(roots.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if roots.filter("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return all_words.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
