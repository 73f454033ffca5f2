"""Passages that repeat anywhere in the corpus, found by refining buckets, and removed.

A byte goes where a string of K bytes that covers it also starts elsewhere. Bucket-pointer refinement sorts all suffixes
by buckets: by their first q bytes to begin with, then each bucket by the bucket identifiers at later offsets, over and
over; every_suffix() does that. It exchanges many times the corpus, so repeated_starts() has anchors in the buckets. Each string of
K bytes has one anchor in it, the rightmost of the least hashes of q-grams that fit; equal strings have theirs at the
same place, and one byte in about (K - q) / 2 is an anchor.

- The first buckets are the anchors' q-grams. An anchor alone in its bucket has no repeat, and is done.
- In a bucket, anchors are told apart by the identifier of all bytes that strings with this anchor can reach. Where it
  is shared, every string of the anchor repeats.
- The others are refined: by ranges of string starts, each with the identifier of the bytes that all its strings share
  (alone: none repeats) and that of all their bytes (shared: all repeat); what neither decides is refined to single
  starts. Identifiers of each level sort only the buckets that the level before left open.

Identifiers are 64-bit hashes of strings; two anchors meet on the pair of the q-gram's and the longer string's.
Every level is one exchange by identifier, with counts summed up within tasks before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, discard, materialise, mix, mix_in_place

K = 200
Q = 100
REACH = K - Q
STEP = 13
CHUNK = 1 << 19
#: The q-grams of the first buckets where every suffix is sorted.
GRAM = 25
_ODD = 0x9E3779B97F4A7C15
_PLACE = (1 << 20) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


class Strings:
    """Hashes of the substrings of some bytes; those of equal strings are equal."""

    def __init__(self, data: np.ndarray):
        if not _POWERS:
            _POWERS.extend((_powers(_ODD, CHUNK + 4 * K), _powers(pow(_ODD, -1, 2**64), CHUNK + 4 * K)))
        self.n = len(data)
        self.sums = np.zeros(self.n + 1, U)
        terms = data.astype(U)
        terms += U(1)
        terms *= _POWERS[0][: self.n]
        np.cumsum(terms, out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _POWERS[1][start]

    def ids(self, start: np.ndarray, end: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
        """Identifiers of the substrings, told apart by length and a further number too."""
        salt = (end - start).astype(U) * U(0xC2B2AE3D27D4EB4F) + np.asarray(more).astype(U) * U(0x165667B19E3779F9)
        return mix(self.raw(start, end) ^ mix(salt + U(1)))

    def all_of(self, n: int) -> np.ndarray:
        """The identifiers of all substrings of a length."""
        out = self.sums[n:] - self.sums[:-n]
        out *= _POWERS[1][: len(out)]
        return mix_in_place(out, np.empty_like(out))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(q-gram's identifier, context's identifier, place, least and greatest offset of the strings that have this anchor)."""
    out: list[tuple[np.ndarray, ...]] = []
    total = len(data)
    for base in range(0, max(0, total - K + 1), CHUNK):
        starts = min(CHUNK, total - K + 1 - base)
        before = min(base, REACH)  # bytes kept before the chunk, for contexts
        piece = data[base - before : min(total, base + starts + 2 * K - 1)]
        s = Strings(piece)
        h = s.all_of(Q)
        keys = (h & ~U(_PLACE)) | (U(_PLACE) - np.arange(len(h), dtype=U))
        least = _sliding_min(keys[before : before + starts + REACH], REACH + 1)
        at = (U(_PLACE) - (least & U(_PLACE))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [starts]]) - 1
        p = at[first]
        a, b = np.maximum(p - REACH, 0), np.minimum(p + K, len(piece))
        context = s.ids(a, b, p - a)
        out.append((h[p], context, p + (base - before), p - before - last, p - before - first))
    if not out:
        return ()
    core, context, p, j0, j1 = (np.concatenate(x) for x in zip(*out))
    # strings on both sides of a cut may have one anchor: one row for it
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return core[first], context[first], p[first], np.minimum.reduceat(j0, first), np.maximum.reduceat(j1, first)


def _bytes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer((value.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text) -> anchors."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            found, which = [], []
            for i, value in enumerate(part.column(2)):
                x = anchors(_bytes(value))
                if x:
                    found.append(x)
                    which.append(np.full(len(x[0]), i))
            if not found:
                continue
            core, context, p, j0, j1 = (np.concatenate(x) for x in zip(*found))
            i = pa.array(np.concatenate(which))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(i), part.column(1).take(i), pa.array(core.view(np.int64)), pa.array(context.view(np.int64)), pa.array(p.astype(np.int32)), pa.array(j0.astype(np.int16)), pa.array(j1.astype(np.int16))],
                ["doc_id", "th", "core", "context", "p", "j0", "j1"])


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their open anchors -> one row per anchor, with the bytes around it."""
    names = ["doc_id", "th", "core", "p", "j0", "j1", "known", "lead", "around"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.bool_(), pa.int16(), pa.binary())
    cols: list[list] = [[] for _ in names]

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        for c in cols:
            c.clear()
        return out

    for batch in batches:
        for doc, th, text, open_ in zip(*(batch.column(k) for k in range(4))):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for core, p, j0, j1, known in zip(*(open_.values.field(k).to_pylist() for k in range(5))):
                a = max(0, p - REACH)
                for c, v in zip(cols, (doc.as_py(), th.as_py(), core, p, j0, j1, known, p - a, data[a : p + K])):
                    c.append(v)
                if len(cols[0]) >= 10_000:
                    yield rows()
        yield rows()


def _refiner(single: bool):
    """Rows of _context_rows (j0 and j1: the offsets still open) -> ranges of offsets a..b with two identifiers.

    inner: of the bytes that all strings of the range share; outer: of all their bytes. Ranges lie on a grid of STEP
    offsets, or are single ones, so that those of equal strings are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                part = batch.slice(start, 20_000)
                n = part.num_rows
                if not n:
                    continue
                lead = part.column(7).to_numpy().astype(np.int64)
                pieces = part.column(8).to_pylist()
                sizes = np.array([len(x) for x in pieces])
                j0, j1 = (part.column(k).to_numpy().astype(np.int64) for k in (4, 5))
                step = 1 if single else STEP
                first, count = j0 // step, j1 // step - j0 // step + 1
                row = np.repeat(np.arange(n), count)
                cell = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]
                lo, hi = cell * step, np.minimum(cell * step + step - 1, REACH)
                # pieces one after the other, in chunks that the powers reach
                ends = np.cumsum(sizes)
                inner, outer = np.empty(len(row), U), np.empty(len(row), U)
                at = 0
                while at < n:
                    base = ends[at] - sizes[at]
                    till = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
                    s = Strings(np.frombuffer(b"".join(pieces[at:till]), np.uint8))
                    mine = slice(*np.searchsorted(row, [at, till]))
                    r = row[mine]
                    origin, size = ends[r] - sizes[r] - base, sizes[r]
                    a, b = lead[r] - hi[mine], lead[r] - lo[mine]  # least and greatest start in the piece
                    inner[mine] = s.ids(origin + np.minimum(np.maximum(b, 0), size), origin + np.minimum(np.maximum(a + K, b), size), cell[mine])
                    oa, ob = np.maximum(a, 0), np.minimum(b + K, size)
                    outer[mine] = s.ids(origin + oa, origin + ob, lead[r] - oa)
                    at = till
                # offsets whose string is in the document, and still open
                a = np.maximum(np.maximum(lo, j0[row]), lead[row] + K - sizes[row])
                b = np.minimum(np.minimum(hi, j1[row]), lead[row])
                ok = a <= b
                i = pa.array(row[ok])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(i) for k in (0, 1, 2, 3, 6)), pa.array(a[ok].astype(np.int16)), pa.array(b[ok].astype(np.int16)), pa.array(inner[ok].view(np.int64)), pa.array(outer[ok].view(np.int64))],
                    ["doc_id", "th", "core", "p", "known", "a", "b", "inner", "outer"])

    return run


def _refined(around: DataFrame, single: bool) -> DataFrame:
    schema = "doc_id long, th long, core long, p int, known boolean, a short, b short, inner long, outer long"
    return around.mapInArrow(_refiner(single), schema)


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text, m) -> the q-gram at every place of a text."""
    for batch in batches:
        for doc, th, text, m in zip(*(batch.column(k).to_pylist() for k in range(4))):
            data = _bytes(pa.scalar(text))
            for base in range(0, len(data) - GRAM + 1, CHUNK):
                ids = Strings(data[base : base + CHUNK + GRAM - 1]).all_of(GRAM).view(np.int64)
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array(np.full(n, th)), pa.array(np.arange(base, base + n)), pa.array(ids), pa.array(np.full(n, m))], ["doc_id", "th", "p", "bucket", "m"])


def every_suffix(docs: DataFrame) -> DataFrame:
    """repeated_starts() by plain bucket-pointer refinement over all suffixes.

    The first buckets are the q-grams at every place. A suffix alone in its bucket is done. The others are sorted on the
    bucket identifier at the offset of the depth reached, so that the depth doubles: identifiers of one round are the
    pointers of the next, and a suffix that points to one that is done is done. At K bytes, those left repeat. It moves
    some fifty bytes for each byte of text, which the check tool's limit on disk doesn't allow.
    """
    one = docs.groupBy("doc_id", "th").agg(F.first("text").alias("text"), F.count("*").alias("m"))  # repeated rows count m times
    level, depth = one.mapInArrow(_gram_rows, "doc_id long, th long, p long, bucket long, m long"), GRAM
    while True:
        shared = level.groupBy("bucket").agg(F.sum("m").alias("n")).filter("n > 1").select("bucket")
        level = materialise(level.join(shared, "bucket"), "suffixes")
        if depth >= K:
            return level.groupBy("doc_id", "th").agg(F.collect_list(F.struct(F.col("p").cast("int").alias("a"), F.col("p").cast("int").alias("b"))).alias("ranges"))
        step = min(depth, K - depth)
        after = level.select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), (F.col("p") - step).alias("_p"), F.col("bucket").alias("next"))
        same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h")) & (F.col("p") == F.col("_p"))
        level, depth = level.join(after, same).select("doc_id", "th", "p", F.xxhash64("bucket", "next").alias("bucket"), "m"), depth + step


_RANGE = "array<struct<a:int,b:int>>"


def _by_document(starts: DataFrame) -> DataFrame:
    """Ranges (doc_id, th, a, b), each once, as a table of (doc_id, th, ranges); a document bounds how many it has."""
    return materialise(starts.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).cast(_RANGE).alias("ranges")), "ranges")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, th, text) -> (doc_id, th, ranges): the starts of strings of K bytes that start elsewhere too, as ranges (a, b)."""
    schema = "doc_id long, th long, core long, context long, p int, j0 short, j1 short"
    every = docs.mapInArrow(_anchor_rows, schema)
    # a table, so that both sides of the join are exchanged for it, and a hot q-gram can be split
    shared = materialise(every.select("core").groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "shared")
    found = materialise(every.join(shared, "core"), "anchors")
    classes = found.groupBy("core", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "p", "j0", "j1")).alias("one"))
    classes = materialise(classes, "contexts")
    repeated = found.join(classes.filter("n > 1").select("core", "context"), ["core", "context"])
    ranges = [_by_document(repeated.select("doc_id", "th", (F.col("p") - F.col("j1")).alias("a"), (F.col("p") - F.col("j0")).alias("b")))]

    # one anchor of each context, where a bucket has several contexts
    mixed = classes.groupBy("core").agg(F.count("*").alias("k"), F.min("n").alias("least")).filter("k > 1 and least = 1").select("core")
    open_ = classes.join(mixed, "core").select("core", (F.col("n") > 1).alias("known"), "one.*")
    by_doc = open_.groupBy("doc_id", "th").agg(F.collect_list(F.struct("core", "p", "j0", "j1", "known")).alias("open"))
    texts = docs.withColumnsRenamed({"doc_id": "_d", "th": "_h"})
    joined = by_doc.join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h"))).select("doc_id", "th", "text", "open").dropDuplicates(["doc_id", "th"])
    around = materialise(joined.mapInArrow(_context_rows, "doc_id long, th long, core long, p int, j0 short, j1 short, known boolean, lead short, around binary"), "around")
    discard(shared, found, classes)
    first = around

    for single in (False, True):
        rows = _refined(around, single)
        classes = rows.groupBy("core", "inner", "outer").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "p", "a", "b", "known")).alias("one"))
        classes = materialise(classes, "classes")
        repeated = rows.filter(~F.col("known")).join(classes.filter("n > 1").select("core", "inner", "outer"), ["core", "inner", "outer"])
        ranges.append(_by_document(repeated.select("doc_id", "th", (F.col("p") - F.col("b")).alias("a"), (F.col("p") - F.col("a")).alias("b"))))
        if single:
            discard(classes, first)
            break
        # one range of each outer string, where an inner one has several and one of them is open
        mixed = classes.groupBy("core", "inner").agg(F.count("*").alias("k"), F.max((F.col("n") == 1) & ~F.col("one.known")).alias("open")).filter("k > 1 and open").select("core", "inner")
        left = classes.join(mixed, ["core", "inner"]).select(
            F.col("one.doc_id").alias("_d"), F.col("one.th").alias("_h"), F.col("one.p").alias("_p"), F.col("one.a").alias("_a"), F.col("one.b").alias("_b"), ((F.col("n") > 1) | F.col("one.known")).alias("_known"))
        around = around.join(left, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h")) & (F.col("p") == F.col("_p"))).select(
            "doc_id", "th", "core", "p", F.col("_a").alias("j0"), F.col("_b").alias("j1"), F.col("_known").alias("known"), "lead", "around")
    starts = ranges[0]
    for more in ranges[1:]:
        starts = starts.unionByName(more)
    return starts.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _runs(ranges: list[dict] | None) -> list[list[int]]:
    """The maximal runs of bytes that strings of K bytes at the starts of the ranges cover."""
    runs: list[list[int]] = []
    for x in sorted(ranges or (), key=lambda x: x["a"]):
        if runs and x["a"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], x["b"] + K)
        else:
            runs.append([x["a"], x["b"] + K])
    return runs


def _final_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ranges) -> doc_id, n_bytes, removed, kept; some MB of text at once."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        cols: list[list] = [[] for _ in range(4)]
        held = 0
        for k in range(batch.num_rows):
            data = (batch.column(1)[k].as_py() or "").encode("utf-8", "surrogatepass")
            runs, out, at = _runs(batch.column(2)[k].as_py()), [], 0
            for a, b in runs:
                out.append(data[at:a])
                at = b
            for c, v in zip(cols, (batch.column(0)[k].as_py(), len(data), [{"start": a, "end": b} for a, b in runs], b"".join([*out, data[at:]]))):
                c.append(v)
            held += len(data)
            if held > 4 << 20 or k == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), span, pa.binary()))], ["doc_id", "n_bytes", "removed", "kept"])
                cols, held = [[] for _ in range(4)], 0


def remove_repeats(df: DataFrame, starts: Callable[[DataFrame], DataFrame] = repeated_starts) -> DataFrame:
    """One row per row of df (doc_id, text): its bytes, the runs removed (start, end), and the bytes that are left.

    Null texts count as empty. Repeated rows are occurrences of their own, so their strings repeat. Texts under K bytes
    lose nothing. What is left may cut a character. Other columns aren't read; an empty df gives no rows.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    ranges = starts(docs).withColumnsRenamed({"doc_id": "_d", "th": "_h"})
    out = docs.join(ranges, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h")), "left").select("doc_id", "text", "ranges")
    return out.mapInArrow(_final_rows, "doc_id long, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary")
