"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has t bins. In round i < t every shingle is hashed to one bin, in round t + i to bin i; a bin keeps the
least value of the first round that reaches it. So every bin fills, after about t log(t) / n rounds for n shingles, and
the share of equal bins of two sketches is concentrated around the similarity of their sets.

1. One row per document: size and 128-bit signature of its set, and one hash per band. Documents with equal sets form
   a class, whose least doc_id stands for it from here on: groups of exact copies, however large, end here.
2. Classes that share a band are candidates. In each bucket all are compared with its least member c only (a star, so
   no bucket makes pairs by the square), on the full sets, computed again from the texts. A comparison also gives what
   sets b apart from c, the symmetric difference.
3. The links so far give components. Two members of a star in one component need no more comparison, so those outside
   the star's largest component are a query set against all its members, in blocks: |u & v| = |c| - |c \\ u| - |c \\ v|
   + |(c ^ u) & (c ^ v)|, so the differences are all that it takes. A member of the query set returns one link for each
   other component that it is linked with. So the components are those of all candidate pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from .common import U, materialise, mix, own
from .shingles import members, shingle_set, shingle_sets

ROWS = 6
MISS = 1e-6
#: The blocks in which members of a star are held against all of it, and the parts that a star's rows are dealt to.
QUERIES, MEMBERS = 512, 1024
SALTS = 32


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """As many bands as leave a pair at the threshold without a common band in at most that share of the cases."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def fast_sketch(items: np.ndarray, t: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit items: t values, each a round (upper 16 bits) and a hash."""
    empty = U(2**64 - 1)
    out = np.full(t, empty)
    step = max(1, min(2 * t, 4096 // len(items)))
    i = 0
    while i < 2 * t and (out == empty).any():
        rounds = np.arange(i, min(i + step, 2 * t), dtype=U)[:, None]
        h = mix(items[None, :] + (rounds + U(1)) * U(0xC2B2AE3D27D4EB4F))
        bins = np.where(rounds < U(t), h % U(t), rounds % U(t)).astype(np.int64)
        value = (rounds << U(48)) | (mix(h) >> U(16))
        np.minimum.at(out, bins.ravel(), value.ravel())
        i += step
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    for column in sketch[: bands * rows].reshape(bands, rows).T:
        out = mix(out ^ column) * U(0xD6E8FEB86659FD93)
    return mix(out).view(np.int64)


def _sketcher(width: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                n, s1, s2, keys = [], [], [], []
                for items in shingle_sets(part.column(1).to_pylist(), width):
                    n.append(len(items))
                    if len(items):
                        s1.append(int(mix(items).sum(dtype=U).view(np.int64)))
                        s2.append(int(mix(items ^ U(0xA0761D6478BD642F)).sum(dtype=U).view(np.int64)))
                        keys.append(band_keys(fast_sketch(items, bands * rows), bands, rows))
                    else:
                        s1.append(None), s2.append(None), keys.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return run


def _star(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, b, text_a, text_b), in the order of a -> whether they are linked, both sizes, and the symmetric difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = object(), None
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                a = part.column(0).to_pylist()
                linked, n_a, n_b, apart = [], [], [], []
                for i in range(part.num_rows):
                    if a[i] != last:
                        last, x = a[i], shingle_set(part.column(2)[i].as_py(), width)
                    y = shingle_set(part.column(3)[i].as_py(), width)
                    common = members(y, x)
                    both = int(np.count_nonzero(common))
                    linked.append(100 * both >= percent * (len(x) + len(y) - both))
                    n_a.append(len(x)), n_b.append(len(y))
                    apart.append(np.concatenate([y[~common], x[~members(x, y)]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(linked, pa.bool_()), pa.array(n_a, pa.int32()), pa.array(n_b, pa.int32()), pa.array(apart, pa.list_(pa.int64()))], ["a", "b", "linked", "n_a", "n_b", "apart"])

    return run


class _Block:
    """Members of one star's block: queries and the members to hold them against."""

    def __init__(self, percent: int):
        self.percent = percent
        self.rows: tuple[list, list] = ([], [])

    def links(self) -> list[tuple[int, int]]:
        """For each query, a linked member of each other component."""
        queries, others = self.rows
        if not queries or not others:
            return []
        tokens = np.concatenate([r[4] for r in queries])
        owner = np.repeat(np.arange(len(queries)), [len(r[4]) for r in queries])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        size_q, apart_q = (np.array(x) for x in zip(*((r[2], len(r[4])) for r in queries)))
        label_q = np.array([r[1] for r in queries])
        out = []
        for start in range(0, len(others), 512):
            some = others[start : start + 512]
            theirs = np.concatenate([r[4] for r in some])
            who = np.repeat(np.arange(len(some)), [len(r[4]) for r in some])
            lo, hi = np.searchsorted(tokens, theirs, "left"), np.searchsorted(tokens, theirs, "right")
            shared = np.zeros(len(queries) * len(some), np.int64)
            for k in range(0, len(theirs), 4096):  # the places of equal tokens, a bounded number at once
                n = hi[k : k + 4096] - lo[k : k + 4096]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[k : k + 4096], n)
                shared += np.bincount(owner[at] * len(some) + np.repeat(who[k : k + 4096], n), minlength=len(shared))
            shared = shared.reshape(len(queries), len(some))
            centre = some[0][3]
            size_o, apart_o = (np.array(x) for x in zip(*((r[2], len(r[4])) for r in some)))
            missing_q, missing_o = (apart_q + centre - size_q) // 2, (apart_o + centre - size_o) // 2
            both = centre - missing_q[:, None] - missing_o[None, :] + shared
            label_o = np.array([r[1] for r in some])
            hit = (100 * both >= self.percent * (size_q[:, None] + size_o[None, :] - both)) & (label_q[:, None] != label_o[None, :])
            i, j = np.nonzero(hit)
            _, first = np.unique(np.stack([i, label_o[j]]), axis=1, return_index=True)
            out += [(queries[i[k]][0], some[j[k]][0]) for k in first.tolist()]
        return out


def _held(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, i, j, query, b, label, n_a, n_b, apart), in the order of the first three -> links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, _Block(percent)
        found: list[tuple[int, int]] = []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            query, b, label, n_a, n_b = (batch.column(k).to_pylist() for k in range(3, 8))
            apart = batch.column(8)
            for k, key in enumerate(keys):
                if key != now:
                    found += block.links()
                    now, block = key, _Block(percent)
                block.rows[0 if query[k] else 1].append((b[k], label[k], n_b[k], n_a[k], apart[k].values.to_numpy() if len(apart[k]) else np.empty(0, np.int64)))
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        found += block.links()
        yield _pairs(found)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """df (doc_id, text) -> doc_id, n_shingles, component_id, kept: one row for each of df's.

    Documents are linked where 100 * intersection >= percent * union of their sets of word shingles; component_id is
    the least doc_id that a document reaches. Null, empty and blank texts have no shingles and are linked with nothing.
    Rows that share a doc_id are one document to the links. Rows without a doc_id are linked with nothing; their
    component_id is null and they are kept. An empty df gives no rows; other columns aren't read.
    """
    bands = bands_for(percent)
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(texts.mapInArrow(_sketcher(width, bands, ROWS), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "sketches")
    has = F.col("s1").isNotNull() & F.col("doc_id").isNotNull()
    # a table, so that both sides of the join below are exchanged for it, and a large class can be split
    classes = materialise(rows.filter(has).groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "sets")
    sets = rows.filter(has).join(classes, ["s1", "s2"]).select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands"))
    docs = materialise(sets.unionByName(rows.filter(~has).select("doc_id", "n_shingles", F.col("doc_id").alias("rep"), F.lit(None).cast("array<long>").alias("bands"))), "classes")

    keys = docs.filter("bands is not null").select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("key", "low")
    buckets = materialise(keys.join(shared, "key"), "buckets")
    held = texts.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    labels = _link(buckets, materialise(held, "texts"), width, percent)
    least = F.coalesce(F.col("label"), F.col("rep"))
    out = docs.select("doc_id", "n_shingles", "rep").join(labels, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", least.alias("component_id"), F.col("doc_id").eqNullSafe(least).alias("kept"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the components of links (a, b), each round a table in the shared folder."""
    return connected(links, lambda df: materialise(df, "edges"))


def _link(buckets: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, label) of the components of all pairs in a bucket (key, rep, low) that the full sets link."""
    edges = buckets.filter("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    text_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    text_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = edges.join(text_b, "b").join(text_a, "a").select("a", "b", "text_a", "text_b")
    stars = materialise(both.mapInArrow(_star(width, percent), "a long, b long, linked boolean, n_a int, n_b int, apart array<long>"), "stars")
    links = stars.filter("linked").select("a", "b")
    labels = components(links)

    # stars with members of several components: those outside the largest one are held against all of the star. Rows of a
    # star are dealt by a salt too, so that none is one task
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    named = stars.join(labels, F.col("b") == F.col("node"), "left").select("a", "b", "n_a", "n_b", "apart", F.coalesce("label", "b").alias("label"), salt.alias("salt"))
    parts = named.groupBy("a", "label").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("a").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.max("n").alias("n_in"), F.sum("n").alias("n")).filter("n_in < n")
    sizes = sizes.select("a", "largest", F.ceil((F.col("n") - F.col("n_in")) / QUERIES).cast("int").alias("of_q"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("of_m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = named.join(sizes, ["a", "salt"])
    cut = F.xxhash64("b")
    every = F.sequence(F.lit(0), F.col("of_m") - 1)
    queries = rows.filter("label <> largest").select("a", F.pmod(cut, F.col("of_q")).cast("int").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("query"), "b", "label", "n_a", "n_b", "apart")
    against = rows.select("a", F.explode(F.sequence(F.lit(0), F.col("of_q") - 1)).alias("i"), F.pmod(cut, F.col("of_m")).cast("int").alias("j"), F.lit(False).alias("query"), "b", "label", "n_a", "n_b", "apart")
    blocks = queries.unionByName(against).repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")
    more = materialise(blocks.mapInArrow(_held(percent), "a long, b long"), "links")
    return labels if more.isEmpty() else components(links.unionByName(more))


def keep_one_of_each(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df whose document is the least of its component, with df's columns; repeated doc_ids give one row.

    Of rows with one doc_id that with the least hash of its text stays (then of all its columns), so reruns agree. Rows
    without a doc_id stay.
    """
    kept, hashed, row = own(df, "_kept", "_hash", "_row")
    names = near_duplicates(df, width, percent).filter("kept and doc_id is not null").select(F.col("doc_id").alias(kept)).distinct()
    columns = [F.col(f"`{c}`") for c in df.columns]
    some = df.filter("doc_id is not null").join(names, F.col("doc_id") == F.col(kept), "left_semi")
    some = some.select(F.struct(*columns).alias(row), F.struct(F.xxhash64("text"), F.xxhash64(*columns)).alias(hashed))
    one = some.groupBy(F.col(f"{row}.doc_id")).agg(F.min_by(row, hashed).alias(row))
    return one.select(*(F.col(f"{row}.`{c}`").alias(c) for c in df.columns)).unionByName(df.filter("doc_id is null"))
