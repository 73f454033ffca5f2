"""Interval algebra by a sweep, and sets of intervals.

Any number of inputs become +1 and -1 at their bounds; a running sum per input gives the pieces of constant cover. Sums run
per tile of positions, with the totals of the tiles before as one row a tile. All operations on cover (what is in some, in
all, in one but not the other) are filters of these pieces. Intervals are half-open (chrom, start, end); empty ones count
for nothing, repeated rows count each, and touching ones have no gap between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import TILE, neighbours, overlaps, points_in


def cover(inputs: list[DataFrame], tile: int = TILE) -> DataFrame:
    """(chrom, start, end, n_0, n_1, ...): pieces between neighbouring bounds, and how many intervals of each input hold each. Pieces in none are left out."""
    names = [f"n_{k}" for k in range(len(inputs))]
    events = None
    for k, df in enumerate(inputs):
        ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))
        rows = df.filter("end > start").select("chrom", F.inline(ends)).select("chrom", "pos", *(F.col("d").alias(n) if j == k else F.lit(0).alias(n) for j, n in enumerate(names)))
        events = rows if events is None else events.unionByName(rows)
    at = events.groupBy("chrom", "pos").agg(*(F.sum(n).alias(n) for n in names)).withColumn("_tile", F.floor(F.col("pos") / tile))
    before = Window.partitionBy("chrom").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = at.groupBy("chrom", "_tile").agg(*(F.sum(n).alias(f"_t{n}") for n in names)).select("chrom", "_tile", *(F.coalesce(F.sum(f"_t{n}").over(before), F.lit(0)).alias(f"_c{n}") for n in names))
    inside = Window.partitionBy("chrom", "_tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = at.join(carry, ["chrom", "_tile"]).select("chrom", "pos", *((F.sum(n).over(inside) + F.col(f"_c{n}")).alias(n) for n in names))
    pieces = neighbours(sums, F.col("pos"), ["pos"], tile=tile).select("chrom", F.col("pos").alias("start"), F.col("_after").alias("end"), *names)
    held = F.lit(False)
    for n in names:
        held = held | (F.col(n) > 0)
    return pieces.filter(F.col("end").isNotNull() & held)


def joined(pieces: DataFrame, tile: int = TILE) -> DataFrame:
    """(chrom, start, end) of pieces that don't overlap, those that touch as one."""
    near = neighbours(pieces.select("chrom", "start", "end"), F.col("end"), ["start"], tile=tile).drop("_after")
    heads = near.withColumn("_head", F.col("_before").isNull() | (F.col("_before") < F.col("start"))).drop("_before")
    after = neighbours(heads, F.col("start"), ["start"], tile=tile).drop("_before")
    # a run ends where the next piece begins a new one: heads and last pieces come in turn
    bounds = after.select("chrom", "start", F.when(F.col("_head"), F.col("start")).alias("first"), F.when(F.col("_after").isNull() | (F.col("_after") > F.col("end")), F.col("end")).alias("last")).filter("first is not null or last is not null")
    runs = neighbours(bounds, F.col("last"), ["start"], tile=tile)
    return runs.filter("first is not null").select("chrom", F.col("first").alias("start"), F.coalesce("last", "_after").alias("end"))


def union(*inputs: DataFrame) -> DataFrame:
    """What some input covers."""
    return joined(cover(list(inputs)))


def intersection(*inputs: DataFrame) -> DataFrame:
    """What all inputs cover."""
    held = F.lit(True)
    for k in range(len(inputs)):
        held = held & (F.col(f"n_{k}") > 0)
    return joined(cover(list(inputs)).filter(held))


def difference(a: DataFrame, *others: DataFrame) -> DataFrame:
    """What a covers and no other does."""
    held = F.col("n_0") > 0
    for k in range(len(others)):
        held = held & (F.col(f"n_{k + 1}") == 0)
    return joined(cover([a, *others]).filter(held))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """What just one of two covers."""
    return joined(cover([a, b]).filter((F.col("n_0") > 0) != (F.col("n_1") > 0)))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """The intervals, as rows with all their columns, that are in both; once each."""
    return a.intersect(b.select(*a.columns))


def only(a: DataFrame, b: DataFrame) -> DataFrame:
    """The intervals that are in a and not in b; once each."""
    return a.subtract(b.select(*a.columns))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """The intervals that are in one of both; once each."""
    return only(a, b).unionByName(only(b, a))


def enveloped(intervals: DataFrame, ranges: DataFrame, bin_: int = 128) -> DataFrame:
    """Pairs of a range and an interval that lies in it whole; the range's columns get the suffix _b."""
    return overlaps(intervals, ranges, bin_).filter((F.col("start") >= F.col("start_b")) & (F.col("end") <= F.col("end_b")))


def without(intervals: DataFrame, ranges: DataFrame, whole: bool = False, bin_: int = 128) -> DataFrame:
    """Intervals (once each) that overlap no range, or (whole) lie in none."""
    hit = (enveloped if whole else overlaps)(intervals, ranges, bin_)
    return only(intervals, hit.select(*intervals.columns))


def nested(intervals: DataFrame, bin_: int = 128) -> DataFrame:
    """Distinct (chrom, start, end, start_b, end_b): the second interval lies in the first and isn't equal to it."""
    v = intervals.select("chrom", "start", "end").distinct()
    inside = (F.col("start_b") >= F.col("start")) & (F.col("end_b") <= F.col("end"))
    return overlaps(v, v, bin_).filter(inside & ((F.col("start") != F.col("start_b")) | (F.col("end") != F.col("end_b")))).select("chrom", "start", "end", "start_b", "end_b")


def sliced(intervals: DataFrame, points: DataFrame, bin_: int = 128) -> DataFrame:
    """Intervals cut at the points (chrom, pos) within them, with all their columns; points at their bounds don't cut. Repeated rows are cut each."""
    within = intervals.select("chrom", (F.col("start") + 1).alias("_s"), F.col("end").alias("_e"), F.col("start").alias("_start"), F.col("end").alias("_end")).distinct()
    cuts = points_in(points.select("chrom", "pos").distinct(), within, "pos", bin_, "inner", "_s", "_e").select("_start", "_end", F.col("chrom").alias("_chrom"), "pos")
    key = [F.col("chrom") == F.col("_chrom"), F.col("start") == F.col("_start"), F.col("end") == F.col("_end")]
    lists = cuts.groupBy("_chrom", "_start", "_end").agg(F.sort_array(F.collect_list("pos")).alias("_cuts"))  # the points within one interval
    bounds = F.concat(F.array("start"), F.coalesce("_cuts", F.array().cast("array<bigint>")), F.array("end"))
    pieces = F.transform(F.sequence(F.lit(0), F.size("_b") - 2), lambda k: F.struct(F.get(F.col("_b"), k).alias("_s"), F.get(F.col("_b"), k + 1).alias("_e")))
    out = intervals.join(lists, key, "left").withColumn("_b", bounds).withColumn("_p", F.explode(pieces))
    return out.select(*(F.col("_p._s").alias("start") if c == "start" else F.col("_p._e").alias("end") if c == "end" else F.col(c) for c in intervals.columns))


def extent(intervals: DataFrame) -> DataFrame:
    """(chrom, start, end, span): from the first bound of a contig's intervals to the last."""
    out = intervals.filter("end > start").groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return out.withColumn("span", F.col("end") - F.col("start"))


def merged_with(intervals: DataFrame, reducer, column: str, touching: bool = True) -> DataFrame:
    """The union of intervals with an aggregate of a column over those of each part: (chrom, start, end, column). reducer makes an aggregate of a column."""
    from .intervals import merge

    whole = merge(intervals.select("chrom", "start", "end"), touching).drop("n").withColumnsRenamed({"start": "_s", "end": "_e"})
    held = points_in(intervals.filter("end > start").select("chrom", "start", F.col(column).alias("_v")), whole, "start", 128, "inner", "_s", "_e")
    return held.groupBy("chrom", F.col("_s").alias("start"), F.col("_e").alias("end")).agg(reducer(F.col("_v")).alias(column))


def relation(start: Column, end: Column, start_b: Column, end_b: Column) -> Column:
    """How two intervals lie: equal, contains, within, overlaps, touches or apart."""
    return (F.when((start == start_b) & (end == end_b), "equal").when((start <= start_b) & (end >= end_b), "contains").when((start >= start_b) & (end <= end_b), "within")
            .when((start < end_b) & (start_b < end), "overlaps").when((start == end_b) | (start_b == end), "touches").otherwise("apart"))
