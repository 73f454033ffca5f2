"""Joins and algebra of half-open intervals (chrom, start, end).

Intervals are cut into bins, so that a join with points or intervals is an equi-join on (chrom, level, bin) with the
exact test left over: a hash or sort-merge join that AQE can split, never a nested loop. Long intervals go to a level
with wider bins, so that none of up to bin_ * SPREAD ** LEVELS makes more than SPREAD + 1 rows. Points are looked up in the
levels that occur, which a pass over the intervals tells (LEVELS numbers at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPREAD = 8
LEVELS = 8
TILE = 1 << 16


def _level(n: Column, bin_: int) -> Column:
    out = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        out = F.when(n <= SPREAD * bin_ * SPREAD**k, F.lit(k)).otherwise(out)
    return out


def _level_of(n: int, bin_: int) -> int:
    """The level of intervals of that length."""
    return next((k for k in range(LEVELS - 1) if n <= SPREAD * bin_ * SPREAD**k), LEVELS - 1)


def _width(bin_: int, level: Column) -> Column:
    return F.element_at(F.array(*(F.lit(bin_ * SPREAD**k).cast("long") for k in range(LEVELS))), level + 1)


def _levels_of(intervals: DataFrame, bin_: int, start: str, end: str) -> list[int]:
    n = F.col(end) - F.col(start)
    return sorted(r[0] for r in intervals.filter(n > 0).select(_level(n, bin_).alias("l")).distinct().collect())


def _cell(x: Column, width: Column | int) -> Column:
    return F.floor(x / width)


def points_in(points: DataFrame, intervals: DataFrame, pos: str = "pos", bin_: int = 128, how: str = "inner", start: str = "start", end: str = "end", longest: int | None = None) -> DataFrame:
    """points (chrom, pos, ...) with the intervals (chrom, start, end, ...) that hold them, start <= pos < end.

    how: inner, left, left_semi or left_anti. The interval's chrom is dropped. longest: a bound on the intervals' lengths
    where it is known; else a pass over them tells which levels there are.
    """
    levels = [_level_of(longest, bin_)] if longest is not None and longest <= SPREAD * bin_ else _levels_of(intervals, bin_, start, end) if longest is None else [*range(_level_of(longest, bin_) + 1)]
    n = F.col(end) - F.col(start)
    if how == "inner" or len(levels) <= 1:
        cut = intervals.withColumnRenamed("chrom", "_chrom").filter(n > 0).withColumn("_level", _level(n, bin_)).withColumn("_w", _width(bin_, F.col("_level")))
        cut = cut.withColumn("_bin", F.explode(F.sequence(_cell(F.col(start), F.col("_w")), _cell(F.col(end) - 1, F.col("_w"))))).drop("_w")
        hit = (F.col("chrom") == F.col("_chrom")) & (F.col("_pl") == F.col("_level")) & (F.col("_pb") == F.col("_bin")) & (F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))
        if len(levels) <= 1:  # a point has one row, so any kind of join tells at once
            k = levels[0] if levels else 0
            return points.withColumns({"_pl": F.lit(k), "_pb": _cell(F.col(pos), bin_ * SPREAD**k)}).join(cut, hit, how).drop("_pl", "_pb", "_chrom", "_level", "_bin")
        keys = F.array(*(F.struct(F.lit(k).alias("_pl"), _cell(F.col(pos), bin_ * SPREAD**k).alias("_pb")) for k in levels))
        return points.select("*", F.inline(keys)).join(cut, hit).drop("_pl", "_pb", "_chrom", "_level", "_bin")
    found = points_in(points.select("chrom", pos).distinct(), intervals, pos, bin_, "inner", start, end, longest).withColumnsRenamed({"chrom": "_c", pos: "_p"})
    same = (F.col("chrom") == F.col("_c")) & (F.col(pos) == F.col("_p"))
    if how == "left":
        return points.join(found, same, "left").drop("_c", "_p")
    return points.join(found.select("_c", "_p").distinct(), same, how)


def overlaps(a: DataFrame, b: DataFrame, bin_: int = 128) -> DataFrame:
    """Pairs of rows whose intervals overlap, each pair once (repeated rows repeatedly); b's columns get the suffix _b.

    A pair meets at the wider one's level, in the bin where the later one starts.
    """
    levels = sorted({*_levels_of(a, bin_, "start", "end"), *_levels_of(b, bin_, "start", "end")}) or [0]

    def cut(df: DataFrame, start: str, end: str, x: str) -> DataFrame:
        """A row for each bin at the row's own level and those above it that occur."""
        n = F.col(end) - F.col(start)
        out = df.filter(n > 0).withColumn(f"_l{x}", _level(n, bin_))
        up = F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col(f"_l{x}"))
        out = out.withColumn(f"_at{x}", F.explode(up))
        w = _width(bin_, F.col(f"_at{x}"))
        return out.withColumn(f"_cell{x}", F.explode(F.sequence(_cell(F.col(start), w), _cell(F.col(end) - 1, w))))

    left = cut(a, "start", "end", "")
    right = cut(b.select(*(F.col(c).alias(f"{c}_b") for c in b.columns)), "start_b", "end_b", "_b")
    meet = (F.col("chrom") == F.col("chrom_b")) & (F.col("_at") == F.col("_at_b")) & (F.col("_cell") == F.col("_cell_b")) & (F.col("_at") == F.greatest("_l", "_l_b"))
    later = F.col("_cell") == _cell(F.greatest("start", "start_b"), _width(bin_, F.col("_at")))
    out = left.join(right, meet & later & (F.col("start") < F.col("end_b")) & (F.col("start_b") < F.col("end")))
    return out.select(*a.columns, *(f"{c}_b" for c in b.columns))


def _met_width(longest: int) -> int:
    return max(128, 1 << (longest - 1).bit_length())


def met_levels(rows: DataFrame, longest: int) -> list[int]:
    """The levels of the rows' lengths, as met() deals them: a pass over start and end."""
    return sorted(r[0] for r in rows.filter("end > start").select(_level(F.col("end") - F.col("start"), _met_width(longest) / SPREAD).alias("l")).distinct().collect()) or [0]


def met(regions: DataFrame, rows: DataFrame, longest: int, levels: list[int] | None = None) -> DataFrame:
    """rows (chrom, start, end, ...) with the other columns of the regions they overlap, each pair once; start and end go.

    For many rows and few regions, of up to `longest` each: a row stays one row, in the bin of its start at the level of its
    length, and regions make a row for each bin in which a row that reaches them may start, three or so a level. levels:
    met_levels() of these rows or of more, where they are known.
    """
    width = _met_width(longest)
    levels = levels or met_levels(rows, longest)
    more = [c for c in regions.columns if c not in ("chrom", "start", "end")]

    def cells(k: int) -> Column:
        w = width * SPREAD**k
        first = _cell(F.col("start") - w, w)
        return F.transform(F.sequence(first, _cell(F.col("end") - 1, w)), lambda b: F.struct(F.lit(k).alias("_level"), b.alias("_bin")))

    if levels[-1] == LEVELS - 1:  # of any length: the usual join
        out = overlaps(regions, rows)
        return out.select(*more, *(F.col(f"{c}_b").alias(c) for c in rows.columns if c not in ("start", "end")))
    cut = regions.filter("end > start").select(F.col("chrom").alias("_chrom"), F.col("start").alias("_start"), F.col("end").alias("_end_"), *more, F.inline(F.concat(*map(cells, levels))))
    level = _level(F.col("end") - F.col("start"), width / SPREAD) if len(levels) > 1 else F.lit(levels[0])
    dealt = rows.filter("end > start").withColumns({"_l": level, "_b": _cell(F.col("start"), _width(width, level))})
    meet = (F.col("chrom") == F.col("_chrom")) & (F.col("_l") == F.col("_level")) & (F.col("_b") == F.col("_bin")) & (F.col("start") < F.col("_end_")) & (F.col("_start") < F.col("end"))
    return dealt.join(cut, meet).select(*more, *(c for c in rows.columns if c not in ("start", "end")))


def neighbours(df: DataFrame, value: Column, order: list[str], key: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """df with `_before` and `_after`: value of the row before and of the row after, by the key, in that order (its first column is a position).

    Windows run per tile of positions; the rows at its ends look at one row for each tile of the key.
    """
    key = key or ["chrom"]
    rows = df.withColumn("_v", value).withColumn("_tile", F.floor(F.col(order[0]) / tile))
    inside = Window.partitionBy(*key, "_tile").orderBy(*order)
    rows = rows.withColumn("_k", F.row_number().over(inside)).withColumn("_before", F.lag("_v").over(inside)).withColumn("_after", F.lead("_v").over(inside)).withColumn("_n", F.count("*").over(Window.partitionBy(*key, "_tile")))
    ends = rows.groupBy(*key, "_tile").agg(F.min_by("_v", "_k").alias("_first"), F.max_by("_v", "_k").alias("_last"))
    tiles = Window.partitionBy(*key).orderBy("_tile")
    ends = ends.select(*(F.col(c).alias(f"_key_{c}") for c in key), F.col("_tile").alias("_t"), F.lag("_last").over(tiles).alias("_left"), F.lead("_first").over(tiles).alias("_right"))
    same = F.col("_tile") == F.col("_t")
    for c in key:
        same = same & (F.col(c) == F.col(f"_key_{c}"))
    out = rows.join(ends, same)
    return out.select(*df.columns, F.when(F.col("_k") == 1, F.col("_left")).otherwise(F.col("_before")).alias("_before"), F.when(F.col("_k") == F.col("_n"), F.col("_right")).otherwise(F.col("_after")).alias("_after"))


def near(a: DataFrame, b: DataFrame, slack: int, how: str = "left_semi", bin_: int | None = None) -> DataFrame:
    """Rows of a with (or without) a site of b in [pos - slack, pos + slack); inner: with hit, the least such site."""
    sites = b.select("chrom", F.col("pos").alias("hit"), (F.col("pos") - slack + 1).alias("start"), (F.col("pos") + slack + 1).alias("end")).distinct()
    found = points_in(a.select("chrom", "pos").distinct(), sites, "pos", bin_ or max(1, 2 * slack), longest=2 * slack)
    least = found.groupBy(F.col("chrom").alias("_c"), F.col("pos").alias("_p")).agg(F.min("hit").alias("hit"))
    same = (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p"))
    if how in ("left_semi", "left_anti"):
        return a.join(least.drop("hit"), same, how)
    return a.join(least, same, how).drop("_c", "_p")


def merge(intervals: DataFrame, touching: bool = True, tile: int = TILE) -> DataFrame:
    """The union of intervals: (chrom, start, end, n), joined where they overlap (or touch).

    Windows run per tile of starts; how far the tiles before reach, and where their last union starts, is one row a tile.
    """
    rows = intervals.filter("end > start").select("chrom", "start", "end", F.floor(F.col("start") / tile).alias("_tile"))
    w = Window.partitionBy("chrom", "_tile").orderBy("start", "end")
    before = Window.partitionBy("chrom").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy("chrom", "_tile").agg(F.max("end").alias("_m")).withColumn("_reach", F.max("_m").over(before)).drop("_m")
    rows = rows.join(reach, ["chrom", "_tile"]).withColumn("_till", F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_reach"))
    gap = (F.col("start") > F.col("_till")) if touching else (F.col("start") >= F.col("_till"))
    rows = rows.withColumn("_new", F.when(F.col("_till").isNull() | gap, F.col("start")))
    lasts = rows.groupBy("chrom", "_tile").agg(F.max("_new").alias("_m")).withColumn("_carry", F.max("_m").over(before)).drop("_m")
    # intervals with one start belong to one union: the range frame takes all of them
    own = F.max("_new").over(Window.partitionBy("chrom", "_tile").orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_own", own).join(lasts, ["chrom", "_tile"]).withColumn("_union", F.coalesce("_own", "_carry"))
    return rows.groupBy("chrom", "_union").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_union")


def split(intervals: DataFrame, bin_: int = 128) -> DataFrame:
    """Every interval cut at the bounds of all others: distinct (chrom, start, end, n), n of how many."""
    rows = intervals.filter("end > start").select("chrom", "start", "end").withColumnsRenamed({"start": "s", "end": "e"})
    bounds = rows.select("chrom", F.explode(F.array("s", "e")).alias("pos")).distinct()
    pieces = neighbours(bounds, F.col("pos"), ["pos"]).select("chrom", "pos", F.col("_after").alias("stop")).filter("stop is not null")
    held = points_in(pieces, rows, "pos", bin_, "inner", "s", "e")
    return held.groupBy("chrom", F.col("pos").alias("start"), F.col("stop").alias("end")).agg(F.count("*").alias("n"))


def chop(intervals: DataFrame, begin: int, stop: int) -> DataFrame:
    """Intervals without what lies in [begin, stop)."""
    left = F.struct(F.col("start").alias("start"), F.least("end", F.lit(begin)).alias("end"))
    right = F.struct(F.greatest("start", F.lit(stop)).alias("start"), F.col("end").alias("end"))
    rest = [c for c in intervals.columns if c not in ("start", "end")]
    return intervals.select(*rest, F.explode(F.array(left, right)).alias("_p")).select(*rest, "_p.start", "_p.end").filter("end > start")


def equal_merged(intervals: DataFrame, reducer, zero_column: str) -> DataFrame:
    """Intervals with equal bounds as one; reducer makes an aggregate of the named column."""
    return intervals.groupBy("chrom", "start", "end").agg(reducer(F.col(zero_column)).alias(zero_column))


def distance(start: Column, end: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(start_b - end, start - end_b, F.lit(0))


def overlap_length(start: Column, end: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.least(end, end_b) - F.greatest(start, start_b), F.lit(0))
