"""Neighbourhood sums, gap clusters and peaks of positions.

Positions of a contig are cut into tiles. Window functions run per tile, with copies of the rows that lie within reach
of it, so a contig is many tasks and no window holds all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import neighbours

TILE = 1 << 16


def _tiled(df: DataFrame, key: list[str], before: int, after: int, tile: int) -> DataFrame:
    """Rows in their own tile (_home) and in those whose rows see them: `before` positions before, `after` after."""
    own = F.floor(F.col("pos") / tile)
    cells = F.array_distinct(F.array(own, F.floor((F.col("pos") + before) / tile), F.floor((F.col("pos") - after) / tile)))
    return df.withColumn("_tile", F.explode(cells)).withColumn("_home", F.col("_tile") == own)


def nearby_sums(df: DataFrame, sums: dict[str, Column], before: int = 50, after: int = 49, key: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """df with sums over the rows whose positions lie in [pos - before, pos + after]. The reach must be under a tile."""
    key = key or ["chrom"]
    w = Window.partitionBy(*key, "_tile").orderBy("pos").rangeBetween(-before, after)
    rows = _tiled(df, key, before, after, tile)
    return rows.withColumns({k: F.sum(v).over(w) for k, v in sums.items()}).filter("_home").drop("_tile", "_home")


def islands(df: DataFrame, gap: int, inclusive: bool = False, key: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """df with `island`, the first position of the run of positions in which no step is over gap (inclusive: gap or over).

    Starts are found per tile; the last start before a tile comes from one row per tile.
    """
    key = key or ["chrom"]
    tile = max(tile, 2 * gap)
    rows = _tiled(df, key, gap, 0, tile)
    w = Window.partitionBy(*key, "_tile").orderBy("pos")
    step = F.col("pos") - F.lag("pos").over(w)
    new = step.isNull() | ((step >= gap) if inclusive else (step > gap))
    rows = rows.withColumn("_start", F.when(new, F.col("pos"))).filter("_home")
    lasts = rows.groupBy(*key, "_tile").agg(F.max("_start").alias("_last"))
    w2 = Window.partitionBy(*key).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.withColumn("_carry", F.max("_last").over(w2)).drop("_last")
    # equal positions belong together: the range frame takes all of them
    inside = F.max("_start").over(w.rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_in", inside).join(lasts, [*key, "_tile"]).withColumn("island", F.coalesce("_in", "_carry")).drop("_tile", "_home", "_start", "_in", "_carry")


def deviation(x: Column, weight: Column) -> Column:
    """The population standard deviation of values with weights, to two decimals; -1 without weight."""
    n, s, q = F.sum(weight), F.sum(weight * x), F.sum(weight * x * x)
    return F.when(n > 0, F.round(F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))), 2)).otherwise(F.lit(-1.0))


def peaks(df: DataFrame, gap: int, extra: list[Column] | None = None) -> DataFrame:
    """df (chrom, pos, n_l, n_r) -> one row per island: the position with most clips (of ties the least), and totals."""
    rows = islands(df, gap)
    clips = F.col("n_l") + F.col("n_r")
    return rows.groupBy("chrom", "island").agg(F.max_by("pos", F.struct(clips, -F.col("pos"))).alias("peak"), F.sum("n_l").alias("sum_l"), F.sum("n_r").alias("sum_r"), F.count("*").alias("n_pos"), *(extra or []))


def peaks_by_two(df: DataFrame, gap: int) -> DataFrame:
    """df (chrom, pos, n_clip, n_all) -> one row per island: the position with most clips, of those the one with most of all features, of ties the least; and its clips."""
    rows = islands(df, gap)
    return rows.groupBy("chrom", "island").agg(F.max_by(F.struct("pos", "n_clip"), F.struct("n_clip", "n_all", -F.col("pos"))).alias("b")).select("chrom", F.col("b.pos").alias("pos"), F.col("b.n_clip").alias("n_clip"))


def peaks_with_deviation(df: DataFrame, gap: int) -> DataFrame:
    """Deviations are of the distance to the island's first position, which keeps sums of squares small."""
    x = (F.col("pos") - F.col("island")).cast("double")
    l, r = F.col("n_l").cast("double"), F.col("n_r").cast("double")
    return peaks(df, gap, [deviation(x, l).alias("std_l"), deviation(x, r).alias("std_r"), deviation(x, l + r).alias("std_all")])


def weighted_median_peaks(df: DataFrame, gap: int, focal: int = 75) -> DataFrame:
    """One row per island: the first position where the running count reaches half, and the counts within focal of it."""
    rows = islands(df.withColumn("n", F.col("n_l") + F.col("n_r")), gap)
    w = Window.partitionBy("chrom", "island")
    rows = rows.withColumn("_all", F.sum("n").over(w)).withColumn("_run", F.sum("n").over(w.orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)))
    median = rows.filter(2 * F.col("_run") >= F.col("_all")).groupBy("chrom", "island").agg(F.min("pos").alias("median"))
    return rows.join(median, ["chrom", "island"]).groupBy("chrom", "island", "median").agg(F.sum(F.when(F.abs(F.col("pos") - F.col("median")) <= focal, F.col("n")).otherwise(0)).alias("n_focal"), F.sum("n").alias("n_all"))


def chained_regions(df: DataFrame, gap: int) -> DataFrame:
    """Islands that break at a step of gap or over, with left and right peaks; the left one stands for both if there is one."""
    rows = islands(df, gap, inclusive=True)

    def peak(c: str) -> Column:
        return F.max_by("pos", F.when(F.col(c) > 0, F.struct(F.col(c), -F.col("pos"))))

    out = rows.groupBy("chrom", "island").agg(peak("n_l").alias("left_peak"), peak("n_r").alias("right_peak"), F.max("pos").alias("last"))
    return out.withColumn("site", F.coalesce("left_peak", "right_peak", "island"))


def mate_clusters(df: DataFrame, gap: int, ratio: float = 0.3) -> DataFrame:
    """df (site, chrom, pos of mates) -> the largest gap cluster of each site, if it holds over that share of its mates."""
    rows = islands(df, gap, key=["site", "chrom"])
    island = ["site", "chrom", "island"]
    # the upper median comes from counts by position
    at = rows.groupBy(*island, "pos").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*island)
    at = at.withColumn("_n", F.sum("k").over(w)).withColumn("_till", F.sum("k").over(w.orderBy("pos")))
    groups = at.groupBy(*island).agg(F.max("_n").alias("n"), F.min(F.when(F.col("_till") > F.floor(F.col("_n") / 2), F.col("pos"))).alias("mate_pos"))
    best = groups.groupBy("site").agg(F.min_by(F.struct("chrom", "mate_pos", "n"), F.struct(F.negate("n"), "chrom", "island")).alias("b"), F.sum("n").alias("total"))
    return best.filter(F.col("b.n") > ratio * F.col("total")).select("site", F.col("b.chrom").alias("mate_chrom"), F.col("b.mate_pos").alias("mate_pos"), F.col("b.n").alias("n"), "total")


def max_cover(df: DataFrame, distance: int, ratio: float, key: list[str]) -> DataFrame:
    """The densest stretch of up to `distance`: how many rows come after its first, and whether that is the share asked for.

    df has the key and pos, one row per observation. Rows are counted by position first.
    """
    at = df.groupBy(*key, "pos").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy("pos").rangeBetween(0, distance)
    within = at.withColumn("_n", F.sum("n").over(w) - 1).withColumn("_end", F.max("pos").over(w))
    best = within.groupBy(*key).agg(F.max_by(F.struct(F.col("pos").alias("start"), F.col("_end").alias("end"), F.col("_n").alias("n")), F.struct("_n", -F.col("pos"))).alias("b"), F.sum("n").alias("total"))
    return best.select(*key, F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.col("b.n").alias("n"), "total", (F.col("b.n") >= ratio * F.col("total")).alias("is_cluster"))


def two_peaks(df: DataFrame, key: list[str], before: int = 7, after: int = 6) -> DataFrame:
    """First and second peaks of window sums of n; positions up to 0 are left out, and the second lies outside the first's window."""
    w = Window.partitionBy(*key).orderBy("pos").rangeBetween(-before, after)
    rows = df.filter("pos > 0").withColumn("_s", F.sum("n").over(w))
    first = rows.groupBy(*key).agg(F.max_by(F.struct(F.col("pos").alias("p"), F.col("_s").alias("s")), F.struct("_s", -F.col("pos"))).alias("f"))
    other = rows.join(first, key).filter((F.col("pos") < F.col("f.p") - before) | (F.col("pos") > F.col("f.p") + after))
    second = other.groupBy(*key).agg(F.max_by(F.struct(F.col("pos").alias("p"), F.col("_s").alias("s")), F.struct("_s", -F.col("pos"))).alias("g"))
    return first.join(second, key, "left").select(*key, F.col("f.p").alias("peak1"), F.col("f.s").alias("n1"), F.col("g.p").alias("peak2"), F.col("g.s").alias("n2"))


def paired_deletions(df: DataFrame) -> DataFrame:
    """One-sided sites (chrom, pos, is_left) in order: a left one with the next if that is a right one, else an open end."""
    rows = neighbours(df, F.struct("pos", "is_left"), ["pos"])
    left = rows.filter("is_left").select("chrom", F.col("pos").alias("start"), F.when(~F.col("_after.is_left"), F.col("_after.pos")).otherwise(F.lit(-1)).alias("end"))
    right = rows.filter("not is_left and (_before is null or not _before.is_left)").select("chrom", F.lit(-1).cast("long").alias("start"), F.col("pos").alias("end"))
    return left.unionByName(right)
