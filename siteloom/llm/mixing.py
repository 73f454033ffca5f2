"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. The rates r of its documents are the least informative ones (closest to 1 in relative
entropy) with sum(size * r) = target and r <= 3: r = min(3, exp(l * x)), where x is the size over the source's mean size
and l the multiplier of its token constraint. l solves the convex dual; every Newton step is one aggregation of all
sources at once over (source, size, number of documents), which holds all that the dual depends on.

The rates become whole copies per (source, size): rounding the running sum of expected copies leaves a source within
half its longest document of the target, and a few corrections with ever shorter documents bring it to within a short
one. The copies are then dealt to the documents of that size in order of a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

MOST = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: Newton steps, and halvings of the bracket for sources that these don't settle.
STEPS, HALVINGS = 40, 80
CORRECTIONS = 5
SLICES = 1024


def source_targets(cells: DataFrame) -> DataFrame:
    """cells (source, size, n) -> source, source_size, target.

    A target is min(3 * source_size, weight * level) with the level at which they add up to all words: in the order of
    the level at which sources reach their cap, the first whose cap lies above what is left per weight ends the search.
    """
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    # one row for each source from here on
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    ranked = sizes.withColumn("weight", F.element_at(weights, ((F.row_number().over(by_code_point) - 1) % len(WEIGHTS) + 1).cast("int"))).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    onward = fills.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(onward)).withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(every)["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level))
    return levels.select("source", "source_size", "docs", target.alias("target"))


def _rate(l: Column, x: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(l * x, F.lit(50.0))))


def multipliers(cells: DataFrame, targets: DataFrame, steps: int = STEPS, halvings: int = HALVINGS) -> DataFrame:
    """The dual's multiplier of each source that has words and a target below its cap, by Newton steps kept in a bracket.

    Below: f(l) = sum(size * n * min(3, exp(l * x))) - target rises with l. A step out of the bracket is halved into it. A
    source that is still off its target after the steps has its bracket halved, until it is on it or the bracket is as
    narrow as numbers are; one that isn't settled after that raises an error.
    """
    open_ = targets.filter((F.col("source_size") > 0) & (F.col("target") < MOST * F.col("source_size")))
    mean = F.col("source_size") / F.col("docs")
    state = materialise(open_.select("source", "source_size", "target", mean.alias("mean"), F.lit(0.0).alias("l"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"), F.lit(1.0).alias("gap")), "dual")
    for k in range(steps + halvings):
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("l"), x)
        words = F.col("size") * F.col("n")
        joined = cells.join(state, cells["source"].eqNullSafe(state["source"])).drop(cells["source"])
        sums = joined.groupBy("source", "target", "mean", "source_size", "l", "low", "high").agg(
            F.sum(words * rate).alias("now"), F.sum(F.when(rate < MOST, words * rate * x).otherwise(0.0)).alias("slope"))
        f = F.col("now") - F.col("target")
        low, high = F.when(f < 0, F.col("l")).otherwise(F.col("low")), F.when(f < 0, F.col("high")).otherwise(F.col("l"))
        step = F.col("l") - f / F.when(F.col("slope") > 0, F.col("slope"))
        # a finite bracket is halved; before there is one, the step may grow by a limit
        inside = F.when(F.lit(k < steps) & (step > low) & (step < high) & (F.abs(step - F.col("l")) < 5.0), step).otherwise(
            F.when((low > -1e4) & (high < 1e4), (low + high) / 2).when(f < 0, F.col("l") + 2.0).otherwise(F.col("l") - 2.0))
        gap = F.abs(f) / F.greatest(F.col("target"), F.lit(1.0))
        state = materialise(sums.select("source", "source_size", "target", "mean", F.when(gap < 1e-9, F.col("l")).otherwise(inside).alias("l"), low.alias("low"), high.alias("high"), gap.alias("gap")), "dual", free=False)
        narrow = F.col("high") - F.col("low") <= 1e-13 * F.greatest(F.abs("low"), F.abs("high"), F.lit(1.0))
        worst = state.agg(F.max(F.when(narrow, 0.0).otherwise(F.col("gap")))).first()[0]
        if worst is None or worst < 1e-7:
            return state.select("source", "l", "mean")
    raise ArithmeticError(f"a source is still off its target by {worst:.3g} of it after {steps} steps and {halvings} halvings")


def cell_copies(cells: DataFrame, targets: DataFrame, duals: DataFrame) -> DataFrame:
    """cells with whole copies for each (source, size), source_size and target."""
    t, d = targets.alias("t"), duals.alias("d")
    named = cells.alias("c").join(t, F.col("c.source").eqNullSafe(F.col("t.source"))).join(d, F.col("c.source").eqNullSafe(F.col("d.source")), "left")
    rate = F.when(F.col("target") >= MOST * F.col("source_size"), F.lit(float(MOST))).otherwise(_rate(F.col("l"), F.col("size") / F.col("mean")))
    out = named.select("c.source", "size", "n", "source_size", "target", F.when(F.col("size") == 0, 0.0).otherwise(rate * F.col("n")).alias("want"))
    longest_first = Window.partitionBy("source").orderBy(F.col("size").desc())
    till = longest_first.rowsBetween(Window.unboundedPreceding, 0)
    # floor(x + 1/2) of the running sum; the difference is within one of want, so within 0 and 3 n as far as both are whole
    out = out.withColumn("_sum", F.sum("want").over(till))
    copies = F.floor(F.col("_sum") + 0.5) - F.floor(F.col("_sum") - F.col("want") + 0.5)
    out = out.withColumn("copies", F.least(F.greatest(copies, F.lit(0)), MOST * F.col("n")))
    every = Window.partitionBy("source")
    for _ in range(CORRECTIONS):
        lack = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(every)
        out = out.withColumn("_lack", lack)
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("_lack"))
        room = F.when(fits, F.when(F.col("_lack") > 0, MOST * F.col("n") - F.col("copies")).otherwise(F.col("copies"))).otherwise(0)
        out = out.withColumn("_room", room)
        used = F.sum(F.col("_room") * F.col("size")).over(till) - F.col("_room") * F.col("size")
        out = out.withColumn("_used", used)
        k = F.when(F.col("_room") > 0, F.least(F.col("_room"), F.greatest(F.floor((F.abs("_lack") - F.col("_used")) / F.col("size")), F.lit(0)))).otherwise(0)
        out = out.withColumn("copies", F.col("copies") + F.signum("_lack").cast("long") * k)
    return out.select("source", "size", "n", "source_size", "target", F.col("copies").cast("long").alias("copies"))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (source, size, and others) with source_size, target and copies.

    A document's rank among those of its source and size orders by a hash of its doc_id. A hot (source, size) is cut in
    slices by that hash: ranks are taken in the slices, and the slices' counts are added up before.
    """
    rows = materialise(rows.withColumn("_h", F.xxhash64("doc_id")).withColumn("_slice", F.pmod("_h", F.lit(SLICES))), "sizes")
    slices = rows.groupBy("source", "size", "_slice").agg(F.count("*").alias("in_slice"))
    cells = materialise(slices.groupBy("source", "size").agg(F.sum("in_slice").alias("n")), "cells")
    targets = materialise(source_targets(cells), "targets")
    copies = materialise(cell_copies(cells, targets, multipliers(cells, targets)), "copies")
    in_order = Window.partitionBy("source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("before", F.coalesce(F.sum("in_slice").over(in_order), F.lit(0)))
    plan = offsets.alias("o").join(copies.alias("c"), F.col("o.source").eqNullSafe(F.col("c.source")) & (F.col("o.size") == F.col("c.size"))).select(
        F.col("o.source").alias("_source"), F.col("o.size").alias("_size"), F.col("_slice").alias("_of"), "before", "n", "source_size", "target", F.col("copies").alias("_copies"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "size", "_slice").orderBy("_h", "doc_id")) - 1)
    # a merge at every size: the plan isn't broadcast while it is small
    out = ranked.join(plan.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("_slice") == F.col("_of")))
    extra = F.when(F.col("before") + F.col("_rank") < F.col("_copies") % F.col("n"), 1).otherwise(0)
    return out.withColumn("copies", F.floor(F.col("_copies") / F.col("n")) + extra)


def _size() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")


def sized(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"))


def mix(df: DataFrame) -> DataFrame:
    """One row per row of df (doc_id, text, source): size, source_size, target and taken, the words of its copies.

    Null texts and null sources are a size of 0 and a source of their own; a source without words has the target 0.
    No document has more than 3 copies. Equal hashes fall back on doc_id; repeated rows are dealt to one by one.
    Other columns aren't read; an empty df gives no rows.
    """
    out = _dealt(sized(df))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"))


def resample(df: DataFrame) -> DataFrame:
    """df with each row as often as mix() has copies of it; rows without words go.

    Rows with one doc_id, source and size share out their copies in order of a hash of the text, then of all columns.
    """
    dealt = _dealt(sized(df)).groupBy(F.struct("doc_id", "source", "size").alias("_k")).agg(F.sum("copies").cast("long").alias("_all"), F.count("*").alias("_rows")).filter("_all > 0")
    columns = [F.col(f"`{c}`") for c in df.columns]
    hashed = [F.xxhash64("text"), F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind))]
    named = df.select(F.struct(*columns).alias("_row"), F.struct("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size")).alias("_key"), F.struct(*hashed).alias("_rank"))
    out = named.join(dealt, F.col("_key") == F.col("_k"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_rank")) - 1
    times = F.floor(F.col("_all") / F.col("_rows")) + F.when(place < F.col("_all") % F.col("_rows"), 1).otherwise(0)
    out = out.withColumn("_copies", times.cast("int")).filter("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns))
