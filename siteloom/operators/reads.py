"""Aggregations of reads: clips, discordant pairs, coverage, library statistics, barcodes, allele fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import cigar as C
from .intervals import TILE, overlaps, points_in


def mate_in_repeat(reads: DataFrame, repeats: DataFrame) -> DataFrame:
    """reads with in_repeat: whether the mate's position lies in a repeat. Distinct positions are joined, so no read repeats."""
    places = reads.select(F.col("mate_chrom").alias("chrom"), F.col("mate_pos").alias("pos")).distinct()
    hit = points_in(places, repeats.select("chrom", "start", "end")).select(F.col("chrom").alias("_c"), F.col("pos").alias("_p")).distinct()
    return reads.join(hit, (F.col("mate_chrom") == F.col("_c")) & (F.col("mate_pos") == F.col("_p")), "left").withColumn("in_repeat", F.col("_c").isNotNull()).drop("_c", "_p")


def eligible(config: Config = Config()) -> Column:
    """Reads whose clips count: mapped, no duplicate, of enough quality, not one plain match."""
    return ~F.col("is_duplicate") & ~F.col("is_unmapped") & (F.size("cigar") > 0) & ~C.fully_mapped(F.col("cigar")) & (F.col("mapq") >= config.clip_mapq)


def clip_events(reads: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per clip: chrom, pos (the breakpoint), side. A supplementary read with a left clip has that one only."""
    left, right = C.left_clipped(F.col("cigar")), C.right_clipped(F.col("cigar"))
    supplementary = F.col("is_supplementary") & left
    sides = F.array_compact(F.array(
        F.when(left, F.struct(F.col("pos").alias("at"), F.lit("L").alias("side"))),
        F.when(right & ~supplementary, F.struct(C.right_breakpoint(F.col("pos"), F.col("cigar")).alias("at"), F.lit("R").alias("side")))))
    return reads.filter(eligible(config)).select("*", F.explode(sides).alias("_e")).withColumns({"breakpoint": F.col("_e.at"), "side": F.col("_e.side")}).drop("_e")


def clip_counts(events: DataFrame, cutoff: int = 1) -> DataFrame:
    """events (chrom, pos, side L/R, in_repeat) -> chrom, pos, n_l, n_r, n_mate where n_l + n_r >= cutoff."""
    left, right = F.count_if(F.col("side") == "L"), F.count_if(F.col("side") == "R")
    out = events.filter(F.col("side").isin("L", "R")).groupBy("chrom", "pos").agg(left.alias("n_l"), right.alias("n_r"), F.count_if("in_repeat").alias("n_mate"))
    return out.filter(F.col("n_l") + F.col("n_r") >= cutoff)


def candidate_filter(sums: DataFrame, clip: int, mate: int, both: bool = False) -> DataFrame:
    sides = (F.col("near_l") >= clip) & (F.col("near_r") >= clip) if both else (F.col("near_l") >= clip) | (F.col("near_r") >= clip)
    return sums.filter(sides & (F.col("near_mate") >= mate))


def discordant_sides(sites: DataFrame, reads: DataFrame, extend: int, far: int, mapq: int = 20, bin_: int = 256) -> DataFrame:
    """Discordant reads in [pos - extend, pos) and [pos + 1, pos + extend) of each site; distance is from the region's start."""
    region = sites.select("chrom", F.col("pos").alias("site"), (F.col("pos") - extend).alias("start"), (F.col("pos") + extend).alias("end"))
    hits = points_in(reads.filter(F.col("mapq") >= mapq).select("chrom", "pos", "mate_chrom", "mate_pos"), region, "pos", bin_, longest=2 * extend)
    begin = F.when(F.col("pos") < F.col("site"), F.col("start")).otherwise(F.col("site") + 1)
    apart = (F.col("mate_chrom") != F.col("chrom")) | (F.abs(F.col("mate_pos") - begin) > far)
    left, right = apart & (F.col("pos") < F.col("site")), apart & (F.col("pos") > F.col("site"))
    return hits.groupBy("chrom", F.col("site").alias("pos")).agg(F.count_if(left).alias("n_l"), F.count_if(right).alias("n_r"))


def disc_filter(df: DataFrame, cutoff: int, tumor: bool = False) -> DataFrame:
    l, r = F.col("n_l"), F.col("n_r")
    if tumor:
        return df.filter(l + r >= cutoff)
    return df.filter(((l > cutoff / 2) & (r > cutoff / 2)) | (l > cutoff) | (r > cutoff))


def depth_filter(clips: DataFrame, left: int, right: int, most: float) -> DataFrame:
    """Clip positions with enough clips on one side, and no more than `most` in all."""
    l, r = F.col("n_l"), F.col("n_r")
    return clips.filter(((l >= left) | (r >= right)) & (l + r <= most))


def raw_disc_sum(parts: DataFrame) -> DataFrame:
    """Raw discordant counts of samples (chrom, pos, raw_l, raw_r, n_l, n_r, l_cluster, r_cluster) added up; a side is clustered if it is in any sample."""
    counts = [F.sum(c).alias(c) for c in ("raw_l", "raw_r", "n_l", "n_r")]
    return parts.groupBy("chrom", "pos").agg(*counts, F.bool_or("l_cluster").alias("l_cluster"), F.bool_or("r_cluster").alias("r_cluster"))


def raw_disc_filter(sites: DataFrame, cutoff: int, tumor: bool = False) -> DataFrame:
    """raw_disc_sum() -> sites with a clustered side that has enough raw pairs."""
    least = raw_disc_cutoff(cutoff, tumor)
    side = [(F.col(f"raw_{x}") >= least) & F.coalesce(F.col(f"{x}_cluster"), F.lit(False)) for x in "lr"]
    return sites.filter(side[0] | side[1])


def count_between(mates: DataFrame, regions: DataFrame) -> DataFrame:
    """regions (chrom, start, end) with n, the mates (chrom, pos) in [start, end], both ends included."""
    wide = regions.select("chrom", "start", "end", (F.col("end") + 1).alias("_stop")).distinct()
    counts = points_in(mates.select("chrom", "pos"), wide, start="start", end="_stop").groupBy("chrom", "start", "end").agg(F.count("*").alias("n"))
    return regions.join(counts, ["chrom", "start", "end"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def raw_disc_cutoff(cutoff: int, tumor: bool) -> int:
    return max(1, int(cutoff / 2) if tumor else int(3 * cutoff / 4) + 1)


def site_coverage(sites: DataFrame, reads: DataFrame, window: int, bin_: int = 256) -> DataFrame:
    """Mean depth left [p - w, p] and right [p + 1, p + w] of a site, both over w; from overlap lengths, no base is listed."""
    region = sites.select("chrom", F.col("pos").alias("site"), (F.col("pos") - window).alias("start"), (F.col("pos") + window + 1).alias("end")).distinct()
    held = overlaps(region, reads.select("chrom", F.col("pos").alias("start"), "end"), bin_)
    hits = held.select("chrom", "site", F.col("start_b").alias("pos"), F.col("end_b").alias("read_end"))

    def depth(a: Column, b: Column) -> Column:
        return F.sum(F.greatest(F.least(F.col("read_end"), b) - F.greatest(F.col("pos"), a), F.lit(0)))

    sums = hits.groupBy("chrom", "site").agg(depth(F.col("site") - window, F.col("site") + 1).alias("l"), depth(F.col("site") + 1, F.col("site") + window + 1).alias("r"))
    out = sites.select("chrom", "pos").distinct().join(sums.withColumnsRenamed({"chrom": "_c"}), (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("site")), "left")
    inside = F.col("pos") - window > 0
    return out.select("chrom", "pos", *(F.when(inside, F.coalesce(F.col(c), F.lit(0)) / window).otherwise(0.0).alias(f"{c}cov") for c in "lr"))


def upper_median(df: DataFrame, value: str, key: list[str], least: float = 5) -> DataFrame:
    """sorted[n // 2] of the values from `least` on, by key; ranks come from counts by value."""
    counts = df.filter(F.col(value) >= least).groupBy(*key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key)
    ranked = counts.withColumn("_till", F.sum("n").over(w.orderBy(value))).withColumn("_all", F.sum("n").over(w))
    return ranked.filter(F.col("_till") > F.floor(F.col("_all") / 2)).groupBy(*key).agg(F.min(value).alias("median"), F.max("_all").alias("n"))


def insert_sizes(reads: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """Mean and population deviation of |pos - mate| of pairs on one contig within `most`, by read group."""
    x = F.abs(F.col("pos") - F.col("mate_pos")).cast("double")
    ok = reads.filter((F.col("chrom") == F.col("mate_chrom")) & (x <= most))
    return ok.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean_is"), F.round(F.stddev_pop(x), 4).alias("std_is"))


def most_frequent(df: DataFrame, value: str, key: list[str]) -> DataFrame:
    """The value with most rows by key, of ties the least."""
    counts = df.groupBy(*key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.max_by(value, F.struct("n", F.negate(F.col(value)))).alias("mode"), F.max("n").alias("n"))


def _windows(sites: DataFrame, reads: DataFrame, extend: int, sets: dict[str, tuple[int, int]], tile: int = TILE) -> DataFrame:
    """Distinct sites (chrom, pos) that have reads in [pos - extend, pos + extend), with sets of the barcodes (as structs, so that null is one) in ranges around pos.

    Sites and reads are sorted together, per tile: a site's reads lie next to it, so that no pair of them is made or dealt out.
    """
    own = F.floor(F.col("pos") / tile)
    cells = F.array_distinct(F.array(own, F.floor((F.col("pos") + extend) / tile), F.floor((F.col("pos") - extend + 1) / tile)))
    told = reads.filter("chrom is not null and pos is not null").select("chrom", "pos", F.struct("bx").alias("_bx"), F.explode(cells).alias("_tile"))
    asked = sites.filter("chrom is not null and pos is not null").select("chrom", "pos").distinct()
    rows = told.unionByName(asked.withColumn("_tile", own), allowMissingColumns=True)
    by = Window.partitionBy("chrom", "_tile").orderBy("pos")
    found = rows.withColumns({name: F.collect_set("_bx").over(by.rangeBetween(first, last)) for name, (first, last) in sets.items()})
    return found.filter(F.col("_bx").isNull() & (sum((F.size(name) for name in sets), F.lit(0)) > 0)).select("chrom", "pos", *sets)


def barcode_counts(sites: DataFrame, reads: DataFrame, extend: int, most: int) -> DataFrame:
    """Distinct barcodes within extend of a site, where there are no more than `most`."""
    near = _windows(sites, reads, extend, {"_b": (-extend, extend - 1)})
    return near.select("chrom", "pos", F.size(F.filter("_b", lambda x: x["bx"].isNotNull())).cast("long").alias("n_bx")).filter(F.col("n_bx") <= most)


def barcode_overlap(sites: DataFrame, reads: DataFrame, extend: int) -> DataFrame:
    """How many barcodes the left and right neighbourhoods of a site share, and how many only one has."""
    near = _windows(sites, reads, extend, {"_l": (-extend, -1), "_r": (0, extend - 1)})
    both = F.size(F.array_intersect("_l", "_r")).cast("long")
    return near.select("chrom", "pos", both.alias("n_shared"), (F.size("_l") + F.size("_r") - 2 * both).alias("n_different"))


def genotype_features(sites: DataFrame, reads: DataFrame, extend: int, slack: int = 3) -> DataFrame:
    """sites and reads (chrom, pos, side, clip_len, mate_chrom, mate_pos, mapq) -> the features of each site in one aggregation."""
    region = sites.select("chrom", F.col("pos").alias("site"), (F.col("pos") - extend).alias("start"), (F.col("pos") + extend).alias("end")).distinct()
    hits = points_in(reads, region)
    exact = F.abs(F.col("pos") - F.col("site")) < slack
    clip = F.col("side").isin("L", "R")
    disc = (F.col("mate_chrom") != F.col("chrom")) | (F.abs(F.col("mate_pos") - F.col("pos")) > 2000)
    return hits.groupBy("chrom", F.col("site").alias("pos")).agg(
        F.count_if(exact & clip).alias("n_af_clip"), F.count_if(exact & ~clip).alias("n_full_map"), F.count_if((F.col("side") == "L")).alias("n_l_raw"), F.count_if((F.col("side") == "R")).alias("n_r_raw"),
        F.count_if(disc).alias("n_disc"), F.count_if(~disc).alias("n_conc"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(exact & clip, F.col("clip_len")))), lambda x: x.cast("string")), ":").alias("clip_lens"),
        F.size(F.collect_set(F.when(disc, F.col("mate_chrom")))).cast("long").alias("n_mate_chroms"))  # contigs are few: no grouping by each


def merge_features(parts: DataFrame) -> DataFrame:
    """Features of several samples added up by site."""
    rest = [c for c in parts.columns if c not in ("chrom", "pos", "clip_lens")]
    return parts.groupBy("chrom", "pos").agg(*(F.sum(c).alias(c) for c in rest))


def allele_fraction(clip: Column, all_clip: Column, disc: Column, near: Column, span: float, slack: int) -> tuple[Column, Column]:
    return F.least(F.lit(1.0), clip * span / F.nullif(all_clip * 2 * slack, F.lit(0))), F.least(F.lit(1.0), disc / F.nullif(near, F.lit(0)))


def source_argmax(df: DataFrame, cutoff: int, ratio: float) -> DataFrame:
    """df (site, source), one row per supporting read -> the source with most, if it has `cutoff` and that share."""
    counts = df.groupBy("site", "source").agg(F.count("*").alias("n"))
    best = counts.groupBy("site").agg(F.max_by("source", F.struct("n", F.negate("source"))).alias("source"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.filter((F.col("n") >= cutoff) & (F.col("n") >= ratio * F.col("total")))


def subtract_unaligned(clips: DataFrame, failed: DataFrame) -> DataFrame:
    """Clip counts without the clips that failed to realign; both (chrom, pos, n_l, n_r)."""
    f = failed.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.col("n_l").alias("_l"), F.col("n_r").alias("_r"))
    out = clips.join(f, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")), "left")
    return out.withColumns({"n_l": F.col("n_l") - F.coalesce("_l", F.lit(0)), "n_r": F.col("n_r") - F.coalesce("_r", F.lit(0))}).drop("_c", "_p", "_l", "_r")


def mates(reads: DataFrame, wanted: DataFrame) -> DataFrame:
    """The mates of some reads (qname, is_read1), by an equi-join on name and the other read's flag."""
    w = wanted.select(F.col("qname").alias("_q"), (~F.col("is_read1")).alias("_r")).distinct()
    return reads.join(w, (F.col("qname") == F.col("_q")) & (F.col("is_read1") == F.col("_r")), "left_semi")


def molecule_totals(reads: DataFrame, region: list[str]) -> DataFrame:
    """For each region (columns of reads): how many molecules (bx) it has seen, and the reads of these molecules anywhere.

    Reads are counted by barcode first, so a molecule is one row for each region.
    """
    totals = reads.groupBy("bx").agg(F.count("*").alias("n"), F.sum("pos").alias("total"))
    return reads.select(*region, "bx").distinct().join(totals, "bx").groupBy(*region).agg(F.count("*").alias("n_molecules"), F.sum("n").alias("n"), F.sum("total").alias("total"))


def shared_barcode_reads(reads: DataFrame, region_reads: DataFrame) -> DataFrame:
    """All reads of the molecules seen in a region."""
    return reads.join(region_reads.select("bx").distinct(), "bx", "left_semi")


def low_quality_background(sites: DataFrame, reads: DataFrame, extend: int, ratio: float = 0.1) -> DataFrame:
    """Sites whose share of reads with mapq under 10 is below the ratio."""
    region = sites.select("chrom", F.col("pos").alias("site"), (F.col("pos") - extend).alias("start"), (F.col("pos") + extend).alias("end"))
    return points_in(reads.select("chrom", "pos", "mapq"), region).groupBy("chrom", F.col("site").alias("pos")).agg(F.avg((F.col("mapq") < 10).cast("double")).alias("low")).filter(F.col("low") < ratio)


def realigned_counts(parts: DataFrame) -> DataFrame:
    """Realigned clipped parts (chrom, pos, side, n_polya) -> counts by side, and of those with polyA. No parts give no rows."""
    l, r = F.col("side") == "L", F.col("side") == "R"
    polya = [F.coalesce(F.sum(F.when(s, F.col("n_polya"))), F.lit(0)).alias(n) for s, n in ((l, "l_polya"), (r, "r_polya"))]
    return parts.groupBy("chrom", "pos").agg(F.count_if(l).alias("n_l"), F.count_if(r).alias("n_r"), *polya)


def phased_barcodes(reads: DataFrame, key: list[str], most: int) -> DataFrame:
    """Distinct barcodes (bx) by haplotype (phase 1, 2; 0: none, 3: both) of each site, where there are no more than `most` in all."""
    def of(n: int) -> Column:
        return F.count_distinct(F.when(F.col("phase") == n, F.col("bx")))

    out = reads.groupBy(*key).agg(of(1).alias("hap1"), of(2).alias("hap2"), of(0).alias("unphased"), of(3).alias("conflicting"), F.count_distinct("bx").alias("_all"))
    return out.filter(F.col("_all") <= most).drop("_all")


def mate_support(reads: DataFrame, key: list[str], least: int) -> DataFrame:
    """Pairs of each site by the mate's contig, and how far apart the mates lie."""
    return reads.groupBy(*key, "mate_chrom").agg(F.count("*").alias("n"), (F.max("mate_pos") - F.min("mate_pos")).alias("span")).filter(F.col("n") >= least)


def split_at(reads: DataFrame, key: list[str], site: str, slack: int) -> DataFrame:
    """Reads to the left and to the right of a site's position; within the slack they count on both sides."""
    return reads.groupBy(*key).agg(F.count_if(F.col("pos") <= F.col(site) + slack).alias("n_left"), F.count_if(F.col("pos") >= F.col(site) - slack).alias("n_right"))


def ends_in_repeats(pairs: DataFrame, repeats: DataFrame) -> DataFrame:
    """pairs with one_in_repeat and both_in_repeat, for the read's and its mate's position."""
    mates_ = mate_in_repeat(pairs, repeats).withColumnRenamed("in_repeat", "_mate")
    places = points_in(pairs.select("chrom", "pos").distinct(), repeats.select("chrom", "start", "end")).select(F.col("chrom").alias("_c"), F.col("pos").alias("_p")).distinct()
    out = mates_.join(places, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")), "left")
    own = F.col("_c").isNotNull()
    return out.withColumns({"one_in_repeat": own != F.col("_mate"), "both_in_repeat": own & F.col("_mate")}).drop("_c", "_p", "_mate")


def sequence_lengths(parts: DataFrame, key: list[str]) -> DataFrame:
    """parts (key, name, length) of sequences, one row a line -> the mean and the least length of the sequences."""
    whole = parts.groupBy(*key, "name").agg(F.sum("length").alias("len"))
    return whole.groupBy(*key).agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"), F.min("len").alias("min_len"))


def raw_coverage(n_reads: Column, read_length: Column, genome: int) -> Column:
    """Mean depth of a library from the number and length of its reads."""
    return n_reads * read_length / genome


def flanks_on_contigs(left: DataFrame, right: DataFrame, key: list[str], slack: int) -> DataFrame:
    """Left and right flanks (key, contig, is_rc, at) that lie on one contig on one strand, the right one by `slack` or more further."""
    r = right.select(*(F.col(c).alias(f"_{c}") for c in (*key, "contig", "is_rc")), F.col("at").alias("right_at"))
    same = (F.col("contig") == F.col("_contig")) & (F.col("is_rc") == F.col("_is_rc"))
    for c in key:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return left.withColumnRenamed("at", "left_at").join(r, same & (F.col("right_at") - F.col("left_at") >= slack)).select(*key, "contig", "is_rc", "left_at", "right_at")
