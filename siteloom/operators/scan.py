"""The scan of reads around sites: clipped parts, discordant pairs, poorly placed clips, library statistics of windows.

Reads are schema.READ; sites have chrom and pos. All come from one join of reads with the sites' neighbourhoods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import cigar as C
from ..functions import seq as S
from .features import told_columns
from .intervals import met, met_levels, points_in

#: Lengths of clipped parts that need nearly only A or T, mapping qualities, and how near a poorly placed clip counts.
SHORT, LONG_ENOUGH, POOR, NEAR_POOR = 7, 9, 5, 35


def placed(reads: DataFrame, duplicates: bool = False) -> DataFrame:
    """Usable reads with start and end: what sites look at. Whatever a read tells by itself is best told before at()."""
    usable = reads.filter((F.lit(duplicates) | ~F.col("is_duplicate")) & ~F.col("is_unmapped") & (F.size("cigar") > 0))
    return usable.withColumns({"start": F.col("pos"), "end": F.greatest(C.reference_end(F.col("pos"), F.col("cigar")), F.col("pos") + 1)})


def at(rows: DataFrame, sites: DataFrame, extend: int, levels: list[int] | None = None) -> DataFrame:
    """rows (chrom, start, end, ...) that overlap [site - extend, site + extend), with the site's position for start and end.

    levels: levels_at() of these rows or of more, where they are known; else a pass over the rows tells.
    """
    regions = sites.select("chrom", F.col("pos").alias("site"), (F.col("pos") - extend).alias("start"), (F.col("pos") + extend).alias("end")).distinct()
    return met(regions, rows, 2 * extend, levels)


def levels_at(rows: DataFrame, extend: int) -> list[int]:
    """Which levels of lengths at() meets in rows (chrom, start, end)."""
    return met_levels(rows, 2 * extend)


def around(reads: DataFrame, sites: DataFrame, extend: int, duplicates: bool = False) -> DataFrame:
    """reads that overlap [site - extend, site + extend), with the site's position; a read may be at several sites."""
    return at(placed(reads, duplicates), sites, extend).select("site", *reads.columns)


def _where(near: DataFrame) -> list[str]:
    """site after at(), start and end before."""
    return [c for c in ("site", "start", "end") if c in near.columns]


def _sides(config: Config) -> dict[str, Column]:
    g, n = F.col("cigar"), F.length("seq")
    l, r = C.left_clipped(g, hard=False), C.right_clipped(g, hard=False)
    ln, rn = C.first(g)["len"], C.last(g)["len"]
    lseq, rseq = F.substring(F.col("seq"), F.lit(1), ln), F.right("seq", rn)
    lqual, rqual = F.slice("qual", F.lit(1), ln), F.slice("qual", n - rn + 1, rn)
    extra = F.col("is_supplementary") | F.col("is_secondary")

    def plain(x: Column, k: Column) -> Column:
        return (k > LONG_ENOUGH) | S.enough_a_t_of(x, k - 1)

    lok = ~extra & (ln >= SHORT) & plain(lseq, ln) & ~C.low_quality(lqual)
    rok = ~extra & (rn >= LONG_ENOUGH) & plain(rseq, rn) & ~C.low_quality(rqual)
    # a left part that fails ends the read; a right one that fails ends what comes after it
    return {"_l": l, "_r": r, "_lok": l & F.coalesce(lok, F.lit(False)), "_rok": r & F.coalesce(rok, F.lit(False)), "_lseq": lseq, "_rseq": rseq, "_lqual": lqual, "_rqual": rqual}


def _clip_counts(config: Config) -> Column:
    """Whether clipped parts of a read are looked at."""
    g = F.col("cigar")
    return (F.col("mapq") >= config.clip_mapq) & (C.left_clipped(g, hard=False) | C.right_clipped(g, hard=False)) & ~C.both_sides_clipped(g)


def _right_counts() -> Column:
    """Where a left part fails, the right one isn't looked at."""
    return F.col("_rok") & (~F.col("_l") | F.col("_lok"))


def clipped_parts(near: DataFrame, config: Config = Config()) -> DataFrame:
    """around() or placed() -> one row per clipped part to be realigned: site (or start and end), chrom, breakpoint, side, is_rc, seq, qual.

    Not those of reads that are clipped at both ends, poorly placed, secondary or supplementary; nor parts that are short
    (unless of A or T) or of low quality. Where a left part fails, the right one isn't looked at.
    """
    rows = near.filter(_clip_counts(config))
    # what reads are asked for again and again stands in one row first
    rows = rows.select(F.inline(F.array(F.struct(*_where(near), "chrom", "qname", "pos", "is_reverse", "cigar", *(v.alias(k) for k, v in _sides(config).items())))))

    def part(side: str, at: Column, x: str) -> Column:
        return F.struct(F.lit(side).alias("side"), at.alias("breakpoint"), F.col(f"_{x}seq").alias("part"), F.col(f"_{x}qual").alias("part_qual"))

    parts = F.array_compact(F.array(F.when(F.col("_lok"), part("L", F.col("pos"), "l")), F.when(_right_counts(), part("R", C.right_breakpoint(F.col("pos"), F.col("cigar")), "r"))))
    return rows.select(*_where(near), "chrom", "qname", F.col("is_reverse").alias("is_rc"), F.inline(parts)).withColumnsRenamed({"part": "seq", "part_qual": "qual"})


def all_clipped_parts(reads: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per clipped part of eligible reads, wherever they are: chrom, breakpoint, side, is_rc, seq, qual; short parts only if all A or all T."""
    g = F.col("cigar")
    rows = reads.filter(~F.col("is_duplicate") & ~F.col("is_unmapped") & (F.size(g) > 0) & ~C.fully_mapped(g) & (F.col("mapq") >= config.clip_mapq))
    n = F.length("seq")

    def part(side: str, at: Column) -> Column:
        end = C.first(g) if side == "L" else C.last(g)
        seq = C.clipped_part(F.col("seq"), g, side == "L")
        qual = F.slice("qual", F.lit(1), end["len"]) if side == "L" else F.slice("qual", n - end["len"] + 1, end["len"])
        ok = (end["op"] == 4) & C.clip_length_ok(seq) & ~C.low_quality(qual)
        return F.when(ok, F.struct(F.lit(side).alias("side"), at.alias("breakpoint"), seq.alias("part"), qual.alias("part_qual")))

    parts = F.array_compact(F.array(part("L", F.col("pos")), F.when(~(F.col("is_supplementary") & C.left_clipped(g)), part("R", C.right_breakpoint(F.col("pos"), g)))))
    return rows.select("chrom", "qname", F.col("is_reverse").alias("is_rc"), F.inline(parts)).withColumnsRenamed({"part": "seq", "part_qual": "qual"})


def _mate_counts(config: Config) -> Column:
    return (F.col("mapq") >= config.disc_mapq) & ~C.both_sides_clipped(F.col("cigar")) & ~F.col("mate_is_unmapped") & F.col("mate_chrom").isNotNull() & ~S.is_decoy(F.col("mate_chrom"))


def _ends_count() -> Column:
    """No clipped part of a read fails."""
    return (~F.col("_l") | F.col("_lok")) & (~F.col("_r") | F.col("_rok"))


def discordant_pairs(near: DataFrame, config: Config = Config()) -> DataFrame:
    """around() or placed() -> one row per discordant read: its anchor (the breakpoint of a right clip), its mate's place, strands, and which ends are clipped.

    Reads with a clipped part that fails, with a poor mapping quality or with a mate on a decoy contig are left out.
    """
    rows = near.filter(_mate_counts(config)).withColumns(_sides(config)).filter(_ends_count())
    rows = rows.withColumn("anchor", F.when(F.col("_r"), C.right_breakpoint(F.col("pos"), F.col("cigar"))).otherwise(F.col("pos")))
    rows = rows.filter(C.discordant(F.col("chrom"), F.col("anchor"), F.col("mate_chrom"), F.col("mate_pos"), config.discordant_distance))
    return rows.select(*_where(near), "chrom", "anchor", F.col("is_reverse").alias("is_rc"), F.col("mate_is_reverse").alias("mate_rc"), "mate_chrom", "mate_pos", "qname", (~F.col("is_read1")).alias("mate_is_read1"), F.col("_lok").alias("anchor_lclip"), F.col("_rok").alias("anchor_rclip"))


def poor_clips(near: DataFrame, config: Config = Config()) -> DataFrame:
    """around() -> chrom, site, n_low: clipped reads of very low mapping quality with their clip near the site; sites without any have no row."""
    near = near if "clip_at" in near.columns else poorly_placed(near, config)
    return near.filter(F.abs(F.col("clip_at") - F.col("site")) < NEAR_POOR).groupBy("chrom", "site").agg(F.count("*").alias("n_low"))


def poorly_placed(near: DataFrame, config: Config = Config()) -> DataFrame:
    """around() or placed() -> where clipped reads of very low mapping quality are clipped."""
    clip = _poor_clip(config)
    return near.filter(clip.isNotNull()).select(*_where(near), "chrom", clip.alias("clip_at"))


def _poor_clip(config: Config) -> Column:
    g = F.col("cigar")
    l, r = C.left_clipped(g, hard=False), C.right_clipped(g, hard=False)
    return F.when(F.col("mapq") < POOR, F.when(l, F.col("pos")).when(r, F.col("pos") + config.read_length - C.last(g)["len"]))


def summary(reads: DataFrame, config: Config = Config()) -> DataFrame:
    """Usable reads with all that site records ask of a read by itself, in short columns, so that reads are looked at once.

    features.told(); start and end, and _end, which is end but for reads without a base of the reference; counts: neither
    secondary nor supplementary; clip_at as poorly_placed(); l_part and r_part, the sequences of clipped_parts(); paired: of
    discordant_pairs(), place its anchor, is_rc, mate_rc, anchor_lclip and anchor_rclip.
    """
    # what is asked for again and again stands in a row first, so that no cigar is made or walked twice
    rows = reads.filter(~F.col("is_duplicate") & ~F.col("is_unmapped")).select(F.inline(F.array(F.struct(*(c for c in reads.columns if c not in ("sample", "tags", "tlen", "is_duplicate", "is_unmapped"))))))
    g, pos = F.col("cigar"), F.col("pos")
    sides = {k: v for k, v in _sides(config).items() if not k.endswith("qual")}
    rows = rows.filter(F.size(g) > 0).select(F.inline(F.array(F.struct(*rows.columns, C.reference_end(pos, g).alias("_end"), C.right_breakpoint(pos, g).alias("_right"), *(v.alias(k) for k, v in sides.items())))))
    place = F.when(F.col("_r"), F.col("_right")).otherwise(pos)
    clip, no = _clip_counts(config), F.lit(False)
    paired = _mate_counts(config) & _ends_count() & C.discordant(F.col("chrom"), place, F.col("mate_chrom"), F.col("mate_pos"), config.discordant_distance)
    return rows.select(
        *told_columns(config, place), pos.alias("start"), F.greatest("_end", pos + 1).alias("end"), "_end", F.coalesce(~F.col("is_secondary") & ~F.col("is_supplementary"), no).alias("counts"), _poor_clip(config).alias("clip_at"),
        F.when(clip & F.col("_lok"), F.col("_lseq")).alias("l_part"), F.when(clip & _right_counts(), F.col("_rseq")).alias("r_part"),
        F.coalesce(paired, no).alias("paired"), F.col("is_reverse").alias("is_rc"), F.col("mate_is_reverse").alias("mate_rc"), F.col("_lok").alias("anchor_lclip"), F.col("_rok").alias("anchor_rclip"))


def window_statistics(reads: DataFrame, sites: DataFrame, window: int, most: int = 2000) -> DataFrame:
    """For each site: mean depth left and right, the most frequent read length (of ties the least), pairs within `most`, and their sums of x and x**2, x with the read length.

    Secondary and supplementary reads don't count.
    """
    apart = F.abs(F.col("pos") - F.col("mate_pos"))
    told = placed(reads.filter(~F.col("is_secondary") & ~F.col("is_supplementary")))
    told = told.select("chrom", "start", "end", "pos", C.reference_end(F.col("pos"), F.col("cigar")).alias("_end"), F.length("seq").alias("len"), F.when((F.col("chrom") == F.col("mate_chrom")) & (apart <= most), apart).alias("apart"))
    near, site = at(told, sites, window), F.col("site")

    def covered(a: Column, b: Column) -> Column:
        return F.sum(F.greatest(F.least(F.col("_end"), b) - F.greatest(F.col("pos"), a), F.lit(0)))

    # sums of x and x**2 come from those without the read length, which is known after all reads are counted
    sums = near.groupBy("chrom", "site", "len").agg(
        covered(site - window, site).alias("lcov"), covered(site, site + window).alias("rcov"), F.count("*").alias("k"), F.count("apart").alias("n"), F.coalesce(F.sum("apart"), F.lit(0)).alias("s"), F.coalesce(F.sum(F.col("apart") * F.col("apart")), F.lit(0)).alias("q"))
    out = sums.groupBy("chrom", "site").agg(F.max_by("len", F.struct("k", F.negate("len"))).alias("read_length"), *(F.sum(c).alias(c) for c in ("lcov", "rcov", "n", "s", "q")))
    n, length = F.col("n"), F.col("read_length")
    return out.select("chrom", "site", (F.col("lcov") / window).alias("lcov"), (F.col("rcov") / window).alias("rcov"), "read_length", n.alias("n_pairs"), (F.col("s") + n * length).alias("sum_x"), (F.col("q") + 2 * length * F.col("s") + n * length * length).alias("sum_xx"))


def depths(near: DataFrame, window: int) -> DataFrame:
    """at() of summary() rows, with begins and ends -> chrom, site and the mean depths of window_statistics(), for the same sites."""
    site = F.col("site")
    rows = near.filter(F.col("counts") & (F.col("begins") < site + window) & (F.col("ends") > site - window))

    def covered(a: Column, b: Column) -> Column:
        return F.sum(F.greatest(F.least(F.col("_end"), b) - F.greatest(F.col("pos"), a), F.lit(0))) / window

    return rows.groupBy("chrom", "site").agg(covered(site - window, site).alias("lcov"), covered(site, site + window).alias("rcov"))


def library(statistics: DataFrame, least: float = 5) -> DataFrame:
    """window_statistics() -> one row: coverage (the upper median of sites with a depth from `least` on), read length, insert size and its deviation.

    The median is looked for among whole depths first, then among the depths that begin with that one.
    """
    d = statistics.withColumn("depth", F.col("lcov") + F.col("rcov"))
    counts = d.filter(F.col("depth") / 2 >= least).groupBy("depth").agg(F.count("*").alias("n")).withColumn("_whole", F.floor("depth"))
    total = counts.agg(F.sum("n").alias("all"))

    def reached(rows: DataFrame, by: str) -> Column:
        """Whether more than half of all sites come up to the row; one row a depth."""
        return F.sum("n").over(Window.orderBy(by)) + F.col("_before") > F.floor(F.col("all") / 2)

    whole = counts.groupBy("_whole").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).withColumn("_before", F.lit(0))  # total: one row
    first = whole.withColumn("_ok", reached(whole, "_whole")).filter("_ok").agg(F.min("_whole").alias("_w"))
    before = counts.join(F.broadcast(first), F.col("_whole") < F.col("_w")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_before"))  # first: one row
    there = counts.join(F.broadcast(first), F.col("_whole") == F.col("_w")).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(before))  # one row each
    median = there.withColumn("_ok", reached(there, "depth")).filter("_ok").agg((F.min("depth") / 2).alias("coverage"))
    n, s, q = F.sum("n_pairs"), F.sum("sum_x"), F.sum("sum_xx")
    rest = d.agg(F.mode("read_length", True).alias("read_length"), (s / n).alias("mean_is"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("std_is"))
    return median.crossJoin(rest)  # one row each


def without_unrelated(reads: DataFrame, sites: DataFrame, flank: int, unique: int = 60) -> DataFrame:
    """reads without the uniquely placed ones that start away from all sites."""
    regions = sites.select("chrom", (F.col("pos") - flank).alias("start"), (F.col("pos") + flank + 1).alias("end")).distinct()
    return reads.filter(F.col("mapq") < unique).unionByName(points_in(reads.filter(F.col("mapq") >= unique), regions, how="left_semi"))
