"""Insertions on assembled contigs, by where a site's two flanks lie on them.

Alignments of flanks have the site's key (chrom, pos), the group of reads that the contigs are of (all, hap1, hap2, unknown
or discord), flank ("left" or "right"), contig, start, cigar, is_rc, and the flags of schema.READ. Of a flank's alignments
the primary one counts; should there be several, that of least contig and start. A site is one row of a grouping, and
inserted bases are cut out after one join with the contigs: nothing is paired up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C

SITE = ["chrom", "pos"]
#: A clip of so many bases at the inner end of a flank; the least inserted bases; the share of them that has to lie on a copy.
INNER_CLIP, LEAST_INSERT, ON_COPY = 100, 35, 0.5
#: The groups in the order in which they are looked at, and their labels.
GROUPS = {"all": "all", "hap1": "hap1", "hap2": "hap2", "unknown": "unknown", "discord": "discord"}
WHOLE = "homoTEI"


def _primary(flanks: DataFrame) -> DataFrame:
    return flanks.filter(~F.col("is_secondary") & ~F.col("is_supplementary") & ~F.col("is_unmapped") & ~F.col("is_duplicate") & (F.size("cigar") > 0))


def _sides(flanks: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: l and r, each (contig, start, n, is_rc) or null; n is how many bases are matched."""
    one = F.struct("contig", "start", C.total(F.col("cigar"), (0,)).alias("n"), "is_rc")
    return flanks.groupBy(*key).agg(*(F.min(F.when(F.col("flank") == name, one)).alias(x) for x, name in (("l", "left"), ("r", "right"))))


def _mapped(flanks: DataFrame, length: int, ratio: float) -> DataFrame:
    return _primary(flanks).filter(C.total(F.col("cigar"), (0,)) / length >= ratio)


def without_plain_sites(flanks: DataFrame, length: int, ratio: float, slack: int) -> DataFrame:
    """The sites (chrom, pos) of the flanks but for those whose flanks follow each other on one contig with nothing between:

    both mapped for that share of their length, on one strand, starting less than length + slack apart.
    """
    plain = _sides(_mapped(flanks, length, ratio), SITE).filter((F.col("l.contig") == F.col("r.contig")) & (F.col("l.is_rc") == F.col("r.is_rc")) & (F.abs(F.col("r.start") - F.col("l.start")) < length + slack))
    return flanks.select(*SITE).distinct().join(plain.select(*SITE), SITE, "left_anti")


def paired(flanks: DataFrame, length: int, ratio: float, slack: int) -> DataFrame:
    """flanks -> a row for each site and group with a flank: l, r, first, last, same and verdict.

    A flank counts if it is mapped for that share of its length and isn't clipped for INNER_CLIP bases at the end where the
    insertion begins. verdict: "strict" (both on one contig and strand, with `slack` bases or more between), "loose" (one of
    them alone, or both on different contigs) or "none" (one contig, but strands differ, or too little between). [first, last)
    is what lies between on the contig of a strict pair.
    """
    cigar, rc = F.col("cigar"), F.col("is_rc")

    def clip(x: Column) -> Column:
        return F.coalesce((x["op"] == 4) & (x["len"] >= INNER_CLIP), F.lit(False))

    # a left flank's inner end is its right one, on the other strand its left one
    inner_is_last = (F.col("flank") == "left") != rc
    usable = _mapped(flanks, length, ratio).filter(~F.when(inner_is_last, clip(C.last(cigar))).otherwise(clip(C.first(cigar))))
    out = _sides(usable, [*SITE, "group"])
    before, after = (F.when(F.col("l.is_rc"), F.col(a)).otherwise(F.col(b)) for a, b in (("r", "l"), ("l", "r")))
    same = F.coalesce(F.col("l.contig") == F.col("r.contig"), F.lit(False))
    out = out.withColumns({"same": same, "first": F.when(same, before["start"] + before["n"]), "last": F.when(same, after["start"])})
    good = (F.col("l.is_rc") == F.col("r.is_rc")) & (F.col("last") >= F.col("first")) & (F.col("last") - F.col("first") >= slack)
    return out.withColumn("verdict", F.when(~F.col("same"), "loose").when(good, "strict").otherwise("none"))


def inserted(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """paired() and contigs (chrom, pos, group, contig, seq) -> a row for each inserted part: part ("whole", "left" or "right") and seq.

    Of a strict pair what lies between; of a loose one the contigs' ends beyond the left flank and before the right one. Parts
    without bases are left out.
    """
    def cut(name: str, x: str, first: Column, last: Column) -> Column:
        return F.when(F.col(x).isNotNull(), F.struct(F.lit(name).alias("part"), F.col(f"{x}.contig").alias("contig"), first.cast("long").alias("first"), last.cast("long").alias("last")))

    end = F.lit(None)
    left = cut("left", "l", F.when(F.col("l.is_rc"), 0).otherwise(F.col("l.start") + F.col("l.n")), F.when(F.col("l.is_rc"), F.col("l.start")).otherwise(end))
    right = cut("right", "r", F.when(F.col("r.is_rc"), F.col("r.start") + F.col("r.n")).otherwise(0), F.when(F.col("r.is_rc"), end).otherwise(F.col("r.start")))
    cuts = F.when(F.col("verdict") == "strict", F.array(cut("whole", "l", F.col("first"), F.col("last")))).when(F.col("verdict") == "loose", F.array_compact(F.array(left, right)))
    # the cuts are hashed, so that contigs pass by unsorted
    parts = contigs.select(*SITE, "group", "contig", F.col("seq").alias("_seq")).join(pairs.select(*SITE, "group", F.inline(cuts)).hint("shuffle_hash"), [*SITE, "group", "contig"])
    seq = F.substring(F.col("_seq"), (F.col("first") + 1).cast("int"), (F.coalesce("last", F.length("_seq")) - F.col("first")).cast("int"))
    return parts.select(*SITE, "group", "part", "contig", seq.alias("seq")).filter(F.col("seq") != "")


def labelled(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """inserted() -> parts of LEAST_INSERT bases or more with a label and its rank; groups: (chrom, pos) of the sites that have contigs of all reads.

    Without such contigs a site has no label. A whole insertion there is in both haplotypes and ends the search; else parts
    are named by group and side, whole ones by the group alone, but those of all reads always have a side.
    """
    long = parts.join(groups.select(*SITE).distinct(), SITE, "left_semi").filter(F.length("seq") >= LEAST_INSERT)
    first = F.col("group").eqNullSafe("all") & (F.col("part") == "whole")
    # a window, as it reads the cut parts once
    long = long.withColumn("_both", F.max(first).over(Window.partitionBy(*SITE)))
    order = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("group"))
    side = F.when(F.col("part") == "left", "L").when(F.col("part") == "right", "R").otherwise("")
    label = F.when(first, WHOLE).otherwise(F.concat(F.element_at(F.create_map(*(F.lit(x) for kv in GROUPS.items() for x in kv)), F.col("group")), side))
    rank = order * 3 + F.when(F.col("part") == "left", 1).when(F.col("part") == "right", 2).otherwise(0)
    return long.filter(~F.coalesce("_both", F.lit(False)) | first).select(*SITE, label.alias("label"), rank.cast("int").alias("rank"), "seq")


def called(labels: DataFrame, copies: DataFrame) -> DataFrame:
    """labelled() and alignments of its parts to copies of the repeat (chrom, pos, label, cigar and flags) -> one call a site.

    Parts count whose matched share is ON_COPY or more. The last one by rank is the call: label and n, its matched bases;
    both: whether it is a whole insertion, whose n is that of both sides of its group together if these have more.
    """
    on = _primary(copies).filter(C.qualified_share(F.col("cigar")) >= ON_COPY)
    hits = on.groupBy(*SITE, "label").agg(F.max(C.total(F.col("cigar"), (0,))).alias("n")).join(labels.select(*SITE, "label", "rank"), [*SITE, "label"])
    group = F.regexp_replace("label", "[LR]$", "")
    sides = hits.withColumn("name", group).groupBy(*SITE, "name").agg(
        F.max_by(F.struct("label", "rank", "n"), "rank").alias("top"), F.max(F.when(F.col("label") == F.col("name"), F.col("n"))).alias("whole"),
        F.max(F.when(F.col("label").endswith("L"), F.col("n"))).alias("left"), F.max(F.when(F.col("label").endswith("R"), F.col("n"))).alias("right"))
    both = F.col("top.label") == F.col("name")
    n = F.when(both, F.greatest(F.col("whole"), F.col("left") + F.col("right"))).otherwise(F.col("top.n"))
    return sides.select(*SITE, F.struct("top.rank", "top.label", n.alias("n"), both.alias("both")).alias("x")).groupBy(*SITE).agg(F.max("x").alias("x")).select(*SITE, "x.label", "x.n", "x.both")


def masked_parts(alignments: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Alignments of contig ends to the consensus (chrom, pos, side, start, cigar, seq, is_unmapped) -> what is masked and what is left.

    masked: one row a site with the leftmost consensus position and the sorted masked sequences of `least` bases or more;
    rest: a row for each clipped part of those, to be aligned once more.
    """
    a = alignments.filter(~F.col("is_unmapped") & (F.size("cigar") > 0))
    ln, rn = (F.when(end["op"] == 4, end["len"]).otherwise(0) for end in (C.first(F.col("cigar")), C.last(F.col("cigar"))))
    one = F.size("cigar") == 1
    a = a.withColumns({"_l": ln, "_r": F.when(one, 0).otherwise(rn)})
    masked = F.substring(F.col("seq"), F.col("_l") + 1, F.length("seq") - F.col("_l") - F.col("_r"))
    touched = (one & (C.first(F.col("cigar"))["op"] == 0)) | (F.col("_l") > 0) | (F.col("_r") > 0)
    a = a.withColumn("masked", masked).filter(touched & (F.length("masked") >= least))
    whole = a.groupBy(*SITE).agg(F.min("start").alias("start"), F.sort_array(F.collect_list("masked")).alias("seqs"))
    parts = F.array(F.struct(F.lit("L").alias("end"), F.substring(F.col("seq"), F.lit(1), F.col("_l")).alias("part")), F.struct(F.lit("R").alias("end"), F.right("seq", F.col("_r")).alias("part")))
    return whole, a.select(*SITE, "side", F.inline(parts)).filter("part <> ''")
