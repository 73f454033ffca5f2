"""Site records from reads, in one plan: scan, clusters, filter, labels, all columns of schema.SITE.

Aligning clipped parts and mates to the consensus is the aligner's work; its results are two tables. clip_hits: qname, side,
start, cigar, is_rc, mapq, is_unmapped, a row for each part of scan.clipped_parts() that was aligned; pair_hits: qname, start,
cigar, is_rc, mapq, is_unmapped, seq, a row for each mate of scan.discordant_pairs().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..config import Config
from ..functions import seq as S
from ..shared import written
from . import consistency, realigned, rules, scan
from .features import genotype_evidence

KEY = ["chrom", "site"]


@dataclass(frozen=True)
class Call:
    """clips and pairs: least numbers; consensus: its length without polyA; end: the bases at its end that a site has to reach."""

    clips: int = 3
    pairs: int = 5
    extend: int = 500
    window: int = 200
    coverage: float = 30.0
    consensus: int = 6050
    end: int = 100
    spread: int = 200
    share: float = 0.4
    sva: bool = False
    rna_mediated: bool = True


def records(reads: DataFrame, sites: DataFrame, clip_hits: DataFrame, pair_hits: DataFrame, call: Call = Call(), config: Config = Config()) -> DataFrame:
    """reads (schema.READ) around sites (chrom, pos) -> the site records of those that stay, and high_confident.

    A site needs clips (of both sides together, or over half as many on one), clusters of pairs, and genotype features. The
    refined position is the left breakpoint, or the right one where there is no left one or the right side has more clips.
    polyA counts are negative where most are of T. Copy label, gene and genotype are left null.
    """
    # reads are looked at once; all that is asked of them comes from short rows, and aligned parts meet the sites as numbers
    told = written(scan.summary(reads, config), "reads")
    wide = max(call.extend, call.window)
    levels = {x: scan.levels_at(told, x) for x in {call.extend, wide}}
    read = {"begins": F.col("start"), "ends": F.col("end"), "sample": F.lit("")}

    def met(rows: DataFrame) -> DataFrame:
        return scan.at(rows.withColumnsRenamed({"begins": "start", "ends": "end"}), sites, call.extend, levels[call.extend])

    ends = F.array_compact(F.array(*(F.when(F.col(x).isNotNull(), F.struct(F.lit(s).alias("side"), at.alias("ref_pos"), F.col(x).alias("seq"))) for s, at, x in (("L", F.col("pos"), "l_part"), ("R", F.col("place"), "r_part")))))
    parts = told.filter("l_part is not null or r_part is not null").select("chrom", "qname", *(v.alias(k) for k, v in read.items()), F.inline(ends)).join(clip_hits, ["qname", "side"])
    as_aligned = F.when(F.col("is_rc"), S.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    clips = met(realigned.clips_on_consensus(parts.withColumn("seq", as_aligned), config)).filter(F.abs(F.col("ref_pos") - F.col("site")) <= realigned.NEAR)
    clips = written(clips, "clips")
    near = written(scan.at(told.drop("l_part", "r_part", "paired", "is_rc", "mate_rc", "anchor_lclip", "anchor_rclip").withColumns({"begins": F.col("start"), "ends": F.col("end")}), sites, wide, levels[wide]), "near")
    within = near.filter((F.col("begins") < F.col("site") + call.extend) & (F.col("ends") > F.col("site") - call.extend))
    sides = [consistency.clip_side(clips.filter(F.col("side") == s).select(*KEY, F.col("ref_pos").alias("ref"), "cns"), KEY) for s in "LR"]
    alone = written(consistency.clips_alone(*sides, KEY, call.clips, scan.poor_clips(within.filter("clip_at is not null"))), "clip-sites")
    pairs = told.filter("paired").select("chrom", "qname", *(v.alias(k) for k, v in read.items()), F.col("place").alias("anchor"), F.col("is_rc").alias("anchor_rc"), "mate_rc", "anchor_lclip", "anchor_rclip").join(pair_hits, "qname")
    mates = met(realigned.pairs_on_consensus(pairs, config))
    mates = mates.join(alone.select(*KEY, F.coalesce("l_peak", "r_peak").alias("clip_pos")), KEY)
    clusters = consistency.pair_clusters(mates, KEY, call.spread, call.share, call.pairs)
    depths = scan.depths(near, call.window)
    out = consistency.assemble(alone, clusters, depths, KEY, config.tsd_cutoff)
    out = out.join(realigned.polya_counts(clips), KEY, "left").join(genotype_evidence(within, config), KEY)
    zero = F.lit(0)
    for s in "lr":
        n, forward = F.coalesce(f"n_{s}polya", zero), F.coalesce(f"n_{s}polya_forward", zero)
        out = out.withColumns({f"n_all_{s}polya": n, f"_{s}p": F.when(forward < n - forward, -n).otherwise(n)})
    out = out.drop("n_lpolya", "n_rpolya").withColumnsRenamed({"_lp": "n_lpolya", "_rp": "n_rpolya"})
    right = F.col("lclip_pos").isNull() | (F.col("n_all_rclip") > F.col("n_all_lclip"))
    out = out.withColumns({
        "pos": F.when(right, F.col("rclip_pos")).otherwise(F.col("lclip_pos")), "tsd": F.abs(F.col("rclip_pos") - F.col("lclip_pos")), "mean_cov": F.lit(call.coverage), "td_src": F.lit("not_transduction"),
        **{f"n_{x}": F.col(f"n_all_{x}") for x in ("lclip", "rclip", "ldisc", "rdisc")}})
    steps, marks = consistency.evidence_rules(call.clips, call.pairs, config.insert_size, call.consensus - call.end, sva=call.sva, config=config, rna_mediated=call.rna_mediated)
    kept = rules.post_filter(out, steps).filter("reason is null").withColumns(marks)
    label, sure = rules.site_label(F.col("low_confident"), config)

    def bounds(x: str) -> Column:
        return F.when(F.col(f"{x}_start").isNotNull() & F.col(f"{x}_end").isNotNull(), F.concat_ws(":", F.col(f"{x}_start").cast("string"), F.col(f"{x}_end").cast("string")))

    own = {
        **{f"{name}_cns": bounds(x) for name, x in (("lclip", "lc"), ("rclip", "rc"), ("ldisc", "ld"), ("rdisc", "rd"))}, "td_src": F.lit(None), "n_td_clip": zero, "n_td_disc": zero, "n_td_polya": zero, "inversion": rules.inversion(), "sub_type": label,
        "consistent": F.when(F.col("high_confident"), "both_end_consistent").otherwise("one_end_consistent"), "hit_end": F.when(F.col("reaches_end"), "hit_end_of_consensus").otherwise("not_hit_end_of_consensus"), "n_indel": F.col("n_large_indel"),
        "clip_lens": F.when(F.size("clip_lens") > 0, F.array_join(F.transform("clip_lens", lambda x: x.cast("string")), ":")), "ins_len": rules.insertion_length(call.consensus), "ref_copy": F.lit(None), "gene": F.lit(None), "genotype": F.lit(None)}
    return kept.select(*(own.get(f.name, F.col(f.name) if f.name in kept.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.SITE), sure.alias("high_confident"))
