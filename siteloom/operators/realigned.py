"""Realigned parts of reads: where on the consensus they lie, and which come from flanks of a source.

Parts are clipped ends or mates of discordant reads that were aligned once more, to the consensus, to copies of the repeat
with flanks on both sides, or to the flanks of sources. A part's row has the site's key (chrom, site, sample), cigar, start,
is_rc, mapq, is_unmapped and seq, as aligned (a part on the other strand is reverse complemented); clips also have side ("L"
or "R") and ref_pos, the breakpoint. Each function maps rows to rows; counters() groups them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import cigar as C
from ..functions import seq as S

SITE = ["chrom", "site"]
#: How near a clip is to its site, the bases of its inner end that are looked at, the least mapping quality on a flank, and the distances at flanks' borders and from a source.
NEAR, TAIL, FLANK_MAPQ, CLIP_BORDER, PAIR_BORDER, OWN_SOURCE, RUN = 50, 20, 10, 5, 15, 1000, 5


def _usable(parts: DataFrame, ratio: float) -> DataFrame:
    return parts.filter(~F.col("is_unmapped") & (F.size("cigar") > 0) & C.qualified(F.col("cigar"), ratio)).withColumns({"_n": C.total(F.col("cigar"), (0,))})


def _clips(parts: DataFrame, ratio: float) -> DataFrame:
    near = parts.filter(F.abs(F.col("ref_pos") - F.col("site")) <= NEAR) if "site" in parts.columns else parts
    return _usable(near, ratio).withColumn("_left", F.col("side") == "L")


def _where(parts: DataFrame) -> list[str]:
    """The site; parts that haven't met sites have where their read begins and ends."""
    return SITE if "site" in parts.columns else ["chrom", "begins", "ends"]


def _inner() -> Column:
    """The bases of a clip next to its breakpoint: the end of a left clip, the start of a right one; the other way round on the other strand."""
    return F.when(F.col("_left") != F.col("is_rc"), F.right("seq", F.lit(TAIL))).otherwise(F.substring("seq", 1, TAIL))


def _breakpoint() -> Column:
    """Where the clip's breakpoint is on what it is aligned to: past its matched bases, or at its start."""
    return F.col("start") + F.when(F.col("is_rc") == F.col("_left"), F.col("_n")).otherwise(0)


def _on_consensus(at: Column, flank: int) -> Column:
    """A place on a copy with its flank as a place on the consensus; -1 where the copy isn't known."""
    off = F.when(F.col("copy_rc"), F.col("cns_end") - F.col("cns_start") - at + flank).otherwise(at - flank)
    return F.coalesce(F.col("cns_start") + off, F.lit(-1))


def _copies(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    known = repeats.groupBy(F.col("chrom").alias("_cc"), F.col("start").alias("_cs")).agg(F.min(F.struct("cns_start", "cns_end", F.col("is_rc").alias("copy_rc"))).alias("_k"))
    out = rows.join(known, (F.col("copy_chrom") == F.col("_cc")) & (F.col("copy_start") == F.col("_cs")), "left")
    return out.select(*rows.columns, F.col("_k.cns_start").alias("cns_start"), F.col("_k.cns_end").alias("cns_end"), F.col("_k.copy_rc").alias("copy_rc"))


def _source() -> Column:
    return F.concat_ws("~", "copy_chrom", F.col("copy_start").cast("string"), F.col("copy_end").cast("string"))


def clips_on_consensus(parts: DataFrame, config: Config = Config()) -> DataFrame:
    """Clips aligned to the consensus -> (SITE, sample, side, ref_pos, cns, polya, forward): polya tells of A next to the breakpoint.

    Parts without a site have chrom, begins and ends instead; whether they are NEAR it is left to where they meet one.
    """
    rows = _clips(parts, config.clip_mapped_ratio)
    return rows.select(*_where(parts), "sample", "side", "ref_pos", _breakpoint().cast("long").alias("cns"), S.has_any(_inner(), S.POLY_A).alias("polya"), (~F.col("is_rc")).alias("forward"))


def clips_on_copies(parts: DataFrame, repeats: DataFrame, flank: int, config: Config = Config()) -> DataFrame:
    """Clips aligned to copies (copy_chrom, copy_start, copy_end) with flanks -> (SITE, sample, side, ref_pos, kind, cns, source, at, polya).

    kind "body" has cns, the place on the consensus by the copy's own (repeats: chrom, start, cns_start, cns_end, is_rc; of
    repeated rows the least), or -1; "flank" has source and at, the place on the copy. Parts on a flank count if they are
    well placed and have no run of A or T; others there are "lost": only their polya counts.
    """
    rows = _copies(_clips(parts, config.clip_mapped_ratio), repeats)
    polya = S.has_run_a_t(F.col("seq"), RUN)
    on_flank = (F.col("start") < flank - CLIP_BORDER) | (F.col("start") > F.col("copy_end") - F.col("copy_start") + flank - CLIP_BORDER)
    kind = F.when(~on_flank, "body").when((F.col("mapq") >= FLANK_MAPQ) & ~polya, "flank").otherwise("lost")
    rows = rows.withColumns({"kind": kind, "polya": polya})
    body, td = F.col("kind") == "body", F.col("kind") == "flank"
    return rows.select(*SITE, "sample", "side", "ref_pos", "kind", F.when(body, _on_consensus(_breakpoint(), flank)).cast("long").alias("cns"), F.when(td, _source()).alias("source"), F.when(td, F.col("start")).cast("long").alias("at"), "polya")


def pairs_on_consensus(parts: DataFrame, config: Config = Config()) -> DataFrame:
    """Mates aligned to the consensus (with anchor, anchor_rc, mate_rc, anchor_lclip, anchor_rclip) -> those, cns (the middle), polya and same_ori: whether mate and anchor point the same way."""
    rows = _usable(parts, config.disc_mapped_ratio)
    middle = F.col("start") + F.floor(F.length("seq") / 2)
    return rows.select(*_where(parts), "sample", "anchor", "anchor_lclip", "anchor_rclip", "anchor_rc", middle.cast("long").alias("cns"), C.same_orientation(F.col("is_rc"), F.col("mate_rc"), F.col("anchor_rc")).alias("same_ori"), S.consecutive_a_t(F.col("seq")).alias("polya"))


def pairs_on_copies(parts: DataFrame, repeats: DataFrame, flank: int, config: Config = Config()) -> DataFrame:
    """Mates aligned to copies with flanks -> (SITE, sample, kind, cns, source, at, polya), as clips_on_copies().

    A mate before the copy has to be well placed to be of the flank, one beyond it hasn't; a run of A or T keeps either with
    the body. cns is of the mate's middle, null where the copy isn't known.
    """
    rows = _copies(_usable(parts, config.disc_mapped_ratio), repeats)
    polya = S.has_run_a_t(F.col("seq"), RUN)
    before = (F.col("mapq") >= FLANK_MAPQ) & (F.col("start") < flank - PAIR_BORDER)
    beyond = F.col("start") > F.col("copy_end") - F.col("copy_start") + flank - PAIR_BORDER
    td = (before | beyond) & ~polya
    cns = F.when(~td & F.col("cns_start").isNotNull(), _on_consensus(F.col("start") + F.floor(F.length("seq") / 2), flank))
    return rows.select(*SITE, "sample", F.when(td, "flank").otherwise("body").alias("kind"), cns.cast("long").alias("cns"), F.when(td, _source()).alias("source"), F.when(td, F.col("start")).cast("long").alias("at"), polya.alias("polya"))


def clips_on_flanks(parts: DataFrame, flank: int, config: Config = Config()) -> DataFrame:
    """Clips aligned to the flanks of sources (src_chrom, src_start, src_end, src_rc, and flank_side, "L" before the source or "R" after it) -> (SITE, side, ref_pos, source, ref_at, base).

    Clips whose breakpoint lies within OWN_SOURCE bases of either end of that source are left out: the site is the source.
    Parts on a decoy sequence have no src_chrom; they have no source and are at the site. ref_at is the place on the
    reference. base: which of A and T the inner end has, as it was read: "A", "T", "AT" for both, null for none.
    """
    rows = _clips(parts, config.td_mapped_ratio)
    own = (F.col("chrom") == F.col("src_chrom")) & ((F.abs(F.col("ref_pos") - F.col("src_start")) < OWN_SOURCE) | (F.abs(F.col("ref_pos") - F.col("src_end")) < OWN_SOURCE))
    rows = rows.filter(~F.coalesce(own, F.lit(False)))
    inner = F.when(F.col("is_rc"), S.reverse_complement(_inner())).otherwise(_inner())
    a, t = S.has_any(inner, S.POLY_A), S.has_any(inner, S.POLY_T)
    base = F.when(a & t, "AT").when(a, "A").when(t, "T")
    bare = F.when(F.col("chrom").startswith("chr"), F.col("src_chrom")).otherwise(F.regexp_replace("src_chrom", "^chr(?=.)", ""))
    name = F.when(F.col("src_chrom").isNotNull(), F.concat(bare, F.lit(":"), F.col("src_start").cast("string"), F.lit("-"), F.col("src_end").cast("string"), F.lit("~"), F.when(F.col("src_rc"), "1").otherwise("0")))
    at = F.when(F.col("src_chrom").isNull(), F.col("site")).when(F.col("flank_side") == "L", F.col("src_start") - flank + F.col("start")).otherwise(F.col("src_end") + F.col("start"))
    return rows.select(*SITE, "side", "ref_pos", name.alias("source"), at.cast("long").alias("ref_at"), base.alias("base"))


def tail_counts(clips: DataFrame) -> DataFrame:
    """clips_on_flanks() -> one row a site with the six counters of A and T: left and right A, left and right T, left and right both."""
    return clips.groupBy(*SITE).agg(*(F.count_if((F.col("side") == side) & (F.col("base") == base)).alias(f"n_{side.lower()}{name}") for base, name in (("A", "polya"), ("T", "polyt"), ("AT", "both")) for side in "LR"))


def polya_counts(clips: DataFrame) -> DataFrame:
    """clips_on_consensus() -> one row a site: polyA of left and right clips, and how many of these lie forward on the consensus."""
    return clips.groupBy(*SITE).agg(*(F.count_if((F.col("side") == s) & F.col("polya") & x).alias(f"n_{s.lower()}{n}") for n, x in (("polya", F.lit(True)), ("polya_forward", F.col("forward"))) for s in "LR"))


def sample_counts(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """Rows by site and sample: n, and for clips n_left and n_right; kind: of these only."""
    rows = rows.filter(F.col("kind") == kind) if kind else rows
    sides = [F.count_if(F.col("side") == s).alias(n) for s, n in (("L", "n_left"), ("R", "n_right"))] if "side" in rows.columns else []
    return rows.groupBy(*SITE, "sample").agg(F.count("*").alias("n"), *sides)
