"""Consistency of a site's evidence: clusters of clips and pairs on the consensus, samples, and the filter over both.

Sites are named by the columns of a key. Every step is a grouping by the key, or by the key and a position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .cluster import islands, max_cover, two_peaks
from .rules import hit


def consensus_cluster(df: DataFrame, key: list[str], gap: int, ratio: float) -> DataFrame:
    """df (key, cns; one row a read) -> key, start, end, n of the gap cluster with most reads (of ties the first), and `consistent`:

    whether that share of the distinct positions lies in it.
    """
    at = df.groupBy(*key, F.col("cns").alias("pos")).agg(F.count("*").alias("n"))
    groups = islands(at, gap, key=key).groupBy(*key, "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.sum("n").alias("n"), F.count("*").alias("k"))
    best = groups.groupBy(*key).agg(F.max_by(F.struct("start", "end", "n", "k"), F.struct("n", F.negate("island"))).alias("b"), F.sum("k").alias("all"))
    return best.select(*key, "b.start", "b.end", "b.n", (F.col("b.k") >= ratio * F.col("all")).alias("consistent"))


def clip_side(df: DataFrame, key: list[str], gap: int = 15, ratio: float = 0.4, before: int = 7, after: int = 6) -> DataFrame:
    """df (key, ref, cns; one row a clip of one side) -> key, peak and n of the densest window on the reference, and the cluster that its clips form on the consensus."""
    at = df.groupBy(*key, F.col("ref").alias("pos")).agg(F.count("*").alias("n"))
    peak = two_peaks(at, key, before, after).select(*key, F.col("peak1").alias("peak"), F.col("n1").alias("n"))
    near = df.join(peak, key).filter((F.col("ref") >= F.col("peak") - before) & (F.col("ref") <= F.col("peak") + after))
    found = consensus_cluster(near, key, gap, ratio).select(*key, "start", "end", "consistent")
    return peak.join(found, key, "left")


def clips_alone(left: DataFrame, right: DataFrame, key: list[str], cutoff: int, low_quality: DataFrame | None = None, most_low: float = 0.65) -> DataFrame:
    """clip_side() of both sides -> sites with enough clips: `cutoff` on both sides together, or over half of it on one side alone.

    low_quality (key, n_low): sites where these are over that share of all clips go.
    """
    def named(df: DataFrame, x: str) -> DataFrame:
        return df.select(*key, *(F.col(c).alias(f"{x}_{c}") for c in ("peak", "n", "start", "end")))

    both = named(left, "l").join(named(right, "r"), key, "full")
    n = F.coalesce("l_n", F.lit(0)) + F.coalesce("r_n", F.lit(0))
    two = F.col("l_n").isNotNull() & F.col("r_n").isNotNull()
    out = both.filter(F.when(two, n >= cutoff).otherwise(n >= cutoff / 2 + 1))
    if low_quality is not None:
        out = out.join(low_quality, key, "left").filter(~F.coalesce(F.col("n_low") > most_low * (F.col("n_low") + n), F.lit(False))).drop("n_low")
    return out.withColumns({"only_left": F.col("r_n").isNull(), "only_right": F.col("l_n").isNull()})


def in_all_samples(counts: DataFrame, key: list[str], n_samples: int, cutoff: int, every: bool = False) -> DataFrame:
    """counts (key, sample, n) -> the keys where as many samples as there are have `cutoff` or more; every: and none has less."""
    enough = F.count_if(F.col("n") >= cutoff)
    out = counts.groupBy(*key).agg(F.count("*").alias("n_seen"), enough.alias("n_enough"))
    ok = (F.col("n_seen") >= n_samples) & ((F.col("n_enough") == F.col("n_seen")) if every else (F.col("n_enough") >= n_samples))
    return out.filter(ok).select(*key)


def pair_side(near: int = 50) -> Column:
    """L or R, for a discordant read with anchor, clip_pos, anchor_lclip and anchor_rclip: by its clip where that lies near, else by its place."""
    close = F.abs(F.col("anchor") - F.col("clip_pos")) < near
    l, r = F.col("anchor_lclip"), F.col("anchor_rclip")
    return F.when(close & l & ~r, "R").when(close & r & ~l, "L").when(F.col("anchor") < F.col("clip_pos"), "L").otherwise("R")


def pair_clusters(df: DataFrame, key: list[str], distance: int, ratio: float, cutoff: int, transduction: bool = False) -> DataFrame:
    """df (key, cns, anchor, clip_pos, anchor_lclip, anchor_rclip, same_ori, anchor_rc) -> clusters of both sides and orientation counts.

    A site stays where one side forms a cluster; with two, they need `cutoff` pairs together. Sides without a cluster have
    null bounds. transduction: one side alone needs half the cutoff.
    """
    rows = df.withColumn("side", pair_side())
    found = max_cover(rows.select(*key, "side", F.col("cns").alias("pos")), distance, ratio, [*key, "side"])
    counts = rows.groupBy(*key, "side").agg(F.count("*").alias("n"), F.count_if("same_ori").alias("n_same"), F.count_if(~F.col("same_ori")).alias("n_diff"), F.count_if("anchor_rc").alias("n_rc"), F.count_if(~F.col("anchor_rc")).alias("n_not_rc"))
    each = counts.join(found.select(*key, "side", "is_cluster", "start", "end"), [*key, "side"])

    def of(side: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(c)))

    names = ("n", "n_same", "n_diff", "n_rc", "n_not_rc")
    out = each.groupBy(*key).agg(
        *(F.coalesce(of(s, c), F.lit(0)).alias(f"{s.lower()}_{c}") for s in "LR" for c in names), *(F.coalesce(of(s, "is_cluster"), F.lit(False)).alias(f"{s.lower()}_cluster") for s in "LR"),
        *(F.max(F.when((F.col("side") == s) & F.col("is_cluster"), F.col(c))).alias(f"{s.lower()}_{c}") for s in "LR" for c in ("start", "end")))
    l, r = F.col("l_cluster"), F.col("r_cluster")
    stays = (l | r) & ~(l & r & (F.col("l_n") + F.col("r_n") < cutoff))
    if transduction:
        stays = stays & ~(l & ~r & (F.col("l_n") < cutoff / 2)) & ~(r & ~l & (F.col("r_n") < cutoff / 2))
    return out.filter(stays)


def best_pair(l1: Column, l2: Column, r1: Column, r2: Column, l1n: Column, l2n: Column, r1n: Column, r2n: Column, cutoff: int) -> Column:
    """(l, r, is_tsd): the first peaks if they lie within the cutoff, else the pair of a first and a second one that does (of two, that with more clips), else the first ones."""
    def pair(l: Column, r: Column, tsd: bool) -> Column:
        return F.struct(l.alias("l"), r.alias("r"), F.lit(tsd).alias("is_tsd"))

    def near(a: Column, b: Column) -> Column:
        return F.coalesce(F.abs(a - b) <= cutoff, F.lit(False))

    a, b = near(l1, r2), near(l2, r1)
    more = F.coalesce(l1n + r2n > l2n + r1n, F.lit(True))
    return F.when(near(l1, r1), pair(l1, r1, True)).when(a & (~b | more), pair(l1, r2, True)).when(b, pair(l2, r1, True)).otherwise(pair(l1, r1, False))


def depth_differs(l: Column, r: Column, left: bool, ratio: float = 0.35) -> Column:
    """The depth of one side lies by that share under the other's; without depth on the other it doesn't."""
    low, high = (l, r) if left else (r, l)
    return F.coalesce((high > 0) & ((high - low) / F.nullif(high, F.lit(0.0)) >= ratio), F.lit(False))


def regions_meet(s1: Column, e1: Column, s2: Column, e2: Column, insert_size: float) -> Column:
    """An end of the first region lies in the second, once both are widened by half an insert size."""
    w = insert_size / 2 + 1
    a, b, p, q = s1 - w, e1 + w, s2 - w, e2 + w
    return F.coalesce(((a >= p) & (a <= q)) | ((b >= p) & (b <= q)), F.lit(False))


def orientation_consistent(l_rc: Column, l_not: Column, r_rc: Column, r_not: Column, ratio: float) -> Column:
    """Left anchors are mostly forward, right ones mostly reverse; a side without any is."""
    def ok(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(a + b, F.lit(0)) >= ratio, F.lit(True))

    return ok(l_not, l_rc) & ok(r_rc, r_not)


def full_length(leftmost: int) -> Column:
    """A cluster begins within the first `leftmost` bases of the consensus."""
    out = F.lit(False)
    for s in ("lc", "rc", "ld", "rd"):
        at = F.col(f"{s}_start")
        out = out | F.coalesce((at > 0) & (at <= leftmost), F.lit(False))
    return out


def evidence_rules(clip: int, disc: int, insert_size: float, tail: int, ratio: float = 0.35, sva: bool = False, config: Config = Config(), rna_mediated: bool = True) -> tuple[list[tuple[str, Column]], dict[str, Column]]:
    """(rules, marks) over site records with their clusters, counts and depths.

    Transductions only have to have like depths on both sides. rna_mediated: whether sites of this type are expected to have
    polyA; if not, its lack drops none, and both sides suffice for high confidence. marks, for sites that stay: both_consistent (high
    confidence), low_confident (a side without evidence and no lower depth there) and hit_end.
    """
    c = F.col
    td = c("td_src").isNotNull() & ~c("td_src").contains("not_transduction")
    left_low, right_low = depth_differs(c("lcov"), c("rcov"), True, ratio), depth_differs(c("lcov"), c("rcov"), False, ratio)
    lc, rc, ld, rd = c("n_all_lclip") >= clip, c("n_all_rclip") >= clip, c("n_all_ldisc") >= disc, c("n_all_rdisc") >= disc

    def meet(a: str, b: str) -> Column:
        a1, a2, b1, b2 = (F.coalesce(c(x), F.lit(-1)) for x in (f"{a}_start", f"{a}_end", f"{b}_start", f"{b}_end"))
        return regions_meet(a1, a2, b1, b2, insert_size)

    def reaches(a: str, b: str) -> Column:
        return (F.coalesce(c(f"{a}_end"), F.lit(-1)) >= tail) | (F.coalesce(c(f"{b}_end"), F.lit(-1)) >= tail)

    left, right = lc & rd & meet("lc", "rd"), rc & ld & meet("rc", "ld")
    tailed_disc, tailed_clip = reaches("ld", "rd"), reaches("lc", "rc")
    no_polya = F.lit(rna_mediated) & (c("n_all_lpolya") == 0) & (c("n_all_rpolya") == 0)
    part_clip = (~lc & right_low) | (~rc & left_low)
    plain = ~td
    rules = [
        ("td_depth", td & (left_low | right_low)),
        ("no_side_consistent", plain & ~left & ~right & ~F.lit(sva)),
        ("clips_without_pairs", plain & lc & ~rd & rc & ~ld),
        ("no_polya", plain & no_polya & lc & rc & ~tailed_disc & ~tailed_clip),
        ("no_end", plain & ~tailed_disc & ld & rd & ~tailed_clip & ~part_clip),
    ]
    side_missing = ((c("n_all_ldisc") < disc) & (c("n_all_rclip") <= 0) & ~left_low) | ((c("n_all_rdisc") < disc) & (c("n_all_lclip") <= 0) & ~right_low)
    marks = {"high_confident": plain & left & right & ~no_polya, "low_confident": plain & side_missing, "reaches_end": td | tailed_disc | tailed_clip}
    return rules, marks


def assemble(clips: DataFrame, pairs: DataFrame, depths: DataFrame, key: list[str], tsd_cutoff: int = 100) -> DataFrame:
    """clips_alone(), pair_clusters() and depths (key, lcov, rcov) -> site records under the names of schema.SITE, for the sites that all have.

    The refined position is the left breakpoint, else the right one; pos stays the site's own. Bounds stay null where
    there is no cluster.
    """
    c = clips.select(*key, F.col("l_peak").alias("lclip_pos"), F.col("r_peak").alias("rclip_pos"), F.coalesce("l_n", F.lit(0)).alias("n_all_lclip"), F.coalesce("r_n", F.lit(0)).alias("n_all_rclip"),
                     F.col("l_start").alias("lc_start"), F.col("l_end").alias("lc_end"), F.col("r_start").alias("rc_start"), F.col("r_end").alias("rc_end"))
    p = pairs.select(*key, F.col("l_n").alias("n_all_ldisc"), F.col("r_n").alias("n_all_rdisc"), F.col("l_n_same").alias("ldisc_same"), F.col("l_n_diff").alias("ldisc_diff"), F.col("r_n_same").alias("rdisc_same"), F.col("r_n_diff").alias("rdisc_diff"),
                     F.col("l_n_rc").alias("lanchor_rc"), F.col("l_n_not_rc").alias("lanchor_nrc"), F.col("r_n_rc").alias("ranchor_rc"), F.col("r_n_not_rc").alias("ranchor_nrc"),
                     F.col("l_start").alias("ld_start"), F.col("l_end").alias("ld_end"), F.col("r_start").alias("rd_start"), F.col("r_end").alias("rd_end"))
    out = c.join(p, key).join(depths.select(*key, "lcov", "rcov"), key)
    tsd = F.when(F.abs(F.col("rclip_pos") - F.col("lclip_pos")) <= tsd_cutoff, F.col("rclip_pos") - F.col("lclip_pos"))
    return out.withColumns({"refined": F.coalesce("lclip_pos", "rclip_pos"), "tsd": tsd, "n_clusters": sum((F.when(hit(x), 1).otherwise(0) for x in ("lc", "rc", "ld", "rd")), F.lit(0))})
