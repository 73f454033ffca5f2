"""Rules on site records: cascades of column expressions over the typed record, each with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config

c = F.col


def hit(side: str) -> Column:
    return c(f"{side}_start").isNotNull() & c(f"{side}_end").isNotNull()


def has_polya() -> Column:
    return (F.abs("n_lpolya") + F.abs("n_rpolya")) > 0


def category(config: Config = Config()) -> Column:
    """The site's class by which of its four clusters exist, with the polyA and TSD refinements."""
    lc, rc, ld, rd = (hit(x) for x in ("lc", "rc", "ld", "rd"))
    p, t = has_polya(), (c("tsd") > 0) & (c("tsd") < config.tsd_cutoff)

    def refined(name: str) -> Column:
        return F.when(p & t, f"{name}_tprt_both").when(p | t, f"{name}_tprt").otherwise(name)

    return (
        F.when((c("lcov") > config.coverage_multiple * c("mean_cov")) | (c("rcov") > config.coverage_multiple * c("mean_cov")), "high_coverage_island")
        .when(lc & rc & ld & rd, refined("two_side"))
        .when((lc & rd & ~rc & ~ld) | (rc & ld & ~lc & ~rd), "one_side")
        .when((lc & rd & (rc | ld)) | (rc & ld & (lc | rd)), refined("one_half_side"))
        .otherwise("other_type")
    )


def final_label() -> Column:
    """The class with polyA dominance."""
    share = (F.abs("n_lpolya") + F.abs("n_rpolya")) / F.nullif(c("n_l_raw") + c("n_r_raw"), F.lit(0))
    dominant = F.coalesce(share > 0.85, F.lit(False))
    return (
        F.when(dominant & c("sub_type").startswith("two_side"), "polyA_dominant_both-side_may_low_confident")
        .when(dominant & c("sub_type").startswith("one_half"), "polyA_dominant_one_half_side")
        .otherwise(c("sub_type"))
    )


def site_label(low_confident: Column | None = None, config: Config = Config()) -> tuple[Column, Column]:
    """(label, whether it is of high confidence) by the class, polyA dominance, transductions and flanks.

    Two-sided classes come first, then transductions, then those of one side and a half and of one side; with low_confident
    a one-sided site conflicts with its coverage. A site that was rescued by the flanks of a source has that label, whatever
    its class. Dominance: the polyA counts are over 0.85 of the raw clips.
    """
    kind = category(config)
    clips = c("n_l_raw") + c("n_r_raw")
    dominant = F.coalesce((clips > 0) & (F.abs("n_lpolya") + F.abs("n_rpolya") > 0.85 * clips), F.lit(False))
    flanks = F.coalesce(c("td_src") == "may_two_side_with_one_side_on_flanking", F.lit(False))
    td = c("td_src").isNotNull() & ~F.coalesce(c("td_src") == "not_transduction", F.lit(True))
    two, half, tprt = kind.startswith("two_side"), kind.startswith("one_half_side"), kind.contains("tprt")
    conflict = F.coalesce(low_confident, F.lit(False)) if low_confident is not None else F.lit(False)
    label = (
        F.when(flanks, "may_two_side_with_one_side_on_flanking").when(two & dominant, "polyA_dominant_both-side_may_low_confident").when(two, kind).when(td, "one_side_and_half_transduction")
        .when(half & dominant, "polyA_dominant_one-half-side_may_low_confident").when(half, kind).when((kind == "one_side") & conflict, "one_side_coverage_conflict").when(kind == "one_side", kind)
        .when(kind == "high_coverage_island", "high_coverage_island_low_confident").otherwise("other_type_low_confident"))
    sure = F.when(two, ~dominant | tprt).when(td, False).otherwise(half & ~dominant)
    return label, sure


def is_transduction() -> Column:
    return c("td_src").isNotNull() & ~c("td_src").contains("not_transduction") & ~c("td_src").contains("may")


def is_orphan() -> Column:
    """By the source's label."""
    return F.coalesce(c("td_src").contains("orphan"), F.lit(False))


def is_sibling() -> Column:
    return F.coalesce(c("td_src").contains("sibling"), F.lit(False))


def is_orphan_call() -> Column:
    """By the record's class."""
    return c("sub_type").contains("orphan")


def two_side() -> Column:
    return c("sub_type").rlike("two_side|both-side|one_side_and_half_transduction")


def one_side() -> Column:
    return ~two_side() & c("sub_type").contains("one_side")


def one_half() -> Column:
    return ~two_side() & ~one_side() & c("sub_type").rlike("one_half|one-half")


def tprt_both() -> Column:
    return c("sub_type").contains("two_side_tprt_both")


def v(name: str) -> Column:
    """A cluster's bound; that of a missing one is -1, as in the text form."""
    return F.coalesce(c(name), F.lit(-1))


def absent(*sides: str) -> Column:
    out = F.lit(False)
    for s in sides:
        out = out | c(f"{s}_start").isNull() | c(f"{s}_end").isNull()
    return out


def apart(a: str, b: str, cutoff: int = 300) -> Column:
    """Two clusters lie apart, or one of them is missing."""
    close = (F.abs(c(f"{a}_end") - c(f"{b}_start")) < cutoff) | (F.abs(c(f"{b}_end") - c(f"{a}_start")) < cutoff)
    return absent(a, b) | ~close


def _polya_share(side: str) -> Column:
    return c(f"n_all_{side}polya") / F.nullif(c(f"n_all_{side}clip"), F.lit(0))


def has_polya_signal() -> Column:
    return (c("n_all_lpolya") > 0) | (c("n_all_rpolya") > 0)


def polya_dominant(ratio: float = 0.75) -> Column:
    """PolyA is over that share of the clips on both sides, which have clips in clusters that aren't apart."""
    clips = (c("n_all_lclip") > 0) & (c("n_all_rclip") > 0)
    return clips & ~apart("lc", "rc") & ~(tprt_both() & apart("ld", "rd")) & (_polya_share("l") > ratio) & (_polya_share("r") > ratio)


def polya_dominant_td(ratio: float = 0.85) -> Column:
    """A side without clips counts as dominated."""
    return ~tprt_both() & F.coalesce(_polya_share("l") > ratio, F.lit(True)) & F.coalesce(_polya_share("r") > ratio, F.lit(True))


def polya_dominant_sva(head: int, ratio: float = 0.75) -> Column:
    clips = (c("n_all_lclip") > 0) & (c("n_all_rclip") > 0)
    at_head = ~absent("ld", "rd") & ((v("ld_start") < head) | (v("rd_start") < head))
    return clips & ~(tprt_both() & at_head) & (_polya_share("l") > ratio) & (_polya_share("r") > ratio)


def polya_dominant_one_side(least: int = 5, ratio: float = 0.75) -> Column:
    """No side has clips that count, or one has only polyA while `least` clips or more fail on the other."""
    l, r = c("n_all_lclip"), c("n_all_rclip")

    def lone(side: str, n: Column) -> Column:
        return F.coalesce(_polya_share(side) > ratio, F.lit(False)) & (c("n_af_clip") - n >= least)

    return ((l <= 0) & (r <= 0)) | ((l <= 0) & lone("r", r)) | ((r <= 0) & lone("l", l))


def same_orientation_polya() -> Column:
    return c("n_lpolya") * c("n_rpolya") > 0


def enough_size(n: int) -> Column:
    """Both ends agree, and the clip clusters span over n bases of the consensus."""
    return c("both_consistent") & ((F.abs(v("lc_start") - v("rc_end")) > n) | (F.abs(v("rc_start") - v("lc_end")) > n))


def consistent_tprt_both(tail: int = 5950, least: int = 100) -> Column:
    """Target-primed on both sides, both ends agree, a clip and a pair cluster reach the tail, and the clusters span enough."""
    short = ((v("lc_end") < tail) & (v("rc_end") < tail)) | ((v("ld_end") < tail) & (v("rd_end") < tail))
    small = (F.abs(v("lc_start") - v("rc_end")) < least) & (F.abs(v("rc_start") - v("lc_end")) < least)
    return ~short & ~small & tprt_both() & c("both_consistent")


def tprt_reaches(end: int) -> Column:
    return c("sub_type").contains("two_side_tprt") & ~absent("lc", "rc") & ((v("lc_end") > end) | (v("rc_end") > end))


def both_beyond(end: int) -> Column:
    return ~absent("lc", "rc") & (v("lc_start") > end) & (v("rc_start") > end)


def hits_tail(end: int) -> Column:
    """One of the clip clusters reaches the tail; true as well where one is missing."""
    return absent("lc", "rc") | (v("lc_end") >= end) | (v("rc_end") >= end)


def ratios() -> dict[str, Column]:
    """Effective clips and pairs of all, clips of clips and full matches, discordant pairs of all pairs; 0 of none is 0."""
    def of(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    return {"ef_clip": of(c("n_all_lclip") + c("n_all_rclip"), c("n_af_clip")), "ef_disc": of(c("n_all_ldisc") + c("n_all_rdisc"), c("n_disc")),
            "clip": of(c("n_af_clip"), c("n_af_clip") + c("n_full_map")), "disc": of(c("n_disc"), c("n_disc") + c("n_conc"))}


def af_conflict(tumor: bool = False) -> Column:
    """Kept only if all four ratios are above."""
    least = 0.001 if tumor else 0.075
    out = F.lit(True)
    for r in ratios().values():
        out = out & (r > least)
    return ~out


def coverage_abnormal(times: float) -> Column:
    return (c("lcov") > times * c("mean_cov")) | (c("rcov") > times * c("mean_cov"))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that drops the row, or null."""
    out = None
    for name, test in rules:
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def _types() -> Column:
    return two_side() | one_half() | one_side()


def l1_rules(config: Config = Config()) -> list[tuple[str, Column]]:
    """Needs in_blacklist, div (least divergence of a copy there, null: none), within_copy, td_novel, hit_end, both_consistent, mean_cov.

    Orphans, and transductions that were called anew, stay once they pass their own rules.
    """
    in_copy, low = c("div").isNotNull(), c("div") < 15
    td, novel = ~is_orphan_call() & is_transduction(), c("td_novel")
    plain = ~is_orphan_call() & ~(td & novel)
    dominant_same = polya_dominant() & same_orientation_polya()
    keeps_one = F.lit(config.tumor)
    return [
        ("blacklist", c("in_blacklist")),
        ("orphan_one_side", is_orphan_call() & one_side() & ~keeps_one),
        ("td_in_copy", td & (c("div") <= 7) & c("within_copy") & ~consistent_tprt_both()),
        ("td_polya", td & (polya_dominant_td() | (ratios()["disc"] < 0.08))),
        ("td_one_side", td & novel & one_side() & ~keeps_one),
        ("no_polya_no_end", plain & ~has_polya_signal() & ~c("hit_end")),
        ("two_side_polya", plain & two_side() & dominant_same & ~enough_size(200)),
        ("two_side_end", plain & two_side() & ~c("hit_end")),
        ("two_side_af", plain & two_side() & af_conflict(config.tumor)),
        ("two_side_copy", plain & two_side() & low & ~consistent_tprt_both(6000, 200)),
        ("one_half_copy", plain & one_half() & low),
        ("one_half_polya", plain & one_half() & dominant_same),
        ("one_side_copy", plain & one_side() & low),
        ("other", plain & ~_types()),
        ("tail_same_way", plain & (in_copy | coverage_abnormal(2)) & both_beyond(5950) & same_orientation_polya()),
        ("copy_without_tail", plain & in_copy & ~hits_tail(5950)),
    ]


def alu_rules(config: Config = Config()) -> list[tuple[str, Column]]:
    """A record of one side and a half with effective clips on both sides counts as two-sided."""
    both = one_half() & (c("n_all_lclip") > 0) & (c("n_all_rclip") > 0)
    two, less = two_side() | both, (one_half() & ~both) | one_side()
    in_copy, low = c("div").isNotNull(), c("div") < 15
    indels = F.floor(0.3 * c("mean_cov"))
    return [
        ("blacklist", c("in_blacklist")),
        ("two_side_polya", two & polya_dominant() & same_orientation_polya()),
        ("two_side_af", two & af_conflict(config.tumor)),
        ("two_side_no_polya", two & ~has_polya_signal() & ~tprt_reaches(200)),
        ("low_copy", less & low),
        ("one_side_polya", less & polya_dominant_one_side()),
        ("copy_no_polya", less & in_copy & ~has_polya_signal()),
        ("other", ~two & ~less),
        ("copy_both_tails", in_copy & both_beyond(255)),
        ("copy_without_tail", in_copy & ~hits_tail(255)),
        ("indels", (indels > 0) & (c("n_indel") > indels) & coverage_abnormal(2)),
    ]


def sva_rules(config: Config = Config()) -> list[tuple[str, Column]]:
    in_copy, low = c("div").isNotNull(), c("div") < 15
    less = one_half() | one_side()
    here = ~absent("lc", "rc")
    return [
        ("blacklist", c("in_blacklist")),
        ("two_side_polya", two_side() & polya_dominant_sva(400)),
        ("two_side_af", two_side() & af_conflict(config.tumor)),
        ("low_copy", less & low),
        ("no_polya", _types() & ~has_polya_signal()),
        ("one_half_polya", one_half() & polya_dominant_sva(400)),
        ("one_side_td", one_side() & (is_orphan_call() | is_transduction()) & ~F.lit(config.tumor)),
        ("other", ~_types()),
        ("copy_both_tails", in_copy & here & (v("lc_start") >= 1900) & (v("rc_start") >= 1900)),
        ("copy_both_heads", in_copy & here & (v("lc_start") < 1900) & (v("rc_start") < 1900)),
    ]


def mosaic_rules(kind: str = "L1") -> list[tuple[str, Column]]:
    """Sites that a panel of normals has within the slack of a breakpoint go as well: intervals.near(..., how="left_anti")."""
    r, in_copy = ratios(), c("div").isNotNull()
    return [
        ("no_polya", ~has_polya_signal()),
        ("clip_af", ~r["clip"].between(0.02, 0.35)),
        ("disc_af", r["disc"] > 0.35),
        ("two_side_polya", two_side() & polya_dominant()),
        ("one_half_copy", one_half() & in_copy),
        ("one_half_polya", one_half() & polya_dominant() & F.lit(kind != "SVA")),
        ("one_side_copy", one_side() & in_copy),
        ("other", ~_types()),
    ]


def _barrier() -> Column:
    """0, but the optimizer takes it for non-deterministic, so what it is added to is computed where it stands."""
    return F.when(F.spark_partition_id() < 0, 1).otherwise(0)


def post_filter(records: DataFrame, rules: list[tuple[str, Column]], at_once: bool = False) -> DataFrame:
    """records with `reason`, the first rule that drops the row; null where it stays.

    at_once: all rules are tested in one projection, which computes what they share once, and the cascade is over their
    results. This pays where rules share long expressions; else a row needs no test after the first one that drops it.
    """
    if not at_once:
        return records.withColumn("reason", first_reason(rules))
    tests = {f"_rule_{k}": F.when(F.coalesce(test, F.lit(False)), 1).otherwise(0) + _barrier() for k, (_, test) in enumerate(rules)}
    reason = None
    for name, k in ((name, f"_rule_{k}") for k, (name, _) in enumerate(rules)):
        reason = F.when(F.col(k) == 1, name) if reason is None else reason.when(F.col(k) == 1, name)
    return records.withColumns(tests).withColumn("reason", reason).drop(*tests)


def copy_label(name: str) -> Column:
    """Whether the site lies in a copy of its own type, with the copy's divergence."""
    return F.when(c("div").isNull(), f"not_in_{name}_copy").otherwise(F.concat(F.lit(f"Fall_in_{name}_copy_"), c("div").cast("string")))


def insertion_length(tail: int) -> Column:
    """From the clip clusters, else the pair clusters, else those of one side; of a transduction from its pairs to the tail; else 0."""
    def span(a: str, b: str) -> Column:
        whole = v(f"{b}_end") - v(f"{a}_start")
        return F.when(whole < 0, v(f"{a}_end") - v(f"{b}_start")).otherwise(whole)

    def has(s: str) -> Column:
        return v(f"{s}_start") > 0

    plain = F.lit(0)
    for a, b in (("rc", "rd"), ("lc", "ld"), ("ld", "rd"), ("lc", "rc")):
        plain = F.when(has(a) & has(b), span(a, b)).otherwise(plain)
    l, r = v("ld_start"), v("rd_start")
    td = F.when((l > 0) & (r > 0), tail - F.least(l, r)).when((l > 0) & (r < 0), tail - l).when((l < 0) & (r > 0), tail - r).otherwise(0)
    return F.abs(F.when(is_transduction(), td).otherwise(plain))


def inversion() -> Column:
    """The majority orientations of the two sides differ."""
    left, right = c("ldisc_same") >= c("ldisc_diff"), c("rdisc_same") >= c("rdisc_diff")
    return F.when(left != right, "5prime-inversion").otherwise("Not-5prime-inversion")


def strand() -> Column:
    """By the polyA counts: negative ones are T."""
    return F.when((c("n_lpolya") < 0) | (c("n_rpolya") < 0), "-").when((c("n_lpolya") > 0) | (c("n_rpolya") > 0), "+").otherwise(".")


def tsd_label(chrom: Column, left: Column, right: Column, cutoff: int = 100) -> Column:
    return F.when(F.abs(right - left) <= cutoff, F.concat_ws("~", chrom, left.cast("string"), right.cast("string"))).otherwise("")


def depth_differs(l: Column, r: Column, ratio: float = 0.35) -> Column:
    return F.when((l <= 0) | (r <= 0), F.lit(True)).otherwise(F.abs(r - l) / F.greatest(l, r) >= ratio)


def regions_consistent(s1: Column, e1: Column, s2: Column, e2: Column, insert_size: float) -> Column:
    """The regions overlap once both are widened by half an insert size."""
    w = insert_size / 2 + 1
    return (s1 - w <= e2 + w) & (s2 - w <= e1 + w)


def case_control_rules() -> list[tuple[str, Column]]:
    """Needs a case record's counts, and the control's at the site with the prefix k_ (null where there are none).

    A control ratio above a share of a case ratio of 0 is any ratio above 0.
    """
    cov, kcov = c("lcov") + c("rcov"), c("k_lcov") + c("k_rcov")
    d = c("n_all_ldisc") + c("n_all_rdisc")
    td, orphan = ~c("td_src").contains("not_transduction"), is_orphan() | is_orphan_call()
    sibling = is_sibling() | c("sub_type").contains("sibling")

    def of(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))

    def either(l: str, r: str, least: float) -> Column:
        return ((c("lcov") > 0) & (of(c(l), c("lcov")) < least)) | ((c("rcov") > 0) & (of(c(r), c("rcov")) < least))

    disc, kdisc = of(2 * c("n_disc"), cov), of(2 * c("k_n_disc"), kcov)
    raw, kraw = of(2 * (c("n_l_raw") + c("n_r_raw")), cov), of(2 * (c("k_n_l_raw") + c("k_n_r_raw")), kcov)
    ef, kef = of(2 * (c("n_all_lclip") + c("n_all_rclip")), cov), of(2 * c("k_n_af_clip"), kcov)
    n_raw = c("k_n_l_raw") + c("k_n_r_raw")
    share = of(n_raw, n_raw + c("k_n_full_map"))
    polya = of(c("k_n_polya"), n_raw) > 0.375
    return [
        ("no_coverage", cov <= 1e-10),
        ("few_effective_disc", of(2 * d, cov) < 0.05),
        ("orphan_disc", orphan & either("n_all_ldisc", "n_all_rdisc", 0.05)),
        ("orphan_clip", orphan & either("n_l_raw", "n_r_raw", 0.05)),
        ("few_disc", disc < 0.15),
        ("no_disc", c("n_disc") <= 0),
        ("effective_share", ~orphan & ~sibling & (of(d, c("n_disc")) < 0.1)),
        ("no_control", c("k_lcov").isNull()),
        ("control_no_coverage", kcov <= 1e-10),
        ("control_has_both", (kdisc > 0.35 * disc) & F.when(td, kraw > 0.35 * raw).otherwise(kef > 0.35 * ef)),
        ("control_polya", of(c("k_n_polya"), kcov) > 0.3),
        ("control_af", ((c("k_n_af_clip") + c("k_n_full_map") == 0) | (of(c("k_n_af_clip"), c("k_n_af_clip") + c("k_n_full_map")) > 0.75)) & (kdisc > 0.15)),
        ("control_raw_clip", ((n_raw + c("k_n_full_map") == 0) | (share > 0.75)) & ((kdisc > 0.15) | (polya & (c("k_n_disc") > 0)))),
        ("no_polya_control_clip", (c("n_all_lpolya") + c("n_all_rpolya") == 0) & (share > 0.35)),
    ]


def type_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(bit) != 0
