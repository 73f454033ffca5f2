"""Transductions and orphans: which source a site's pairs point to, whether its clips and pairs bear that out, and updates of call sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import max_cover, two_peaks
from .intervals import near, points_in


def site_rules(most_coverage: float, half: int) -> list[tuple[str, Column]]:
    """Candidate transductions that go: in a little diverged copy of their type (in_low_copy), on an island of alignments, or with polyA (or polyT) on both sides."""
    c = F.col
    island = F.lit(False)
    for x in ("lcov_200", "rcov_200", "lcov_900", "rcov_900"):
        island = island | (c(x) > most_coverage)
    return [("copy", c("in_low_copy")), ("island", island), ("two_side_polya", (c("n_la") > half) & (c("n_ra") > half)), ("two_side_polyt", (c("n_lt") > half) & (c("n_rt") > half))]


def reselect(sites: DataFrame, existing: DataFrame, copies: DataFrame, disc: int, slack: int = 100, tumor: bool = False, divergence: float = 5) -> DataFrame:
    """sites (chrom, pos, n_disc) away from existing ones, with enough pairs (half the cutoff, of germline three quarters), outside little diverged copies (chrom, start, end, div)."""
    least = disc / 2 if tumor else 3 * disc / 4
    away = near(sites.filter(F.col("n_disc") >= least), existing, slack, "left_anti")
    return points_in(away, copies.filter(F.col("div") < divergence).select("chrom", "start", "end"), how="left_anti")


def pick_source(df: DataFrame, key: list[str], cutoff: int, ratio: float = 0.45, unique: float = 0.5, others: DataFrame | None = None) -> DataFrame:
    """df (key, source; one row a pair) -> key, source, n, total and `verdict`: td, normal (several sources) or none (too few pairs).

    others (key, source, n_other): pairs of that source that fit elsewhere too; the unique ones must be over that share.
    """
    counts = df.groupBy(*key, "source").agg(F.count("*").alias("n"))
    best = counts.groupBy(*key).agg(F.min_by("source", F.struct(F.negate("n"), "source")).alias("source"), F.max("n").alias("n"), F.sum("n").alias("total"))
    if others is not None:
        best = best.join(others, [*key, "source"], "left")
    n_other = F.coalesce("n_other", F.lit(0)) if others is not None else F.lit(0)
    td = (F.col("n") >= cutoff) & (F.col("n") >= ratio * F.col("total")) & (F.col("n") > unique * (F.col("n") + n_other))
    verdict = F.when(F.col("total") < cutoff, "none").when(td, "td").otherwise("normal")
    return best.select(*key, "source", "n", "total", verdict.alias("verdict"))


def flank_vote(df: DataFrame, key: list[str], flank: int, cutoff: int) -> DataFrame:
    """df (key, source, at; one row a read on a source's flanks) -> the source with most reads, its 3' and 5' counts, and whether the larger is over the cutoff.

    The 5' flank comes first in the flanks' sequence; a tie is 5'.
    """
    counts = df.groupBy(*key, "source").agg(F.count("*").alias("n"), F.count_if(F.col("at") < flank).alias("n5"), F.count_if(F.col("at") >= flank).alias("n3"))
    best = counts.groupBy(*key).agg(F.min_by(F.struct("source", "n5", "n3"), F.struct(F.negate("n"), "source")).alias("b"))
    out = best.select(*key, "b.source", "b.n5", "b.n3", (F.col("b.n3") > F.col("b.n5")).alias("is_3"))
    return out.withColumn("is_td", F.greatest("n3", "n5") > cutoff)


def called_out(pairs: DataFrame, clips: DataFrame, tails: DataFrame, key: list[str], pos: str, distance: int, ratio: float, orphans: DataFrame | None = None) -> DataFrame:
    """Transductions of sites: key, is_left, n_disc, td_src, n_clip, clip_pos and n_polya.

    pairs (key, pos, source, ref_at, anchor): of each site's one source, a row each; pos is the site's breakpoint. The side
    with more anchors counts (of equal ones the right), if its places on the reference are a cluster: that share of them
    within `distance` after the first. clips (key, side, ref_pos), aligned to flanks, give the densest window of that side;
    tails (key, n_lpolya, n_rpolya) its polyA. Sites need clips and tails. orphans (key, source, n_left, n_right) take the
    place of what pairs tell, as right ones.
    """
    side = F.when(F.col("anchor") < F.col(pos), "L").otherwise("R")
    rows = pairs.join(clips.select(*key).distinct(), key, "left_semi").join(tails.select(*key).distinct(), key, "left_semi").withColumn("_side", side)
    counts = rows.groupBy(*key).agg(F.count_if(F.col("_side") == "L").alias("_l"), F.count_if(F.col("_side") == "R").alias("_r"), F.min("source").alias("source"))
    chosen = counts.select(*key, "source", F.when(F.col("_l") > F.col("_r"), "L").otherwise("R").alias("_side"), F.greatest("_l", "_r").alias("n_disc"))
    found = max_cover(rows.join(chosen.select(*key, "_side"), [*key, "_side"]).select(*key, F.col("ref_at").alias("pos")), distance, ratio, key).filter("is_cluster")
    label = F.concat(F.col("source").cast("string"), F.lit("~"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    out = chosen.join(found, key).select(*key, F.col("_side"), "n_disc", label.alias("td_src"))
    if orphans is not None:
        own = orphans.join(clips.select(*key).distinct(), key, "left_semi").select(*key, F.lit("R").alias("_side"), (F.col("n_left") + F.col("n_right")).alias("n_disc"), F.concat(F.col("source").cast("string"), F.lit("~orphan")).alias("td_src"))
        out = out.join(own.select(*key), key, "left_anti").unionByName(own)
    at = clips.groupBy(*key, F.col("side").alias("_side"), F.col("ref_pos").alias("pos")).agg(F.count("*").alias("n"))
    peaks = two_peaks(at, [*key, "_side"]).select(*key, "_side", F.col("peak1").alias("clip_pos"), F.col("n1").alias("n_clip"))
    out = out.join(peaks, [*key, "_side"], "left").join(tails.select(*key, "n_lpolya", "n_rpolya"), key, "left")
    left = F.col("_side") == "L"
    return out.select(*key, left.alias("is_left"), "n_disc", "td_src", F.coalesce("n_clip", F.lit(0)).alias("n_clip"), "clip_pos", F.coalesce(F.when(left, F.col("n_lpolya")).otherwise(F.col("n_rpolya")), F.lit(0)).alias("n_polya"))


def with_transductions(records: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Site records with called_out(): its source and counts, its clips, pairs and polyA added to its side, and its breakpoint where it has more clips than that side."""
    joined = records.join(found.select(*key, *(F.col(c).alias(f"_t_{c}") for c in ("is_left", "n_disc", "td_src", "n_clip", "clip_pos", "n_polya"))), key, "left")
    has = F.col("_t_td_src").isNotNull()

    def added(name: str, more: str, left: bool) -> Column:
        here = F.coalesce(F.col("_t_is_left") if left else ~F.col("_t_is_left"), F.lit(False))
        return F.when(here, F.col(name) + F.col(f"_t_{more}")).otherwise(F.col(name)).cast(dict(records.dtypes)[name])

    def moved(name: str, n: str, left: bool) -> Column:
        here = F.coalesce(F.col("_t_is_left") if left else ~F.col("_t_is_left"), F.lit(False))
        return F.when(here & (F.col("_t_n_clip") > F.col(n)), F.col("_t_clip_pos")).otherwise(F.col(name))

    new = {"lclip_pos": moved("lclip_pos", "n_lclip", True), "rclip_pos": moved("rclip_pos", "n_rclip", False), "n_all_lclip": added("n_all_lclip", "n_clip", True), "n_all_rclip": added("n_all_rclip", "n_clip", False),
           "n_all_rdisc": added("n_all_rdisc", "n_disc", True), "n_all_ldisc": added("n_all_ldisc", "n_disc", False), "n_all_lpolya": added("n_all_lpolya", "n_polya", True), "n_all_rpolya": added("n_all_rpolya", "n_polya", False),
           "td_src": F.when(has, F.col("_t_td_src")).otherwise(F.col("td_src")), **{f"n_td_{a}": F.when(has, F.col(f"_t_{b}")).otherwise(F.col(f"n_td_{a}")).cast(dict(records.dtypes)[f"n_td_{a}"]) for a, b in (("clip", "n_clip"), ("disc", "n_disc"), ("polya", "n_polya"))}}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in records.columns))


def orphan_sides(df: DataFrame, key: list[str], site: str, half: int) -> DataFrame:
    """df (key, the site's position, anchor; one row a pair of its source) -> sites with `half` pairs or more on both sides; an anchor within 5 of the site is to its right."""
    left = F.col("anchor") + 5 < F.col(site)
    out = df.groupBy(*key).agg(F.count_if(left).alias("n_left"), F.count_if(~left).alias("n_right"))
    return out.filter((F.col("n_left") >= half) & (F.col("n_right") >= half))


def with_clips(clips: DataFrame, polya: DataFrame, key: list[str], least: int, least_polya: int) -> DataFrame:
    """clips (key, n), of both sides, and polya (key, n): the sites with that many clips and that many of polyA."""
    a, b = clips.groupBy(*key).agg(F.sum("n").alias("n_clip")), polya.groupBy(*key).agg(F.sum("n").alias("n_polya"))
    return a.filter(F.col("n_clip") >= least).join(b.filter(F.col("n_polya") >= least_polya), key)


def rescued(pairs: DataFrame, left: DataFrame, right: DataFrame, key: list[str], clip: int, disc: int) -> DataFrame:
    """Sites with `disc` pairs or more on flanks, and `clip` clips or more there on a side; all three are (key, n).

    n_left and n_right are the counts of a side that falls short, else 0.
    """
    def of(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*key).agg(F.sum("n").alias(name))

    out = of(pairs, "n_disc").filter(F.col("n_disc") >= disc).join(of(left, "_l"), key, "left").join(of(right, "_r"), key, "left")
    l, r = (F.coalesce(c, F.lit(0)) for c in ("_l", "_r"))
    return out.filter((l >= clip) | (r >= clip)).select(*key, F.when(l < clip, l).otherwise(0).alias("n_left"), F.when(r < clip, r).otherwise(0).alias("n_right"), "n_disc")


def decoys(df: DataFrame, key: list[str], own: str, cutoff: int) -> DataFrame:
    """df (key, family; one row an alternative hit) -> counts by family of each site, and whether it stays: no other family reaches the cutoff."""
    families = ("Alu", "L1", "SVA")
    counts = [F.count_if(F.col("family") == f).alias(f"n_{f.lower()}") for f in families]
    out = df.groupBy(*key).agg(*counts)
    other = F.greatest(*(F.col(f"n_{f.lower()}") for f in families if f != own))
    return out.withColumn("stays", other < cutoff)


def unique_cluster(df: DataFrame, key: list[str], half: int, ratio: float = 0.45, share: float = 0.45, reach: int = 2000) -> DataFrame:
    """df (key, chrom, pos of mates) -> the contig with most mates, their upper median, and whether they form one cluster:

    over `half` of them, over that ratio of all, and over the share of them within reach of the median.
    """
    # dealt by the key and sorted once: windows and both groupings (of structs, hence by order) go through in that order
    at = df.groupBy(*key, "chrom", "pos").agg(F.count("*").alias("k")).repartition(*key)
    w = Window.partitionBy(*key, "chrom")
    at = at.withColumn("_till", F.sum("k").over(w.orderBy("pos"))).withColumn("_n", F.max("_till").over(w))
    at = at.withColumn("_mid", F.min(F.when(F.col("_till") > F.floor(F.col("_n") / 2), F.col("pos"))).over(w))
    each = at.groupBy(*key, "chrom").agg(F.max(F.struct(F.col("_n").alias("n"), F.col("_mid").alias("mid"))).alias("x"), F.sum(F.when(F.abs(F.col("pos") - F.col("_mid")) < reach, F.col("k")).otherwise(0)).alias("within"))
    each = each.select(*key, "chrom", "x.n", "x.mid", "within")
    best = each.groupBy(*key).agg(F.min_by(F.struct("chrom", "n", "mid", "within"), F.struct(F.negate("n"), "chrom")).alias("b"), F.sum("n").alias("total"))
    ok = (F.col("total") >= half) & (F.col("b.n") > half) & (F.col("b.n") > ratio * F.col("total")) & (F.col("b.within") > share * F.col("b.n"))
    return best.select(*key, F.col("b.chrom").alias("mate_chrom"), F.col("b.mid").alias("mate_pos"), F.col("b.n").alias("n"), "total", ok.alias("is_cluster"))


def repeat_or_same(df: DataFrame, repeats: DataFrame, key: list[str], half: int, half_same: int, ratio: float, share: float, reach: int = 5000) -> DataFrame:
    """df (key, chrom, pos of mates, src_chrom, src_pos) -> how many mates lie in a repeat or, else, near the source, and `state`: repeat, source or none."""
    places = points_in(df.select("chrom", "pos").distinct(), repeats.select("chrom", "start", "end")).select(F.col("chrom").alias("_c"), F.col("pos").alias("_p")).distinct()
    rows = df.join(places, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")), "left")
    inside = F.col("_c").isNotNull()
    same = ~inside & (F.col("chrom") == F.col("src_chrom")) & (F.abs(F.col("pos") - F.col("src_pos")) < reach)
    out = rows.groupBy(*key).agg(F.count("*").alias("total"), F.count_if(inside).alias("n_repeat"), F.count_if(same).alias("n_same"))
    state = F.when((F.col("n_repeat") > half) & (F.col("n_repeat") > ratio * F.col("total")), "repeat").when((F.col("n_same") > half_same) & (F.col("n_same") > share * F.col("total")), "source").otherwise("none")
    return out.withColumn("state", state)


def sibling_source(sites: DataFrame, one_sided: DataFrame, reach: int) -> DataFrame:
    """sites (chrom, pos) with the nearest position of a one-sided site on the contig closer than reach (of ties the lower), null: none."""
    around = one_sided.select("chrom", F.col("pos").alias("sibling"), (F.col("pos") - reach + 1).alias("start"), (F.col("pos") + reach).alias("end")).distinct()
    found = points_in(sites.select("chrom", "pos").distinct(), around)
    nearest = found.groupBy(F.col("chrom").alias("_c"), F.col("pos").alias("_p")).agg(F.min_by("sibling", F.struct(F.abs(F.col("pos") - F.col("sibling")), "sibling")).alias("sibling"))
    return sites.join(nearest, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")), "left").drop("_c", "_p")


TD_COLUMNS = ("td_src", "n_td_clip", "n_td_disc", "n_td_polya")


def update_records(records: DataFrame, found: DataFrame, slack: int) -> tuple[DataFrame, DataFrame]:
    """(records, new): the first of found (chrom, pos, TD_COLUMNS) in [pos - slack, pos + slack) gives a record its transduction; what meets no record is new."""
    hits = near(records, found, slack, "left")
    by = found.groupBy(F.col("chrom").alias("_c"), F.col("pos").alias("_p")).agg(F.min(F.struct(*TD_COLUMNS)).alias("_t"))
    joined = hits.join(by, (F.col("chrom") == F.col("_c")) & (F.col("hit") == F.col("_p")), "left")
    updated = joined.select(*(F.when(F.col("hit").isNotNull(), F.col(f"_t.{c}")).otherwise(F.col(c)).alias(c) if c in TD_COLUMNS else F.col(c) for c in records.columns))
    met = hits.filter("hit is not null").select(F.col("chrom").alias("_c"), F.col("hit").alias("_p")).distinct()
    return updated, found.join(met, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")), "left_anti")


def high_confidence(confident: DataFrame, updated: DataFrame, is_td: Column) -> DataFrame:
    """The updated records of the confident sites (chrom, pos), and of all other transductions."""
    sites = confident.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.lit(True).alias("_in")).distinct()
    rows = updated.join(sites, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")), "left")
    return rows.filter(F.col("_in").isNotNull() | F.coalesce(is_td, F.lit(False))).select(*updated.columns)


def append_new(existing: DataFrame, failed: DataFrame, new: DataFrame) -> DataFrame:
    """The sites of existing that didn't fail, and the new ones that aren't among them; by (chrom, pos), one row each of the new ones."""
    key = ["chrom", "pos"]
    stay = existing.join(failed.select(*key).distinct(), key, "left_anti")
    return stay.unionByName(new.dropDuplicates(key).join(stay.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)
