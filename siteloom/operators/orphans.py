"""Orphan and sibling transductions: from reads around candidate sites to records.

The sequence moved comes from elsewhere (the source region) and has no copy of the repeat with it, so that the mates of
discordant reads on both sides of an insertion lie together. A sample's site becomes one row of counters by groupings of
reads; clusters of mates are found over counts by position, so no list of a site's reads is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import cigar as C
from ..functions import seq as S
from ..shared import written
from .intervals import overlaps, points_in
from .scan import around
from .transduction import unique_cluster

KEY = ["sample", "chrom", "site"]


@dataclass(frozen=True)
class Orphans:
    """Fixed values of the calls: distances in bases, shares, and the tail of a clip that is looked at."""

    extend: int = 3000
    coverage: float = 30.0
    coverage_times: int = 3
    local: int = 200
    near_clip: int = 50
    far_mate: int = 100_000
    tail: int = 20
    poor: int = 10
    most_poor: float = 0.1
    dominant: float = 0.45
    together: float = 0.67
    other_side: float = 0.1
    least_polya: float = 0.1
    strand: float = 0.6
    longest: int = 5000
    spread: int = 2000


def _reads(near: DataFrame, s: Orphans, config: Config) -> DataFrame:
    """Reads around sites with what each of them tells."""
    g, site, pos = F.col("cigar"), F.col("site"), F.col("pos")
    right = pos >= site - config.read_length // 4
    ok = (F.col("mapq") >= config.disc_mapq) & ~F.col("is_secondary") & ~F.col("is_supplementary") & ~F.col("is_duplicate")
    left_part, right_part = (C.clipped_part(F.col("seq"), g, x) for x in (True, False))
    lclip = ok & (C.first(g)["op"] == 4) & (F.abs(pos - site) < s.near_clip)
    rclip = ok & (C.last(g)["op"] == 4) & (F.abs(C.right_breakpoint(pos, g) - site) < s.near_clip)
    l_tail, r_tail = F.right(left_part, F.lit(s.tail)), F.substring(right_part, 1, s.tail)
    far = (F.col("chrom") != F.col("mate_chrom")) | (F.abs(F.col("mate_pos") - site) > s.far_mate)
    disc = ok & ~F.col("mate_is_unmapped") & F.col("mate_chrom").isNotNull() & ~S.is_decoy(F.col("mate_chrom")) & far
    no = F.lit(False)
    return near.select(
        *KEY, "pos", "mate_chrom", "mate_pos", "is_reverse", right.alias("right"), (F.abs(pos - site) < s.local).alias("local"), (F.col("mapq") < s.poor).alias("poor"), F.coalesce(lclip, no).alias("lclip"), F.coalesce(rclip, no).alias("rclip"),
        F.coalesce(lclip & S.has_any(l_tail, S.POLY_A), no).alias("lpolya"), F.coalesce(rclip & ~S.has_any(r_tail, S.POLY_A) & S.has_any(r_tail, S.POLY_T), no).alias("rpolyt"), F.coalesce(disc, no).alias("disc"), (F.abs(pos - site) < config.insert_size).alias("focal"))


def _quantile(rows: DataFrame, name: str, of: int) -> DataFrame:
    """rows (KEY, pos) -> the value at a place of the sorted positions: of quarters of their number, rounded down, from 0."""
    counts = rows.groupBy(*KEY, "pos").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*KEY)
    counts = counts.withColumns({"_n": F.sum("k").over(w), "_till": F.sum("k").over(w.orderBy("pos"))})
    return counts.filter(F.col("_till") > F.floor(F.col("_n") * of / 4)).groupBy(*KEY).agg(F.min("pos").alias(name))


def _other_side(mates: DataFrame, repeats: DataFrame, half: float, s: Orphans) -> DataFrame:
    """mates (KEY, mate_chrom, mate_pos, src_chrom, src_pos): of the side without a cluster -> whether they lie in repeats, or with the other side's, and the upper median of these (-1: in repeats)."""
    places = points_in(mates.select(F.col("mate_chrom").alias("chrom"), F.col("mate_pos").alias("pos")).distinct(), repeats.select("chrom", "start", "end")).select(F.col("chrom").alias("_c"), F.col("pos").alias("_p")).distinct()
    counts = mates.groupBy(*KEY, "mate_chrom", "mate_pos", "src_chrom", "src_pos").agg(F.count("*").alias("k"))
    counts = counts.join(places, (F.col("mate_chrom") == F.col("_c")) & (F.col("mate_pos") == F.col("_p")), "left").withColumn("inside", F.col("_c").isNotNull())
    same = ~F.col("inside") & (F.col("mate_chrom") == F.col("src_chrom")) & (F.abs(F.col("mate_pos") - F.col("src_pos")) < s.longest)
    counts = counts.withColumn("same", F.when(same, F.col("k")).otherwise(0))
    w = Window.partitionBy(*KEY)
    counts = counts.withColumns({"_n": F.sum("same").over(w), "_till": F.sum("same").over(w.orderBy("mate_pos"))})
    mid = F.min(F.when((F.col("same") > 0) & (F.col("_till") > F.floor(F.col("_n") / 2)), F.col("mate_pos")))
    out = counts.groupBy(*KEY).agg(F.sum("k").alias("_total"), F.sum(F.when(F.col("inside"), F.col("k")).otherwise(0)).alias("_in"), F.sum("same").alias("_same"), mid.alias("_mid"))
    repeat = (F.col("_in") > half) & (F.col("_in") > s.dominant * F.col("_total"))
    source = (F.col("_same") > half) & (F.col("_same") > s.other_side * F.col("_total"))
    return out.select(*KEY, (repeat | source).alias("other_ok"), F.when(repeat, -1).when(source, F.col("_mid")).otherwise(-1).alias("other_mid"))


def evidence(reads: DataFrame, sites: DataFrame, repeats: DataFrame, clips: int, pairs: int, s: Orphans = Orphans(), config: Config = Config()) -> DataFrame:
    """One row for each sample and site that has reads around it: counters, the sides' clusters and the verdicts.

    clips and pairs are the least numbers of a call; a side needs half. Of equally frequent mate contigs the least counts.
    Verdicts: consistent (both sides' mates lie within `longest` on one contig, or one side's do and the other side's lie in
    repeats or there too, and left reads are forward, right ones reverse), polya (enough clips of left A or right T), inner
    (a quarter of the forward reads begin up to the site, three quarters of the reverse ones from it on), depth_ok, placed_ok.
    """
    half = pairs / 2
    # seven groupings read it
    reads_ = written(_reads(around(reads, sites, s.extend, duplicates=True), s, config), "orphan-reads")
    n = lambda cond: F.count_if(cond)
    r, l, focal, rev, disc = F.col("right"), ~F.col("right"), F.col("focal"), F.col("is_reverse"), F.col("disc")
    out = reads_.groupBy(*KEY).agg(
        n(F.col("local") & l).alias("n_left"), n(F.col("local") & r).alias("n_right"), n(F.col("local") & F.col("poor")).alias("n_poor"), n(F.col("lclip")).alias("n_lclip"), n(F.col("rclip")).alias("n_rclip"), n(F.col("lpolya")).alias("n_lpolya"), n(F.col("rpolyt")).alias("n_rpolyt"),
        *(n(disc & focal & side & (rev if x == "rc" else ~rev)).alias(f"n_{y}_{x}") for y, side in (("l", l), ("r", r)) for x in ("rc", "nrc")))
    pairs_ = reads_.filter("disc")
    for of, strand, name in ((1, ~rev, "nrc_at"), (3, rev, "rc_at")):
        out = out.join(_quantile(pairs_.filter(focal & strand), name, of), KEY, "left")
    mates = {}
    for side, name in ((l, "l"), (r, "r")):
        mates[name] = pairs_.filter(side).select(*KEY, "mate_chrom", "mate_pos")
        found = unique_cluster(mates[name].withColumnsRenamed({"chrom": "_chrom"}).withColumnsRenamed({"mate_chrom": "chrom", "mate_pos": "pos"}), ["sample", "_chrom", "site"], half, s.dominant, s.together, s.spread).withColumnRenamed("_chrom", "chrom")
        # positions of a cluster are told only where one contig dominates
        told = (F.col("total") >= half) & (F.col("n") > half) & (F.col("n") > s.dominant * F.col("total"))
        out = out.join(found.select(*KEY, F.col("mate_chrom").alias(f"{name}_chrom"), F.when(told, F.col("mate_pos")).otherwise(-1).alias(f"{name}_pos"), F.col("n").alias(f"n_{name}"), F.col("is_cluster").alias(f"{name}_cluster")), KEY, "left")
    out = out.fillna({"nrc_at": -1, "rc_at": -1, "l_pos": -1, "r_pos": -1, "n_l": 0, "n_r": 0, "l_cluster": False, "r_cluster": False})
    one = out.filter(F.col("l_cluster") != F.col("r_cluster"))
    for name, other in (("l", "r"), ("r", "l")):
        src = one.filter(F.col(f"{name}_cluster")).select(*KEY, F.col(f"{name}_chrom").alias("src_chrom"), F.col(f"{name}_pos").alias("src_pos"))
        side = _other_side(mates[other].join(src, KEY), repeats, half, s).withColumn("_of", F.lit(other))
        both = side if name == "l" else both.unionByName(side)
    out = out.join(both, KEY, "left")
    strands = (F.col("n_l_nrc") > s.strand * (F.col("n_l_rc") + F.col("n_l_nrc"))) & (F.col("n_r_rc") > s.strand * (F.col("n_r_rc") + F.col("n_r_nrc")))
    same = F.col("l_cluster") & F.col("r_cluster") & (F.col("l_chrom") == F.col("r_chrom")) & (F.abs(F.col("l_pos") - F.col("r_pos")) < s.longest)
    polya = ((F.col("n_lpolya") >= clips / 2) | (F.col("n_rpolyt") >= clips / 2)) & ((F.col("n_lpolya") > s.least_polya * F.col("n_lclip")) | (F.col("n_rpolyt") > s.least_polya * F.col("n_rclip")))
    total = F.col("n_left") + F.col("n_right")
    depth = {x: F.col(y) * config.read_length / s.local for x, y in (("lcov", "n_left"), ("rcov", "n_right"))}
    most = s.coverage * s.coverage_times
    return out.withColumns({
        "l_pos": F.when(F.col("_of") == "l", F.col("other_mid")).otherwise(F.col("l_pos")), "r_pos": F.when(F.col("_of") == "r", F.col("other_mid")).otherwise(F.col("r_pos")), **depth,
        "consistent": F.coalesce(strands & (same | F.col("other_ok")), F.lit(False)), "polya": polya, "inner": ~((F.col("site") < F.col("nrc_at")) | ((F.col("site") > F.col("rc_at")) & (F.col("rc_at") > 0))),
        "depth_ok": (depth["lcov"] <= most) & (depth["rcov"] <= most), "placed_ok": (total > 0) & (F.col("n_poor") <= s.most_poor * total)}).drop("_of", "other_ok", "other_mid")


def candidates(found: DataFrame) -> DataFrame:
    """evidence() -> rows that pass all verdicts, with the source: the right side's contig, from l_pos to r_pos in either order.

    A position of -1 isn't known: the source is then the 500 bases up to the other one. Without either there is no candidate.
    """
    a, b = F.least("l_pos", "r_pos"), F.greatest("l_pos", "r_pos")
    passed = found.filter("consistent and polya and inner and depth_ok and placed_ok").filter((a > 0) | (b > 0))
    return passed.withColumns({"src_chrom": F.col("r_chrom"), "src_start": F.when(a < 0, b - 500).otherwise(a), "src_end": b})


def well_placed(found: DataFrame, reads: DataFrame, s: Orphans = Orphans()) -> DataFrame:
    """candidates() whose source region has reads of the sample, less than a tenth of them poorly placed."""
    regions = found.select(F.col("src_chrom").alias("chrom"), "sample", F.col("src_start").alias("start"), F.greatest("src_end", F.col("src_start") + 1).alias("end")).distinct()
    usable = reads.filter(~F.col("is_unmapped") & (F.size("cigar") > 0))
    whole = usable.select("chrom", "sample", F.col("pos").alias("start"), F.greatest(C.reference_end(F.col("pos"), F.col("cigar")), F.col("pos") + 1).alias("end"), (F.col("mapq") < s.poor).alias("poor"))
    hits = overlaps(regions, whole).filter(F.col("sample") == F.col("sample_b"))
    good = hits.groupBy("sample", F.col("chrom").alias("src_chrom"), F.col("start").alias("src_start"), F.col("end").alias("_e")).agg(F.count("*").alias("_n"), F.count_if("poor_b").alias("_p")).filter(F.col("_p") < s.most_poor * F.col("_n"))
    return found.withColumn("_e", F.greatest("src_end", F.col("src_start") + 1)).join(good.drop("_n", "_p"), ["sample", "src_chrom", "src_start", "_e"], "left_semi").drop("_e")


COUNTERS = ("n_lclip", "n_rclip", "n_lpolya", "n_rpolyt", "n_l", "n_r", "n_l_rc", "n_l_nrc", "n_r_rc", "n_r_nrc", "lcov", "rcov")


def merged(found: DataFrame, s: Orphans = Orphans()) -> DataFrame:
    """candidates() of all samples -> one row a site: counters added up over samples, in their order, that agree with the last one taken on the source (one contig, both positions within `spread`)."""
    one = F.struct("sample", "src_chrom", "l_pos", "r_pos", *(F.col(c).cast("double").alias(c) for c in COUNTERS))
    rows = found.groupBy("chrom", "site").agg(F.array_sort(F.collect_list(one)).alias("_x"))  # a row for each sample

    def take(a: Column, b: Column) -> Column:
        agree = (a["src_chrom"] == b["src_chrom"]) & (F.abs(a["l_pos"] - b["l_pos"]) <= s.spread) & (F.abs(a["r_pos"] - b["r_pos"]) <= s.spread)
        return F.when(agree, F.struct(b["sample"].alias("sample"), b["src_chrom"].alias("src_chrom"), b["l_pos"].alias("l_pos"), b["r_pos"].alias("r_pos"), *((a[c] + b[c]).alias(c) for c in COUNTERS))).otherwise(a)

    folded = rows.select("chrom", "site", F.aggregate(F.slice("_x", 2, 1 << 30), F.col("_x")[0], take).alias("x"))
    return folded.select("chrom", "site", "x.src_chrom", F.least("x.l_pos", "x.r_pos").alias("src_start"), F.greatest("x.l_pos", "x.r_pos").alias("src_end"), *(F.col(f"x.{c}").cast("double" if c.endswith("cov") else "long").alias(c) for c in COUNTERS))


def calls(reads: DataFrame, sites: DataFrame, repeats: DataFrame, blacklist: DataFrame, clips: int, pairs: int, s: Orphans = Orphans(), config: Config = Config(), at_sources: DataFrame | None = None) -> DataFrame:
    """Records of orphan transductions from reads (schema.READ) around candidate sites (chrom, pos) outside the blacklist.

    Over all samples, a site needs half of `clips` on a side and of polyA or polyT there, and half of `pairs` on both sides.
    at_sources: the reads that tell how well source regions are placed, where they aren't those around the sites.
    """
    kept = points_in(sites.select("chrom", "pos").distinct(), blacklist, how="left_anti")
    found = written(candidates(evidence(reads, kept, repeats, clips, pairs, s, config)), "orphan-candidates")
    good = merged(well_placed(found, reads if at_sources is None else at_sources, s), s)
    return good.filter((F.greatest("n_lclip", "n_rclip") >= clips / 2) & (F.greatest("n_lpolya", "n_rpolyt") >= clips / 2) & (F.least("n_l", "n_r") >= pairs / 2))


def sources_among(found: DataFrame) -> DataFrame:
    """evidence() -> sites that look like the source of a transduction: their pairs' reads aren't where an insertion has them."""
    return found.filter(~F.col("inner")).select("sample", "chrom", "site")


#: Edges that a task of a grouping holds, while DEALT tasks are enough: up to that many Spark writes a shuffle without holding its rows.
EDGES, DEALT = 1 << 17, 200


def _dealt(edges: DataFrame, n: int, *by: str) -> DataFrame:
    """n edges over so many tasks that none groups many; nearly all keys differ, so grouping them before a shuffle saves nothing."""
    return edges.repartition(min(DEALT, max(1, -(-n // EDGES))), *by)


def matched(edges: DataFrame, repeated: Callable[[str], Column] = F.max) -> DataFrame:
    """edges (source, insertion, support) -> pairs in which each source and each insertion is once, the best supported first.

    As if edges were taken in the order of support (greatest first), then of their hash, and dropped where either end is
    taken. A round takes all edges that come first at both of their ends; as the hash is like a random order, rounds are few
    even where all supports are equal. Edges with a null are left out, of repeated ones the greatest support counts (or what
    `repeated` makes of it). A pass over the edges tells how many there are.
    """
    order = F.struct(F.negate("support").alias("m"), F.xxhash64("source", "insertion").alias("h"), F.col("source").alias("a"), F.col("insertion").alias("b"))
    whole = edges.dropna(subset=["source", "insertion", "support"])
    rest = written(_dealt(whole, edges.count(), "source", "insertion").groupBy("source", "insertion").agg(repeated("support").alias("support")), "edges")
    taken = []
    while n := rest.count():
        best = {c: _dealt(rest, n, c).groupBy(c).agg(F.min(order).alias("x")).select("x.a", "x.b", F.negate("x.m").alias("support")) for c in ("source", "insertion")}
        now = written(best["source"].join(best["insertion"].drop("support"), ["a", "b"]).select(F.col("a").alias("source"), F.col("b").alias("insertion"), "support"), "matched")
        taken.append(now)
        for c in ("source", "insertion"):
            rest = rest.join(now.select(c), c, "left_anti")
        rest = written(rest.select("source", "insertion", "support"), "edges")
    out = edges.select("source", "insertion", "support").limit(0)
    for t in taken:
        out = out.unionByName(t)
    return out
