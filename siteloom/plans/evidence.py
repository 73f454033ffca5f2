"""Queries of the operators on sites' evidence: consistency, filters, records, transductions, and read-level aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar as C
from ..operators import consistency, population, reads, rules, transduction
from .queries import _cohort, _COHORT, query
from .virtual import table, view

KEY = ["chrom", "site"]


def _cc(rows: str) -> str:
    """The cluster on the consensus that most of the rows (chrom, site, cns) lie in, in SQL."""
    return f"""SELECT chrom, site, b.s AS start, b.e AS "end", b.n AS n, b.k >= 0.4 * a AS consistent FROM (SELECT chrom, site, arg_max({{'s': s, 'e': e, 'n': n, 'k': k}}, (n, -island)) AS b, sum(k) AS a FROM (
      SELECT chrom, site, island, min(pos) AS s, max(pos) AS e, sum(n)::BIGINT AS n, count(*) AS k FROM (SELECT *, max(st) OVER (PARTITION BY chrom, site ORDER BY pos) AS island FROM (
        SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom, site ORDER BY pos) <= 15 THEN NULL ELSE pos END AS st FROM (SELECT chrom, site, cns AS pos, count(*) AS n FROM ({rows}) GROUP BY ALL))) GROUP BY ALL) GROUP BY ALL)"""


def _side(side: str) -> str:
    """A side's densest window on the reference, and the cluster of its clips."""
    rows = f"(SELECT * FROM evidence WHERE side = '{side}')"
    peak = f"""(SELECT chrom, site, arg_max(pos, (s, -pos)) AS peak, max(s) AS n FROM (SELECT chrom, site, pos, sum(k) OVER (PARTITION BY chrom, site ORDER BY pos RANGE BETWEEN 7 PRECEDING AND 6 FOLLOWING)::BIGINT AS s
      FROM (SELECT chrom, site, ref AS pos, count(*) AS k FROM {rows} GROUP BY ALL) WHERE pos > 0) GROUP BY ALL)"""
    return f"""SELECT chrom, site, peak, p.n, c.start, c."end", c.consistent FROM {peak} p LEFT JOIN ({_cc(f"SELECT r.chrom, r.site, r.cns FROM {rows} r JOIN {peak} q ON r.chrom = q.chrom AND r.site = q.site AND r.ref >= peak - 7 AND r.ref <= peak + 6")}) c USING (chrom, site)"""


def _ev(spark, d):
    return view(spark, d, "evidence")


def _sides(spark, d):
    e = _ev(spark, d)
    return tuple(consistency.clip_side(e.filter(F.col("side") == s).select(*KEY, "ref", "cns"), KEY) for s in "LR")


@query(_cc("SELECT chrom, site, cns FROM evidence"), "evidence")
def consensus_cluster(spark, d):
    return consistency.consensus_cluster(_ev(spark, d), KEY, 15, 0.4)


@query(_side("L"), "evidence")
def clip_side(spark, d):
    return _sides(spark, d)[0]


_ALONE = f"""SELECT chrom, site, l.peak AS l_peak, l.n AS l_n, l.start AS l_start, l."end" AS l_end, r.peak AS r_peak, r.n AS r_n, r.start AS r_start, r."end" AS r_end, r.n IS NULL AS only_left, l.n IS NULL AS only_right FROM ({_side("L")}) l FULL JOIN ({_side("R")}) r USING (chrom, site)
  WHERE coalesce(l.n, 0) + coalesce(r.n, 0) >= CASE WHEN l.n IS NOT NULL AND r.n IS NOT NULL THEN 5 ELSE 3.5 END"""


@query(_ALONE, "evidence")
def clips_alone(spark, d):
    return consistency.clips_alone(*_sides(spark, d), KEY, 5)


@query("SELECT chrom, site FROM (SELECT chrom, site, sample, count(*) AS n FROM evidence GROUP BY ALL) GROUP BY chrom, site HAVING count(*) >= 3 AND count(*) FILTER (n >= 2) = count(*)", "evidence")
def sample_consistency(spark, d):
    counts = _ev(spark, d).groupBy(*KEY, "sample").agg(F.count("*").alias("n"))
    return consistency.in_all_samples(counts, KEY, 3, 2, every=True)


_PAIRS = """SELECT * FROM (SELECT chrom, site, coalesce(max(n) FILTER (side = 'L'), 0) AS l_n, coalesce(max(ns) FILTER (side = 'L'), 0) AS l_n_same, coalesce(max(nd) FILTER (side = 'L'), 0) AS l_n_diff, coalesce(max(nr) FILTER (side = 'L'), 0) AS l_n_rc, coalesce(max(nn) FILTER (side = 'L'), 0) AS l_n_not_rc,
    coalesce(max(n) FILTER (side = 'R'), 0) AS r_n, coalesce(max(ns) FILTER (side = 'R'), 0) AS r_n_same, coalesce(max(nd) FILTER (side = 'R'), 0) AS r_n_diff, coalesce(max(nr) FILTER (side = 'R'), 0) AS r_n_rc, coalesce(max(nn) FILTER (side = 'R'), 0) AS r_n_not_rc,
    coalesce(bool_or(ok) FILTER (side = 'L'), false) AS l_cluster, coalesce(bool_or(ok) FILTER (side = 'R'), false) AS r_cluster, max(b.start) FILTER (side = 'L' AND ok) AS l_start, max(b."end") FILTER (side = 'L' AND ok) AS l_end, max(b.start) FILTER (side = 'R' AND ok) AS r_start, max(b."end") FILTER (side = 'R' AND ok) AS r_end
  FROM (SELECT *, b.n >= 0.4 * n AS ok FROM (SELECT chrom, site, side, count(*) AS n, count(*) FILTER (same_ori) AS ns, count(*) FILTER (NOT same_ori) AS nd, count(*) FILTER (anchor_rc) AS nr, count(*) FILTER (NOT anchor_rc) AS nn FROM sided GROUP BY ALL) JOIN (
    SELECT chrom, site, side, arg_max({'start': pos, 'end': e, 'n': m}, (m, -pos)) AS b FROM (SELECT chrom, site, side, pos, sum(k) OVER w - 1 AS m, max(pos) OVER w AS e FROM (SELECT chrom, site, side, cns AS pos, count(*) AS k FROM sided GROUP BY ALL)
      WINDOW w AS (PARTITION BY chrom, site, side ORDER BY pos RANGE BETWEEN CURRENT ROW AND 100 FOLLOWING)) GROUP BY ALL) USING (chrom, site, side)) GROUP BY chrom, site) WHERE (l_cluster OR r_cluster) AND NOT (l_cluster AND r_cluster AND l_n + r_n < 6)"""
_PAIRS = "SELECT * FROM (WITH sided AS (SELECT * EXCLUDE (side), CASE WHEN abs(anchor - clip_pos) < 50 AND anchor_lclip AND NOT anchor_rclip THEN 'R' WHEN abs(anchor - clip_pos) < 50 AND anchor_rclip AND NOT anchor_lclip THEN 'L' WHEN anchor < clip_pos THEN 'L' ELSE 'R' END AS side FROM evidence) " + _PAIRS + ")"


def _pairs(spark, d):
    return consistency.pair_clusters(_ev(spark, d).drop("side"), KEY, 100, 0.4, 6)


@query(_PAIRS, "evidence")
def pair_clusters(spark, d):
    return _pairs(spark, d)


_DEPTH = "SELECT chrom, site, avg(mapq) FILTER (ref < clip_pos) AS lcov, avg(mapq) FILTER (ref >= clip_pos) AS rcov FROM evidence GROUP BY ALL"


@query(f"""SELECT chrom, site, l_peak AS lclip_pos, r_peak AS rclip_pos, c.l_n AS n_all_lclip_, coalesce(c.l_n, 0) + coalesce(c.r_n, 0) AS n_clip, p.l_n AS n_all_ldisc, p.r_n AS n_all_rdisc, coalesce(l_peak, r_peak) AS refined, CASE WHEN abs(r_peak - l_peak) <= 100 THEN r_peak - l_peak END AS tsd,
  (CASE WHEN c.l_start IS NOT NULL AND c.l_end IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN c.r_start IS NOT NULL AND c.r_end IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN p.l_start IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN p.r_start IS NOT NULL THEN 1 ELSE 0 END) AS n_clusters, round(lcov, 6) AS lcov, round(rcov, 6) AS rcov
  FROM ({_ALONE}) c JOIN ({_PAIRS}) p USING (chrom, site) JOIN ({_DEPTH}) USING (chrom, site)""".replace("c.l_n AS n_all_lclip_, ", ""), "evidence")
def site_records(spark, d):
    depth = _ev(spark, d).groupBy(*KEY).agg(F.avg(F.when(F.col("ref") < F.col("clip_pos"), F.col("mapq"))).alias("lcov"), F.avg(F.when(F.col("ref") >= F.col("clip_pos"), F.col("mapq"))).alias("rcov"))
    out = consistency.assemble(consistency.clips_alone(*_sides(spark, d), KEY, 5), _pairs(spark, d), depth, KEY)
    return out.select(*KEY, "lclip_pos", "rclip_pos", (F.col("n_all_lclip") + F.col("n_all_rclip")).alias("n_clip"), "n_all_ldisc", "n_all_rdisc", "refined", "tsd", "n_clusters", F.round("lcov", 6).alias("lcov"), F.round("rcov", 6).alias("rcov"))


def _meet(a: str, b: str) -> str:
    w = "276.0"
    return f"(({a}s - {w} >= {b}s - {w} AND {a}s - {w} <= {b}e + {w}) OR ({a}e + {w} >= {b}s - {w} AND {a}e + {w} <= {b}e + {w}))"


_FILTER = f"""SELECT chrom, pos, reason, CASE WHEN reason IS NULL THEN hc END AS high_confident, CASE WHEN reason IS NULL THEN low END AS low_confident, CASE WHEN reason IS NULL THEN fin END AS reaches_end FROM (SELECT *, NOT td AND lok AND rok AND NOT nopa AS hc,
  NOT td AND ((n_all_ldisc < 3 AND n_all_rclip <= 0 AND NOT llow) OR (n_all_rdisc < 3 AND n_all_lclip <= 0 AND NOT rlow)) AS low, td OR tdisc OR tclip AS fin,
  CASE WHEN td AND (llow OR rlow) THEN 'td_depth' WHEN NOT td AND NOT lok AND NOT rok THEN 'no_side_consistent' WHEN NOT td AND l AND NOT rdk AND r AND NOT ldk THEN 'clips_without_pairs' WHEN NOT td AND nopa AND l AND r AND NOT tdisc AND NOT tclip THEN 'no_polya'
    WHEN NOT td AND NOT tdisc AND ldk AND rdk AND NOT tclip AND NOT ((NOT l AND rlow) OR (NOT r AND llow)) THEN 'no_end' END AS reason FROM (
  SELECT *, NOT contains(td_src, 'not_transduction') AS td, rcov > 0 AND (rcov - lcov) / rcov >= 0.35 AS llow, lcov > 0 AND (lcov - rcov) / lcov >= 0.35 AS rlow, n_all_lclip >= 2 AS l, n_all_rclip >= 2 AS r, n_all_ldisc >= 3 AS ldk, n_all_rdisc >= 3 AS rdk, n_all_lpolya = 0 AND n_all_rpolya = 0 AS nopa,
    n_all_lclip >= 2 AND n_all_rdisc >= 3 AND {_meet('l', 'dr')} AS lok, n_all_rclip >= 2 AND n_all_ldisc >= 3 AND {_meet('r', 'dl')} AS rok, dle >= 5000 OR dre >= 5000 AS tdisc, le >= 5000 OR re >= 5000 AS tclip FROM (
  SELECT *, coalesce(lc_start, -1) AS ls, coalesce(lc_end, -1) AS le, coalesce(rc_start, -1) AS rs, coalesce(rc_end, -1) AS re, coalesce(ld_start, -1) AS dls, coalesce(ld_end, -1) AS dle, coalesce(rd_start, -1) AS drs, coalesce(rd_end, -1) AS dre FROM records)))"""


@query(_FILTER, "records")
def evidence_filter(spark, d):
    steps, marks = consistency.evidence_rules(2, 3, 550, 5000)
    out = rules.post_filter(view(spark, d, "records"), steps)
    return out.select("chrom", "pos", "reason", *(F.when(F.col("reason").isNull(), m).alias(k) for k, m in marks.items()))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN abs(l1 - r1) <= 50 THEN l1 WHEN abs(l1 - r2) <= 50 AND (abs(l2 - r1) > 50 OR a > b) THEN l1 WHEN abs(l2 - r1) <= 50 THEN l2 ELSE l1 END AS l, CASE WHEN abs(l1 - r1) <= 50 THEN r1 WHEN abs(l1 - r2) <= 50 AND (abs(l2 - r1) > 50 OR a > b) THEN r2 WHEN abs(l2 - r1) <= 50 THEN r1 ELSE r1 END AS r,
  abs(l1 - r1) <= 50 OR abs(l1 - r2) <= 50 OR abs(l2 - r1) <= 50 AS is_tsd FROM (SELECT *, l_partkey % 120 AS l1, l_partkey % 150 AS l2, l_suppkey % 130 AS r1, l_suppkey % 90 + 30 AS r2, l_partkey % 7 + l_suppkey % 5 AS a, l_partkey % 5 + l_suppkey % 7 AS b FROM lineitem)""")
def best_pair(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    x = consistency.best_pair(p % 120, p % 150, s % 130, s % 90 + 30, p % 7, p % 5, s % 7, s % 5, 50)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query("""SELECT chrom, site, source, n, total, CASE WHEN total < 4 THEN 'none' WHEN n >= 4 AND n >= 0.45 * total AND n > 0.5 * (n + coalesce(o, 0)) THEN 'td' ELSE 'normal' END AS verdict FROM (SELECT chrom, site, arg_max(source, (n, -source)) AS source, max(n) AS n, sum(n)::BIGINT AS total FROM (SELECT chrom, site, source, count(*) AS n FROM evidence GROUP BY ALL) GROUP BY ALL)
  LEFT JOIN (SELECT chrom, site, source, count(*) AS o FROM evidence WHERE mapq < 20 GROUP BY ALL) USING (chrom, site, source)""", "evidence")
def td_source(spark, d):
    e = _ev(spark, d)
    others = e.filter("mapq < 20").groupBy(*KEY, "source").agg(F.count("*").alias("n_other"))
    return transduction.pick_source(e, KEY, 4, others=others)


@query("SELECT chrom, site, b.source, b.n5, b.n3, b.n3 > b.n5 AS is_3, greatest(b.n3, b.n5) > 3 AS is_td FROM (SELECT chrom, site, arg_max({'source': source, 'n5': n5, 'n3': n - n5}, (n, -source)) AS b FROM (SELECT chrom, site, source, count(*) AS n, count(*) FILTER (flank_at < 300) AS n5 FROM evidence GROUP BY ALL) GROUP BY ALL)", "evidence")
def flank_vote(spark, d):
    return transduction.flank_vote(_ev(spark, d).withColumnRenamed("flank_at", "at"), KEY, 300, 3)


@query("SELECT chrom, site, count(*) FILTER (anchor + 5 < clip_pos) AS n_left, count(*) FILTER (anchor + 5 >= clip_pos) AS n_right FROM evidence GROUP BY ALL HAVING n_left >= 4 AND n_right >= 4", "evidence")
def orphan_sides(spark, d):
    return transduction.orphan_sides(_ev(spark, d), KEY, "clip_pos", 4)


@query("SELECT chrom, site, count(*) AS n_clip, sum(n_polya)::BIGINT AS n_polya FROM evidence GROUP BY ALL HAVING count(*) >= 8 AND sum(n_polya) >= 12", "evidence")
def td_clips(spark, d):
    e = _ev(spark, d)
    return transduction.with_clips(e.select(*KEY, F.lit(1).alias("n")), e.select(*KEY, F.col("n_polya").alias("n")), KEY, 8, 12)


@query("SELECT chrom, site, count(*) FILTER (family = 'Alu') AS n_alu, count(*) FILTER (family = 'L1') AS n_l1, count(*) FILTER (family = 'SVA') AS n_sva, greatest(n_alu, n_sva) < 5 AS stays FROM evidence GROUP BY ALL", "evidence")
def td_decoys(spark, d):
    return transduction.decoys(_ev(spark, d), KEY, "L1", 5)


@query("""SELECT chrom, site, b.c AS mate_chrom, b.mid AS mate_pos, b.n AS n, total, total >= 2 AND b.n > 2 AND b.n > 0.1 * total AND b.w > 0.45 * b.n AS is_cluster FROM (SELECT chrom, site, arg_max({'c': mate_chrom, 'n': n, 'mid': mid, 'w': w}, (n, -mate_chrom)) AS b, sum(n)::BIGINT AS total FROM (
  SELECT chrom, site, mate_chrom, count(*) AS n, any_value(mid) AS mid, count(*) FILTER (abs(mate_pos - mid) < 500) AS w FROM evidence JOIN (SELECT chrom, site, mate_chrom, list_sort(list(mate_pos))[(count(*) // 2 + 1)::INT] AS mid FROM evidence GROUP BY ALL) USING (chrom, site, mate_chrom) GROUP BY ALL) GROUP BY ALL)""", "evidence")
def unique_cluster(spark, d):
    e = _ev(spark, d).select(F.col("chrom").alias("c"), "site", F.col("mate_chrom").alias("chrom"), F.col("mate_pos").alias("pos"))
    return transduction.unique_cluster(e, ["c", "site"], 2, 0.1, 0.45, 500).withColumnRenamed("c", "chrom")


@query("""SELECT *, CASE WHEN n_repeat > 2 AND n_repeat > 0.3 * total THEN 'repeat' WHEN n_same > 1 AND n_same > 0.05 * total THEN 'source' ELSE 'none' END AS state FROM (SELECT chrom, site, count(*) AS total, count(*) FILTER (c IS NOT NULL) AS n_repeat, count(*) FILTER (c IS NULL AND mate_chrom = source AND abs(mate_pos - site) < 3000) AS n_same
  FROM evidence LEFT JOIN (SELECT DISTINCT e.mate_chrom AS c, e.mate_pos AS p FROM evidence e JOIN repeats i ON e.mate_chrom = i.chrom AND e.mate_pos >= i.start AND e.mate_pos < i."end") ON mate_chrom = c AND mate_pos = p GROUP BY ALL)""", "evidence", "repeats")
def repeat_or_same(spark, d):
    e = _ev(spark, d).select(F.col("chrom").alias("c"), "site", F.col("mate_chrom").alias("chrom"), F.col("mate_pos").alias("pos"), F.col("source").alias("src_chrom"), F.col("site").alias("src_pos"))
    return transduction.repeat_or_same(e, view(spark, d, "repeats"), ["c", "site"], 2, 1, 0.3, 0.05, 3000).withColumnRenamed("c", "chrom")


@query("SELECT a.chrom, a.pos, arg_min(b.pos, (abs(a.pos - b.pos), b.pos)) AS sibling FROM (SELECT DISTINCT chrom, pos FROM calls WHERE priority = 0) a LEFT JOIN (SELECT DISTINCT chrom, pos FROM calls WHERE priority = 1) b ON a.chrom = b.chrom AND abs(a.pos - b.pos) < 100 GROUP BY ALL", "calls")
def sibling_source(spark, d):
    v = view(spark, d, "calls")
    return transduction.sibling_source(v.filter("priority = 0").select("chrom", "pos").distinct(), v.filter("priority = 1"), 100)


_FOUND = "(SELECT chrom, pos + 3 AS pos, 'src' || (pos % 7) AS td_src, CAST(pos % 5 AS INT) AS n_td_clip, CAST(pos % 6 AS INT) AS n_td_disc, CAST(pos % 4 AS INT) AS n_td_polya FROM calls WHERE priority = 1)"
_BASE = "(SELECT chrom, pos, 'not_transduction' AS td_src, 0 AS n_td_clip, 0 AS n_td_disc, 0 AS n_td_polya FROM calls WHERE priority = 0)"


def _td_parts(spark, d):
    v = view(spark, d, "calls")
    found = v.filter("priority = 1").select("chrom", (F.col("pos") + 3).alias("pos"), F.concat(F.lit("src"), (F.col("pos") % 7).cast("string")).alias("td_src"), *((F.col("pos") % m).cast("int").alias(c) for c, m in (("n_td_clip", 5), ("n_td_disc", 6), ("n_td_polya", 4))))
    base = v.filter("priority = 0").select("chrom", "pos", F.lit("not_transduction").alias("td_src"), *(F.lit(0).alias(c) for c in ("n_td_clip", "n_td_disc", "n_td_polya")))
    return transduction.update_records(base, found, 75)


_UPDATED = f"""SELECT r.chrom, r.pos, coalesce(f.td_src, r.td_src) AS td_src, coalesce(f.n_td_clip, r.n_td_clip) AS n_td_clip, coalesce(f.n_td_disc, r.n_td_disc) AS n_td_disc, coalesce(f.n_td_polya, r.n_td_polya) AS n_td_polya, hit FROM (SELECT r.*, (SELECT min(f.pos) FROM {_FOUND} f WHERE f.chrom = r.chrom AND f.pos >= r.pos - 75 AND f.pos < r.pos + 75) AS hit FROM {_BASE} r) r
  LEFT JOIN (SELECT chrom, pos, m.a AS td_src, m.b AS n_td_clip, m.c AS n_td_disc, m.d AS n_td_polya FROM (SELECT chrom, pos, min({{'a': td_src, 'b': n_td_clip, 'c': n_td_disc, 'd': n_td_polya}}) AS m FROM {_FOUND} GROUP BY chrom, pos)) f ON f.chrom = r.chrom AND f.pos = hit"""


@query(f"SELECT 'old' AS state, * EXCLUDE (hit) FROM ({_UPDATED}) UNION ALL SELECT 'new', f.* FROM {_FOUND} f WHERE NOT EXISTS (SELECT 1 FROM ({_UPDATED}) u WHERE u.chrom = f.chrom AND u.hit = f.pos)", "calls")
def td_records(spark, d):
    old, new = _td_parts(spark, d)
    return old.withColumn("state", F.lit("old")).unionByName(new.withColumn("state", F.lit("new"))).select("state", "chrom", "pos", *transduction.TD_COLUMNS)


@query(f"SELECT * EXCLUDE (hit) FROM ({_UPDATED}) u WHERE td_src <> 'not_transduction' OR EXISTS (SELECT 1 FROM calls c WHERE c.priority = 0 AND c.sub_type = 'two_side_tprt_both' AND c.chrom = u.chrom AND c.pos = u.pos)", "calls")
def high_confidence(spark, d):
    confident = view(spark, d, "calls").filter("priority = 0 and sub_type = 'two_side_tprt_both'")
    return transduction.high_confidence(confident, _td_parts(spark, d)[0], F.col("td_src") != "not_transduction")


@query("SELECT chrom, pos FROM calls a WHERE priority < 2 AND NOT EXISTS (SELECT 1 FROM calls f WHERE f.sample = 5 AND f.chrom = a.chrom AND f.pos = a.pos) UNION ALL SELECT DISTINCT chrom, pos FROM calls n WHERE priority > 0 AND NOT EXISTS (SELECT 1 FROM calls a WHERE a.priority < 2 AND a.chrom = n.chrom AND a.pos = n.pos AND NOT EXISTS (SELECT 1 FROM calls f WHERE f.sample = 5 AND f.chrom = a.chrom AND f.pos = a.pos))", "calls")
def append_new(spark, d):
    v = view(spark, d, "calls").select("chrom", "pos", "priority", "sample")
    two = ["chrom", "pos"]
    return transduction.append_new(v.filter("priority < 2").select(*two), v.filter("sample = 5"), v.filter("priority > 0").select(*two))


@query("SELECT chrom, ref AS pos, count(*) FILTER (side = 'L') AS n_l, count(*) FILTER (side = 'R') AS n_r, coalesce(sum(n_polya) FILTER (side = 'L'), 0)::BIGINT AS l_polya, coalesce(sum(n_polya) FILTER (side = 'R'), 0)::BIGINT AS r_polya FROM evidence WHERE mapq >= 12 GROUP BY ALL", "evidence")
def realigned_clips(spark, d):
    return reads.realigned_counts(_ev(spark, d).filter("mapq >= 12").withColumnsRenamed({"ref": "pos"}))


@query("SELECT chrom, site, count(DISTINCT bx) FILTER (phase = 1) AS hap1, count(DISTINCT bx) FILTER (phase = 2) AS hap2, count(DISTINCT bx) FILTER (phase = 0) AS unphased, count(DISTINCT bx) FILTER (phase = 3) AS conflicting FROM evidence GROUP BY ALL HAVING count(DISTINCT bx) <= 39", "evidence")
def phased_barcodes(spark, d):
    return reads.phased_barcodes(_ev(spark, d), KEY, 39)


@query("SELECT chrom, site, mate_chrom, count(*) AS n, max(mate_pos) - min(mate_pos) AS span FROM evidence GROUP BY ALL HAVING count(*) >= 2", "evidence")
def mate_support(spark, d):
    return reads.mate_support(_ev(spark, d), KEY, 2)


@query("SELECT chrom, site, count(*) FILTER (ref <= clip_pos + 5) AS n_left, count(*) FILTER (ref >= clip_pos - 5) AS n_right FROM evidence GROUP BY ALL", "evidence")
def split_at_peak(spark, d):
    return reads.split_at(_ev(spark, d).withColumnRenamed("ref", "pos"), KEY, "clip_pos", 5)


@query("""SELECT chrom, count(*) AS n, count(*) FILTER (a IS NOT NULL AND b IS NULL OR a IS NULL AND b IS NOT NULL) AS n_one, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both FROM (SELECT r.chrom, x.c AS a, y.c AS b FROM reads r LEFT JOIN hits x ON r.mate_chrom = x.c AND r.mate_pos = x.p
  LEFT JOIN (SELECT DISTINCT r.chrom AS c, r.pos AS p FROM reads r JOIN repeats i ON r.chrom = i.chrom AND r.pos >= i.start AND r.pos < i."end") y ON r.chrom = y.c AND r.pos = y.p WHERE r.mate_chrom <> r.chrom OR abs(r.mate_pos - r.pos) > 2000) GROUP BY chrom""", "reads", "repeats", "hits")
def repeat_pairs(spark, d):
    r = view(spark, d, "reads")
    r = r.filter(C.discordant(F.col("chrom"), F.col("pos"), F.col("mate_chrom"), F.col("mate_pos")))
    out = reads.ends_in_repeats(r, view(spark, d, "repeats"))
    return out.groupBy("chrom").agg(F.count("*").alias("n"), F.count_if("one_in_repeat").alias("n_one"), F.count_if("both_in_repeat").alias("n_both"))


@query("""SELECT chrom, site, arg_max(svtype, (n, -first)) AS svtype, max(n) AS n FROM (SELECT chrom, site, svtype, count(*) AS n, min(pos) AS first FROM csites GROUP BY ALL) GROUP BY chrom, site""", *_COHORT)
def site_modes(spark, d):
    return population.site_modes(_cohort(spark, d), ["svtype"]).select("chrom", "site", "svtype", F.col("svtype_n").alias("n"))


@query("SELECT chrom, site, population, arg_max(source, (n, -source)) AS source, max(n) AS n FROM (SELECT chrom, site, population, sample % 9 AS source, count(*) AS n FROM csites JOIN samples USING (sample) GROUP BY ALL) GROUP BY ALL", *_COHORT)
def population_sources(spark, d):
    return population.source_by_population(_cohort(spark, d).withColumn("source", F.col("sample") % 9), view(spark, d, "samples"))


@query("SELECT source, count(*) AS n, avg(len) AS mean_len, min(len) AS min_len FROM (SELECT source, ref, sum(cns)::BIGINT AS len FROM evidence GROUP BY ALL) GROUP BY source", "evidence")
def consensus_lengths(spark, d):
    return reads.sequence_lengths(_ev(spark, d).select("source", F.col("ref").alias("name"), F.col("cns").alias("length")), ["source"])


@query("SELECT l.chrom, l.site, l.ref AS left_at, r.ref AS right_at FROM evidence l JOIN evidence r ON l.chrom = r.chrom AND l.site = r.site AND l.bx = r.bx AND l.same_ori = r.same_ori AND r.ref - l.ref >= 30 WHERE l.side = 'L' AND r.side = 'R'", "evidence")
def flank_pairs(spark, d):
    e = _ev(spark, d).select(*KEY, "side", F.col("bx").alias("contig"), F.col("same_ori").alias("is_rc"), F.col("ref").alias("at"))
    out = reads.flanks_on_contigs(e.filter("side = 'L'"), e.filter("side = 'R'"), KEY, 30)
    return out.select(*KEY, "left_at", "right_at")


@query("SELECT * FROM (SELECT chrom, pos, count(*) FILTER (side = 'L') AS n_l, count(*) FILTER (side = 'R') AS n_r FROM reads WHERE side IN ('L', 'R') GROUP BY ALL) WHERE (n_l >= 2 OR n_r >= 2) AND n_l + n_r <= 3", "reads")
def clip_depth(spark, d):
    clips = view(spark, d, "reads").filter("side IN ('L', 'R')").groupBy("chrom", "pos").agg(F.count_if(F.col("side") == "L").alias("n_l"), F.count_if(F.col("side") == "R").alias("n_r"))
    return reads.depth_filter(clips, 2, 2, 3)


@query("""SELECT chrom, site AS pos, sum(l)::BIGINT AS raw_l, sum(r)::BIGINT AS raw_r, sum(pl)::BIGINT AS n_l, sum(pr)::BIGINT AS n_r, bool_or(lc) AS l_cluster, bool_or(rc) AS r_cluster FROM (SELECT chrom, site, sample, count(*) FILTER (side = 'L') AS l, count(*) FILTER (side = 'R') AS r, count(*) FILTER (side = 'L' AND same_ori) AS pl, count(*) FILTER (side = 'R' AND same_ori) AS pr,
  count(*) FILTER (side = 'L') > 4 AS lc, count(*) FILTER (side = 'R') > 4 AS rc FROM evidence GROUP BY ALL) GROUP BY chrom, site HAVING (sum(l) >= 7 AND bool_or(lc)) OR (sum(r) >= 7 AND bool_or(rc))""", "evidence")
def raw_disc(spark, d):
    l, r = F.col("side") == "L", F.col("side") == "R"
    parts = _ev(spark, d).groupBy("chrom", F.col("site").alias("pos"), "sample").agg(
        F.count_if(l).alias("raw_l"), F.count_if(r).alias("raw_r"), F.count_if(l & F.col("same_ori")).alias("n_l"), F.count_if(r & F.col("same_ori")).alias("n_r"), (F.count_if(l) > 4).alias("l_cluster"), (F.count_if(r) > 4).alias("r_cluster"))
    return reads.raw_disc_filter(reads.raw_disc_sum(parts), 8)


@query("""SELECT s.chrom, s.start, s."end", count(r.mate_pos) AS n FROM (SELECT DISTINCT chrom, site AS start, site + 40 AS "end" FROM evidence) s LEFT JOIN reads r ON r.mate_chrom = s.chrom AND r.mate_pos >= s.start AND r.mate_pos <= s."end" GROUP BY ALL""", "evidence", "reads")
def range_mates(spark, d):
    regions = _ev(spark, d).select("chrom", F.col("site").alias("start"), (F.col("site") + 40).alias("end")).distinct()
    return reads.count_between(view(spark, d, "reads").select(F.col("mate_chrom").alias("chrom"), F.col("mate_pos").alias("pos")), regions)


@query("""SELECT chrom, site, CASE WHEN l < 4 THEN l ELSE 0 END AS n_left, CASE WHEN r < 4 THEN r ELSE 0 END AS n_right, d AS n_disc FROM (SELECT chrom, site, count(*) FILTER (source = 1) AS d, count(*) FILTER (side = 'L' AND mapq >= 20) AS l, count(*) FILTER (side = 'R' AND mapq >= 20) AS r FROM evidence GROUP BY ALL) WHERE d >= 3 AND (l >= 4 OR r >= 4)""", "evidence")
def flank_rescue(spark, d):
    e = _ev(spark, d).withColumn("n", F.lit(1))
    left, right = (e.filter((F.col("side") == x) & (F.col("mapq") >= 20)).select(*KEY, "n") for x in "LR")
    return transduction.rescued(e.filter("source = 1").select(*KEY, "n"), left, right, KEY, 4, 3)


#: Pairs of each site's most frequent source, clips of its sides, and their tails; sites with more reverse anchors than forward ones have an orphan's source as well.
_OUT = """WITH pairs AS (SELECT e.* FROM evidence e JOIN (SELECT chrom, site, arg_min(source, (-n, source)) AS source FROM (SELECT chrom, site, source, count(*) AS n FROM evidence GROUP BY ALL) GROUP BY ALL) USING (chrom, site, source)),
  clips AS (SELECT chrom, site, side, ref FROM evidence WHERE mapq > 20), tails AS (SELECT chrom, site, count(*) FILTER (side = 'L' AND n_polya > 0) AS n_lpolya, count(*) FILTER (side = 'R' AND n_polya > 1) AS n_rpolya FROM evidence WHERE n_polya > 0 GROUP BY ALL),
  chosen AS (SELECT chrom, site, min(source) AS source, CASE WHEN count(*) FILTER (anchor < clip_pos) > count(*) FILTER (anchor >= clip_pos) THEN 'L' ELSE 'R' END AS side, greatest(count(*) FILTER (anchor < clip_pos), count(*) FILTER (anchor >= clip_pos)) AS n_disc FROM pairs SEMI JOIN clips USING (chrom, site) SEMI JOIN tails USING (chrom, site) GROUP BY ALL),
  cover AS (SELECT chrom, site, arg_max((pos, e, m), (m, -pos)) AS b, sum(k) AS total FROM (SELECT chrom, site, pos, k, sum(k) OVER w - 1 AS m, max(pos) OVER w AS e FROM (SELECT chrom, site, mate_pos AS pos, count(*) AS k FROM pairs p JOIN chosen c USING (chrom, site) WHERE (CASE WHEN p.anchor < p.clip_pos THEN 'L' ELSE 'R' END) = c.side GROUP BY ALL)
    WINDOW w AS (PARTITION BY chrom, site ORDER BY pos RANGE BETWEEN CURRENT ROW AND 900 FOLLOWING)) GROUP BY ALL),
  orphans AS (SELECT chrom, site, min(mate_chrom) AS source, count(*) FILTER (side = 'L') AS n_left, count(*) FILTER (side = 'R') AS n_right FROM evidence GROUP BY ALL HAVING count(*) FILTER (anchor_rc) > count(*) FILTER (NOT anchor_rc)),
  told AS (SELECT chrom, site, side, n_disc, c.source || '~' || b[1] || '-' || b[2] AS td_src FROM chosen c JOIN cover USING (chrom, site) ANTI JOIN orphans USING (chrom, site) WHERE b[3] >= 0.4 * total UNION ALL SELECT chrom, site, 'R', n_left + n_right, source || '~orphan' FROM orphans SEMI JOIN clips USING (chrom, site)),
  peaks AS (SELECT chrom, site, side, arg_max(pos, (s, -pos)) AS clip_pos, max(s) AS n_clip FROM (SELECT chrom, site, side, pos, sum(k) OVER (PARTITION BY chrom, site, side ORDER BY pos RANGE BETWEEN 7 PRECEDING AND 6 FOLLOWING)::BIGINT AS s FROM (SELECT chrom, site, side, ref AS pos, count(*) AS k FROM clips WHERE ref > 0 GROUP BY ALL)) GROUP BY ALL)
  SELECT chrom, site, side = 'L' AS is_left, n_disc, td_src, coalesce(n_clip, 0) AS n_clip, clip_pos, coalesce(CASE WHEN side = 'L' THEN n_lpolya ELSE n_rpolya END, 0) AS n_polya FROM told LEFT JOIN peaks USING (chrom, site, side) LEFT JOIN tails USING (chrom, site)"""


@query(_OUT, "evidence")
def td_calls(spark, d):
    e = _ev(spark, d)
    best = e.groupBy(*KEY, "source").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.min_by("source", F.struct(F.negate("n"), "source")).alias("source"))
    pairs = e.join(best, [*KEY, "source"]).select(*KEY, "clip_pos", "source", F.col("mate_pos").alias("ref_at"), "anchor")
    clips = e.filter("mapq > 20").select(*KEY, "side", F.col("ref").alias("ref_pos"))
    tails = e.filter("n_polya > 0").groupBy(*KEY).agg(F.count_if(F.col("side") == "L").alias("n_lpolya"), F.count_if((F.col("side") == "R") & (F.col("n_polya") > 1)).alias("n_rpolya"))
    orphans = e.groupBy(*KEY).agg(F.min("mate_chrom").alias("source"), F.count_if(F.col("side") == "L").alias("n_left"), F.count_if(F.col("side") == "R").alias("n_right"), F.count_if("anchor_rc").alias("rc"), F.count("*").alias("n")).filter("2 * rc > n")
    return transduction.called_out(pairs, clips, tails, KEY, "clip_pos", 900, 0.4, orphans)
