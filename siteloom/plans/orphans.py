"""Queries on orphan transductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..operators import orphans
from .queries import query
from .virtual import view

S = orphans.Orphans(extend=50, coverage=400.0)
CLIPS, PAIRS = 6, 20


def _reads(spark, d):
    """The virtual reads as schema.READ."""
    v = view(spark, d, "moved")
    parts = F.filter(F.array(*(F.struct(F.lit(op).alias("op"), x.cast("int").alias("len")) for op, x in ((4, F.col("lead")), (0, 100 - F.col("lead") - F.col("tail")), (4, F.col("tail"))))), lambda x: x["len"] > 0)
    seq = F.concat(F.when(F.col("poly"), F.expr("repeat('A', lead)")).otherwise(F.expr("substr(repeat('ACGGTTCAATC', 12), 1, lead)")), F.expr("substr(repeat('ACGGTTCAATC', 12), 1, 100 - lead - tail)"), F.when(F.col("poly"), F.expr("repeat('T', tail)")).otherwise(F.expr("substr(repeat('ACGGTTCAATC', 12), 1, tail)")))
    own = {"qname": F.lit("q"), "is_read1": F.lit(True), "is_duplicate": F.lit(False), "is_unmapped": F.lit(False), "mate_is_unmapped": F.col("mate_lost"), "is_secondary": F.col("sec"), "is_supplementary": F.lit(False), "is_reverse": F.col("rev"), "mate_is_reverse": F.lit(False),
           "cigar": parts, "seq": seq, "tlen": F.lit(0), "qual": F.array_repeat(F.lit(30).cast("tinyint"), 100), "tags": F.create_map().cast("map<string,string>")}
    return v.select(*(own.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema.READ))


def _with_mates(first):
    """Reads and their mates from 150,000 on, which tell about sources only: sites may lie there too, and see the reads alone."""
    whole = F.array(F.struct(F.lit(0).alias("op"), F.lit(100).alias("len")))
    mate = {"chrom": F.col("mate_chrom"), "pos": F.col("mate_pos"), "mate_chrom": F.col("chrom"), "mate_pos": F.col("pos"), "cigar": whole, "mapq": F.when(F.col("mate_pos") % 15 == 0, 5).otherwise(60), "is_read1": F.lit(False)}
    second = first.filter("not mate_is_unmapped").select(*(mate.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema.READ))
    return first.unionByName(second.filter("pos >= 150000"))


def _sites(spark, d):
    return view(spark, d, "moved").select("chrom", F.col("site").alias("pos")).distinct()


def _repeats(spark, d):
    return view(spark, d, "repeats").select(F.concat(F.lit("c"), F.col("chrom").cast("string")).alias("chrom"), "start", "end")


def _evidence(spark, d):
    return orphans.evidence(_reads(spark, d), _sites(spark, d), _repeats(spark, d), CLIPS, PAIRS, S)


#: Reads around sites, by the read's own words; clips of a window's reads are of A (left) or T (right), or of neither.
_NEAR = """(SELECT m.*, s.site AS place_, m.pos >= s.site - 25 AS r, abs(m.pos - s.site) < 200 AS loc, mapq >= 20 AND NOT sec AS ok, lead > 0 AND abs(m.pos - s.site) < 50 AS lc, tail > 0 AND abs(m.pos + 100 - lead - tail - s.site) < 50 AS rc,
  mapq >= 20 AND NOT sec AND NOT mate_lost AND mate_chrom <> 'hs37d5' AND (m.chrom <> mate_chrom OR abs(mate_pos - s.site) > 100000) AS disc
  FROM (SELECT DISTINCT chrom AS sc, site FROM moved) s JOIN moved m ON m.chrom = s.sc AND m.pos < s.site + 50 AND m.pos + 100 - lead - tail > s.site - 50)"""


def _cluster(side: str) -> str:
    return f"""(SELECT sample, chrom, place_, arg_min((mate_chrom, n, mid, near), (-n, mate_chrom)) AS b, sum(n) AS total FROM (SELECT sample, chrom, place_, mate_chrom, any_value(mid) AS mid, count(*) AS n, count(*) FILTER (abs(mate_pos - mid) < 2000) AS near FROM (
      SELECT d.sample, d.chrom, d.place_, d.mate_chrom, d.mate_pos, list_sort(list(d.mate_pos) OVER (PARTITION BY d.sample, d.chrom, d.place_, d.mate_chrom))[1 + count(*) OVER (PARTITION BY d.sample, d.chrom, d.place_, d.mate_chrom) // 2] AS mid FROM {_NEAR} d WHERE disc AND {side}) GROUP BY ALL) GROUP BY ALL)"""


_SIDES = f"""(SELECT sample, chrom, place_, l.b[1] AS l_chrom, r.b[1] AS r_chrom, coalesce(l.b[2], 0) AS n_l, coalesce(r.b[2], 0) AS n_r, CASE WHEN l.total >= 10 AND l.b[2] > 10 AND l.b[2] > 0.45 * l.total THEN l.b[3] ELSE -1 END AS l_pos, CASE WHEN r.total >= 10 AND r.b[2] > 10 AND r.b[2] > 0.45 * r.total THEN r.b[3] ELSE -1 END AS r_pos,
  coalesce(l.total >= 10 AND l.b[2] > 10 AND l.b[2] > 0.45 * l.total AND l.b[4] > 0.67 * l.b[2], false) AS lk, coalesce(r.total >= 10 AND r.b[2] > 10 AND r.b[2] > 0.45 * r.total AND r.b[4] > 0.67 * r.b[2], false) AS rk FROM {_cluster("NOT r")} l FULL JOIN {_cluster("r")} r USING (sample, chrom, place_))"""
_OTHER = f"""(SELECT sample, chrom, place_, CASE WHEN n_in > 10 AND n_in > 0.45 * total THEN -1 WHEN len(same) > 10 AND len(same) > 0.1 * total THEN list_sort(same)[1 + len(same) // 2] END AS mid FROM (
  SELECT d.sample, d.chrom, d.place_, count(*) AS total, count(*) FILTER (inside) AS n_in, coalesce(list(mate_pos) FILTER (NOT inside AND mate_chrom = CASE WHEN lk THEN l_chrom ELSE r_chrom END AND abs(mate_pos - CASE WHEN lk THEN l_pos ELSE r_pos END) < 5000), []) AS same FROM (
    SELECT *, EXISTS (SELECT 1 FROM repeats p WHERE 'c' || p.chrom = mate_chrom AND p.start <= mate_pos AND mate_pos < p."end") AS inside FROM {_NEAR} WHERE disc) d JOIN {_SIDES} s USING (sample, chrom, place_) WHERE lk <> rk AND d.r = lk GROUP BY ALL))"""
_COUNTS = f"""(SELECT sample, chrom, place_ AS site, count(*) FILTER (loc AND NOT r) AS n_left, count(*) FILTER (loc AND r) AS n_right, count(*) FILTER (loc AND mapq < 10) AS n_poor, count(*) FILTER (ok AND lc) AS n_lclip, count(*) FILTER (ok AND rc) AS n_rclip, count(*) FILTER (ok AND lc AND poly) AS n_lpolya,
  count(*) FILTER (ok AND rc AND poly) AS n_rpolyt, count(*) FILTER (disc AND NOT r AND rev) AS n_l_rc, count(*) FILTER (disc AND NOT r AND NOT rev) AS n_l_nrc, count(*) FILTER (disc AND r AND rev) AS n_r_rc, count(*) FILTER (disc AND r AND NOT rev) AS n_r_nrc,
  coalesce(list_sort(list(pos) FILTER (disc AND NOT rev))[1 + count(*) FILTER (disc AND NOT rev) // 4], -1) AS nrc_at, coalesce(list_sort(list(pos) FILTER (disc AND rev))[1 + 3 * count(*) FILTER (disc AND rev) // 4], -1) AS rc_at FROM {_NEAR} GROUP BY ALL)"""
_EVIDENCE = f"""(SELECT c.*, l_chrom, r_chrom, coalesce(n_l, 0) AS n_l, coalesce(n_r, 0) AS n_r, CASE WHEN rk AND NOT lk THEN coalesce(o.mid, -1) ELSE coalesce(l_pos, -1) END AS l_pos, CASE WHEN lk AND NOT rk THEN coalesce(o.mid, -1) ELSE coalesce(r_pos, -1) END AS r_pos, coalesce(lk, false) AS l_cluster, coalesce(rk, false) AS r_cluster,
  n_left * 100 / 200.0 AS lcov, n_right * 100 / 200.0 AS rcov, coalesce(n_l_nrc > 0.6 * (n_l_rc + n_l_nrc) AND n_r_rc > 0.6 * (n_r_rc + n_r_nrc) AND (lk AND rk AND l_chrom = r_chrom AND abs(l_pos - r_pos) < 5000 OR lk <> rk AND o.mid IS NOT NULL), false) AS consistent,
  (n_lpolya >= 3 OR n_rpolyt >= 3) AND (n_lpolya > 0.1 * n_lclip OR n_rpolyt > 0.1 * n_rclip) AS polya, NOT (site < nrc_at OR site > rc_at AND rc_at > 0) AS "inner", n_left * 100 / 200.0 <= 1200 AND n_right * 100 / 200.0 <= 1200 AS depth_ok, n_left + n_right > 0 AND n_poor <= 0.1 * (n_left + n_right) AS placed_ok
  FROM {_COUNTS} c LEFT JOIN {_SIDES} s ON s.sample = c.sample AND s.chrom = c.chrom AND s.place_ = c.site LEFT JOIN {_OTHER} o ON o.sample = c.sample AND o.chrom = c.chrom AND o.place_ = c.site)"""


@query(f"SELECT * FROM {_EVIDENCE}", "moved", "repeats")
def orphan_evidence(spark, d):
    return _evidence(spark, d)


@query(f"""SELECT sample, chrom, site, r_chrom AS src_chrom, CASE WHEN least(l_pos, r_pos) < 0 THEN greatest(l_pos, r_pos) - 500 ELSE least(l_pos, r_pos) END AS src_start, greatest(l_pos, r_pos) AS src_end FROM {_EVIDENCE} WHERE consistent AND polya AND "inner" AND depth_ok AND placed_ok AND greatest(l_pos, r_pos) > 0""", "moved", "repeats")
def orphan_candidates(spark, d):
    return orphans.candidates(_evidence(spark, d)).select("sample", "chrom", "site", "src_chrom", "src_start", "src_end")


#: Candidates with few poorly placed mates in their source region; those of the second sample count if they agree with the first one's.
_PLACED = f"""(SELECT e.* FROM (SELECT *, CASE WHEN least(l_pos, r_pos) < 0 THEN greatest(l_pos, r_pos) - 500 ELSE least(l_pos, r_pos) END AS s, greatest(greatest(l_pos, r_pos), CASE WHEN least(l_pos, r_pos) < 0 THEN greatest(l_pos, r_pos) - 499 ELSE least(l_pos, r_pos) + 1 END) AS e
  FROM {_EVIDENCE} WHERE consistent AND polya AND "inner" AND depth_ok AND placed_ok AND greatest(l_pos, r_pos) > 0) e JOIN (SELECT sample, mate_chrom AS chrom, mate_pos AS pos, mate_pos + 100 AS till, CASE WHEN mate_pos % 15 = 0 THEN 5 ELSE 60 END AS mapq FROM moved WHERE NOT mate_lost AND mate_pos >= 150000
  UNION ALL SELECT sample, chrom, pos, pos + 100 - lead - tail, mapq FROM moved) m ON m.sample = e.sample AND m.chrom = e.r_chrom AND m.pos < e.e AND m.till > e.s GROUP BY ALL HAVING count(*) FILTER (m.mapq < 10) < 0.1 * count(*))"""
_SUMS = ", ".join(f"CASE WHEN a.sample IS NULL THEN b.{c} WHEN agree THEN a.{c} + b.{c} ELSE a.{c} END AS {c}" for c in orphans.COUNTERS)


@query(f"""SELECT * FROM (SELECT chrom, site, src_chrom, least(l_pos, r_pos) AS src_start, greatest(l_pos, r_pos) AS src_end, {", ".join(orphans.COUNTERS)} FROM (SELECT chrom, site, CASE WHEN a.sample IS NULL OR agree THEN b.r_chrom ELSE a.r_chrom END AS src_chrom, CASE WHEN a.sample IS NULL OR agree THEN b.l_pos ELSE a.l_pos END AS l_pos,
  CASE WHEN a.sample IS NULL OR agree THEN b.r_pos ELSE a.r_pos END AS r_pos, {_SUMS} FROM (SELECT * FROM {_PLACED} WHERE sample = 's0') a FULL JOIN (SELECT * FROM {_PLACED} WHERE sample = 's1') b USING (chrom, site), LATERAL (SELECT coalesce(a.r_chrom = b.r_chrom AND abs(a.l_pos - b.l_pos) <= 2000 AND abs(a.r_pos - b.r_pos) <= 2000, false) AS agree))) o
  WHERE greatest(n_lclip, n_rclip) >= 3 AND greatest(n_lpolya, n_rpolyt) >= 3 AND least(n_l, n_r) >= 10 AND NOT EXISTS (SELECT 1 FROM repeats p WHERE p."end" - p.start > 48 AND 'c' || p.chrom = o.chrom AND p.start <= o.site AND o.site < p."end")""", "moved", "repeats")
def orphan_calls(spark, d):
    repeats, reads = _repeats(spark, d), _reads(spark, d)
    return orphans.calls(reads, _sites(spark, d), repeats, repeats.filter("`end` - start > 48"), CLIPS, PAIRS, S, at_sources=_with_mates(reads))


@query(f"""SELECT sample, chrom, site FROM {_EVIDENCE} WHERE NOT "inner" """, "moved", "repeats")
def orphan_sources(spark, d):
    return orphans.sources_among(_evidence(spark, d))


@query()
def source_matching(spark, d):
    e = view(spark, d, "evidence")
    region = lambda c, p: F.concat_ws(":", c, F.floor(p / 100))
    one = F.lit(1).cast("long").alias("support")
    return orphans.matched(e.select(region("mate_chrom", F.col("mate_pos")).alias("source"), region("chrom", F.col("site")).alias("insertion"), one), F.sum)
