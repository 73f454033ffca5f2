"""Queries from reads to site records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import caller, features, scan
from .alignments import _AROUND, reads
from .evidence import _ALONE, _FILTER, _PAIRS
from .queries import query
from .virtual import view

CALL = caller.Call(clips=2, pairs=3, extend=50, window=50, coverage=12.0, spread=100)


def _hits(spark, d):
    """What the aligner told of clipped parts and of mates: all aligned whole, near the end of the consensus."""
    v = view(spark, d, "alns")
    rc = F.col("mapq") % 2 == 0

    def whole(n):
        return F.array(F.struct(F.lit(0).alias("op"), n.cast("int").alias("len")))

    both = F.array(F.struct(F.lit("L").alias("side"), F.col("lead").alias("n")), F.struct(F.lit("R").alias("side"), F.col("tail").alias("n")))
    clips = v.select("qname", "pos", rc.alias("is_rc"), F.inline(both)).filter("n > 0")
    lost = F.lit(False)
    clips = clips.select("qname", "side", (5850 + F.col("pos") % 7 * 3).cast("int").alias("start"), whole(F.col("n")).alias("cigar"), "is_rc", F.lit(60).alias("mapq"), lost.alias("is_unmapped"))
    mates = v.select("qname", (5700 + F.col("pos") % 150).cast("int").alias("start"), whole(F.lit(100)).alias("cigar"), rc.alias("is_rc"), F.lit(60).alias("mapq"), lost.alias("is_unmapped"), "seq")
    return clips.distinct(), mates.distinct()


def _records(spark, d):
    clips, mates = _hits(spark, d)
    return caller.records(reads(spark, d), view(spark, d, "places"), clips, mates, CALL)


#: Clips as they are aligned to the consensus, from the reads around places.
_CLIPS = """(SELECT chrom, site, side, ref, mapq % 2 = 0 AS rc, 5850 + pos % 7 * 3 + CASE WHEN (mapq % 2 = 0) = (side = 'L') THEN length(part) ELSE 0 END AS cns, CASE WHEN mapq % 2 = 0 THEN reverse(translate(part, 'ACGT', 'TGCA')) ELSE part END AS aligned FROM (
  SELECT *, 'L' AS side, pos AS ref, lseq AS part FROM near_reads WHERE mapq >= 12 AND NOT both_ends AND l AND lok UNION ALL SELECT *, 'R', pos + m + del, rseq FROM near_reads WHERE mapq >= 12 AND NOT both_ends AND r AND rok AND (NOT l OR lok)) WHERE abs(ref - site) <= 50)"""
_LOW = "(SELECT chrom, site, count(*) AS n_low FROM near_reads WHERE mapq < 5 AND abs(CASE WHEN l THEN pos WHEN r THEN pos + 100 - tail END - site) < 35 GROUP BY ALL)"
_DISC = """(SELECT p.chrom, p.site, anchor, l AND lok AS anchor_lclip, r AND rok AS anchor_rclip, rev AS anchor_rc, 5700 + pos % 150 + 50 AS cns, ((mapq % 2 = 0) <> mate_rev) <> rev AS same_ori, coalesce(l_peak, r_peak) AS clip_pos FROM (
  SELECT *, CASE WHEN r THEN pos + m + del ELSE pos END AS anchor FROM near_reads WHERE mapq >= 20 AND NOT both_ends AND NOT mate_lost AND (NOT l OR lok) AND (NOT r OR rok) AND mate_chrom <> 'hs37d5') p JOIN alone USING (chrom, site) WHERE p.chrom <> mate_chrom OR abs(mate_pos - anchor) > 2000)"""
_DEPTHS = "(SELECT chrom, site, sum(greatest(least(pos + m + del, site) - greatest(pos, site - 50), 0)) / 50.0 AS lcov, sum(greatest(least(pos + m + del, site + 50) - greatest(pos, site), 0)) / 50.0 AS rcov FROM near_reads WHERE NOT sup AND NOT sec GROUP BY ALL)"
_POLYA = """(SELECT chrom, site, count(*) FILTER (side = 'L' AND a) AS lp, count(*) FILTER (side = 'R' AND a) AS rp, count(*) FILTER (side = 'L' AND a AND NOT rc) AS lf, count(*) FILTER (side = 'R' AND a AND NOT rc) AS rf FROM (
  SELECT *, regexp_matches(CASE WHEN (side = 'L') <> rc THEN right(aligned, 20) ELSE substr(aligned, 1, 20) END, 'AAAAA|AATAA') AS a FROM clip_rows) GROUP BY ALL)"""
#: Genotype features, by the read's own words; a read's place is its right breakpoint if it is clipped there.
_FEATURES = """(WITH f AS (SELECT *, sec OR sup AS extra, CASE WHEN r THEN pos + m + del ELSE pos END AS place, lead + tail + ins + del = 0 AND pos <= site AND site <= pos + 100 AS fm FROM near_reads), g AS (
  SELECT *, l AND NOT extra AS lk, r AND NOT extra AS rk, NOT ((l OR r) AND extra) AND NOT mate_lost AND mate_chrom <> 'hs37d5' AS mt, chrom <> mate_chrom OR abs(mate_pos - place) > 2000 AS apart, least(place, mate_pos) AS fs, greatest(place, mate_pos) + 100 AS fe FROM f), h AS (
  SELECT *, lk AND abs(pos - site) < 100 AS lraw, rk AND abs(place - site) < 100 AS rraw, CASE WHEN lk AND abs(pos - site) < 3 THEN lead END AS lx, CASE WHEN rk AND abs(place - site) < 3 THEN tail END AS rx,
    coalesce(regexp_matches(CASE WHEN rk AND abs(place - site) < 25 THEN CASE WHEN rev THEN right(rseq, 20) ELSE substr(rseq, 1, 20) END WHEN lk AND abs(pos - site) < 25 THEN CASE WHEN rev THEN substr(lseq, 1, 20) ELSE right(lseq, 20) END END, 'AAAAA|AATAA|TTTTT|TTATT'), false) AS pa FROM g), c AS (
  SELECT chrom, site, sum(k) FILTER (NOT cl)::BIGINT AS n_conc FROM (SELECT chrom, site, qname, bool_or(lraw OR rraw) AS cl, count(*) FILTER (mt AND NOT apart AND chrom = mate_chrom AND fs <= site AND site <= fe AND site - fs <= 550 AND fe - site <= 550) AS k FROM h GROUP BY ALL) GROUP BY ALL)
  SELECT chrom, site, greatest(nl, nr) AS n_af_clip, nf - CASE WHEN nl < nr THEN nfr ELSE nfl END AS n_full_map, n_l_raw, n_r_raw, n_disc, coalesce(n_conc, 0) AS n_conc, n_large_indel, CASE WHEN greatest(nl, nr) = 0 THEN '' ELSE array_to_string(list_sort(CASE WHEN nl < nr THEN rs ELSE ls END), ':') END AS clip_lens, n_polya, n_mate_chroms FROM (
    SELECT chrom, site, count(lx) AS nl, count(rx) AS nr, count(*) FILTER (fm) AS nf, count(*) FILTER (fm AND abs(pos - site) < 45) AS nfr, count(*) FILTER (fm AND abs(pos - site) >= 45 AND abs(pos + 100 - site) < 45) AS nfl, count(*) FILTER (lraw) AS n_l_raw, count(*) FILTER (rraw) AS n_r_raw, count(*) FILTER (mt AND apart AND abs(place - site) <= 550) AS n_disc,
      count(*) FILTER (mt AND apart AND (ins >= 3 OR del >= 3)) AS n_large_indel, list(lx) FILTER (lx IS NOT NULL) AS ls, list(rx) FILTER (rx IS NOT NULL) AS rs, count(*) FILTER (pa) AS n_polya, count(DISTINCT mate_chrom) FILTER (mt) AS n_mate_chroms FROM h GROUP BY ALL) JOIN c USING (chrom, site))"""
_ROWS = f"""(SELECT chrom, site, CASE WHEN l_peak IS NULL OR coalesce(a.r_n, 0) > coalesce(a.l_n, 0) THEN r_peak ELSE l_peak END AS pos, l_peak AS lclip_pos, r_peak AS rclip_pos, abs(r_peak - l_peak) AS tsd, coalesce(a.l_n, 0) AS n_all_lclip, coalesce(a.r_n, 0) AS n_all_rclip, d.l_n AS n_all_ldisc, d.r_n AS n_all_rdisc,
  coalesce(lp, 0) AS n_all_lpolya, coalesce(rp, 0) AS n_all_rpolya, CASE WHEN lf < lp - lf THEN -lp ELSE coalesce(lp, 0) END AS n_lpolya, CASE WHEN rf < rp - rf THEN -rp ELSE coalesce(rp, 0) END AS n_rpolya, lcov, rcov, a.l_start AS lc_start, a.l_end AS lc_end, a.r_start AS rc_start, a.r_end AS rc_end,
  d.l_start AS ld_start, d.l_end AS ld_end, d.r_start AS rd_start, d.r_end AS rd_end, d.l_n_same AS ldisc_same, d.l_n_diff AS ldisc_diff, d.r_n_same AS rdisc_same, d.r_n_diff AS rdisc_diff, d.l_n_rc AS lanchor_rc, d.l_n_not_rc AS lanchor_nrc, d.r_n_rc AS ranchor_rc, d.r_n_not_rc AS ranchor_nrc, 'not_transduction' AS td_src,
  n_af_clip, n_full_map, n_l_raw, n_r_raw, n_disc, n_conc, n_large_indel AS n_indel, nullif(clip_lens, '') AS clip_lens FROM alone a JOIN pair_sites d USING (chrom, site) JOIN {_DEPTHS} USING (chrom, site) LEFT JOIN {_POLYA} USING (chrom, site) JOIN {_FEATURES} USING (chrom, site))"""
_MARKS = _FILTER.replace("5000", "5950").replace("SELECT chrom, pos, reason,", "SELECT chrom, site, reason,", 1)
_START = f"""WITH near_reads AS ({_AROUND}), clip_rows AS {_CLIPS}, alone AS (SELECT a.* FROM ({_ALONE.replace("evidence", "clip_rows").replace("THEN 5 ELSE 3.5", "THEN 2 ELSE 2")}) a LEFT JOIN {_LOW} w USING (chrom, site) WHERE NOT coalesce(n_low > 0.65 * (n_low + coalesce(l_n, 0) + coalesce(r_n, 0)), false)),
  disc_rows AS {_DISC}, pair_sites AS ({_PAIRS.replace(" EXCLUDE (side)", "").replace("evidence", "disc_rows").replace("r_n < 6)", "r_n < 3)")}), records AS {_ROWS}, marks AS ({_MARKS})"""
_HAS = {x: f"{x}_start IS NOT NULL AND {x}_end IS NOT NULL" for x in ("lc", "rc", "ld", "rd")}
_KIND = f"""CASE WHEN lcov > 36 OR rcov > 36 THEN 'high' WHEN {" AND ".join(_HAS.values())} THEN 'two_side' WHEN {_HAS["lc"]} AND {_HAS["rd"]} AND NOT ({_HAS["rc"]}) AND NOT ({_HAS["ld"]}) OR {_HAS["rc"]} AND {_HAS["ld"]} AND NOT ({_HAS["lc"]}) AND NOT ({_HAS["rd"]}) THEN 'one_side'
  WHEN {_HAS["lc"]} AND {_HAS["rd"]} OR {_HAS["rc"]} AND {_HAS["ld"]} THEN 'one_half_side' ELSE 'other' END"""
_SPAN = lambda a, b: f"CASE WHEN {b}_end - {a}_start < 0 THEN {a}_end - {b}_start ELSE {b}_end - {a}_start END"
_LEN = f"""abs(CASE WHEN coalesce(lc_start, -1) > 0 AND coalesce(rc_start, -1) > 0 THEN {_SPAN("lc", "rc")} WHEN coalesce(ld_start, -1) > 0 AND coalesce(rd_start, -1) > 0 THEN {_SPAN("ld", "rd")} WHEN coalesce(lc_start, -1) > 0 AND coalesce(ld_start, -1) > 0 THEN {_SPAN("lc", "ld")}
  WHEN coalesce(rc_start, -1) > 0 AND coalesce(rd_start, -1) > 0 THEN {_SPAN("rc", "rd")} ELSE 0 END)"""
_CNS = ", ".join(f"CASE WHEN {_HAS[x]} THEN {x}_start || ':' || {x}_end END AS {n}_cns" for n, x in (("lclip", "lc"), ("rclip", "rc"), ("ldisc", "ld"), ("rdisc", "rd")))
_SITES = f"""{_START}, kinds AS (SELECT r.*, high_confident AS both_, low_confident AS low_, reaches_end AS end_, {_KIND} AS kind, abs(n_lpolya) + abs(n_rpolya) > 0 AS p, coalesce(tsd > 0 AND tsd < 100, false) AS t, n_l_raw + n_r_raw > 0 AND abs(n_lpolya) + abs(n_rpolya) > 0.85 * (n_l_raw + n_r_raw) AS dom FROM records r JOIN marks USING (chrom, site) WHERE reason IS NULL),
  named AS (SELECT *, CASE WHEN kind IN ('two_side', 'one_half_side') THEN kind || CASE WHEN p AND t THEN '_tprt_both' WHEN p OR t THEN '_tprt' ELSE '' END ELSE kind END AS full_ FROM kinds)
  SELECT chrom, pos, lclip_pos, rclip_pos, tsd, n_all_lclip, n_all_rclip, n_all_ldisc, n_all_rdisc, n_all_lpolya, n_all_rpolya, lcov, rcov, n_all_lclip AS n_lclip, n_all_rclip AS n_rclip, n_all_ldisc AS n_ldisc, n_all_rdisc AS n_rdisc, n_lpolya, n_rpolya, {_CNS}, NULL::VARCHAR AS td_src, 0 AS n_td_clip, 0 AS n_td_disc, 0 AS n_td_polya,
  ldisc_same, ldisc_diff, rdisc_same, rdisc_diff, CASE WHEN (ldisc_same >= ldisc_diff) <> (rdisc_same >= rdisc_diff) THEN '5prime-inversion' ELSE 'Not-5prime-inversion' END AS inversion, CASE WHEN kind = 'two_side' AND dom THEN 'polyA_dominant_both-side_may_low_confident' WHEN kind = 'one_half_side' AND dom THEN 'polyA_dominant_one-half-side_may_low_confident'
    WHEN kind = 'one_side' AND low_ THEN 'one_side_coverage_conflict' WHEN kind = 'high' THEN 'high_coverage_island_low_confident' WHEN kind = 'other' THEN 'other_type_low_confident' ELSE full_ END AS sub_type, CASE WHEN both_ THEN 'both_end_consistent' ELSE 'one_end_consistent' END AS consistent, CASE WHEN end_ THEN 'hit_end_of_consensus' ELSE 'not_hit_end_of_consensus' END AS hit_end,
  n_af_clip, n_full_map, n_l_raw, n_r_raw, n_disc, n_conc, n_indel, clip_lens, lanchor_rc, lanchor_nrc, ranchor_rc, ranchor_nrc, {_LEN} AS ins_len, NULL::VARCHAR AS ref_copy, NULL::VARCHAR AS gene, NULL::VARCHAR AS genotype, CASE WHEN kind = 'two_side' THEN NOT dom OR p OR t WHEN kind = 'one_half_side' THEN NOT dom ELSE false END AS high_confident FROM named"""


@query(_SITES, "alns", "places")
def called_records(spark, d):
    """From reads to records: every column of schema.SITE, and high_confident."""
    return _records(spark, d)


@query(f"WITH near_reads AS ({_AROUND}) SELECT * FROM {_FEATURES}", "alns", "places")
def genotype_evidence(spark, d):
    found = features.genotype_evidence(scan.at(features.told(scan.placed(reads(spark, d))), view(spark, d, "places"), 50))
    return found.withColumn("clip_lens", F.array_join(F.transform("clip_lens", lambda x: x.cast("string")), ":"))
