"""Queries on realigned parts of reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import realigned
from .queries import query
from .virtual import table, view

FLANK = 30


def _parts(spark, d):
    v = view(spark, d, "parts")
    cigar = F.filter(F.array(*(F.struct(F.lit(op).alias("op"), x.cast("int").alias("len")) for op, x in ((4, F.col("lead")), (0, 60 - F.col("lead") - F.col("tail")), (4, F.col("tail"))))), lambda x: x["len"] > 0)
    src = F.when(~F.col("decoy"), F.col("chrom"))
    return v.select("chrom", "site", "ref_pos", "sample", "side", F.col("rc").alias("is_rc"), "mapq", F.col("lost").alias("is_unmapped"), "start", cigar.alias("cigar"), "seq", F.concat(F.lit("c"), F.col("copy_no").cast("string")).alias("copy_chrom"), "copy_start", "copy_end", "mate_rc", "anchor_rc",
                    F.col("ref_pos").alias("anchor"), (F.col("lead") > 5).alias("anchor_lclip"), (F.col("tail") > 5).alias("anchor_rclip"), src.alias("src_chrom"), "src_start", "src_end", F.col("copy_rc").alias("src_rc"), F.col("side").alias("flank_side"))


def _repeats(spark, d):
    p = table(spark, d, "part")
    at = F.col("p_size") * 7 % 300
    return p.filter("p_size % 11 > 0").select(F.concat(F.lit("c"), (F.col("p_partkey") % 24).cast("string")).alias("chrom"), F.col("p_partkey").alias("start"), at.alias("cns_start"), (at + F.col("p_size")).alias("cns_end"), (F.col("p_size") % 3 == 0).alias("is_rc"))


#: Parts that count: a share of matched bases, and not clipped for over 8 bases at both ends.
def _good(ratio: float) -> str:
    return f"""(SELECT *, 60 - lead - tail AS m, copy_end - copy_start AS copy_len, CASE WHEN (copy_end - copy_start) % 11 > 0 THEN cns_start END AS k FROM parts WHERE NOT lost AND (lead <= 8 OR tail <= 8) AND 60 - lead - tail >= {ratio} * 60)"""


_NEAR = f"(SELECT *, start + CASE WHEN rc = (side = 'L') THEN m ELSE 0 END AS bp, CASE WHEN (side = 'L') <> rc THEN substr(seq, 41) ELSE substr(seq, 1, 20) END AS inner_ FROM {_good(0.65)} WHERE abs(ref_pos - site) <= 50)"
_RUN = "regexp_matches(seq, 'A{5,}|T{5,}')"
_CNS = f"CASE WHEN k IS NULL THEN -1 WHEN copy_rc THEN k + cns_end - cns_start - {{at}} + {FLANK} ELSE k + {{at}} - {FLANK} END"
_ON_FLANK = f"(start < {FLANK - 5} OR start > copy_len + {FLANK - 5})"


@query(f"SELECT chrom, site, sample, side, ref_pos, bp AS cns, regexp_matches(inner_, 'AAAAA|AATAA') AS polya, NOT rc AS forward FROM {_NEAR}", "parts")
def clips_on_consensus(spark, d):
    return realigned.clips_on_consensus(_parts(spark, d))


@query(f"""SELECT chrom, site, count(*) FILTER (side = 'L' AND a) AS n_lpolya, count(*) FILTER (side = 'R' AND a) AS n_rpolya, count(*) FILTER (side = 'L' AND a AND NOT rc) AS n_lpolya_forward, count(*) FILTER (side = 'R' AND a AND NOT rc) AS n_rpolya_forward FROM (SELECT *, regexp_matches(inner_, 'AAAAA|AATAA') AS a FROM {_NEAR}) GROUP BY ALL""", "parts")
def clip_polya_counts(spark, d):
    return realigned.polya_counts(realigned.clips_on_consensus(_parts(spark, d)))


@query(f"""SELECT chrom, site, sample, side, ref_pos, kind, CASE WHEN kind = 'body' THEN {_CNS.format(at="bp")} END AS cns, CASE WHEN kind = 'flank' THEN 'c' || copy_no || '~' || copy_start || '~' || copy_end END AS source, CASE WHEN kind = 'flank' THEN start END AS "at", {_RUN} AS polya
  FROM (SELECT *, CASE WHEN NOT {_ON_FLANK} THEN 'body' WHEN mapq >= 10 AND NOT {_RUN} THEN 'flank' ELSE 'lost' END AS kind FROM {_NEAR})""", "parts")
def clips_on_copies(spark, d):
    return realigned.clips_on_copies(_parts(spark, d), _repeats(spark, d), FLANK)


@query(f"""SELECT chrom, site, sample, count(*) AS n, count(*) FILTER (side = 'L') AS n_left, count(*) FILTER (side = 'R') AS n_right FROM {_NEAR} WHERE NOT {_ON_FLANK} GROUP BY ALL""", "parts")
def clip_samples(spark, d):
    return realigned.sample_counts(realigned.clips_on_copies(_parts(spark, d), _repeats(spark, d), FLANK), "body")


@query(f"SELECT chrom, site, sample, ref_pos AS anchor, lead > 5 AS anchor_lclip, tail > 5 AS anchor_rclip, anchor_rc, start + 30 AS cns, (rc <> mate_rc) <> anchor_rc AS same_ori, regexp_matches(seq, 'AAAAA|AATAA|TTTTT|TTATT') AS polya FROM {_good(0.7)}", "parts")
def pairs_on_consensus(spark, d):
    return realigned.pairs_on_consensus(_parts(spark, d))


@query(f"""SELECT chrom, site, sample, CASE WHEN td THEN 'flank' ELSE 'body' END AS kind, CASE WHEN NOT td AND k IS NOT NULL THEN {_CNS.format(at="(start + 30)")} END AS cns, CASE WHEN td THEN 'c' || copy_no || '~' || copy_start || '~' || copy_end END AS source, CASE WHEN td THEN start END AS "at", {_RUN} AS polya
  FROM (SELECT *, (mapq >= 10 AND start < {FLANK - 15} OR start > copy_len + {FLANK - 15}) AND NOT {_RUN} AS td FROM {_good(0.7)})""", "parts")
def pairs_on_copies(spark, d):
    return realigned.pairs_on_copies(_parts(spark, d), _repeats(spark, d), FLANK)


_TD = f"""(SELECT chrom, site, side, ref_pos, CASE WHEN NOT decoy THEN chrom || ':' || src_start || '-' || src_end || '~' || CASE WHEN copy_rc THEN '1' ELSE '0' END END AS source, CASE WHEN decoy THEN site WHEN side = 'L' THEN src_start - {FLANK} + start ELSE src_end + start END AS ref_at,
  CASE WHEN a AND t THEN 'AT' WHEN a THEN 'A' WHEN t THEN 'T' END AS base FROM (SELECT *, regexp_matches(x, 'AAAAA|AATAA') AS a, regexp_matches(x, 'TTTTT|TTATT') AS t FROM (SELECT *, CASE WHEN rc THEN reverse(translate(i, 'ACGT', 'TGCA')) ELSE i END AS x FROM (
    SELECT *, CASE WHEN (side = 'L') <> rc THEN substr(seq, 41) ELSE substr(seq, 1, 20) END AS i FROM {_good(0.8)} WHERE abs(ref_pos - site) <= 50 AND (decoy OR abs(ref_pos - src_start) >= 1000 AND abs(ref_pos - src_end) >= 1000)))))"""


@query(f"SELECT * FROM {_TD}", "parts")
def clips_on_flanks(spark, d):
    return realigned.clips_on_flanks(_parts(spark, d), FLANK)


@query(f"""SELECT chrom, site, count(*) FILTER (side = 'L' AND base = 'A') AS n_lpolya, count(*) FILTER (side = 'R' AND base = 'A') AS n_rpolya, count(*) FILTER (side = 'L' AND base = 'T') AS n_lpolyt, count(*) FILTER (side = 'R' AND base = 'T') AS n_rpolyt,
  count(*) FILTER (side = 'L' AND base = 'AT') AS n_lboth, count(*) FILTER (side = 'R' AND base = 'AT') AS n_rboth FROM {_TD} GROUP BY ALL""", "parts")
def td_tail_counts(spark, d):
    return realigned.tail_counts(realigned.clips_on_flanks(_parts(spark, d), FLANK))
