"""Queries on alignments: the binary form written and read, and the scan of reads around places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import cigar as C
from ..operators import scan
from ..shared import scratch
from ..sources import bam
from .queries import query
from .virtual import table, view

CONTIGS = [*((f"c{k}", 500_000_000) for k in range(24)), ("hs37d5", 500_000_000)]
WINDOW = 50


def reads(spark, d) -> DataFrame:
    """The virtual alignments as schema.READ."""
    v = view(spark, d, "alns")
    elements = F.array(*(F.struct(F.lit(op).alias("op"), x.cast("int").alias("len")) for op, x in ((4, F.col("lead")), (0, F.col("m1")), (1, F.col("ins")), (2, F.col("del")), (0, F.col("m") - F.col("m1")), (4, F.col("tail")))))
    own = {"sample": F.lit("s"), "is_read1": F.lit(True), "is_duplicate": F.col("dup"), "is_unmapped": F.lit(False), "mate_is_unmapped": F.col("mate_lost"), "is_secondary": F.col("sec"), "is_supplementary": F.col("sup"), "is_reverse": F.col("rev"),
           "mate_is_reverse": F.col("mate_rev"), "cigar": F.filter(elements, lambda x: x["len"] > 0), "tlen": F.lit(0), "qual": F.array_repeat(F.col("q").cast("tinyint"), 100), "tags": F.map_from_arrays(F.array(F.lit("RG")), F.array(F.concat(F.lit("g"), F.col("q").cast("string"))))}
    return v.select(*(own.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema.READ))


def _binary(spark, d) -> str:
    path = scratch(spark, "alignments")
    bam.write_alignments(reads(spark, d), path, CONTIGS, spark.sparkContext.defaultParallelism)
    return path


_CIGAR = "CASE WHEN lead > 0 THEN lead || 'S' ELSE '' END || m1 || 'M' || CASE WHEN ins > 0 THEN ins || 'I' ELSE '' END || CASE WHEN del > 0 THEN del || 'D' ELSE '' END || CASE WHEN m > m1 THEN (m - m1) || 'M' ELSE '' END || CASE WHEN tail > 0 THEN tail || 'S' ELSE '' END"


def _spelled(cigar):
    return F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), F.element_at(F.split(F.lit("M,I,D,N,S,H"), ","), x["op"] + 1))), "")


@query(f"SELECT qname, chrom, pos, mapq, dup, sec, sup, rev, mate_rev, mate_lost, mate_chrom, mate_pos, {_CIGAR} AS cigar, seq, q, 100 AS n_qual, 'g' || q AS rg FROM alns", "alns")
def binary_alignments(spark, d):
    r = bam.alignments(spark, _binary(spark, d), sample="s")
    return r.select("qname", "chrom", "pos", "mapq", F.col("is_duplicate").alias("dup"), F.col("is_secondary").alias("sec"), F.col("is_supplementary").alias("sup"), F.col("is_reverse").alias("rev"), F.col("mate_is_reverse").alias("mate_rev"),
                    F.col("mate_is_unmapped").alias("mate_lost"), "mate_chrom", "mate_pos", _spelled(F.col("cigar")).alias("cigar"), "seq", F.array_max("qual").alias("q"), F.size("qual").alias("n_qual"), F.col("tags")["RG"].alias("rg"))


@query(f"SELECT qname, pos, {_CIGAR} AS cigar FROM alns WHERE chrom = 'c5' AND pos < 9000 AND pos + m + del > 200", "alns")
def binary_region(spark, d):
    """A region is the feature: reads of c5 that overlap [200, 9000), by the index."""
    return bam.alignments(spark, _binary(spark, d), "c5:200-9000", columns=("qname", "pos", "cigar")).select("qname", "pos", _spelled(F.col("cigar")).alias("cigar"))


#: Reads at the places that their aligned bases come near to, with what both ends' clipped parts are like.
_AROUND = f"""SELECT *, lead > 0 AS l, tail > 0 AS r, lead > 8 AND tail > 8 AS both_ends, substr(seq, 1, lead) AS lseq, substr(seq, 101 - tail) AS rseq,
  NOT sup AND NOT sec AND lead >= 7 AND (lead > 9 OR greatest(length(replace(substr(seq, 1, lead), 'A', '')), 0) <= 1 OR length(replace(substr(seq, 1, lead), 'T', '')) <= 1) AND q >= 15 AS lok,
  NOT sup AND NOT sec AND tail >= 9 AND (tail > 9 OR length(replace(substr(seq, 101 - tail), 'A', '')) <= 1 OR length(replace(substr(seq, 101 - tail), 'T', '')) <= 1) AND q >= 15 AS rok
  FROM (SELECT DISTINCT chrom AS sc, pos AS site FROM places) s JOIN alns a ON a.chrom = sc AND a.pos < site + {WINDOW} AND a.pos + m + del > site - {WINDOW} WHERE NOT dup"""


@query(f"""WITH n AS ({_AROUND}), t AS (SELECT * FROM n WHERE mapq >= 12 AND NOT both_ends)
  SELECT site, chrom, qname, rev AS is_rc, 'L' AS side, pos AS breakpoint, lseq AS seq FROM t WHERE l AND lok UNION ALL SELECT site, chrom, qname, rev, 'R', pos + m + del, rseq FROM t WHERE r AND rok AND (NOT l OR lok)""", "alns", "places")
def clipped_parts(spark, d):
    return scan.at(scan.clipped_parts(scan.placed(reads(spark, d))).drop("qual"), view(spark, d, "places"), WINDOW)


@query("""SELECT chrom, qname, rev AS is_rc, 'L' AS side, pos AS breakpoint, substr(seq, 1, lead) AS seq FROM alns WHERE lead > 0 AND NOT dup AND mapq >= 12 AND q >= 15 AND (lead >= 10 OR (lead >= 7 AND regexp_full_match(substr(seq, 1, lead), 'A+|T+')))
  UNION ALL SELECT chrom, qname, rev, 'R', pos + m + del, substr(seq, 101 - tail) FROM alns WHERE tail > 0 AND NOT dup AND mapq >= 12 AND q >= 15 AND NOT (sup AND lead > 0) AND (tail >= 10 OR (tail >= 7 AND regexp_full_match(substr(seq, 101 - tail), 'A+|T+')))""", "alns")
def all_clipped_parts(spark, d):
    return scan.all_clipped_parts(reads(spark, d)).drop("qual")


@query(f"""WITH n AS ({_AROUND}) SELECT site, chrom, anchor, rev AS is_rc, mate_rev AS mate_rc, mate_chrom, mate_pos, qname, false AS mate_is_read1, l AND lok AS anchor_lclip, r AND rok AS anchor_rclip
  FROM (SELECT *, CASE WHEN r THEN pos + m + del ELSE pos END AS anchor FROM n) WHERE mapq >= 20 AND NOT both_ends AND NOT mate_lost AND (NOT l OR lok) AND (NOT r OR rok) AND mate_chrom <> 'hs37d5' AND (chrom <> mate_chrom OR abs(mate_pos - anchor) > 2000)""", "alns", "places")
def discordant_pairs(spark, d):
    return scan.at(scan.discordant_pairs(scan.placed(reads(spark, d))), view(spark, d, "places"), WINDOW)


@query(f"""WITH n AS ({_AROUND}) SELECT chrom, site, count(*) AS n_low FROM n WHERE mapq < 5 AND abs(CASE WHEN l THEN pos WHEN r THEN pos + 100 - tail END - site) < 35 GROUP BY ALL""", "alns", "places")
def poor_clips(spark, d):
    return scan.poor_clips(scan.at(scan.poorly_placed(scan.placed(reads(spark, d))), view(spark, d, "places"), WINDOW))


@query(f"""WITH n AS (SELECT *, pos + m + del AS e, abs(pos - mate_pos) AS apart, coalesce(chrom = mate_chrom AND abs(pos - mate_pos) <= 2000, false) AS ok FROM ({_AROUND}) WHERE NOT sup AND NOT sec)
  SELECT chrom, site, sum(greatest(least(e, site) - greatest(pos, site - {WINDOW}), 0)) / {WINDOW}.0 AS lcov, sum(greatest(least(e, site + {WINDOW}) - greatest(pos, site), 0)) / {WINDOW}.0 AS rcov, 100 AS read_length,
  count(*) FILTER (ok) AS n_pairs, coalesce(sum(apart + 100) FILTER (ok), 0)::BIGINT AS sum_x, coalesce(sum((apart + 100) * (apart + 100)) FILTER (ok), 0)::BIGINT AS sum_xx FROM n GROUP BY ALL""", "alns", "places")
def window_statistics(spark, d):
    return scan.window_statistics(reads(spark, d), view(spark, d, "places"), WINDOW)


@query(f"""SELECT qname, pos, lead > 0 AS l, tail > 0 AS r, pos + m + del AS ref_end, pos + m + del AS breakpoint, lead > 8 AND tail > 8 AS both_ends, m / 100.0 AS ratio, nullif(lead, 0) AS n_left, nullif(tail, 0) AS n_right, size > 2 AND (lead > 20 OR tail > 20) AS large_clip, NOT (lead > 8 AND tail > 8) AND m >= 65 AS qualified,
  size = 1 OR CASE WHEN lead > 0 THEN lead <= 8 AND tail = 0 WHEN tail > 0 THEN tail <= 8 ELSE false END AS nearly_full, ins >= 3 OR del >= 3 AS indel, q < 15 AS low, CASE WHEN lead > 0 THEN lead >= 10 OR (lead >= 7 AND regexp_full_match(substr(seq, 1, lead), 'A+|T+')) END AS length_ok
  FROM (SELECT *, 1 + (lead > 0)::INT + (tail > 0)::INT + (ins > 0)::INT + (del > 0)::INT + (m > m1)::INT AS size FROM alns)""", "alns")
def alignment_predicates(spark, d):
    """What the expressions on CIGARs say of every read."""
    g = F.col("cigar")
    return reads(spark, d).select(
        "qname", "pos", C.left_clipped(g).alias("l"), C.right_clipped(g).alias("r"), C.reference_end(F.col("pos"), g).alias("ref_end"), (C.right_breakpoint(F.col("pos"), g) + F.when(C.right_clipped(g), 0).otherwise(C.last(g)["len"])).alias("breakpoint"), C.both_sides_clipped(g).alias("both_ends"), C.mapped_ratio(g).alias("ratio"),
        F.length(C.clipped_part(F.col("seq"), g, True)).alias("n_left"), F.length(C.clipped_part(F.col("seq"), g, False)).alias("n_right"), C.large_clip(g, 20).alias("large_clip"), C.qualified(g, 0.65).alias("qualified"), C.nearly_full(g, 8).alias("nearly_full"), C.large_indel(g).alias("indel"),
        C.low_quality(F.col("qual")).alias("low"), C.clip_length_ok(C.clipped_part(F.col("seq"), g, True)).alias("length_ok"))


@query("SELECT qname, pos, q % 4 <= CASE WHEN m >= 100 THEN 2 ELSE 1 END AS few, 'c' || (q % 3) AS alt, q % 2 = 0 AS alt_rc, pos + 7 AS alt_pos, m || 'M' AS alt_cigar FROM alns UNION ALL SELECT qname, pos, q % 4 <= CASE WHEN m >= 100 THEN 2 ELSE 1 END, 'c9', true, mapq, '10S' || m || 'M' FROM alns WHERE q % 5 > 0", "alns")
def alignment_tags(spark, d):
    """Mismatches and alternative places from the tags of every read."""
    v = view(spark, d, "alns")
    md = F.concat(F.expr("repeat('10C', q % 4)"), F.lit("20^AC0")).alias("md")
    first = F.concat(F.lit("c"), (F.col("q") % 3).cast("string"), F.lit(","), F.when(F.col("q") % 2 == 0, "-").otherwise("+"), (F.col("pos") + 7).cast("string"), F.lit(","), F.col("m").cast("string"), F.lit("M,0;"))
    second = F.when(F.col("q") % 5 > 0, F.concat(F.lit("c9,-"), F.col("mapq").cast("string"), F.lit(",10S"), F.col("m").cast("string"), F.lit("M,3;"))).otherwise("")
    rows = v.select("qname", "pos", "m", md, F.concat(first, second).alias("xa"))
    rows = rows.select("qname", "pos", C.few_mismatches(F.regexp_replace("md", r"\^[A-Z]+", ""), F.col("m")).alias("few"), F.explode(C.alternatives(F.col("xa"))).alias("x"))
    return rows.select("qname", "pos", "few", F.col("x.chrom").alias("alt"), F.col("x.is_rc").alias("alt_rc"), F.col("x.pos").alias("alt_pos"), F.col("x.cigar").alias("alt_cigar"))


@query(f"""WITH n AS (SELECT *, pos + m + del AS e, abs(pos - mate_pos) AS apart, coalesce(chrom = mate_chrom AND abs(pos - mate_pos) <= 2000, false) AS ok FROM ({_AROUND}) WHERE NOT sup AND NOT sec), w AS (
  SELECT chrom, site, (sum(greatest(least(e, site) - greatest(pos, site - {WINDOW}), 0)) + sum(greatest(least(e, site + {WINDOW}) - greatest(pos, site), 0))) / {WINDOW}.0 AS depth, count(*) FILTER (ok) AS n, coalesce(sum(apart + 100) FILTER (ok), 0) AS s, coalesce(sum((apart + 100) * (apart + 100)) FILTER (ok), 0) AS q FROM n GROUP BY ALL)
  SELECT round((SELECT list_sort(list(depth))[1 + count(*) // 2] / 2 FROM w WHERE depth / 2 >= 5), 6) AS coverage, 100 AS read_length, round(sum(s) / sum(n), 6) AS mean_is, round(sqrt(greatest(sum(q) / sum(n) - (sum(s) / sum(n)) ^ 2, 0)), 6) AS std_is FROM w""", "alns", "places")
def library(spark, d):
    """One row: what the reads around places tell of the library."""
    out = scan.library(scan.window_statistics(reads(spark, d), view(spark, d, "places"), WINDOW))
    return out.select(*(F.round(c, 6).alias(c) if c != "read_length" else F.col(c) for c in out.columns))
