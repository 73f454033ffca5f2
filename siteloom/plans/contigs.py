"""Queries on insertions found on assembled contigs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar as C
from ..operators import contigs
from ..shared import written
from .queries import query
from .virtual import view

LENGTH, RATIO, SLACK = 500, 0.5, 30
_CIGAR = ((4, "lead"), (0, "m"), (4, "tail"))


def _flanks(spark, d):
    v = view(spark, d, "flanks").withColumn("m", F.lit(LENGTH) - F.col("lead") - F.col("tail") - F.col("lost"))
    parts = F.filter(F.array(*(F.struct(F.lit(op).alias("op"), F.col(x).cast("int").alias("len")) for op, x in _CIGAR)), lambda x: x["len"] > 0)
    none = F.lit(False)
    return v.select("chrom", "pos", "group", "flank", "contig", "start", parts.alias("cigar"), F.col("rev").alias("is_rc"), F.col("sec").alias("is_secondary"), none.alias("is_supplementary"), none.alias("is_unmapped"), none.alias("is_duplicate"))


#: A flank's row that counts, and one row for each site and group, by joins of left and right flanks.
_MAPPED = f"""(SELECT *, {LENGTH} - lead - tail - lost AS n FROM flanks WHERE NOT sec AND ({LENGTH} - lead - tail - lost) / {LENGTH}.0 >= {RATIO})"""
_USABLE = f"""(SELECT * FROM {_MAPPED} WHERE NOT CASE WHEN (flank = 'left') <> rev THEN tail >= 100 ELSE lead >= 100 END)"""
_PAIRED = f"""(SELECT chrom, pos, "group", l.contig AS lc, l.start AS ls, l.n AS ln, l.rev AS lr, r.contig AS rc, r.start AS rs, r.n AS rn, r.rev AS rr,
  CASE WHEN l.contig IS NULL OR r.contig IS NULL OR l.contig <> r.contig THEN 'loose' WHEN l.rev = r.rev AND (CASE WHEN l.rev THEN l.start - r.start - r.n ELSE r.start - l.start - l.n END) >= {SLACK} THEN 'strict' ELSE 'none' END AS verdict
  FROM (SELECT * FROM {_USABLE} WHERE flank = 'left') l FULL JOIN (SELECT * FROM {_USABLE} WHERE flank = 'right') r USING (chrom, pos, "group"))"""
_INSERTED = f"""(SELECT chrom, pos, "group", part, contig, CASE WHEN till IS NULL THEN substr(seq, since + 1) ELSE substr(seq, since + 1, till - since) END AS seq FROM (
  SELECT chrom, pos, "group", 'whole' AS part, lc AS contig, CASE WHEN lr THEN rs + rn ELSE ls + ln END AS since, CASE WHEN lr THEN ls ELSE rs END AS till FROM {_PAIRED} WHERE verdict = 'strict'
  UNION ALL SELECT chrom, pos, "group", 'left', lc, CASE WHEN lr THEN 0 ELSE ls + ln END, CASE WHEN lr THEN ls END FROM {_PAIRED} WHERE verdict = 'loose' AND lc IS NOT NULL
  UNION ALL SELECT chrom, pos, "group", 'right', rc, CASE WHEN rr THEN rs + rn ELSE 0 END, CASE WHEN NOT rr THEN rs END FROM {_PAIRED} WHERE verdict = 'loose' AND rc IS NOT NULL) JOIN contigs USING (chrom, pos, "group", contig)
  WHERE length(CASE WHEN till IS NULL THEN substr(seq, since + 1) ELSE substr(seq, since + 1, till - since) END) > 0)"""
_LABELLED = f"""(SELECT i.chrom, i.pos, CASE WHEN "group" = 'all' AND part = 'whole' THEN 'homoTEI' ELSE "group" || CASE part WHEN 'left' THEN 'L' WHEN 'right' THEN 'R' ELSE '' END END AS label, seq,
  CASE "group" WHEN 'all' THEN 3 WHEN 'hap1' THEN 6 WHEN 'hap2' THEN 9 ELSE 12 END + CASE part WHEN 'left' THEN 1 WHEN 'right' THEN 2 ELSE 0 END AS rank
  FROM {_INSERTED} i WHERE length(seq) >= 35 AND EXISTS (SELECT 1 FROM flanks f WHERE f."group" = 'all' AND f.chrom = i.chrom AND f.pos = i.pos)
  AND ("group" = 'all' AND part = 'whole' OR NOT EXISTS (SELECT 1 FROM {_INSERTED} j WHERE j.chrom = i.chrom AND j.pos = i.pos AND j."group" = 'all' AND j.part = 'whole' AND length(j.seq) >= 35)))"""


@query(f"""SELECT DISTINCT chrom, pos FROM flanks EXCEPT SELECT l.chrom, l.pos FROM (SELECT chrom, pos, min((contig, start, n, rev)) AS x FROM {_MAPPED} WHERE flank = 'left' GROUP BY ALL) l JOIN (SELECT chrom, pos, min((contig, start, n, rev)) AS x FROM {_MAPPED} WHERE flank = 'right' GROUP BY ALL) r
  USING (chrom, pos) WHERE l.x[1] = r.x[1] AND l.x[4] = r.x[4] AND abs(r.x[2] - l.x[2]) < {LENGTH + SLACK}""", "flanks")
def contig_kept_sites(spark, d):
    return contigs.without_plain_sites(_flanks(spark, d), LENGTH, RATIO, SLACK)


@query(f"""SELECT chrom, pos, "group", verdict, lc AS left_contig, rc AS right_contig, CASE WHEN lc = rc THEN CASE WHEN lr THEN rs + rn ELSE ls + ln END END AS first, CASE WHEN lc = rc THEN CASE WHEN lr THEN ls ELSE rs END END AS "last" FROM {_PAIRED}""", "flanks")
def contig_pairing(spark, d):
    p = contigs.paired(_flanks(spark, d), LENGTH, RATIO, SLACK)
    return p.select("chrom", "pos", "group", "verdict", F.col("l.contig").alias("left_contig"), F.col("r.contig").alias("right_contig"), "first", "last")


def _parts(spark, d):
    return contigs.inserted(contigs.paired(_flanks(spark, d), LENGTH, RATIO, SLACK), view(spark, d, "contigs"))


@query(f"SELECT * FROM {_INSERTED}", "flanks", "contigs")
def contig_inserts(spark, d):
    return _parts(spark, d)


def _labels(spark, d):
    return contigs.labelled(_parts(spark, d), view(spark, d, "flanks").filter("`group` = 'all'"))


@query(f"SELECT * FROM {_LABELLED}", "flanks", "contigs")
def contig_labels(spark, d):
    return _labels(spark, d)


@query(f"""SELECT chrom, pos, arg_max(label, rank) AS label, arg_max(m, rank)::INT AS n, right(arg_max(label, rank), 1) NOT IN ('L', 'R') AS "both" FROM (SELECT *, length(seq) - length(seq) * (pos % 7) // 8 AS m FROM {_LABELLED}) WHERE m / length(seq) >= 0.5 GROUP BY chrom, pos""", "flanks", "contigs")
def contig_calls(spark, d):
    labels = written(_labels(spark, d).select("chrom", "pos", "label", "rank", F.length("seq").alias("n")), "labels")  # read twice
    off = F.floor(F.col("n") * (F.col("pos") % 7) / 8).cast("int")
    parts = F.filter(F.array(F.struct(F.lit(0).alias("op"), (F.col("n") - off).alias("len")), F.struct(F.lit(4).alias("op"), off.alias("len"))), lambda x: x["len"] > 0)
    none = F.lit(False)
    copies = labels.select("chrom", "pos", "label", parts.alias("cigar"), none.alias("is_secondary"), none.alias("is_supplementary"), none.alias("is_unmapped"), none.alias("is_duplicate"))
    return contigs.called(labels, copies)


#: Some bases of each read, by arithmetic on where its insertion or deletion is.
_BASES = """SELECT qname, pos, base, CASE WHEN base < lead THEN NULL WHEN base < lead + m1 THEN pos + base - lead WHEN base < lead + m1 + ins THEN NULL WHEN base < 100 - tail THEN pos + base - lead - ins + del END AS ref FROM alns, (SELECT unnest([0, 20, 45, 62, 99]) AS base)"""


@query(f"SELECT qname, pos, base, ref, CASE WHEN ref IS NOT NULL THEN base END AS back FROM ({_BASES})", "alns")
def cigar_walk(spark, d):
    from .alignments import reads

    r = reads(spark, d).select("qname", "pos", "cigar", F.explode(F.array(*map(F.lit, (0, 20, 45, 62, 99)))).alias("base"))
    r = r.withColumn("ref", C.to_reference(F.col("pos"), F.col("cigar"), F.col("base")))
    return r.select("qname", "pos", "base", "ref", C.to_sequence(F.col("pos"), F.col("cigar"), F.col("ref")).alias("back"))
