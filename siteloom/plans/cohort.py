"""Queries on cohorts of samples' call sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import population
from ..shared import scratch
from ..sources import text
from .queries import query
from .virtual import view


def _files(spark, d):
    """The virtual calls as one VCF folder for each sample; which sample has which."""
    path = scratch(spark, "cohort")
    v = view(spark, d, "calls")
    gt = F.when(F.col("priority") == 0, "1/1").when(F.col("priority") == 1, "0|1").otherwise("./.")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chrom").cast("string")), F.col("pos").cast("string"), F.lit("."), F.lit("."), F.lit("<INS>"), F.lit("."), F.lit("PASS"), F.concat(F.lit("SVTYPE=L1;SUBTYPE="), F.col("sub_type"), F.lit(";SVLEN="), (F.col("pos") % 300).cast("string")), F.lit("GT"), gt)
    head = spark.range(1).select(F.lit("##fileformat=VCFv4.2").alias("value"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("sample"))
    v.select(line.alias("value"), F.col("sample").cast("int").alias("sample")).unionByName(head).repartition("sample").write.partitionBy("sample").text(path)
    return spark.createDataFrame([(f"s{k}", f"{path}/sample={k}") for k in range(13)], "sample string, path string")


_CALLS = "SELECT 's' || sample AS sample, 'chr' || chrom AS chrom, pos, CASE priority WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS dosage, sub_type, pos % 300 AS len FROM calls"
_ISLANDS = "SELECT *, max(st) OVER (PARTITION BY chrom ORDER BY pos) AS island FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 300 THEN NULL ELSE pos END AS st FROM c)"
_PEOPLE = "SELECT 's' || k AS sample, 'p' || (k % 4) AS population FROM range(12) t(k)"


@query(f"""WITH c AS ({_CALLS}), i AS ({_ISLANDS}), people AS ({_PEOPLE}), m AS (SELECT i.*, b.site FROM i JOIN (SELECT chrom, island, arg_max(pos, (k, -pos)) AS site FROM (SELECT chrom, island, pos, count(DISTINCT sample) AS k FROM i GROUP BY ALL) GROUP BY ALL) b USING (chrom, island)),
  one AS (SELECT chrom, site, sample, max(dosage) AS dosage, population FROM m JOIN people USING (sample) GROUP BY ALL), pop AS (SELECT chrom, site, population, 6 AS an, sum(dosage)::BIGINT AS ac FROM one GROUP BY ALL)
  SELECT chrom, site, n_samples, an, ac, round(ac / an, 6) AS af, pops, sub_type, sub_type_n FROM (SELECT chrom, site, count(DISTINCT sample) AS n_samples FROM m GROUP BY ALL) LEFT JOIN (SELECT chrom, site, 24 AS an, sum(dosage)::BIGINT AS ac FROM one GROUP BY ALL) USING (chrom, site)
  LEFT JOIN (SELECT chrom, site, string_agg(population || ':' || an || ':' || ac, ';' ORDER BY population) AS pops FROM pop GROUP BY ALL) USING (chrom, site) LEFT JOIN (SELECT chrom, site, arg_max(sub_type, (n, -f)) AS sub_type, max(n) AS sub_type_n FROM (SELECT chrom, site, sub_type, count(*) AS n, min(pos) AS f FROM m GROUP BY ALL) GROUP BY ALL) USING (chrom, site)""", "calls")
def cohort_merge(spark, d):
    """From the samples' files to the sites of the cohort; one sample has no metadata."""
    calls = text.cohort(spark, _files(spark, d), ["SUBTYPE"]).withColumnRenamed("SUBTYPE", "sub_type")
    people = spark.range(12).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sample"), F.concat(F.lit("p"), (F.col("id") % 4).cast("string")).alias("population"))
    out = population.merged_cohort(calls, people, 300, ["sub_type"])
    pops = F.array_join(F.transform("by_population", lambda x: F.concat_ws(":", x["population"], x["an"].cast("string"), x["ac"].cast("string"))), ";")
    return out.select("chrom", "site", "n_samples", "an", "ac", "af", F.when(F.size("by_population") > 0, pops).alias("pops"), "sub_type", "sub_type_n")
