"""Queries on interval algebra and on regions of genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genes, sweep
from .queries import query
from .virtual import view

#: Two tables of intervals on the contigs of the repeats: the repeats, repeated rows and all, and stretches that overlap, touch or repeat them.
_A = 'a AS (SELECT chrom, start, "end" FROM repeats UNION ALL SELECT chrom, start, "end" FROM repeats WHERE div = 3)'
_B = 'b AS (SELECT chrom, "end" AS start, "end" + div AS "end" FROM repeats WHERE div > 10 UNION ALL SELECT chrom, start + 5, "end" - 3 FROM repeats WHERE div <= 10 UNION ALL SELECT chrom, start, "end" FROM repeats WHERE div = 7)'
_POINTS = f"""{_A}, {_B}, bounds AS (SELECT chrom, start AS pos FROM a WHERE "end" > start UNION SELECT chrom, "end" FROM a WHERE "end" > start UNION SELECT chrom, start FROM b WHERE "end" > start UNION SELECT chrom, "end" FROM b WHERE "end" > start),
  pieces AS (SELECT chrom, pos AS start, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS "end" FROM bounds),
  cover AS (SELECT *, (SELECT count(*) FROM a WHERE a.chrom = p.chrom AND a.start <= p.start AND p.start < a."end") AS n_0, (SELECT count(*) FROM b WHERE b.chrom = p.chrom AND b.start <= p.start AND p.start < b."end") AS n_1 FROM pieces p WHERE "end" IS NOT NULL)"""


def _joined(where: str) -> str:
    return f"""WITH {_POINTS} SELECT chrom, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY start) AS k FROM (SELECT chrom, start, "end", CASE WHEN lag("end") OVER (PARTITION BY chrom ORDER BY start) = start THEN 0 ELSE 1 END AS f FROM cover WHERE {where})) GROUP BY chrom, k"""


def _ab(spark, d):
    r = view(spark, d, "repeats")
    a = r.select("chrom", "start", "end")
    a = a.unionByName(r.filter("div = 3").select("chrom", "start", "end"))
    after = r.filter("div > 10").select("chrom", F.col("end").alias("start"), (F.col("end") + F.col("div")).alias("end"))
    inside = r.filter("div <= 10").select("chrom", (F.col("start") + 5).alias("start"), (F.col("end") - 3).alias("end"))
    return a, after.unionByName(inside).unionByName(r.filter("div = 7").select("chrom", "start", "end"))


@query(f"""WITH {_POINTS} SELECT chrom, start, "end", n_0, n_1 FROM cover WHERE n_0 + n_1 > 0""", "repeats")
def iv_cover(spark, d):
    return sweep.cover(list(_ab(spark, d)))


@query(_joined("n_0 + n_1 > 0"), "repeats")
def iv_union(spark, d):
    return sweep.union(*_ab(spark, d))


@query(_joined("n_0 > 0 AND n_1 > 0"), "repeats")
def iv_intersection(spark, d):
    return sweep.intersection(*_ab(spark, d))


@query(_joined("n_0 > 0 AND n_1 = 0"), "repeats")
def iv_difference(spark, d):
    return sweep.difference(*_ab(spark, d))


@query(_joined("(n_0 > 0) <> (n_1 > 0)"), "repeats")
def iv_symmetric_difference(spark, d):
    return sweep.symmetric_difference(*_ab(spark, d))


@query(f"WITH {_A}, {_B} SELECT 'common' AS kind, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', * FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))", "repeats")
def iv_sets(spark, d):
    a, b = _ab(spark, d)
    return sweep.common(a, b).withColumn("kind", F.lit("common")).unionByName(sweep.only(a, b).withColumn("kind", F.lit("only"))).unionByName(sweep.either(a, b).withColumn("kind", F.lit("either")))


@query(f"""WITH {_A}, {_B} SELECT a.chrom, a.start, a."end", b.start AS start_b, b."end" AS end_b FROM a JOIN b ON a.chrom = b.chrom AND a.start >= b.start AND a."end" <= b."end" AND a."end" > a.start""", "repeats")
def iv_envelop(spark, d):
    return sweep.enveloped(*_ab(spark, d), 16).select("chrom", "start", "end", "start_b", "end_b")


@query(f"""WITH {_A}, {_B} SELECT 'overlap' AS kind, * FROM (SELECT DISTINCT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND b."end" > b.start)) UNION ALL SELECT 'whole', * FROM (SELECT DISTINCT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND a.start >= b.start AND a."end" <= b."end"))""", "repeats")
def iv_without(spark, d):
    a, b = _ab(spark, d)
    return sweep.without(a, b, False, 16).withColumn("kind", F.lit("overlap")).unionByName(sweep.without(a, b, True, 16).withColumn("kind", F.lit("whole")))


@query(f"""WITH {_A}, v AS (SELECT DISTINCT * FROM a) SELECT p.chrom, p.start, p."end", c.start AS start_b, c."end" AS end_b FROM v p JOIN v c ON p.chrom = c.chrom AND p.start <= c.start AND p."end" >= c."end" AND (p.start, p."end") <> (c.start, c."end") AND c."end" > c.start""", "repeats")
def iv_nested(spark, d):
    return sweep.nested(_ab(spark, d)[0], 16)


@query(f"""WITH {_A}, {_B}, cuts AS (SELECT DISTINCT chrom, start AS pos FROM b), n AS (SELECT *, row_number() OVER () AS id FROM a), e AS (SELECT id, chrom, start AS pos FROM n UNION ALL SELECT id, n.chrom, c.pos FROM n JOIN cuts c ON c.chrom = n.chrom AND c.pos > n.start AND c.pos < n."end" UNION ALL SELECT id, chrom, "end" FROM n)
  SELECT chrom, pos AS start, stop AS "end" FROM (SELECT *, lead(pos) OVER (PARTITION BY id ORDER BY pos) AS stop FROM e) WHERE stop IS NOT NULL""", "repeats")
def iv_slice(spark, d):
    a, b = _ab(spark, d)
    return sweep.sliced(a, b.select("chrom", F.col("start").alias("pos")), 16)


@query(f"""WITH {_A} SELECT chrom, min(start) AS start, max("end") AS "end", max("end") - min(start) AS span FROM a GROUP BY chrom""", "repeats")
def iv_extent(spark, d):
    return sweep.extent(_ab(spark, d)[0])


#: Genes of 60 bases with three regions each, the last two of which overlap; some genes have none.
_REGIONS = """regions AS (SELECT DISTINCT chrom, name AS gene_id, k AS place, k || '.' || name AS region_id, start + CASE k WHEN 0 THEN 5 WHEN 1 THEN 20 ELSE 30 END AS start, start + CASE k WHEN 0 THEN 12 WHEN 1 THEN 34 ELSE 40 END AS "end" FROM genes, (VALUES (0), (1), (2)) AS x(k) WHERE start % 3 > 0)"""


@query(f"""WITH {_REGIONS}, at_ AS (SELECT s.chrom, s.pos, g.start, g."end", g.name, (SELECT arg_max(region_id, (place, region_id)) FROM regions q WHERE q.chrom = s.chrom AND q.gene_id = g.name AND s.pos >= q.start AND s.pos <= q."end") AS r FROM sites s JOIN genes g ON s.chrom = g.chrom AND s.pos >= g.start - 15 AND s.pos < g."end" + 15),
  hits AS (SELECT chrom, pos, start, name, CASE WHEN r IS NOT NULL THEN r || ':' || name WHEN pos >= "end" THEN 'down_stream:' || name || ':' || name WHEN pos <= start THEN 'up_stream:' || name || ':' || name ELSE 'intron:' || name || ':' || name END AS region FROM at_)
  SELECT s.chrom, s.pos, coalesce(string_agg(region, '/' ORDER BY start, name), 'not_gene_region') AS gene FROM sites s LEFT JOIN hits h USING (chrom, pos) GROUP BY ALL""", "reads", "repeats", "sites", "genes")
def gene_regions(spark, d):
    from .queries import _sites

    g = view(spark, d, "repeats").select("chrom", (F.col("start") * 8).alias("start"), (F.col("start") * 8 + 60).alias("end"), F.concat_ws(":", "subfamily", "family").alias("name")).distinct()
    parts = F.array(*(F.struct(F.lit(k).alias("place"), (F.col("start") + a).alias("s"), (F.col("start") + b).alias("e")) for k, a, b in ((0, 5, 12), (1, 20, 34), (2, 30, 40))))
    r = g.filter("start % 3 > 0").select("chrom", F.col("name").alias("gene_id"), F.inline(parts)).distinct()
    r = r.select("chrom", "gene_id", "place", F.concat_ws(".", F.col("place").cast("string"), "gene_id").alias("region_id"), F.col("s").alias("start"), F.col("e").alias("end"))
    named = g.select("chrom", "start", "end", F.col("name").alias("gene_id"), F.lit("t").alias("gene_type"), F.col("name").alias("gene_name"))
    return genes.annotated(_sites(spark, d), named, r, 15)
