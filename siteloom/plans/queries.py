"""One query per operator over the driver's tables, with the SQL it has to agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GERMLINE_CUTOFFS
from ..functions import cigar as C
from ..functions import seq as S
from ..operators import cluster, intervals, population, reads, rules
from ..operators.components import connected
from ..operators.genes import listed_at
from ..operators.parameters import nearest_cutoffs
from .virtual import oracle_view, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            names = [*views]
            parts = [f"{v} AS ({oracle_view(v)})" if v in _PLAIN else f"{v} AS ({_DERIVED[v]})" for v in names]
            joined = ", " if sql.startswith("WITH ") else " "
            ORACLES[f.__name__] = (f"WITH {', '.join(parts)}{joined}{sql.removeprefix('WITH ')}" if parts else sql)
        return f

    return add


_PLAIN = ("reads", "repeats", "samples", "cohort", "calls", "records", "evidence", "alns", "places", "flanks", "contigs", "moved", "parts")
#: What the oracles build on plain views.
_DERIVED = {
    "hits": "SELECT DISTINCT r.mate_chrom AS c, r.mate_pos AS p FROM reads r JOIN repeats i ON r.mate_chrom = i.chrom AND r.mate_pos >= i.start AND r.mate_pos < i.\"end\"",
    "clips": "SELECT chrom, pos, count(*) FILTER (side = 'L') AS n_l, count(*) FILTER (side = 'R') AS n_r, count(*) FILTER (c IS NOT NULL) AS n_mate FROM reads LEFT JOIN hits ON mate_chrom = c AND mate_pos = p WHERE side IN ('L', 'R') AND mapq >= 12 GROUP BY 1, 2",
    "near_": "SELECT *, sum(n_l) OVER w AS near_l, sum(n_r) OVER w AS near_r, sum(n_mate) OVER w AS near_mate FROM clips WINDOW w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 50 PRECEDING AND 49 FOLLOWING)",
    "cand": "SELECT * FROM near_ WHERE (near_l >= 9 OR near_r >= 9) AND near_mate >= 2",
    "steps": "SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 100 THEN NULL ELSE pos END AS st FROM cand",
    "isl": "SELECT *, max(st) OVER (PARTITION BY chrom ORDER BY pos) AS island FROM steps",
    "csteps": "SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY sample_key ORDER BY pos) <= 30 THEN NULL ELSE pos END AS st FROM (SELECT *, chrom AS sample_key FROM cohort)",
    "cisl": "SELECT *, max(st) OVER (PARTITION BY chrom ORDER BY pos) AS island FROM csteps",
    "csites": "SELECT a.*, b.site FROM cisl a JOIN (SELECT chrom, island, arg_max(pos, (k, -pos)) AS site FROM (SELECT chrom, island, pos, count(DISTINCT sample) AS k FROM cisl GROUP BY ALL) GROUP BY ALL) b USING (chrom, island)",
    "black": "SELECT chrom, start, \"end\" FROM repeats WHERE \"end\" - start > 45",
    "sites": "SELECT DISTINCT chrom, pos FROM reads",
    "genes": "SELECT DISTINCT CAST(chrom AS BIGINT) AS chrom, start * 8 AS start, start * 8 + 60 AS \"end\", subfamily || ':' || family AS name FROM repeats",
}


def _clips(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "reads").filter("mapq >= 12 AND side IN ('L', 'R')")
    return reads.clip_counts(reads.mate_in_repeat(r, view(spark, d, "repeats")).select("chrom", "pos", "side", "in_repeat"))


def _near(spark: SparkSession, d: str) -> DataFrame:
    return cluster.nearby_sums(_clips(spark, d), {"near_l": F.col("n_l"), "near_r": F.col("n_r"), "near_mate": F.col("n_mate")})


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return reads.candidate_filter(_near(spark, d), 9, 2)


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "reads").select("chrom", "pos").distinct()


_CLIP = ("reads", "repeats", "hits", "clips")
_CAND = (*_CLIP, "near_", "cand")
_ISL = (*_CAND, "steps", "isl")


@query("SELECT * FROM clips", *_CLIP)
def clip_count(spark, d):
    return _clips(spark, d)


@query("SELECT chrom, pos, near_l::BIGINT AS near_l, near_r::BIGINT AS near_r, near_mate::BIGINT AS near_mate FROM cand", *_CAND)
def nearby_sum(spark, d):
    return _candidates(spark, d).select("chrom", "pos", "near_l", "near_r", "near_mate")


@query("SELECT chrom, island, arg_max(pos, (n_l + n_r, -pos)) AS peak, sum(n_l)::BIGINT AS sum_l, sum(n_r)::BIGINT AS sum_r, count(*) AS n_pos FROM isl GROUP BY chrom, island", *_ISL)
def peak_cluster(spark, d):
    return cluster.peaks(_candidates(spark, d), 100)


def _std(w: str) -> str:
    x = "(pos - island)::DOUBLE"
    return f"CASE WHEN sum({w}) > 0 THEN round(sqrt(greatest(sum({w} * {x} * {x}) / sum({w}) - (sum({w} * {x}) / sum({w})) ^ 2, 0)), 2) ELSE -1 END"


@query(f"SELECT chrom, island, arg_max(pos, (n_l + n_r, -pos)) AS peak, sum(n_l)::BIGINT AS sum_l, sum(n_r)::BIGINT AS sum_r, count(*) AS n_pos, {_std('n_l')} AS std_l, {_std('n_r')} AS std_r, {_std('(n_l + n_r)')} AS std_all FROM isl GROUP BY chrom, island", *_ISL)
def peak_std(spark, d):
    return cluster.peaks_with_deviation(_candidates(spark, d), 100)


@query("""SELECT chrom, island, median, sum(CASE WHEN abs(pos - median) <= 75 THEN n_l + n_r ELSE 0 END)::BIGINT AS n_focal, sum(n_l + n_r)::BIGINT AS n_all FROM isl JOIN (
  SELECT chrom, island, min(pos) AS median FROM (SELECT chrom, island, pos, sum(n_l + n_r) OVER (PARTITION BY chrom, island ORDER BY pos) AS run, sum(n_l + n_r) OVER (PARTITION BY chrom, island) AS a FROM isl) WHERE 2 * run >= a GROUP BY ALL) USING (chrom, island) GROUP BY ALL""", *_ISL)
def weighted_median_peak(spark, d):
    return cluster.weighted_median_peaks(_candidates(spark, d), 100)


@query("""SELECT chrom, island, arg_max(pos, (n_l, -pos)) FILTER (n_l > 0) AS left_peak, arg_max(pos, (n_r, -pos)) FILTER (n_r > 0) AS right_peak, max(pos) AS "last",
  coalesce(arg_max(pos, (n_l, -pos)) FILTER (n_l > 0), arg_max(pos, (n_r, -pos)) FILTER (n_r > 0), island) AS site
  FROM (SELECT *, max(st) OVER (PARTITION BY chrom ORDER BY pos) AS island FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) < 20 THEN NULL ELSE pos END AS st FROM clips)) GROUP BY chrom, island""", *_CLIP)
def chain_regions(spark, d):
    return cluster.chained_regions(_clips(spark, d), 20)


@query("SELECT chrom, count(*) AS n, count(c) AS n_in FROM reads LEFT JOIN hits ON mate_chrom = c AND mate_pos = p GROUP BY chrom", "reads", "repeats", "hits")
def mate_in_repeat(spark, d):
    return reads.mate_in_repeat(view(spark, d, "reads"), view(spark, d, "repeats")).groupBy("chrom").agg(F.count("*").alias("n"), F.count_if("in_repeat").alias("n_in"))


@query("""SELECT chrom, pos, min(div) AS div, count(*) AS n, min(div) <= 7 AS low FROM (SELECT DISTINCT mate_chrom AS chrom, mate_pos AS pos FROM reads) q JOIN repeats i USING (chrom) WHERE pos >= start AND pos < "end" GROUP BY ALL""", "reads", "repeats")
def min_div_interval(spark, d):
    points = view(spark, d, "reads").select(F.col("mate_chrom").alias("chrom"), F.col("mate_pos").alias("pos")).distinct()
    hits = intervals.points_in(points, view(spark, d, "repeats"))
    return hits.groupBy("chrom", "pos").agg(F.min("div").alias("div"), F.count("*").alias("n")).withColumn("low", F.col("div") <= 7)


@query("""SELECT chrom, pos, count(*) AS n FROM reads r WHERE NOT EXISTS (SELECT 1 FROM black b WHERE b.chrom = r.chrom AND r.pos >= b.start AND r.pos < b."end") GROUP BY ALL""", "reads", "repeats", "black")
def blacklist_anti(spark, d):
    black = view(spark, d, "repeats").filter("`end` - start > 45").select("chrom", "start", "end")
    return intervals.points_in(view(spark, d, "reads"), black, how="left_anti").groupBy("chrom", "pos").agg(F.count("*").alias("n"))


@query("""SELECT s.chrom, s.pos, coalesce(string_agg(g.name, '/' ORDER BY g.start, g.name), 'not_gene_region') AS gene, arg_max(g.name, (g.start, g.name)) AS last_gene
  FROM sites s LEFT JOIN genes g ON s.chrom = g.chrom AND s.pos >= g.start - 1500 AND s.pos < g."end" + 1500 GROUP BY ALL""", "reads", "repeats", "sites", "genes")
def gene_annot(spark, d):
    genes = view(spark, d, "repeats").select("chrom", (F.col("start") * 8).alias("start"), (F.col("start") * 8 + 60).alias("end"), F.concat_ws(":", "subfamily", "family").alias("name")).distinct()
    return listed_at(_sites(spark, d), genes)


_DISC = """SELECT s.chrom, s.pos, count(*) FILTER (r.pos < s.pos AND (mate_chrom <> r.chrom OR abs(mate_pos - (s.pos - 30)) > 500)) AS n_l, count(*) FILTER (r.pos > s.pos AND (mate_chrom <> r.chrom OR abs(mate_pos - (s.pos + 1)) > 500)) AS n_r
  FROM sites s JOIN reads r ON r.chrom = s.chrom AND r.pos >= s.pos - 30 AND r.pos < s.pos + 30 AND mapq >= 20 GROUP BY s.chrom, s.pos"""


@query(_DISC, "reads", "sites")
def disc_count(spark, d):
    return reads.discordant_sides(_sites(spark, d), view(spark, d, "reads"), 30, 500)


@query(f"SELECT * FROM ({_DISC}) WHERE (n_l > 3.0 AND n_r > 3.0) OR n_l > 6 OR n_r > 6", "reads", "sites")
def disc_filter(spark, d):
    return reads.disc_filter(reads.discordant_sides(_sites(spark, d), view(spark, d, "reads"), 30, 500), 6)


@query("""SELECT site, b.chrom AS mate_chrom, b.mate_pos, b.n, total FROM (SELECT site, arg_max({'chrom': chrom, 'mate_pos': mate_pos, 'n': n}, (n, -chrom, -island)) AS b, sum(n)::BIGINT AS total FROM (
  SELECT site, chrom, island, count(*) AS n, list_sort(list(pos))[(count(*) // 2 + 1)::INT] AS mate_pos FROM (
    SELECT *, max(st) OVER (PARTITION BY site, chrom ORDER BY pos) AS island FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY site, chrom ORDER BY pos) <= 40 THEN NULL ELSE pos END AS st FROM (SELECT bx AS site, mate_chrom AS chrom, mate_pos AS pos FROM reads WHERE mapq >= 20)))
  GROUP BY ALL) GROUP BY site) WHERE b.n > 0.02 * total""", "reads")
def mate_cluster(spark, d):
    return cluster.mate_clusters(view(spark, d, "reads").filter("mapq >= 20").select(F.col("bx").alias("site"), F.col("mate_chrom").alias("chrom"), F.col("mate_pos").alias("pos")), 40, 0.02)


@query("""SELECT site, b.start, b."end", b.n::BIGINT AS n, total, b.n >= 0.05 * total AS is_cluster FROM (SELECT site, arg_max({'start': pos, 'end': e, 'n': m}, (m, -pos)) AS b, sum(k)::BIGINT AS total FROM (
  SELECT site, pos, k, sum(k) OVER w - 1 AS m, max(pos) OVER w AS e FROM (SELECT bx AS site, mate_pos AS pos, count(*) AS k FROM reads GROUP BY ALL) WINDOW w AS (PARTITION BY site ORDER BY pos RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING)) GROUP BY site)""", "reads")
def max_cover(spark, d):
    return cluster.max_cover(view(spark, d, "reads").select(F.col("bx").alias("site"), F.col("mate_pos").alias("pos")), 60, 0.05, ["site"])


_TP = "SELECT site, pos, sum(k) OVER (PARTITION BY site ORDER BY pos RANGE BETWEEN 7 PRECEDING AND 6 FOLLOWING)::BIGINT AS s FROM (SELECT bx AS site, mate_pos AS pos, count(*) AS k FROM reads GROUP BY ALL) WHERE pos > 0"


@query(f"""WITH t AS ({_TP}), f AS (SELECT site, arg_max(pos, (s, -pos)) AS peak1, max(s) AS n1 FROM t GROUP BY site), g AS (SELECT t.site, arg_max(pos, (s, -pos)) AS peak2, max(s) AS n2 FROM t JOIN f ON t.site = f.site AND (pos < peak1 - 7 OR pos > peak1 + 6) GROUP BY t.site)
  SELECT f.site, peak1, n1, peak2, n2 FROM f LEFT JOIN g USING (site)""".replace("WITH t AS", "SELECT * FROM (WITH t AS", 1) + ")", "reads")
def two_peaks(spark, d):
    counts = view(spark, d, "reads").groupBy(F.col("bx").alias("site"), F.col("mate_pos").alias("pos")).agg(F.count("*").alias("n"))
    return cluster.two_peaks(counts, ["site"])


@query("""SELECT s.chrom, s.pos, CASE WHEN s.pos - 60 > 0 THEN coalesce(sum(greatest(least(read_end, s.pos + 1) - greatest(r.pos, s.pos - 60), 0)), 0) / 60 ELSE 0 END AS lcov,
  CASE WHEN s.pos - 60 > 0 THEN coalesce(sum(greatest(least(read_end, s.pos + 61) - greatest(r.pos, s.pos + 1), 0)), 0) / 60 ELSE 0 END AS rcov
  FROM sites s LEFT JOIN reads r ON r.chrom = s.chrom AND r.pos < s.pos + 61 AND r.read_end > s.pos - 60 GROUP BY s.chrom, s.pos""", "reads", "sites")
def site_coverage(spark, d):
    return reads.site_coverage(_sites(spark, d), view(spark, d, "reads").withColumnRenamed("read_end", "end"), 60)


@query("SELECT rg, count(*) AS n, round(avg(x), 4) AS mean_is, round(stddev_pop(x), 4) AS std_is FROM (SELECT rg, abs(pos - mate_pos)::DOUBLE AS x FROM reads WHERE chrom = mate_chrom) WHERE x <= 2000 GROUP BY rg", "reads")
def insert_size_stats(spark, d):
    return reads.insert_sizes(view(spark, d, "reads"), "rg")


@query("SELECT chrom, list_sort(list(n))[(count(*) // 2 + 1)::INT] AS median, count(*) AS n FROM (SELECT chrom, pos, count(*) AS n FROM reads GROUP BY ALL) WHERE n >= 2 GROUP BY chrom".replace("count(*) AS n FROM (", "count(*)::BIGINT AS n FROM (", 1), "reads")
def upper_median_cov(spark, d):
    depth = view(spark, d, "reads").groupBy("chrom", "pos").agg(F.count("*").alias("depth"))
    return reads.upper_median(depth, "depth", ["chrom"], 2)


@query("SELECT rg, arg_max(read_len, (n, -read_len)) AS mode, max(n) AS n FROM (SELECT rg, read_len, count(*) AS n FROM reads GROUP BY ALL) GROUP BY rg", "reads")
def read_len_mode(spark, d):
    return reads.most_frequent(view(spark, d, "reads"), "read_len", ["rg"])


@query("SELECT pos, chrom, round(least(1, n_af_clip * 100.0 / nullif((n_l_raw + n_r_raw) * 2 * 3, 0)), 6) AS clip_af, round(least(1, n_disc * 1.0 / nullif(n_disc + n_conc, 0)), 6) AS disc_af FROM records", "records")
def allele_fraction(spark, d):
    clip, disc = reads.allele_fraction(F.col("n_af_clip"), F.col("n_l_raw") + F.col("n_r_raw"), F.col("n_disc"), F.col("n_disc") + F.col("n_conc"), 100.0, 3)
    return view(spark, d, "records").select("pos", "chrom", F.round(clip, 6).alias("clip_af"), F.round(disc, 6).alias("disc_af"))


@query("""SELECT s.chrom, s.pos, count(*) FILTER (abs(r.pos - s.pos) < 3 AND side IN ('L', 'R')) AS n_af_clip, count(*) FILTER (abs(r.pos - s.pos) < 3 AND side = '-') AS n_full_map, count(*) FILTER (side = 'L') AS n_l_raw, count(*) FILTER (side = 'R') AS n_r_raw,
  count(*) FILTER (mate_chrom <> r.chrom OR abs(mate_pos - r.pos) > 2000) AS n_disc, count(*) FILTER (mate_chrom = r.chrom AND abs(mate_pos - r.pos) <= 2000) AS n_conc,
  coalesce(string_agg(clip_len::VARCHAR, ':' ORDER BY clip_len) FILTER (abs(r.pos - s.pos) < 3 AND side IN ('L', 'R')), '') AS clip_lens, count(DISTINCT CASE WHEN mate_chrom <> r.chrom OR abs(mate_pos - r.pos) > 2000 THEN mate_chrom END) AS n_mate_chroms
  FROM sites s JOIN reads r ON r.chrom = s.chrom AND r.pos >= s.pos - 25 AND r.pos < s.pos + 25 GROUP BY s.chrom, s.pos""", "reads", "sites")
def gntp_features(spark, d):
    return reads.genotype_features(_sites(spark, d), view(spark, d, "reads"), 25)


@query("SELECT s.chrom, s.pos, count(DISTINCT bx) AS n_bx FROM sites s JOIN reads r ON r.chrom = s.chrom AND r.pos >= s.pos - 20 AND r.pos < s.pos + 20 GROUP BY ALL HAVING count(DISTINCT bx) <= 3", "reads", "sites")
def barcode_distinct(spark, d):
    return reads.barcode_counts(_sites(spark, d), view(spark, d, "reads"), 20, 3)


@query("SELECT chrom, pos, count(*) FILTER (l AND r) AS n_shared, count(*) FILTER (l <> r) AS n_different FROM (SELECT s.chrom, s.pos, bx, bool_or(r.pos < s.pos) AS l, bool_or(r.pos >= s.pos) AS r FROM sites s JOIN reads r ON r.chrom = s.chrom AND r.pos >= s.pos - 20 AND r.pos < s.pos + 20 GROUP BY ALL) GROUP BY ALL", "reads", "sites")
def barcode_overlap(spark, d):
    return reads.barcode_overlap(_sites(spark, d), view(spark, d, "reads"), 20)


@query("SELECT site, arg_max(source, (n, -source)) AS source, max(n) AS n, sum(n)::BIGINT AS total FROM (SELECT pos AS site, mate_chrom AS source, count(*) AS n FROM reads GROUP BY ALL) GROUP BY site HAVING max(n) >= 2 AND max(n) >= 0.45 * sum(n)", "reads")
def td_source_argmax(spark, d):
    return reads.source_argmax(view(spark, d, "reads").select(F.col("pos").alias("site"), F.col("mate_chrom").alias("source")), 2, 0.45)


@query("SELECT pos, chrom, CASE WHEN abs(rclip_pos - lclip_pos) <= 100 THEN chrom || '~' || lclip_pos || '~' || rclip_pos ELSE '' END AS label FROM records", "records")
def tsd_label(spark, d):
    return view(spark, d, "records").select("pos", "chrom", rules.tsd_label(F.col("chrom").cast("string"), F.col("lclip_pos"), F.col("rclip_pos")).alias("label"))


@query("SELECT pos, chrom, CASE WHEN n_lpolya < 0 OR n_rpolya < 0 THEN '-' WHEN n_lpolya > 0 OR n_rpolya > 0 THEN '+' ELSE '.' END AS strand FROM records", "records")
def strand(spark, d):
    return view(spark, d, "records").select("pos", "chrom", rules.strand().alias("strand"))


def _accepted(stands: str, p: int) -> str:
    """One step of the fold over types: what stands after the calls of priority p."""
    met = f"""(SELECT c.*, c.sub_type = 'two_side_tprt_both' AS strong, (SELECT min(f.pos) FROM {stands} f WHERE f.chrom = c.chrom AND f.pos >= c.pos - 20 AND f.pos < c.pos + 20) AS hit FROM (SELECT chrom, pos, priority, sub_type FROM calls WHERE priority = {p}) c)"""
    beats = f"m.strong AND NOT EXISTS (SELECT 1 FROM {stands} f WHERE f.chrom = m.chrom AND f.pos = m.hit AND f.sub_type = 'two_side_tprt_both')"
    return f"""(SELECT chrom, pos, priority, sub_type FROM {met} m WHERE hit IS NULL OR {beats} UNION ALL SELECT chrom, pos, priority, sub_type FROM {stands} s WHERE NOT EXISTS (SELECT 1 FROM {met} m WHERE m.chrom = s.chrom AND m.hit = s.pos AND {beats}))"""


@query(f"WITH one AS (SELECT chrom, pos, priority, sub_type FROM calls WHERE priority = 0), two AS {_accepted('one', 1)} SELECT * FROM {_accepted('two', 2)}", "calls")
def vcf_type_conflict(spark, d):
    return population.resolve_types(view(spark, d, "calls").select("chrom", "pos", "priority", "sub_type"), 20)


_COHORT = ("cohort", "samples", "csteps", "cisl", "csites")


def _cohort(spark, d):
    return population.site_clusters(view(spark, d, "cohort"), 30)


@query("SELECT chrom, site, count(*) AS n, count(DISTINCT sample) AS n_samples, min(pos) AS first, max(pos) AS \"last\" FROM csites GROUP BY chrom, site", *_COHORT)
def pop_cluster(spark, d):
    return _cohort(spark, d).groupBy("chrom", "site").agg(F.count("*").alias("n"), F.count_distinct("sample").alias("n_samples"), F.min("pos").alias("first"), F.max("pos").alias("last"))


_AC = """one AS (SELECT chrom, site, sample, max(dosage) AS dosage, population FROM csites JOIN samples USING (sample) GROUP BY ALL),
  by_ AS (SELECT chrom, site, population, count(*) FILTER (dosage = 1) AS n_het, count(*) FILTER (dosage = 2) AS n_hom FROM one GROUP BY ALL), sz AS (SELECT population, count(*) AS people FROM samples GROUP BY ALL),
  ac AS (SELECT *, n_het + 2 * n_hom AS ac, round((n_het + 2 * n_hom) / an, 6) AS af FROM (SELECT chrom, site, population, n_het, n_hom, 2 * people AS an FROM by_ JOIN sz USING (population)
  UNION ALL SELECT chrom, site, 'ALL', sum(n_het)::BIGINT, sum(n_hom)::BIGINT, 2 * (SELECT count(*) FROM samples) FROM by_ GROUP BY chrom, site))"""


@query(f"SELECT * FROM (WITH {_AC} SELECT * FROM ac)", *_COHORT)
def pop_allele_stats(spark, d):
    return population.allele_counts(_cohort(spark, d), view(spark, d, "samples"))


@query(f"""SELECT * FROM (WITH {_AC}, p AS (SELECT chrom, site, min(population) AS population, max(ac / an) AS af FROM ac WHERE population <> 'ALL' AND ac > 0 GROUP BY ALL HAVING count(*) = 1)
  SELECT population, level, sum(m) OVER (PARTITION BY population ORDER BY level DESC)::BIGINT AS n FROM (SELECT population, floor(af * 1000 + 1e-9)::BIGINT AS level, count(*) AS m FROM p GROUP BY ALL))""", *_COHORT)
def af_histogram(spark, d):
    return population.private_histogram(population.allele_counts(_cohort(spark, d), view(spark, d, "samples")), 1000)


@query("SELECT sample, population, chrom, site, max(dosage) AS dosage FROM csites JOIN samples USING (sample) GROUP BY ALL", *_COHORT)
def pca_pivot(spark, d):
    return population.dosage_matrix(_cohort(spark, d), view(spark, d, "samples"))


_A, _B = "(SELECT DISTINCT chrom, pos FROM calls WHERE priority = 0)", "(SELECT DISTINCT chrom, pos FROM calls WHERE priority = 1)"
_IN = "EXISTS (SELECT 1 FROM {b} b WHERE b.chrom = a.chrom AND b.pos >= a.pos - 40 AND b.pos < a.pos + 40)"


@query(f"""SELECT tp, fp, fn, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(fp / nullif(tp + fp, 0), 6) AS fdr FROM (SELECT (SELECT count(*) FROM {_A} a WHERE {_IN.format(b=_B)}) AS tp, (SELECT count(*) FROM {_A} a WHERE NOT {_IN.format(b=_B)}) AS fp, (SELECT count(*) FROM {_B} a WHERE NOT {_IN.format(b=_A)}) AS fn)""", "calls")
def f1_compare(spark, d):
    v = view(spark, d, "calls")
    return population.compare(v.filter("priority = 0"), v.filter("priority = 1"), 40)


@query(f"SELECT a.chrom, a.pos FROM {_A} a WHERE {_IN.format(b=_B)}", "calls")
def slack_semi(spark, d):
    v = view(spark, d, "calls")
    return intervals.near(v.filter("priority = 0").select("chrom", "pos").distinct(), v.filter("priority = 1"), 40)


@query(f"SELECT a.chrom, a.pos FROM {_A} a WHERE NOT {_IN.format(b=_B)}", "calls")
def slack_anti(spark, d):
    v = view(spark, d, "calls")
    return intervals.near(v.filter("priority = 0").select("chrom", "pos").distinct(), v.filter("priority = 1"), 40, "left_anti")


@query(f"SELECT a.chrom, a.pos, min(b.pos) AS hit FROM {_A} a LEFT JOIN {_B} b ON b.chrom = a.chrom AND b.pos >= a.pos - 40 AND b.pos < a.pos + 40 GROUP BY a.chrom, a.pos", "calls")
def slack_first_hit(spark, d):
    v = view(spark, d, "calls")
    return intervals.near(v.filter("priority = 0").select("chrom", "pos").distinct(), v.filter("priority = 1"), 40, "left")


@query("SELECT chrom, island, count(DISTINCT sample) AS n_samples, min(pos) AS pos, count(DISTINCT sample) = 1 AS singleton FROM (SELECT *, max(st) OVER (PARTITION BY chrom ORDER BY pos) AS island FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 100 THEN NULL ELSE pos END AS st FROM calls)) GROUP BY chrom, island", "calls")
def joint_singleton(spark, d):
    return population.joint_sites(view(spark, d, "calls"), 100)


#: What the rule cascades ask, as columns in SQL.
_FLAGS = """SELECT *, coalesce(lc_start, -1) AS ls, coalesce(lc_end, -1) AS le, coalesce(rc_start, -1) AS rs, coalesce(rc_end, -1) AS re, coalesce(ld_start, -1) AS dls, coalesce(ld_end, -1) AS dle, coalesce(rd_start, -1) AS drs, coalesce(rd_end, -1) AS dre,
  lc_start IS NULL OR rc_start IS NULL AS noclip, ld_start IS NULL OR rd_start IS NULL AS nodisc, contains(sub_type, 'two_side') OR contains(sub_type, 'both-side') OR contains(sub_type, 'one_side_and_half_transduction') AS two, NOT two AND contains(sub_type, 'one_side') AS one,
  NOT two AND NOT one AND (contains(sub_type, 'one_half') OR contains(sub_type, 'one-half')) AS half, contains(sub_type, 'two_side_tprt_both') AS tboth, contains(sub_type, 'orphan') AS orphan, NOT contains(td_src, 'not_transduction') AND NOT contains(td_src, 'may') AND NOT orphan AS td,
  noclip OR NOT (abs(le - rs) < 300 OR abs(re - ls) < 300) AS capart, nodisc OR NOT (abs(dle - drs) < 300 OR abs(dre - dls) < 300) AS dapart, n_all_lclip > 0 AND n_all_rclip > 0 AS clips, n_all_lpolya / nullif(n_all_lclip, 0) AS lpa, n_all_rpolya / nullif(n_all_rclip, 0) AS rpa,
  coalesce(clips AND NOT capart AND NOT (tboth AND dapart) AND lpa > 0.75 AND rpa > 0.75, false) AS dom, n_lpolya * n_rpolya > 0 AS same, n_all_lpolya > 0 OR n_all_rpolya > 0 AS polya, div IS NOT NULL AS rep, coalesce(div < 15, false) AS low,
  coalesce((n_all_lclip + n_all_rclip) / nullif(n_af_clip, 0), 0) AS r1, coalesce((n_all_ldisc + n_all_rdisc) / nullif(n_disc, 0), 0) AS r2, coalesce(n_af_clip / nullif(n_af_clip + n_full_map, 0), 0) AS r3, coalesce(n_disc / nullif(n_disc + n_conc, 0), 0) AS r4,
  NOT (r1 > 0.075 AND r2 > 0.075 AND r3 > 0.075 AND r4 > 0.075) AS af, lcov > 2 * mean_cov OR rcov > 2 * mean_cov AS cov2 FROM records"""


def _tprt(tail: int, least: int) -> str:
    return f"(tboth AND both_consistent AND (le >= {tail} OR re >= {tail}) AND (dle >= {tail} OR dre >= {tail}) AND (abs(ls - re) >= {least} OR abs(rs - le) >= {least}))"


def _cascade(steps: list[tuple[str, str]]) -> str:
    return f"SELECT chrom, pos, CASE {' '.join(f'WHEN {test} THEN {chr(39)}{name}{chr(39)}' for name, test in steps)} END AS reason FROM ({_FLAGS})"


_P = "NOT orphan AND NOT (td AND td_novel)"
_L1 = _cascade([
    ("blacklist", "in_blacklist"), ("orphan_one_side", "orphan AND one"), ("td_in_copy", f"td AND rep AND div <= 7 AND within_copy AND NOT {_tprt(5950, 100)}"), ("td_polya", "td AND ((NOT tboth AND coalesce(lpa > 0.85, true) AND coalesce(rpa > 0.85, true)) OR r4 < 0.08)"),
    ("td_one_side", "td AND td_novel AND one"), ("no_polya_no_end", f"{_P} AND NOT polya AND NOT hit_end"), ("two_side_polya", f"{_P} AND two AND dom AND same AND NOT (both_consistent AND (abs(ls - re) > 200 OR abs(rs - le) > 200))"), ("two_side_end", f"{_P} AND two AND NOT hit_end"),
    ("two_side_af", f"{_P} AND two AND af"), ("two_side_copy", f"{_P} AND two AND low AND NOT {_tprt(6000, 200)}"), ("one_half_copy", f"{_P} AND half AND low"), ("one_half_polya", f"{_P} AND half AND dom AND same"), ("one_side_copy", f"{_P} AND one AND low"), ("other", f"{_P} AND NOT two AND NOT half AND NOT one"),
    ("tail_same_way", f"{_P} AND (rep OR cov2) AND NOT noclip AND ls > 5950 AND rs > 5950 AND same"), ("copy_without_tail", f"{_P} AND rep AND NOT (noclip OR le >= 5950 OR re >= 5950)")])
_T, _H = "(two OR (half AND clips))", "((half AND NOT clips) OR one)"
_ALU = _cascade([
    ("blacklist", "in_blacklist"), ("two_side_polya", f"{_T} AND dom AND same"), ("two_side_af", f"{_T} AND af"), ("two_side_no_polya", f"{_T} AND NOT polya AND NOT (contains(sub_type, 'two_side_tprt') AND NOT noclip AND (le > 200 OR re > 200))"), ("low_copy", f"{_H} AND low"),
    ("one_side_polya", f"{_H} AND ((n_all_lclip <= 0 AND n_all_rclip <= 0) OR (n_all_lclip <= 0 AND coalesce(rpa > 0.75, false) AND n_af_clip - n_all_rclip >= 5) OR (n_all_rclip <= 0 AND coalesce(lpa > 0.75, false) AND n_af_clip - n_all_lclip >= 5))"),
    ("copy_no_polya", f"{_H} AND rep AND NOT polya"), ("other", f"NOT {_T} AND NOT {_H}"), ("copy_both_tails", "rep AND NOT noclip AND ls > 255 AND rs > 255"), ("copy_without_tail", "rep AND NOT (noclip OR le >= 255 OR re >= 255)"),
    ("indels", "floor(0.3 * mean_cov) > 0 AND n_indel > floor(0.3 * mean_cov) AND cov2")])
_SD = "(clips AND NOT (tboth AND NOT nodisc AND (dls < 400 OR drs < 400)) AND lpa > 0.75 AND rpa > 0.75)"
_SVA = _cascade([
    ("blacklist", "in_blacklist"), ("two_side_polya", f"two AND {_SD}"), ("two_side_af", "two AND af"), ("low_copy", "(half OR one) AND low"), ("no_polya", "(two OR half OR one) AND NOT polya"), ("one_half_polya", f"half AND {_SD}"),
    ("one_side_td", "one AND (orphan OR (NOT contains(td_src, 'not_transduction') AND NOT contains(td_src, 'may')))"), ("other", "NOT two AND NOT half AND NOT one"), ("copy_both_tails", "rep AND NOT noclip AND ls >= 1900 AND rs >= 1900"), ("copy_both_heads", "rep AND NOT noclip AND ls < 1900 AND rs < 1900")])
_MOSAIC = _cascade([
    ("no_polya", "NOT polya"), ("clip_af", "NOT (r3 BETWEEN 0.02 AND 0.35)"), ("disc_af", "r4 > 0.35"), ("two_side_polya", "two AND dom"), ("one_half_copy", "half AND rep"), ("one_half_polya", "half AND dom"), ("one_side_copy", "one AND rep"), ("other", "NOT two AND NOT half AND NOT one")])


@query(_L1, "records")
def postfilter_l1(spark, d):
    return rules.post_filter(view(spark, d, "records"), rules.l1_rules(), at_once=True).select("chrom", "pos", "reason")


@query(_ALU, "records")
def postfilter_alu(spark, d):
    return rules.post_filter(view(spark, d, "records"), rules.alu_rules(), at_once=True).select("chrom", "pos", "reason")


@query(_SVA, "records")
def postfilter_sva(spark, d):
    return rules.post_filter(view(spark, d, "records"), rules.sva_rules(), at_once=True).select("chrom", "pos", "reason")


@query(_MOSAIC, "records")
def mosaic_af(spark, d):
    return rules.post_filter(view(spark, d, "records"), rules.mosaic_rules()).select("chrom", "pos", "reason")


def _refined(name: str) -> str:
    p, t = "(abs(n_lpolya) + abs(n_rpolya) > 0)", "(tsd > 0 AND tsd < 100)"
    return f"CASE WHEN {p} AND {t} THEN '{name}_tprt_both' WHEN {p} OR {t} THEN '{name}_tprt' ELSE '{name}' END"


@query("SELECT chrom, pos, CASE WHEN lcov > 3 * mean_cov OR rcov > 3 * mean_cov THEN 'high_coverage_island' WHEN lc AND rc AND ld AND rd THEN " + _refined("two_side") + " WHEN (lc AND rd AND NOT rc AND NOT ld) OR (rc AND ld AND NOT lc AND NOT rd) THEN 'one_side' WHEN (lc AND rd AND (rc OR ld)) OR (rc AND ld AND (lc OR rd)) THEN " + _refined("one_half_side")
       + " ELSE 'other_type' END AS category, CASE WHEN coalesce((abs(n_lpolya) + abs(n_rpolya)) / nullif(n_l_raw + n_r_raw, 0) > 0.85, false) AND sub_type LIKE 'two_side%' THEN 'polyA_dominant_both-side_may_low_confident' WHEN coalesce((abs(n_lpolya) + abs(n_rpolya)) / nullif(n_l_raw + n_r_raw, 0) > 0.85, false) AND sub_type LIKE 'one_half%' THEN 'polyA_dominant_one_half_side' ELSE sub_type END AS label"
       " FROM (SELECT *, lc_start IS NOT NULL AS lc, rc_start IS NOT NULL AS rc, ld_start IS NOT NULL AS ld, rd_start IS NOT NULL AS rd FROM records)", "records")
def category(spark, d):
    return view(spark, d, "records").select("chrom", "pos", rules.category().alias("category"), rules.final_label().alias("label"))


def _span(a: str, b: str) -> str:
    return f"CASE WHEN {b}e - {a}s < 0 THEN {a}e - {b}s ELSE {b}e - {a}s END"


@query(f"""SELECT chrom, pos, abs(CASE WHEN contains(td_src, 'not_transduction') THEN CASE WHEN ls > 0 AND rs > 0 THEN {_span('l', 'r')} WHEN dls > 0 AND drs > 0 THEN {_span('dl', 'dr')} WHEN ls > 0 AND dls > 0 THEN {_span('l', 'dl')} WHEN rs > 0 AND drs > 0 THEN {_span('r', 'dr')} ELSE 0 END
  ELSE CASE WHEN dls > 0 AND drs > 0 THEN 6050 - least(dls, drs) WHEN drs < 0 AND dls > 0 THEN 6050 - dls WHEN drs > 0 AND dls < 0 THEN 6050 - drs ELSE 0 END END) AS ins_len FROM ({_FLAGS})""", "records")
def ins_len(spark, d):
    return view(spark, d, "records").select("chrom", "pos", rules.insertion_length(6050).alias("ins_len"))


@query("SELECT chrom, pos, CASE WHEN (ldisc_same >= ldisc_diff) <> (rdisc_same >= rdisc_diff) THEN '5prime-inversion' ELSE 'Not-5prime-inversion' END AS inversion FROM records", "records")
def inversion(spark, d):
    return view(spark, d, "records").select("chrom", "pos", rules.inversion().alias("inversion"))


_CC = "n_disc n_l_raw n_r_raw n_af_clip n_full_map lcov rcov".split()


@query(f"""SELECT chrom, pos, CASE WHEN cov <= 1e-10 THEN 'no_coverage' WHEN 2 * d / cov < 0.05 THEN 'few_effective_disc' WHEN orphan AND ((lcov > 0 AND n_all_ldisc / lcov < 0.05) OR (rcov > 0 AND n_all_rdisc / rcov < 0.05)) THEN 'orphan_disc'
  WHEN orphan AND ((lcov > 0 AND n_l_raw / lcov < 0.05) OR (rcov > 0 AND n_r_raw / rcov < 0.05)) THEN 'orphan_clip' WHEN disc < 0.15 THEN 'few_disc' WHEN n_disc <= 0 THEN 'no_disc' WHEN NOT orphan AND NOT sibling AND d / n_disc < 0.1 THEN 'effective_share' WHEN k_lcov IS NULL THEN 'no_control'
  WHEN kcov <= 1e-10 THEN 'control_no_coverage' WHEN kdisc > 0.35 * disc AND CASE WHEN td THEN kraw > 0.35 * raw ELSE kef > 0.35 * ef END THEN 'control_has_both' WHEN k_n_polya / kcov > 0.3 THEN 'control_polya' WHEN (k_n_af_clip + k_n_full_map = 0 OR k_n_af_clip / (k_n_af_clip + k_n_full_map) > 0.75) AND kdisc > 0.15 THEN 'control_af'
  WHEN (nraw + k_n_full_map = 0 OR share > 0.75) AND (kdisc > 0.15 OR (nraw > 0 AND k_n_polya / nraw > 0.375 AND k_n_disc > 0)) THEN 'control_raw_clip' WHEN n_all_lpolya + n_all_rpolya = 0 AND share > 0.35 THEN 'no_polya_control_clip' END AS reason
  FROM (SELECT *, 2 * n_disc / cov AS disc, 2 * k_n_disc / nullif(kcov, 0) AS kdisc, 2 * (n_l_raw + n_r_raw) / cov AS raw, 2 * nraw / nullif(kcov, 0) AS kraw, 2 * (n_all_lclip + n_all_rclip) / cov AS ef, 2 * k_n_af_clip / nullif(kcov, 0) AS kef, coalesce(nraw / nullif(nraw + k_n_full_map, 0), 0) AS share FROM (
    SELECT a.*, a.lcov + a.rcov AS cov, n_all_ldisc + n_all_rdisc AS d, contains(td_src, 'orphan') OR contains(sub_type, 'orphan') AS orphan, contains(td_src, 'sibling') OR contains(sub_type, 'sibling') AS sibling, NOT contains(td_src, 'not_transduction') AS td, k_lcov + k_rcov AS kcov, k_n_l_raw + k_n_r_raw AS nraw, b.* EXCLUDE (c, p)
    FROM records a LEFT JOIN (SELECT chrom AS c, pos - 1 AS p, {', '.join(f'{x} AS k_{x}' for x in _CC)}, abs(n_lpolya) + abs(n_rpolya) AS k_n_polya FROM records) b ON a.chrom = c AND a.pos = p))""", "records")
def case_control_ratio(spark, d):
    """The record at the next position stands for the control's features."""
    v = view(spark, d, "records")
    control = v.select(F.col("chrom").alias("_c"), (F.col("pos") - 1).alias("_p"), *(F.col(x).alias(f"k_{x}") for x in _CC), (F.abs("n_lpolya") + F.abs("n_rpolya")).alias("k_n_polya"))
    joined = v.join(control, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")), "left")
    return rules.post_filter(joined, rules.case_control_rules()).select("chrom", "pos", "reason")


_SEQ = "SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM documents"
_CA, _CT = "(length(s) - length(replace(s, 'A', '')))", "(length(s) - length(replace(s, 'T', '')))"


@query(f"""SELECT doc_id, {_CA} > 0.1 * length(s) OR {_CT} > 0.1 * length(s) AS poly, regexp_matches(s, 'A{{3,}}|T{{3,}}') AS run, regexp_matches(s, 'AAAAA|AATAA|TTTTT|TTATT') AS consecutive, {_CA} >= 40 OR {_CT} >= 40 AS enough,
  regexp_matches(s, 'AATAAA|AAAAAA|ATTAAA') AS signal, length(s) > 0 AND ({_CA} > 0.08 * length(s) OR {_CT} > 0.08 * length(s)) AS dominant FROM ({_SEQ})""")
def polya_predicates(spark, d):
    s = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    return table(spark, d, "documents").select("doc_id", S.is_poly_a_t(s, 0.1).alias("poly"), S.has_run_a_t(s, 3).alias("run"), S.consecutive_a_t(s).alias("consecutive"), S.enough_a_t(s, 40).alias("enough"), S.polya_signal(s, False).alias("signal"), S.dominant_a_t(s, 0.08).alias("dominant"))


@query("SELECT doc_id, md5(reverse(translate(upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', 'N', 'g')), 'ACGT', 'TGCA'))) AS rc FROM documents")
def revcomp(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.reverse_complement(F.coalesce("text", F.lit("")))).alias("rc"))


@query("""SELECT l_orderkey, l_linenumber, CASE m WHEN 0 THEN l_orderkey WHEN 1 THEN l_orderkey + 80 WHEN 2 THEN l_orderkey + 90 WHEN 3 THEN l_orderkey ELSE l_orderkey + 75 END AS break_at, CASE m WHEN 0 THEN l_orderkey + 80 WHEN 1 THEN l_orderkey + 80 WHEN 2 THEN l_orderkey + 90 WHEN 3 THEN l_orderkey + 100 ELSE l_orderkey + 75 END AS ref_end,
  m = 3 AS full_map, m IN (0, 4) AS left_clip, m IN (1, 2, 4) AS right_clip, m = 4 AS both_clipped, m = 2 AS indel, m IN (0, 1, 2, 3) AS good, (CASE m WHEN 0 THEN 0.8 WHEN 1 THEN 0.8 WHEN 2 THEN 0.857143 WHEN 3 THEN 1.0 ELSE 0.75 END)::DOUBLE AS ratio FROM (SELECT *, l_partkey % 5 AS m FROM lineitem)""")
def cigar_metrics(spark, d):
    texts = F.array(*map(F.lit, ("20S80M", "80M20S", "50M5I40M10S", "100M", "10S75M15S")))
    rows = table(spark, d, "lineitem").withColumn("cigar", C.parse_cigar(F.get(texts, (F.col("l_partkey") % 5).cast("int"))))
    g, p = F.col("cigar"), F.col("l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", C.right_breakpoint(p, g).alias("break_at"), C.reference_end(p, g).alias("ref_end"), C.fully_mapped(g).alias("full_map"), C.left_clipped(g).alias("left_clip"), C.right_clipped(g).alias("right_clip"),
                       C.both_sides_clipped(g).alias("both_clipped"), C.large_indel(g).alias("indel"), C.qualified(g, 0.65).alias("good"), F.round(C.mapped_ratio(g), 6).alias("ratio"))


@query("SELECT o_orderkey, o_orderpriority AS svtype, o_custkey AS len, o_orderstatus AS st FROM orders")
def info_parse(spark, d):
    info = F.concat_ws(";", F.concat(F.lit("SVTYPE="), F.col("o_orderpriority")), F.concat(F.lit("SVLEN="), F.col("o_custkey").cast("string")), F.concat(F.lit("STATUS="), F.col("o_orderstatus")))
    m = population.parse_info(info)
    return table(spark, d, "orders").select("o_orderkey", m["SVTYPE"].alias("svtype"), m["SVLEN"].cast("long").alias("len"), m["STATUS"].alias("st"))


@query("""SELECT chrom, pos AS start, CASE WHEN NOT nl THEN np ELSE -1 END AS "end" FROM q WHERE is_left UNION ALL SELECT chrom, -1, pos FROM q WHERE NOT is_left AND (pl IS NULL OR NOT pl)""".join(["SELECT * FROM (WITH q AS (SELECT *, lead(pos) OVER w AS np, lead(is_left) OVER w AS nl, lag(is_left) OVER w AS pl FROM (SELECT DISTINCT chrom, pos, pos % 3 = 0 AS is_left FROM reads) WINDOW w AS (PARTITION BY chrom ORDER BY pos)) ", ")"]), "reads")
def del_pairing(spark, d):
    return cluster.paired_deletions(view(spark, d, "reads").select("chrom", "pos", (F.col("pos") % 3 == 0).alias("is_left")).distinct())


_IV = "(SELECT chrom, start, \"end\" FROM repeats WHERE \"end\" > start)"


@query(f"""SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY chrom ORDER BY start, "end") = 1 THEN 1 ELSE 0 END AS nw FROM {_IV})) GROUP BY chrom, g""", "repeats")
def iv_merge(spark, d):
    return intervals.merge(view(spark, d, "repeats").select("chrom", "start", "end"))


@query(f"""SELECT p.chrom, p.start, p."end", count(*) AS n FROM (SELECT chrom, start, lead(start) OVER (PARTITION BY chrom ORDER BY start) AS "end" FROM (SELECT chrom, start FROM {_IV} UNION SELECT chrom, "end" FROM {_IV})) p JOIN {_IV} i ON i.chrom = p.chrom AND p.start >= i.start AND p.start < i."end" WHERE p."end" IS NOT NULL GROUP BY ALL""", "repeats")
def iv_split(spark, d):
    return intervals.split(view(spark, d, "repeats"))


@query("""SELECT chrom, start, least("end", 500) AS "end" FROM repeats WHERE start < 500 AND "end" > start UNION ALL SELECT chrom, greatest(start, 600), "end" FROM repeats WHERE "end" > greatest(start, 600)""", "repeats")
def iv_chop(spark, d):
    return intervals.chop(view(spark, d, "repeats").select("chrom", "start", "end"), 500, 600)


@query("""SELECT a.chrom, a.start, a."end", b.start AS start_b, b."end" AS end_b, least(a."end", b."end") - greatest(a.start, b.start) AS shared FROM repeats a JOIN repeats b ON a.chrom = b.chrom AND a.start < b."end" AND a."end" > b.start""", "repeats")
def iv_overlap(spark, d):
    v = view(spark, d, "repeats").select("chrom", "start", "end")
    out = intervals.overlaps(v, v, 16)
    return out.select("chrom", "start", "end", "start_b", "end_b", intervals.overlap_length(F.col("start"), F.col("end"), F.col("start_b"), F.col("end_b")).alias("shared"))


_CUT = " UNION ALL ".join(f"SELECT {k} AS cov, {a} AS clip, {b} AS disc, {m} AS mate" for k, (a, b, m) in GERMLINE_CUTOFFS.items())


@query(f"""SELECT p_partkey, p_size AS coverage, clip, disc, mate FROM (SELECT p_partkey, p_size, CASE WHEN k IS NOT NULL THEN k WHEN p_size < 10 THEN 5 WHEN p_size > 200 THEN 200 ELSE 100 END AS key FROM (SELECT p_partkey, p_size, (SELECT arg_min(cov, (abs(cov - p_size), cov)) FROM ({_CUT}) WHERE abs(cov - p_size) <= 9) AS k FROM part)) JOIN ({_CUT}) ON cov = key""")
def param_lookup(spark, d):
    return nearest_cutoffs(table(spark, d, "part").select("p_partkey", F.col("p_size").alias("coverage")), "coverage", GERMLINE_CUTOFFS)


@query("""SELECT c_custkey AS node, (SELECT min(x) FROM (VALUES (c_custkey % 97), (c_custkey % 97)) t(x)) AS label FROM customer WHERE c_custkey >= 97""")
def union_find(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("a"))
    return connected(c.filter("a >= 97").select("a", (F.col("a") - 97).alias("b")))


@query("SELECT user_id, island::BIGINT AS island, count(*) AS n, max(t)::BIGINT AS \"last\" FROM (SELECT *, max(st) OVER (PARTITION BY user_id ORDER BY t) AS island FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 3600 THEN NULL ELSE t END AS st FROM (SELECT user_id, floor(epoch(ts))::BIGINT AS t FROM events))) GROUP BY ALL")
def event_islands(spark, d):
    rows = table(spark, d, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("pos"))
    return cluster.islands(rows, 3600, key=["user_id"]).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


@query("SELECT mask, (mask & 1) <> 0 AS l1, (mask & 2) <> 0 AS alu, (mask & 4) <> 0 AS sva, count(*) AS n FROM (SELECT p_size % 128 AS mask FROM part) GROUP BY ALL")
def type_mask(spark, d):
    m = F.col("mask")
    rows = table(spark, d, "part").select((F.col("p_size") % 128).alias("mask"))
    return rows.select("mask", *(rules.type_bit(m, b).alias(n) for n, b in (("l1", 1), ("alu", 2), ("sva", 4)))).groupBy("mask", "l1", "alu", "sva").agg(F.count("*").alias("n"))


def _known_genotypes(v: DataFrame) -> DataFrame:
    """Records with a genotype that their clips and pairs tell, but for one in twenty: those of every other order."""
    af = F.when(F.col("n_af_clip") + F.col("n_full_map") > 0, F.col("n_af_clip") / (F.col("n_af_clip") + F.col("n_full_map"))).otherwise(0.0) + F.when(F.col("n_disc") + F.col("n_conc") > 0, F.col("n_disc") / (F.col("n_disc") + F.col("n_conc"))).otherwise(0.0)
    told = F.when(af > 1.0, "1/1").when(af > 0.5, "0/1").otherwise("0/0")
    return v.filter(F.floor(F.col("pos") / 10) % 2 == 0).withColumn("genotype", F.when(F.pmod(F.xxhash64("pos"), F.lit(20)) == 0, "0/1").otherwise(told))


@query()
def genotype_rf(spark, d):
    """Learned from the records with a known genotype; applied to all."""
    from ..operators.genotype import predict, train

    v = view(spark, d, "records")
    return predict(train(_known_genotypes(v)), v)


@query()
def genotype_layers(spark, d):
    from ..operators.genotype import predict_layers, train_layers

    v = view(spark, d, "records")
    return predict_layers(train_layers(_known_genotypes(v), levels=2, trees=10, depth=5), v)


@query()
def random_sites(spark, d):
    from ..operators.parameters import random_sites as draw

    contigs = view(spark, d, "reads").groupBy("chrom").agg(F.max("pos").alias("length"))
    return draw(contigs, 3000, 100, seed=5)


@query()
def session_stream(spark, d):
    from ..streaming.sessions import sessions_of

    return sessions_of(spark, f"{d}/events.parquet")


@query("SELECT c.chrom, c.pos, c.n_l, c.n_r, d.n_l AS n_ldisc, d.n_r AS n_rdisc FROM clips c JOIN (" + _DISC + ") d ON c.chrom = d.chrom AND c.pos = d.pos", *_CLIP, "sites")
def clip_disc_join(spark, d):
    disc = reads.discordant_sides(_sites(spark, d), view(spark, d, "reads"), 30, 500).withColumnsRenamed({"n_l": "n_ldisc", "n_r": "n_rdisc"})
    return _clips(spark, d).select("chrom", "pos", "n_l", "n_r").join(disc, ["chrom", "pos"])


@query("SELECT c.chrom, c.pos, c.n_l, c.n_r, d.n_l AS n_ldisc, d.n_r AS n_rdisc, b.n_bx FROM clips c JOIN (" + _DISC + ") d ON c.chrom = d.chrom AND c.pos = d.pos JOIN (SELECT s.chrom, s.pos, count(DISTINCT bx) AS n_bx FROM sites s JOIN reads r ON r.chrom = s.chrom AND r.pos >= s.pos - 20 AND r.pos < s.pos + 20 GROUP BY ALL HAVING count(DISTINCT bx) <= 3) b ON c.chrom = b.chrom AND c.pos = b.pos", *_CLIP, "sites")
def clip_disc_barcode(spark, d):
    """Sites with clips, discordant pairs and few molecules, with all their counts."""
    return clip_disc_join(spark, d).join(reads.barcode_counts(_sites(spark, d), view(spark, d, "reads"), 20, 3), ["chrom", "pos"])


@query("SELECT chrom, b.pos AS pos, b.c AS n_clip FROM (SELECT chrom, island, arg_max({'pos': pos, 'c': n_l + n_r}, (n_l + n_r, n_l + n_r + n_mate, -pos)) AS b FROM isl GROUP BY chrom, island)", *_ISL)
def peak_two_keys(spark, d):
    rows = _candidates(spark, d).withColumn("n_clip", F.col("n_l") + F.col("n_r"))
    return cluster.peaks_by_two(rows.withColumn("n_all", F.col("n_clip") + F.col("n_mate")).select("chrom", "pos", "n_clip", "n_all"), 100)


@query("SELECT c.chrom, c.pos, c.n_l - coalesce(f.n_l, 0) AS n_l, c.n_r - coalesce(f.n_r, 0) AS n_r FROM clips c LEFT JOIN (SELECT chrom, pos, count(*) FILTER (side = 'L') AS n_l, count(*) FILTER (side = 'R') AS n_r FROM reads WHERE side IN ('L', 'R') AND mapq >= 40 GROUP BY ALL) f USING (chrom, pos)", *_CLIP)
def clip_subtract(spark, d):
    failed = reads.clip_counts(view(spark, d, "reads").filter("side IN ('L', 'R') AND mapq >= 40").select("chrom", "pos", "side", F.lit(False).alias("in_repeat")))
    return reads.subtract_unaligned(_clips(spark, d).select("chrom", "pos", "n_l", "n_r"), failed)


@query("SELECT chrom, pos, sum(n_l)::BIGINT AS n_l, sum(n_r)::BIGINT AS n_r, count(*) AS n_samples FROM (SELECT bx % 4 AS sample, chrom, pos, count(*) FILTER (side = 'L') AS n_l, count(*) FILTER (side = 'R') AS n_r FROM reads GROUP BY ALL) GROUP BY chrom, pos", "reads")
def multi_sample_sum(spark, d):
    per = view(spark, d, "reads").groupBy((F.col("bx") % 4).alias("sample"), "chrom", "pos").agg(F.count_if(F.col("side") == "L").alias("n_l"), F.count_if(F.col("side") == "R").alias("n_r"))
    return per.groupBy("chrom", "pos").agg(F.sum("n_l").alias("n_l"), F.sum("n_r").alias("n_r"), F.count("*").alias("n_samples"))


@query("SELECT s.chrom, s.pos, round(avg(CASE WHEN mapq < 10 THEN 1.0 ELSE 0.0 END), 6) AS low FROM sites s JOIN reads r ON r.chrom = s.chrom AND r.pos >= s.pos - 40 AND r.pos < s.pos + 40 GROUP BY s.chrom, s.pos HAVING avg(CASE WHEN mapq < 10 THEN 1.0 ELSE 0.0 END) < 0.15", "reads", "sites")
def low_mapq_background(spark, d):
    return reads.low_quality_background(_sites(spark, d), view(spark, d, "reads"), 40, 0.15).withColumn("low", F.round("low", 6))


@query("SELECT chrom, bin, count(*) AS n_molecules, sum(n)::BIGINT AS n, sum(total)::BIGINT AS total FROM (SELECT DISTINCT chrom, pos // 1000 AS bin, bx FROM reads) JOIN (SELECT bx, count(*) AS n, sum(pos)::BIGINT AS total FROM reads GROUP BY bx) USING (bx) GROUP BY ALL", "reads")
def molecule_reads(spark, d):
    r = view(spark, d, "reads").withColumn("bin", F.floor(F.col("pos") / 1000))
    return reads.molecule_totals(r, ["chrom", "bin"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND (b.l_linenumber % 2 = 1) <> (a.l_linenumber % 2 = 1) AND b.l_quantity > 45)")
def mate_by_name(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qname"), (F.col("l_linenumber") % 2 == 1).alias("is_read1"), "l_linenumber", "l_quantity")
    return reads.mates(r, r.filter("l_quantity > 45")).select(F.col("qname").alias("l_orderkey"), "l_linenumber")


@query("SELECT chrom, pos, rd, CASE WHEN n_ldisc <= 0 OR n_rdisc <= 0 THEN true ELSE abs(n_rdisc - n_ldisc) / greatest(n_ldisc, n_rdisc) >= 0.35 END AS differs, coalesce(lc_start - 276 <= rd_end + 276 AND rd_start - 276 <= lc_end + 276, false) AS near FROM (SELECT *, 1 AS rd FROM records)", "records")
def depth_and_distance(spark, d):
    return view(spark, d, "records").select("chrom", "pos", F.lit(1).alias("rd"), rules.depth_differs(F.col("n_ldisc"), F.col("n_rdisc")).alias("differs"), F.coalesce(rules.regions_consistent(F.col("lc_start"), F.col("lc_end"), F.col("rd_start"), F.col("rd_end"), 550), F.lit(False)).alias("near"))


@query("SELECT l_orderkey, l_linenumber, chrom <> mate OR abs(mate_pos - pos) > 2000 AS by_distance, chrom <> mate OR abs(pos - mate_pos) > 550 + 3 * 50 AS by_template, chrom = mate AND least(pos, mate_pos) <= site AND site <= greatest(pos, mate_pos) + 100 AND site - least(pos, mate_pos) <= 550 AND greatest(pos, mate_pos) + 100 - site <= 550 AS spans, (CASE WHEN rev THEN NOT rev2 ELSE rev2 END) <> rev3 AS same_way FROM (SELECT *, l_suppkey % 2 AS chrom, l_partkey % 2 AS mate, l_orderkey AS pos, l_partkey AS mate_pos, l_orderkey + 40 AS site, l_linestatus = 'F' AS rev, l_returnflag = 'A' AS rev2, l_linenumber = 1 AS rev3 FROM lineitem)")
def pair_predicates(spark, d):
    r = table(spark, d, "lineitem").withColumns({"chrom": (F.col("l_suppkey") % 2).cast("string"), "mate": (F.col("l_partkey") % 2).cast("string"), "pos": F.col("l_orderkey"), "mate_pos": F.col("l_partkey")})
    c, m, p, q = (F.col(x) for x in ("chrom", "mate", "pos", "mate_pos"))
    return r.select("l_orderkey", "l_linenumber", C.discordant(c, p, m, q).alias("by_distance"), C.discordant_by_template(c, m, p - q, 550, 50).alias("by_template"), C.spans_site(c, p, m, q, p + 40, 100, 550).alias("spans"),
                    C.same_orientation(F.col("l_returnflag") == "A", F.col("l_linestatus") == "F", F.col("l_linenumber") == 1).alias("same_way"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN m <= 2 ELSE m <= 1 END AS few FROM (SELECT *, CAST(l_linenumber % 4 AS INT) AS m FROM lineitem)")
def md_mismatches(spark, d):
    md = F.concat(F.lit("10"), F.repeat(F.lit("A5"), (F.col("l_linenumber") % 4).cast("int")), F.lit("7"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.few_mismatches(md, F.when(F.col("l_quantity") > 25, 150).otherwise(75)).alias("few"))


@query("SELECT o_orderkey, 2 AS n, 'hit' || (o_custkey % 5) AS first, o_orderkey AS pos, true AS rc, '50M' AS cigar FROM orders")
def xa_alternatives(spark, d):
    xa = F.concat(F.lit("hit"), (F.col("o_custkey") % 5).cast("string"), F.lit(",-"), F.col("o_orderkey").cast("string"), F.lit(",50M,1;other,+7,30M20S,0;"))
    x = C.alternatives(xa)
    return table(spark, d, "orders").select("o_orderkey", F.size(x).alias("n"), x[0]["chrom"].alias("first"), x[0]["pos"].alias("pos"), x[0]["is_rc"].alias("rc"), x[0]["cigar"].alias("cigar"))


@query("SELECT site, n, q1, q3 FROM (SELECT bx AS site, count(*) AS n, list_sort(list(mate_pos))[(count(*) // 4 + 1)::INT] AS q1, list_sort(list(mate_pos))[(3 * count(*) // 4 + 1)::INT] AS q3 FROM reads GROUP BY bx)", "reads")
def quartile_positions(spark, d):
    counts = view(spark, d, "reads").groupBy(F.col("bx").alias("site"), "mate_pos").agg(F.count("*").alias("k"))
    from pyspark.sql import Window

    w = Window.partitionBy("site")
    r = counts.withColumn("till", F.sum("k").over(w.orderBy("mate_pos"))).withColumn("n", F.sum("k").over(w))
    return r.groupBy("site", "n").agg(F.min(F.when(F.col("till") > F.floor(F.col("n") / 4), F.col("mate_pos"))).alias("q1"), F.min(F.when(F.col("till") > F.floor(3 * F.col("n") / 4), F.col("mate_pos"))).alias("q3"))


@query("SELECT chrom, kind, count(*) AS n FROM (SELECT chrom, CASE WHEN td_src LIKE '%orphan%' THEN 'orphan' WHEN td_src LIKE '%sibling%' THEN 'sibling' WHEN td_src LIKE '%not_transduction%' THEN 'none' ELSE 'td' END AS kind FROM records) GROUP BY ALL", "records")
def td_split(spark, d):
    kind = F.when(rules.is_orphan(), "orphan").when(rules.is_sibling(), "sibling").when(~rules.is_transduction(), "none").otherwise("td")
    return view(spark, d, "records").select("chrom", kind.alias("kind")).groupBy("chrom", "kind").agg(F.count("*").alias("n"))


@query("SELECT chrom, pos, CASE WHEN hit IS NULL THEN 'new' ELSE 'updated' END AS state, hit FROM (SELECT a.chrom, a.pos, min(b.pos) AS hit FROM (SELECT DISTINCT chrom, pos FROM calls WHERE priority = 2) a LEFT JOIN (SELECT DISTINCT chrom, pos FROM calls WHERE priority = 0) b ON b.chrom = a.chrom AND b.pos >= a.pos - 75 AND b.pos < a.pos + 75 GROUP BY ALL)", "calls")
def td_update(spark, d):
    v = view(spark, d, "calls")
    out = intervals.near(v.filter("priority = 2").select("chrom", "pos").distinct(), v.filter("priority = 0"), 75, "left")
    return out.select("chrom", "pos", F.when(F.col("hit").isNull(), "new").otherwise("updated").alias("state"), "hit")


@query("SELECT chrom, pos // 1000 AS bin, count(*) AS n, count(DISTINCT pos) AS n_pos FROM reads GROUP BY ALL", "reads")
def bin_counts(spark, d):
    return view(spark, d, "reads").groupBy("chrom", F.floor(F.col("pos") / 1000).alias("bin")).agg(F.count("*").alias("n"), F.count_distinct("pos").alias("n_pos"))


@query("SELECT o_orderkey, CASE WHEN st IN ('F', 'O') AND n > 0 THEN 'keep' ELSE 'drop' END AS verdict, line FROM (SELECT o_orderkey, o_orderstatus AS st, o_custkey AS n, 'chr' || (o_custkey % 24) || chr(9) || o_orderkey || chr(9) || '.' || chr(9) || '.' || chr(9) || '<' || o_orderpriority || '>' || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'SVTYPE=' || o_orderpriority || ';SVLEN=' || o_custkey || chr(9) || 'GT' || chr(9) || CASE o_orderstatus WHEN 'F' THEN '1/1' ELSE '0/1' END AS line FROM orders)")
def vcf_record(spark, d):
    from ..sources.sinks import vcf_lines

    o = table(spark, d, "orders")
    rec = o.select(F.concat(F.lit("chr"), (F.col("o_custkey") % 24).cast("string")).alias("chrom"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("svtype"), F.col("o_custkey").alias("ins_len"), F.when(F.col("o_orderstatus") == "F", "1/1").otherwise("0/1").alias("genotype"))
    lines = vcf_lines(rec).select(F.split("value", "\t")[1].cast("long").alias("o_orderkey"), F.col("value").alias("line"))
    return lines.join(o.select("o_orderkey", F.when(F.col("o_orderstatus").isin("F", "O") & (F.col("o_custkey") > 0), "keep").otherwise("drop").alias("verdict")), "o_orderkey")


#: Every INFO key of a record, and what it is of the virtual records; null values are left out.
_INFO = {"SVTYPE": "sub_type", "TSDLEN": "tsd", "SUBTYPE": "sub_type", "TD_SRC": "td_src", "LCLIP": "n_lclip", "RCLIP": "n_rclip", "LDISC": "n_ldisc", "RDISC": "n_rdisc", "LPOLYA": "n_lpolya", "RPOLYA": "n_rpolya", "LRAWCLIP": "n_l_raw", "RRAWCLIP": "n_r_raw", "AF_CLIP": "n_af_clip", "AF_FMAP": "n_full_map", "AF_DISC": "n_disc",
         "AF_CONCORDNT": "n_conc", "LDRC": "ldisc_same", "LDNRC": "ldisc_diff", "RDRC": "rdisc_same", "RDNRC": "rdisc_diff", "NINDEL": "n_indel"}


@query(f"""SELECT concat_ws(chr(9), 'chr' || chrom, pos, '.', '.', coalesce('<' || s || '>', '.'), '.', 'PASS', coalesce(nullif(concat_ws(';', {", ".join(f"'{k}=' || {'s' if k == 'SVTYPE' else c}" for k, c in _INFO.items())}), ''), '.'), 'GT', './.') AS value FROM (SELECT *, CASE WHEN within_copy THEN NULL ELSE sub_type END AS s FROM records)""", "records")
def vcf_lines(spark, d):
    """Records with nulls among them as lines of ten columns."""
    from ..sources.sinks import vcf_lines as lines

    v = view(spark, d, "records")
    keys = set(_INFO.values())
    v = v.select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), "pos", F.when(~F.col("within_copy"), F.col("sub_type")).alias("svtype"), *sorted(keys), F.lit(None).cast("string").alias("genotype"))
    return lines(v)


from . import alignments, called, contigs, evidence, cohort, orphans, places, realigned, regions  # noqa: E402,F401  their queries register themselves
