"""Merging call sets: types within a sample, samples within a cohort, comparison with a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .cluster import islands
from .intervals import near


def resolve_types(calls: DataFrame, window: int) -> DataFrame:
    """calls (chrom, pos, priority, sub_type), accepted one type after the other, the least priority number first.

    Each type's calls are held against those that stand after the types before it, not against each other. A call meets the
    first of them in [pos - window, pos + window); it stands only where there is none, or where it is two_side_tprt_both
    and that one isn't, which then goes. Of several calls at one place all stand or go, and one that is strong makes the
    place so. There are as many steps as types.
    """
    rows = calls.withColumn("strong", F.col("sub_type").contains("two_side_tprt_both"))
    stands = None
    for priority in sorted(r[0] for r in calls.select("priority").distinct().collect()):  # the types
        own = rows.filter(F.col("priority") == priority)
        stands = written(own if stands is None else _accepted(stands, own, window), "types")
    return (rows if stands is None else stands).select(*calls.columns)


def _accepted(stands: DataFrame, own: DataFrame, window: int) -> DataFrame:
    met = near(own, stands.select("chrom", "pos"), window, "left")
    base = stands.groupBy(F.col("chrom").alias("_c"), F.col("pos").alias("_p")).agg(F.bool_or("strong").alias("_s"))
    here = (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p"))
    met = met.join(base, (F.col("chrom") == F.col("_c")) & (F.col("hit") == F.col("_p")), "left").withColumn("wins", F.col("strong") & ~F.col("_s"))
    beaten = met.filter("wins").select(F.col("chrom").alias("_c"), F.col("hit").alias("_p")).distinct()
    return stands.join(beaten, here, "left_anti").unionByName(met.filter("hit is null or wins").select(*stands.columns))


def site_clusters(calls: DataFrame, window: int) -> DataFrame:
    """calls (sample, chrom, pos, ...) with island, and the position of the island that most samples have (of ties the least)."""
    rows = islands(calls, window)
    at = rows.groupBy("chrom", "island", "pos").agg(F.count_distinct("sample").alias("k"))
    best = at.groupBy("chrom", "island").agg(F.max_by("pos", F.struct("k", -F.col("pos"))).alias("site"))
    return rows.join(best, ["chrom", "island"])


def allele_counts(clusters: DataFrame, samples: DataFrame) -> DataFrame:
    """Allele counts of each site, in all and by population: an, ac, af. Samples without metadata are left out.

    clusters: sample, chrom, site, dosage (0, 1, 2); samples: sample, population. A population's row exists where one of
    its samples has a call at the site; totals count all its samples.
    """
    people = samples.select("sample", "population").dropDuplicates(["sample"])
    sizes = people.groupBy("population").agg(F.count("*").alias("people"))
    everyone = people.agg(F.count("*").alias("everyone"))
    one = clusters.groupBy("chrom", "site", "sample").agg(F.max("dosage").alias("dosage")).join(people, "sample")
    het, hom = F.count_if(F.col("dosage") == 1), F.count_if(F.col("dosage") == 2)
    by = one.groupBy("chrom", "site", "population").agg(het.alias("n_het"), hom.alias("n_hom"))
    part = by.join(sizes, "population").select("chrom", "site", "population", "n_het", "n_hom", (2 * F.col("people")).alias("an"))
    whole = by.groupBy("chrom", "site").agg(F.sum("n_het").alias("n_het"), F.sum("n_hom").alias("n_hom")).crossJoin(F.broadcast(everyone))  # everyone: one row
    whole = whole.select("chrom", "site", F.lit("ALL").alias("population"), "n_het", "n_hom", (2 * F.col("everyone")).alias("an"))
    ac = F.col("n_het") + 2 * F.col("n_hom")
    return part.unionByName(whole).withColumns({"ac": ac, "af": F.round(ac / F.col("an"), 6)})


def dosage_matrix(clusters: DataFrame, samples: DataFrame) -> DataFrame:
    """The sample by site matrix of dosages in long form: sample, population, chrom, site, dosage; what has no row is 0.

    Sites are told apart by contig and position. Samples without metadata are left out.
    """
    one = clusters.groupBy("sample", "chrom", "site").agg(F.max("dosage").alias("dosage"))
    return one.join(samples.select("sample", "population").dropDuplicates(["sample"]), "sample").select("sample", "population", "chrom", "site", "dosage")


def dosage_columns(matrix: DataFrame, sites: list[tuple[str, int]]) -> DataFrame:
    """The matrix's part of some sites as one column each, named contig_position: a block for principal components."""
    named = matrix.withColumn("_name", F.concat_ws("_", F.col("chrom").cast("string"), F.col("site").cast("string")))
    return named.groupBy("sample", "population").pivot("_name", [f"{c}_{p}" for c, p in sites]).agg(F.max("dosage")).fillna(0)


def presence(matrix: DataFrame) -> DataFrame:
    """dosage_matrix() as 0 or 1: whether a sample has the site."""
    return matrix.withColumn("dosage", (F.col("dosage") > 0).cast("int"))


def within_fractions(sites: DataFrame, names: list[str], least: float, most: float) -> DataFrame:
    """Sites with every one of the named allele fractions in [least, most]."""
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(F.col(n).between(least, most), F.lit(False))
    return sites.filter(out)


def private_histogram(alleles: DataFrame, levels: int) -> DataFrame:
    """How many sites with one population's alleles only have at least each level of frequency: population, level, n.

    Sites are counted by level first, then added up from the top.
    """
    own = alleles.filter(F.col("population") != "ALL").filter("ac > 0")
    private = own.groupBy("chrom", "site").agg(F.count("*").alias("k"), F.min("population").alias("population"), F.max(F.col("ac") / F.col("an")).alias("af")).filter("k = 1")
    counts = private.groupBy("population", F.floor(F.col("af") * levels + 1e-9).cast("long").alias("level")).agg(F.count("*").alias("m"))
    w = Window.partitionBy("population").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("population", "level", F.sum("m").over(w).alias("n"))


def compare(calls: DataFrame, truth: DataFrame, slack: int) -> DataFrame:
    """One row: true and false positives, false negatives, F1, sensitivity, false discovery rate at that slack."""
    a, b = calls.select("chrom", "pos").distinct(), truth.select("chrom", "pos").distinct()
    tp = near(a, b, slack).agg(F.count("*").alias("tp"))
    fp = near(a, b, slack, "left_anti").agg(F.count("*").alias("fp"))
    fn = near(b, a, slack, "left_anti").agg(F.count("*").alias("fn"))
    out = tp.crossJoin(fp).crossJoin(fn)  # one row each
    t, p, n = (F.col(x) for x in ("tp", "fp", "fn"))
    return out.withColumns({"f1": F.round(2 * t / F.nullif(2 * t + p + n, F.lit(0)), 6), "sensitivity": F.round(t / F.nullif(t + n, F.lit(0)), 6), "fdr": F.round(p / F.nullif(t + p, F.lit(0)), 6)})


def joint_sites(calls: DataFrame, slack: int) -> DataFrame:
    """Clusters over samples: site, how many samples share it, and whether it is one sample's own."""
    rows = islands(calls, slack)
    return rows.groupBy("chrom", "island").agg(F.count_distinct("sample").alias("n_samples"), F.min("pos").alias("pos")).withColumn("singleton", F.col("n_samples") == 1)


def parse_info(info: Column) -> Column:
    """'K=v;K2=v2' as a map; flags have null values."""
    return F.str_to_map(info, F.lit(";"), F.lit("="))


def natural_order(chrom: Column) -> list[Column]:
    """Contigs in natural order: numbers by value, then names."""
    bare = F.regexp_replace(chrom, "^chr", "")
    return [F.coalesce(F.expr("try_cast(regexp_replace(chrom, '^chr', '') AS int)"), F.lit(10**6)), bare]


def site_modes(clusters: DataFrame, names: list[str]) -> DataFrame:
    """The most frequent value of each named column at every site (chrom, site), and its count; of ties that seen at the least position.

    All columns are counted in one grouping, by column and value; sites without any value have no row.
    """
    kinds = dict(clusters.dtypes)
    cells = F.array(*(F.struct(F.lit(c).alias("_name"), F.col(c).cast("string").alias("_value")) for c in names))
    counts = clusters.select("chrom", "site", "pos", F.inline(cells)).filter("_value is not null").groupBy("chrom", "site", "_name", "_value").agg(F.count("*").alias("n"), F.min("pos").alias("_first"))

    def of(c: str) -> Column:
        return F.max(F.when(F.col("_name") == c, F.struct("n", F.negate("_first").alias("f"), "_value")))

    best = counts.groupBy("chrom", "site").agg(*(of(c).alias(f"_{k}") for k, c in enumerate(names)))
    return best.select("chrom", "site", *(x for k, c in enumerate(names) for x in (F.col(f"_{k}._value").cast(kinds[c]).alias(c), F.col(f"_{k}.n").alias(f"{c}_n"))))


def merged_cohort(calls: DataFrame, samples: DataFrame, window: int, modes: list[str]) -> DataFrame:
    """Calls of all samples (sample, chrom, pos, dosage, and the columns of modes) -> one row a site of the cohort.

    Calls no more than `window` apart on a contig are one site, at the position that most samples have. an, ac, af over all
    samples with metadata, by_population the same of each population that has calls there, n_samples, and the modes.
    """
    clusters = written(site_clusters(calls, window), "cohort")
    alleles = allele_counts(clusters, samples)
    one = F.struct("population", "an", "ac", "af")
    by = alleles.groupBy("chrom", "site").agg(F.max(F.when(F.col("population") == "ALL", F.struct("an", "ac", "af"))).alias("_a"), F.sort_array(F.collect_list(F.when(F.col("population") != "ALL", one))).alias("by_population"))
    size = clusters.groupBy("chrom", "site").agg(F.count_distinct("sample").alias("n_samples"))
    out = size.join(by, ["chrom", "site"], "left").select("chrom", "site", "n_samples", "_a.an", "_a.ac", "_a.af", "by_population")
    return out.join(site_modes(clusters, modes), ["chrom", "site"], "left")


def source_by_population(clusters: DataFrame, samples: DataFrame) -> DataFrame:
    """The source that most of a population's samples have at a site; of ties the least. Samples without metadata are left out."""
    people = samples.select("sample", "population").dropDuplicates(["sample"])
    counts = clusters.filter("source is not null").join(people, "sample").groupBy("chrom", "site", "population", "source").agg(F.count("*").alias("n"))
    tie = F.negate("source") if dict(counts.dtypes)["source"] != "string" else F.lit(0)
    return counts.groupBy("chrom", "site", "population").agg(F.max_by("source", F.struct("n", tie)).alias("source"), F.max("n").alias("n"))
