"""Genes and regions of genes at sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import SPREAD, _cell, _level, _levels_of, points_in

NONE, UP, DOWN = "not_gene_region", "up_stream", "down_stream"


def regions_at(sites: DataFrame, genes: DataFrame, regions: DataFrame, extend: int = 1500) -> DataFrame:
    """A row for each gene at a site (chrom, pos), extended to both sides: gene_id, gene_type and region.

    genes: chrom, start, end, gene_id, gene_type, gene_name, with closed bounds; regions: chrom, start, end, gene_id, region_id,
    place (their order in the file). Of a gene's regions that hold the site the last one counts, as region_id:gene_name;
    what lies beyond the gene is its upstream and downstream part, which come before all regions; else it is
    intron:gene_id:gene_name. The extended end isn't part of a gene. Genes that begin at one place all keep it.
    """
    wide = genes.select("chrom", "gene_id", "gene_type", "gene_name", F.col("start").alias("_gs"), F.col("end").alias("_ge"), (F.col("start") - extend).alias("start"), (F.col("end") + extend).alias("end"))
    at = sites.select("chrom", "pos").distinct()
    hits = points_in(at, wide, bin_=2048)
    inner = regions.select("chrom", F.col("gene_id").alias("_gene"), "region_id", "place", "start", (F.col("end") + 1).alias("end"))
    within = points_in(at, inner, bin_=256).groupBy(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), "_gene").agg(F.max_by("region_id", F.struct("place", "region_id")).alias("_region"))
    out = hits.join(within, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")) & (F.col("gene_id") == F.col("_gene")), "left")
    beyond = F.when(F.col("pos") >= F.col("_ge"), F.concat_ws(":", F.lit(DOWN), "gene_id")).when(F.col("pos") <= F.col("_gs"), F.concat_ws(":", F.lit(UP), "gene_id"))
    named = F.coalesce("_region", beyond)
    region = F.when(named.isNotNull(), F.concat_ws(":", named, "gene_name")).otherwise(F.concat_ws(":", F.lit("intron"), "gene_id", "gene_name"))
    return out.select("chrom", "pos", "gene_id", "gene_type", "_gs", region.alias("region")).withColumnRenamed("_gs", "gene_start")


def annotated(sites: DataFrame, genes: DataFrame, regions: DataFrame, extend: int = 1500) -> DataFrame:
    """sites (chrom, pos, ...) with `gene`: the regions of all genes there, by the genes' starts and ids, joined with "/", or NONE."""
    found = regions_at(sites, genes, regions, extend)
    listed = F.sort_array(F.collect_list(F.struct("gene_start", "gene_id", "region")))
    by = found.groupBy(F.col("chrom").alias("_c"), F.col("pos").alias("_p")).agg(F.array_join(F.transform(listed, lambda x: x["region"]), "/").alias("_gene"))
    return sites.join(by, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")), "left").select(*sites.columns, F.coalesce("_gene", F.lit(NONE)).alias("gene"))


def listed_at(sites: DataFrame, genes: DataFrame, extend: int = 1500, bin_: int = 512) -> DataFrame:
    """sites (chrom, pos, ...) with `gene`, the names of the genes (chrom, start, end, name) there, extended to both sides, by start and name and joined with "/", or NONE, and `last_gene`.

    A bin's genes are one sorted array, from which each of its sites takes those that hold it: sites are dealt once for each
    level of lengths, and no pair is grouped again. Genes longer than a bin hold one of its ends, so that an array has no
    more than the results of two sites.
    """
    wide = genes.filter("name is not null").select("chrom", F.col("start").alias("_gs"), "name", (F.col("start") - extend).alias("start"), (F.col("end") + extend).alias("end"))
    n = F.col("end") - F.col("start")
    out, held = sites, []
    for k in _levels_of(wide, bin_, "start", "end"):
        w = bin_ * SPREAD**k
        cut = wide.filter((n > 0) & (_level(n, bin_) == k)).withColumn("_bin", F.explode(F.sequence(_cell(F.col("start"), w), _cell(F.col("end") - 1, w))))
        lists = cut.groupBy(F.col("chrom").alias("_c"), "_bin").agg(F.sort_array(F.collect_list(F.struct("_gs", "name", "start", "end"))).alias(f"_of{k}"))
        out = out.join(lists, (F.col("chrom") == F.col("_c")) & (_cell(F.col("pos"), w) == F.col("_bin")), "left").drop("_c", "_bin")
        every = F.coalesce(f"_of{k}", F.array().cast(lists.schema[f"_of{k}"].dataType))
        held.append(F.filter(every, lambda x: (x["start"] <= F.col("pos")) & (F.col("pos") < x["end"])))
    if not held:
        return sites.select("*", F.lit(NONE).alias("gene"), F.lit(None).cast("string").alias("last_gene"))
    every = held[0] if len(held) == 1 else F.sort_array(F.concat(*held))
    out = out.withColumn("_names", F.transform(every, lambda x: x["name"]))
    some = F.size("_names") > 0
    return out.select(*sites.columns, F.when(some, F.array_join("_names", "/")).otherwise(NONE).alias("gene"), F.when(some, F.element_at("_names", -1)).alias("last_gene"))
