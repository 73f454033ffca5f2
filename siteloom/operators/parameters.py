"""Cutoffs by coverage, and random sites for sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_cutoffs(df: DataFrame, coverage: str, table: dict[int, tuple[int, int, int]]) -> DataFrame:
    """df with the cutoffs of the nearest coverage within 9, of two the lower; beyond that 5 below 10, 200 above 200, else 100."""
    c = F.col(coverage)
    keys = F.array(*(F.lit(k) for k in sorted(table)))
    near = F.array_min(F.transform(F.filter(keys, lambda k: F.abs(k - c) <= 9), lambda k: F.struct(F.abs(k - c).alias("d"), k.alias("k"))))["k"]
    key = F.when(near.isNotNull(), near).when(c < 10, 5).when(c > 200, 200).otherwise(100)
    values = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.struct(*(F.lit(n).alias(name) for n, name in zip(v, ("clip", "disc", "mate")))))))
    return df.withColumn("_v", F.element_at(values, key)).select(*df.columns, "_v.clip", "_v.disc", "_v.mate")


def automatic(df: DataFrame, coverage: str, table: dict[int, tuple[int, int, int]], purity: float | None = None) -> DataFrame:
    """df with the cutoffs for its coverage; of a tumor's, only the share of its purity counts."""
    if purity is None:
        return nearest_cutoffs(df, coverage, table)
    return nearest_cutoffs(df.withColumn("_c", F.col(coverage) * purity), "_c", table).drop("_c")


def adjusted(cutoff: int, by: int = 1) -> int:
    """A tumor's cutoff is lower, but never below 2."""
    return cutoff - by if cutoff - by > 1 else cutoff


def initial_cutoff(platform: str, mosaic: bool = False) -> int:
    """Clips that a position needs before anything else is known."""
    return 3 if platform == "10X" else 1 if mosaic else 2


def barcode_cutoff(coverage: float) -> int:
    return 500 if abs(coverage - 30) > abs(coverage - 60) else 400


def random_sites(contigs: DataFrame, n: int, margin: int, seed: int) -> DataFrame:
    """n sites on contigs (chrom, length), uniform over what lies a margin inside of them; equal seeds give equal sites."""
    long = contigs.filter(F.col("length") > 2 * margin)
    listed = long.agg(F.sort_array(F.collect_list(F.struct("chrom", "length"))).alias("c"))  # one entry for each contig
    ids = contigs.sparkSession.range(n).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)).alias("r"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 40)).alias("q"))
    rows = ids.crossJoin(F.broadcast(listed)).filter(F.size("c") > 0).withColumn("x", F.get(F.col("c"), F.pmod("r", F.size("c")).cast("int")))
    return rows.select("id", F.col("x.chrom").alias("chrom"), (margin + F.pmod("q", F.col("x.length") - 2 * margin)).alias("pos"))
