"""Barcodes around sites by windows: against brute force, nulls, borders of tiles, and no join of sites with reads."""

import random

from siteloom.operators import reads
from siteloom.plans.queries import QUERIES


def test_barcodes_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([65_536, 131_072, 300]) + rng.randint(-30, 30), rng.choice([1, 2, 3, None])) for _ in range(150)] + [("c", 9, None), (None, 5, 1), ("a", None, 1)]
    at = [(rng.choice("ab"), rng.choice([65_536, 131_072, 300]) + rng.randint(-45, 45)) for _ in range(200)] + [("c", 10), ("c", 20), ("none", 300), ("a", None), (None, 5)]
    df, sites = spark.createDataFrame(rows, "chrom string, pos long, bx long"), spark.createDataFrame(at, "chrom string, pos long")
    counts, shares = [], []
    for c, p in set(at):
        left, right = ({b for d, q, b in rows if None not in (c, p, d, q) and d == c and lo <= q - p < hi} for lo, hi in ((-10, 0), (0, 10)))
        if left or right:
            shares.append((c, p, len(left & right), len(left ^ right)))
            if len((left | right) - {None}) <= 2:
                counts.append((c, p, len((left | right) - {None})))
    assert sorted(map(tuple, reads.barcode_counts(sites, df, 10, 2).collect())) == sorted(counts)
    assert sorted(map(tuple, reads.barcode_overlap(sites, df, 10).collect())) == sorted(shares)


def test_no_pairs(spark):
    for name in ("barcode_distinct", "barcode_overlap"):
        assert "Join" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
