"""Genes listed at sites, a row a site: no pairs are dealt out."""

import random

from siteloom.operators import genes
from siteloom.plans.queries import QUERIES


def test_genes_of_any_length(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), s, s + n, f"g{k % 90}") for k in range(200) for s, n in [(rng.randint(0, 60_000), rng.choice([0, 1, 60, 900, 5000, 40_000]))]] + [("a", 10, 50, None), ("b", 500, 700, "g1"), ("b", 500, 700, "g1")]
    at = [(rng.choice(["a", "b", "none"]), rng.randint(-3000, 110_000)) for _ in range(300)] + [("a", None), (None, 5)]
    found = genes.listed_at(spark.createDataFrame(at, "chrom string, pos long"), spark.createDataFrame(rows, "chrom string, start long, `end` long, name string"), 20)
    want = []
    for c, p in at:
        here = sorted((s, n) for d, s, e, n in rows if n and None not in (c, p) and d == c and s - 20 <= p < e + 20)
        want.append((c, p, "/".join(n for _, n in here) or "not_gene_region", here[-1][1] if here else None))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    none = genes.listed_at(found.select("chrom", "pos"), spark.createDataFrame([], "chrom string, start long, `end` long, name string"))
    assert {(r.gene, r.last_gene) for r in none.collect()} == {("not_gene_region", None)}


def test_sites_with_genes_are_not_dealt_again(spark):
    plan = QUERIES["gene_annot"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Join")[0]
