"""Interval algebra against sets of positions, regions of genes and types in order, by hand."""

import random

import pytest
from pyspark.sql import functions as F

from siteloom.operators import genes, population, sweep

IV = "chrom string, start long, `end` long"


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(6)
    out = []
    for k in range(3):
        rows = [(rng.choice("ab"), s, s + rng.choice([0, 1, 5, 10, 10, 90])) for s in (rng.randrange(0, 400, 5) for _ in range(40))]
        out.append(rows + rows[:5] + [("a", 50, 60), ("a", 60, 70)] + ([("c", 1000 * k, 1000 * k + 10)] if k else []))
    return out, [spark.createDataFrame(r, IV) for r in out]


def covered(rows):
    return {(c, p) for c, a, b in rows for p in range(a, b)}


def parts(points):
    out = []
    for c, p in sorted(points):
        if out and out[-1][0] == c and out[-1][2] == p:
            out[-1][2] = p + 1
        else:
            out.append([c, p, p + 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("tile", [7, 1 << 16])
def test_cover_by_positions(inputs, tile):
    rows, dfs = inputs
    got = {(r.chrom, p): (r.n_0, r.n_1, r.n_2) for r in sweep.cover(dfs, tile).collect() for p in range(r.start, r.end)}
    points = covered(sum(rows, []))
    assert got == {x: tuple(sum(c == x[0] and a <= x[1] < b for c, a, b in r) for r in rows) for x in points}


def test_set_operations_on_cover(inputs):
    rows, dfs = inputs
    a, b, c = map(covered, rows)

    def of(df):
        return sorted((r.chrom, r.start, r.end) for r in df.collect())

    assert of(sweep.union(*dfs)) == parts(a | b | c)
    assert of(sweep.intersection(*dfs)) == parts(a & b & c)
    assert of(sweep.difference(*dfs)) == parts(a - b - c)
    assert of(sweep.symmetric_difference(*dfs[:2])) == parts(a ^ b)
    assert of(sweep.joined(sweep.cover(dfs, 7), 7)) == parts(a | b | c)
    assert sweep.union(dfs[0].limit(0)).count() == 0


def test_rows_and_ranges(inputs):
    (a, b, _), (x, y, _) = inputs
    a, b = set(a), set(b)

    def of(df):
        return sorted((r.chrom, r.start, r.end) for r in df.collect())

    assert of(sweep.common(x, y)) == sorted(a & b) and of(sweep.only(x, y)) == sorted(a - b) and of(sweep.either(x, y)) == sorted(a ^ b)
    hit = {i for i in a for j in b if i[0] == j[0] and i[1] < j[2] and j[1] < i[2] and i[1] < i[2] and j[1] < j[2]}
    assert of(sweep.without(x, y)) == sorted(a - hit)
    inside = {(i, j) for i in a for j in a if i != j and i[0] == j[0] and i[1] <= j[1] and j[2] <= i[2] and j[1] < j[2]}
    assert sorted(((r.chrom, r.start, r.end), (r.chrom, r.start_b, r.end_b)) for r in sweep.nested(x).collect()) == sorted(inside)


def test_slices_and_extent(spark):
    df = spark.createDataFrame([("a", 0, 10, "x"), ("a", 0, 10, "x"), ("a", 5, 8, "y"), ("b", 0, 3, "z")], IV + ", data string")
    cuts = spark.createDataFrame([("a", 0), ("a", 5), ("a", 5), ("a", 7), ("a", 10), ("c", 1)], "chrom string, pos long")
    got = sorted((r.chrom, r.start, r.end, r.data) for r in sweep.sliced(df, cuts).collect())
    assert got == sorted(2 * [("a", 0, 5, "x"), ("a", 5, 7, "x"), ("a", 7, 10, "x")] + [("a", 5, 7, "y"), ("a", 7, 8, "y"), ("b", 0, 3, "z")])
    assert sorted(map(tuple, sweep.extent(df).collect())) == [("a", 0, 10, 10), ("b", 0, 3, 3)]
    merged = sweep.merged_with(df, F.max, "data")
    assert sorted(map(tuple, merged.collect())) == [("a", 0, 10, "y"), ("b", 0, 3, "z")]


def test_relations(spark):
    pairs = [(0, 5, 0, 5), (0, 9, 2, 5), (2, 5, 0, 9), (0, 5, 3, 8), (0, 5, 5, 8), (0, 5, 6, 8)]
    df = spark.createDataFrame(pairs, "a long, b long, c long, d long")
    assert [r[0] for r in df.select(sweep.relation(*(F.col(c) for c in "abcd"))).collect()] == ["equal", "contains", "within", "overlaps", "touches", "apart"]


def test_regions_of_genes(spark):
    g = spark.createDataFrame([("1", 1000, 2000, "G1", "coding", "one"), ("1", 1900, 3000, "G2", "coding", "two"), ("2", 1000, 2000, "G3", "rna", "three")], "chrom string, start long, `end` long, gene_id string, gene_type string, gene_name string")
    r = spark.createDataFrame([("1", 1100, 1200, "G1", "exon1", 0), ("1", 1150, 1160, "G1", "utr", 1), ("1", 1100, 1300, "G1", "exon2", 2), ("1", 1950, 1960, "G2", "first", 3)], "chrom string, start long, `end` long, gene_id string, region_id string, place int")
    sites = spark.createDataFrame([("1", p, "k") for p in (1100, 1155, 1300, 1301, 1955, 900, 2100, 499, 500, 3499, 3500, 1000, 2000)] + [("2", 1500, "k"), ("3", 5, "k")], "chrom string, pos long, kept string")
    got = {(x.chrom, x.pos): x.gene for x in genes.annotated(sites, g, r, 500).collect()}
    assert got["1", 1100] == got["1", 1155] == got["1", 1300] == "exon2:one"  # the last region in the file's order
    assert got["1", 1301] == "intron:G1:one"
    assert got["1", 1955] == "intron:G1:one/first:two"  # two genes
    assert got["1", 900] == "up_stream:G1:one" and got["1", 1000] == "up_stream:G1:one"
    assert got["1", 2100] == "down_stream:G1:one/intron:G2:two" and got["1", 2000] == "down_stream:G1:one/intron:G2:two"
    assert got["1", 500] == "up_stream:G1:one" and got["1", 499] == "not_gene_region"
    assert got["1", 3499] == "down_stream:G2:two" and got["1", 3500] == "not_gene_region"
    assert got["2", 1500] == "intron:G3:three" and got["3", 5] == "not_gene_region"


def test_types_in_order(spark):
    strong, weak = "two_side_tprt_both", "one_side"
    calls = [
        ("1", 100, 0, weak), ("1", 110, 1, strong), ("1", 105, 2, weak),  # the second beats the first; the third meets the second
        ("1", 300, 0, strong), ("1", 310, 1, strong), ("1", 305, 2, strong),  # the first stands alone
        ("1", 500, 1, weak), ("1", 505, 2, strong),  # the third beats the second
        ("1", 700, 1, weak), ("1", 705, 2, weak), ("1", 720, 2, weak),  # in reach: [pos - 20, pos + 20)
        ("2", 100, 2, weak), ("2", 101, 2, weak),  # one type's calls don't meet
    ]
    got = sorted((r.chrom, r.pos, r.priority) for r in population.resolve_types(spark.createDataFrame(calls, "chrom string, pos long, priority int, sub_type string"), 20).collect())
    assert got == [("1", 110, 1), ("1", 300, 0), ("1", 505, 2), ("1", 700, 1), ("2", 100, 2), ("2", 101, 2)]
