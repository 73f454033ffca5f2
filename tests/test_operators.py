"""Small fixtures of the edges that define the operators, and properties against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from siteloom.config import GERMLINE_CUTOFFS, Config
from siteloom.functions import cigar as C
from siteloom.functions import seq as S
from siteloom.operators import cluster, intervals, reads, rules
from siteloom.operators.parameters import nearest_cutoffs, random_sites

READ = "chrom string, pos long, mapq int, is_duplicate boolean, is_unmapped boolean, is_supplementary boolean, cig string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,at,full,left,right", [("20S80M", 1000, False, True, False), ("80M20S", 1080, False, False, True), ("50M5I40M10S", 1090, False, False, True), ("100M", 1000, True, False, False), ("10H90M", 1000, False, True, False)])
def test_cigars(spark, text, at, full, left, right):
    g = C.parse_cigar(F.lit(text))
    got = spark.range(1).select(C.right_breakpoint(F.lit(1000), g), C.fully_mapped(g), C.left_clipped(g), C.right_clipped(g)).first()
    assert tuple(got) == (at, full, left, right)


def test_clip_events(spark):
    rows = [("1", 100, 12, False, False, False, "20S80M"), ("1", 100, 11, False, False, False, "20S80M"), ("1", 100, 60, True, False, False, "20S80M"), ("1", 20, 60, False, False, True, "9S80M9S"), ("1", 20, 60, False, False, False, "9S80M9S"), ("1", 5, 60, False, False, False, "100M")]
    df = spark.createDataFrame(rows, READ).withColumn("cigar", C.parse_cigar(F.col("cig")))
    got = sorted((r.pos, r.breakpoint, r.side) for r in reads.clip_events(df).collect())
    assert got == [(20, 20, "L"), (20, 20, "L"), (20, 100, "R"), (100, 100, "L")]  # the supplementary one is left only


def test_two_sides_and_ratios(spark):
    assert one(spark, C.both_sides_clipped(C.parse_cigar(F.lit("9S80M9S")))) and not one(spark, C.both_sides_clipped(C.parse_cigar(F.lit("8S80M9S"))))
    assert one(spark, C.qualified(C.parse_cigar(F.lit("65M35S")), 0.65)) and not one(spark, C.qualified(C.parse_cigar(F.lit("64M36S")), 0.65))


def test_clip_length(spark):
    got = [one(spark, C.clip_length_ok(F.lit(x))) for x in ("A" * 6, "A" * 7, "T" * 9, "AAAAAAT", "ACGTACGTAC")]
    assert got == [False, True, True, False, True]


def test_sequences(spark):
    assert one(spark, S.reverse_complement(F.lit("acgtnX"))) == "NNACGT"
    assert one(spark, S.motif_offsets(F.lit("AAAAATTTAAAAA"), "AAAAA")) == [0, 8]
    assert one(spark, S.is_decoy(F.lit("chr1_random"))) and one(spark, S.is_decoy(F.lit("chrM"))) and not one(spark, S.is_decoy(F.lit("chrX")))
    assert one(spark, S.with_prefix(F.lit("7"))) == "chr7" and one(spark, S.without_prefix(F.lit("chr7"))) == "7"
    assert S.rotations("AAT") == ["AAT", "ATA", "TAA"]
    assert one(spark, S.tsd_sequence(F.lit(5), F.lit(3), F.lit("ACG"))) == "-ACG" and one(spark, S.tsd_sequence(F.lit(0), F.lit(3), F.lit("ACG"))) is None


def test_neighbourhood_edges(spark):
    rows = [("1", p, 1) for p in (49, 50, 100, 149, 150)]
    got = {r.pos: r.s for r in cluster.nearby_sums(spark.createDataFrame(rows, "chrom string, pos long, n long"), {"s": F.col("n")}, tile=64).collect()}
    assert got[100] == 3  # 50, 100, 149; neither 49 nor 150


@pytest.mark.parametrize("inclusive", [False, True])
def test_islands_against_brute_force(spark, inclusive):
    rng = random.Random(4)
    rows = [(c, rng.randrange(3000)) for c in ("1", "2") for _ in range(150)] + [("1", 0), ("1", 64), ("1", 128)]
    got = cluster.islands(spark.createDataFrame(rows, "chrom string, pos long"), 20, inclusive, tile=64).collect()
    assert len(got) == len(rows)
    want = {}
    for c in ("1", "2"):
        start, last = None, None
        for p in sorted(p for x, p in rows if x == c):
            if last is None or (p - last >= 20 if inclusive else p - last > 20):
                start = p
            last = p
            want[c, p] = start
    assert {(r.chrom, r.pos): r.island for r in got} == want


def test_points_in_and_overlaps_against_brute_force(spark):
    rng = random.Random(1)
    iv = [("1", s, s + rng.choice([0, 1, 5, 40, 700, 9000])) for s in (rng.randrange(5000) for _ in range(80))]
    pts = [("1", rng.randrange(5000)) for _ in range(200)] + [("1", iv[0][1]), ("1", iv[0][2])]
    a = spark.createDataFrame(iv, "chrom string, start long, end long")
    p = spark.createDataFrame(pts, "chrom string, pos long")
    got = sorted((r.pos, r.start, r.end) for r in intervals.points_in(p, a, bin_=8).collect())
    assert got == sorted((x, s, e) for _, x in pts for _, s, e in iv if s <= x < e)
    inside = {x for _, x in pts if any(s <= x < e for _, s, e in iv)}
    assert sorted(r.pos for r in intervals.points_in(p, a, bin_=8, how="left_semi").collect()) == sorted(x for _, x in pts if x in inside)
    assert sorted(r.pos for r in intervals.points_in(p, a, bin_=8, how="left_anti").collect()) == sorted(x for _, x in pts if x not in inside)
    other = sorted(set(iv))[:20]
    twice = iv + iv[:30]  # repeated rows make repeated pairs
    b = spark.createDataFrame(other, "chrom string, start long, end long")
    got = sorted((r.start, r.end, r.start_b, r.end_b) for r in intervals.overlaps(spark.createDataFrame(twice, a.schema), b, 8).collect())
    assert got == sorted((s, e, s2, e2) for _, s, e in twice for _, s2, e2 in other if s < e2 and s2 < e and e > s and e2 > s2)


@pytest.mark.parametrize("touching", [True, False])
def test_merge_in_tiles(spark, touching):
    """Unions reach over tiles, with whole tiles inside of an interval too."""
    rng = random.Random(7)
    iv = [(c, s, s + rng.choice([0, 1, 3, 9, 120])) for c in ("1", "2") for s in (rng.randrange(0, 1500, 3) for _ in range(90))]
    want = []
    for c in ("1", "2"):
        for _, s, e in sorted(x for x in iv if x[0] == c and x[2] > x[1]):
            if want and want[-1][0] == c and (s <= want[-1][2] if touching else s < want[-1][2]):
                want[-1] = (c, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
            else:
                want.append((c, s, e, 1))
    got = intervals.merge(spark.createDataFrame(iv, "chrom string, start long, end long"), touching, tile=16).collect()
    assert sorted(map(tuple, got)) == want


def test_neighbours_in_tiles(spark):
    rng = random.Random(9)
    rows = [(c, p) for c in ("1", "2") for p in rng.sample(range(1000), 60)]
    got = {(r.chrom, r.pos): (r._before, r._after) for r in intervals.neighbours(spark.createDataFrame(rows, "chrom string, pos long"), F.col("pos"), ["pos"], tile=16).collect()}
    for c in ("1", "2"):
        at = sorted(p for x, p in rows if x == c)
        assert all(got[c, p] == (at[k - 1] if k else None, at[k + 1] if k + 1 < len(at) else None) for k, p in enumerate(at))


def test_upper_median_of_mates(spark):
    rows = [("s", "1", p) for p in (5, 7, 7, 9, 500)]
    r = cluster.mate_clusters(spark.createDataFrame(rows, "site string, chrom string, pos long"), 10).first()
    assert (r.mate_pos, r.n, r.total) == (7, 4, 5)


def test_merge_is_idempotent(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("1", s, s + rng.randrange(1, 30)) for s in (rng.randrange(900) for _ in range(60))], "chrom string, start long, end long")
    once = intervals.merge(df)
    again = intervals.merge(once.drop("n"))
    assert sorted((r.start, r.end) for r in once.collect()) == sorted((r.start, r.end) for r in again.collect())


def test_near_is_half_open(spark):
    a = spark.createDataFrame([("1", 100)], "chrom string, pos long")
    for at, hit in ((90, True), (89, False), (109, True), (110, False)):
        b = spark.createDataFrame([("1", at)], "chrom string, pos long")
        assert bool(intervals.near(a, b, 10).count()) is hit


def test_max_cover_counts_one_less(spark):
    df = spark.createDataFrame([("s", p) for p in (1, 2, 2, 50)], "site string, pos long")
    r = cluster.max_cover(df, 10, 0.5, ["site"]).first()
    assert (r.n, r.total, r.is_cluster) == (2, 4, True)


def test_cutoffs(spark):
    df = spark.createDataFrame([(3,), (29,), (47,), (160,), (188,), (900,)], "coverage int")
    got = {r.coverage: (r.clip, r.disc, r.mate) for r in nearest_cutoffs(df, "coverage", GERMLINE_CUTOFFS).collect()}
    assert got[29] == GERMLINE_CUTOFFS[30] and got[47] == GERMLINE_CUTOFFS[45] and got[900] == GERMLINE_CUTOFFS[200] and got[3] == GERMLINE_CUTOFFS[5]


def test_random_sites_agree(spark):
    c = spark.createDataFrame([("1", 5000), ("2", 100)], "chrom string, length long")
    a, b = (sorted(map(tuple, random_sites(c, 50, 100, 9).collect())) for _ in range(2))
    assert a == b and {x[1] for x in a} == {"1"} and all(100 <= x[2] < 4900 for x in a)


def test_raw_disc_cutoff():
    assert reads.raw_disc_cutoff(5, False) == 4 and reads.raw_disc_cutoff(5, True) == 2 and reads.raw_disc_cutoff(1, True) == 1
    assert Config().max_clip_coverage(30) == 450


def test_sessions_hold_every_event(spark):
    from siteloom.streaming.sessions import sessions_of

    path = "/root/testdata/sf0.001/events.parquet"
    assert sessions_of(spark, path).agg(F.sum("n")).first()[0] == spark.read.parquet(path).count()


def test_clusters_of_mates_sort_once(spark):
    from siteloom.operators.transduction import unique_cluster

    mates = spark.createDataFrame([("a", 1, c, p) for c, p in [("x", 5), ("x", 5), ("x", 9), ("y", 7), ("y", 8), ("y", 9000)]] + [("b", 1, None, 4)], "c string, site long, chrom string, pos long")
    found = unique_cluster(mates, ["c", "site"], 1, 0.4, 0.45)
    assert sorted((r.c, r.mate_chrom, r.mate_pos, r.n, r.total, r.is_cluster) for r in found.collect()) == [("a", "x", 5, 3, 6, True), ("b", None, 4, 1, 1, False)]
    plan = unique_cluster(mates, ["c", "site"], 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
