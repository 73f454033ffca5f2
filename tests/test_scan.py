"""The scan around sites, parameters, genotypes and small predicates, on rows made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from siteloom import schema
from siteloom.config import GERMLINE_CUTOFFS
from siteloom.functions import cigar as C
from siteloom.functions import seq as S
from siteloom.operators import consistency, genotype, parameters, population, rules, scan, transduction
from siteloom.operators.intervals import met
from siteloom.plans.queries import QUERIES

OPS = {"M": 0, "I": 1, "D": 2, "S": 4, "H": 5}


def read(name, pos, cigar, seq=None, mapq=60, mate=("1", 1000), qual=40, **more):
    import re

    g = [(OPS[o], int(n)) for n, o in re.findall(r"(\d+)([A-Z])", cigar)]
    n = sum(k for o, k in g if o in (0, 1, 4))
    row = dict(sample="s", qname=name, is_read1=True, chrom="1", pos=pos, mapq=mapq, is_duplicate=False, is_unmapped=False, mate_is_unmapped=False, is_secondary=False, is_supplementary=False, is_reverse=False, mate_is_reverse=True,
               cigar=g, mate_chrom=mate[0], mate_pos=mate[1], tlen=0, seq=seq or "ACGT" * (n // 4) + "ACGT"[: n % 4], qual=[qual] * n, tags={})
    return tuple({**row, **more}[f.name] for f in schema.READ)


@pytest.fixture(scope="module")
def near(spark):
    rows = [
        read("left", 1000, "20S80M"), read("right", 930, "80M20S"), read("both", 1000, "9S80M9S"), read("small_both", 1000, "12S80M8S"), read("dup", 1000, "20S80M", is_duplicate=True), read("extra", 1000, "20S80M", is_supplementary=True, mate=("2", 5)),
        read("poor_left", 1020, "20S80M", mapq=4), read("poor_right", 930, "80M20S", mapq=4), read("poor_far", 1040, "20S80M", mapq=4), read("poor", 1000, "20S80M", mapq=6),
        read("short", 1000, "8S80M", mate=("2", 5)), read("polya", 1000, "8S80M", seq="AAAAAAAC" + "ACGT" * 20, mate=("2", 5)), read("right_polya", 930, "80M9S", seq="ACGT" * 20 + "TTTTTTTTC"), read("right_short", 930, "80M8S", seq="ACGT" * 20 + "T" * 8),
        read("low", 1000, "20S80M", qual=10), read("far", 5000, "20S80M"), read("mate", 980, "100M", mate=("1", 3100)), read("mate_near", 980, "100M", mate=("1", 2900)), read("decoy", 980, "100M", mate=("hs37d5", 3)), read("mate_low", 980, "100M", mapq=19, mate=("2", 5)),
        read("lost", 980, "100M", mate=(None, None), mate_is_unmapped=True), read("ends_before", 700, "100M", mate=("2", 5)), read("reaches", 750, "60M5I40M20D60M", mate=("2", 9)),
    ]
    return scan.around(spark.createDataFrame(rows, schema.READ), spark.createDataFrame([("1", 1000), ("1", 1000)], "chrom string, pos long"), 100)


def test_clipped_parts(near):
    got = sorted((r.qname, r.side, r.breakpoint, len(r.seq), len(r.qual)) for r in scan.clipped_parts(near).collect())
    assert got == [("left", "L", 1000, 20, 20), ("polya", "L", 1000, 8, 8), ("right", "R", 1010, 20, 20), ("right_polya", "R", 1010, 9, 9), ("small_both", "L", 1000, 12, 12)]


def test_all_clipped_parts(spark):
    rows = [read("a", 1000, "20S80M12S"), read("b", 1000, "20S80M12S", is_supplementary=True), read("c", 1000, "9S80M"), read("d", 1000, "9S80M", seq="T" * 9 + "ACGT" * 20), read("e", 1000, "100M"), read("f", 1000, "20S80M", mapq=11), read("g", 1000, "20H80M"), read("h", 1000, "20S80M", qual=14)]
    got = sorted((r.qname, r.side, r.breakpoint, len(r.seq), len(r.qual)) for r in scan.all_clipped_parts(spark.createDataFrame(rows, schema.READ)).collect())
    assert got == [("a", "L", 1000, 20, 20), ("a", "R", 1080, 12, 12), ("b", "L", 1000, 20, 20), ("d", "L", 1000, 9, 9)]


def test_discordant_pairs(near):
    got = {r.qname: (r.anchor, r.anchor_lclip, r.anchor_rclip, r.mate_chrom, r.mate_is_read1) for r in scan.discordant_pairs(near).collect()}
    assert got == {"mate": (980, False, False, "1", False), "polya": (1000, True, False, "2", False), "reaches": (750, False, False, "2", False)}


def test_poor_clips(near):
    assert [(r.site, r.n_low) for r in scan.poor_clips(near).collect()] == [(1000, 2)]


def test_window_statistics(spark):
    rng = random.Random(3)
    rows = [(f"q{i}", rng.randrange(0, 900), rng.choice([50, 60]), rng.choice([("1", rng.randrange(0, 4000)), ("2", 7)])) for i in range(300)]
    df = spark.createDataFrame([read(n, p, f"{k}M", mate=m) for n, p, k, m in rows], schema.READ)
    got = {r.site: r for r in scan.window_statistics(df, spark.createDataFrame([("1", 300), ("1", 500)], "chrom string, pos long"), 100).collect()}
    for site in (300, 500):
        near = [x for x in rows if x[1] < site + 100 and x[1] + x[2] > site - 100]
        left, right = (sum(max(0, min(p + k, b) - max(p, a)) for _, p, k, _ in near) / 100 for a, b in ((site - 100, site), (site, site + 100)))
        lengths = [k for _, _, k, _ in near]
        length = min((50, 60), key=lambda k: (-lengths.count(k), k))
        x = [abs(p - m[1]) + length for _, p, _, m in near if m[0] == "1" and abs(p - m[1]) <= 2000]
        r = got[site]
        assert (r.lcov, r.rcov, r.read_length, r.n_pairs, r.sum_x, r.sum_xx) == (pytest.approx(left), pytest.approx(right), length, len(x), sum(x), sum(v * v for v in x))
    one = scan.library(spark.createDataFrame([tuple(r) for r in got.values()], list(next(iter(got.values())).asDict()))).first()
    depths = sorted((r.lcov + r.rcov) / 2 for r in got.values())
    assert one.coverage == pytest.approx(depths[1]) and one.mean_is == pytest.approx(sum(r.sum_x for r in got.values()) / sum(r.n_pairs for r in got.values()))


def test_without_unrelated(spark):
    df = spark.createDataFrame([("1", 100, 60), ("1", 500, 60), ("1", 500, 59)], "chrom string, pos long, mapq int")
    assert sorted((r.pos, r.mapq) for r in scan.without_unrelated(df, spark.createDataFrame([("1", 110)], "chrom string, pos long"), 10).collect()) == [(100, 60), (500, 59)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_predicates(spark):
    g = C.parse_cigar(F.lit("20S60M20S"))
    assert one(spark, C.contig_ratio(g, F.lit(120))) == 0.5 and one(spark, C.large_clip(g, 19)) and not one(spark, C.large_clip(g, 20)) and not one(spark, C.large_clip(C.parse_cigar(F.lit("80S20M")), 5))
    assert one(spark, C.clipped_part(F.lit("AACCGGTT"), C.parse_cigar(F.lit("2S6M")), True)) == "AA" and one(spark, C.clipped_part(F.lit("AACCGGTT"), C.parse_cigar(F.lit("2S6M")), False)) is None
    assert one(spark, S.is_polya_repeat(F.lit("(ATAA)n"))) and not one(spark, S.is_polya_repeat(F.lit("(ATAA)n"), t=True)) and one(spark, S.is_polya_repeat(F.lit("(TTG)n"), t=True)) and not one(spark, S.is_polya_repeat(F.lit("(CA)n")))
    assert one(spark, S.signal_offsets(F.lit("AATAAAAAAAATTAAA"), False)) == [0, 3, 10] and one(spark, S.signal_offsets(F.lit("TTTAATTTTATT"), True)) == [6, 0]
    assert one(spark, S.consecutive_long(F.lit("CAAATAAC"))) and not one(spark, S.consecutive_long(F.lit("CAATAAC"))) and one(spark, S.consecutive_on_side(F.lit("AATAA"), F.lit(True))) and not one(spark, S.consecutive_on_side(F.lit("AATAA"), F.lit(False)))
    assert one(spark, S.polya_at(F.lit("AAAAA" + "C" * 20), F.lit(False))) and not one(spark, S.polya_at(F.lit("AAAAA" + "C" * 20), F.lit(True)))
    assert one(spark, S.is_short_contig(F.lit("chr22"))) and not one(spark, S.is_short_contig(F.lit("chrUn1")))
    assert one(spark, S.motif_offsets(F.lit("AA" * 3000), "AA"))[-1] == 5998
    n = F.lit
    assert one(spark, consistency.orientation_consistent(n(1), n(3), n(3), n(1), 0.75)) and one(spark, consistency.orientation_consistent(n(0), n(0), n(3), n(1), 0.75)) and not one(spark, consistency.orientation_consistent(n(2), n(3), n(3), n(1), 0.75))


def test_parameters(spark):
    df = spark.createDataFrame([(60.0,)], "coverage double")
    a, b = (parameters.automatic(df, "coverage", GERMLINE_CUTOFFS, p).first() for p in (None, 0.5))
    assert (a.clip, a.disc, a.mate) == GERMLINE_CUTOFFS[60] and (b.clip, b.disc, b.mate) == GERMLINE_CUTOFFS[30]
    assert [parameters.adjusted(x) for x in (1, 2, 3)] == [1, 2, 2] and [parameters.initial_cutoff("10X"), parameters.initial_cutoff("illumina"), parameters.initial_cutoff("illumina", True)] == [3, 2, 1]


def test_transduction_rules(spark):
    names = "in_low_copy boolean, lcov_200 double, rcov_200 double, lcov_900 double, rcov_900 double, n_la int, n_ra int, n_lt int, n_rt int"
    rows = [(False, 9.0, 9.0, 9.0, 9.0, 3, 2, 3, 2), (True, 9.0, 9.0, 9.0, 9.0, 0, 0, 0, 0), (False, 9.0, 9.0, 11.0, 9.0, 0, 0, 0, 0), (False, 9.0, 9.0, 9.0, 9.0, 3, 3, 0, 0), (False, 9.0, 9.0, 9.0, 9.0, 3, 0, 3, 3)]
    got = rules.post_filter(spark.createDataFrame(rows, names).coalesce(1), transduction.site_rules(10, 2)).select("reason").collect()
    assert [r.reason for r in got] == [None, "copy", "island", "two_side_polya", "two_side_polyt"]
    sites = spark.createDataFrame([("1", 100, 8), ("1", 300, 8), ("1", 500, 5), ("1", 700, 8)], "chrom string, pos long, n_disc int")
    existing, copies = spark.createDataFrame([("1", 350)], "chrom string, pos long"), spark.createDataFrame([("1", 650, 750, 4.0), ("1", 50, 150, 5.0)], "chrom string, start long, end long, div double")
    assert [r.pos for r in transduction.reselect(sites, existing, copies, 8).collect()] == [100] and sorted(r.pos for r in transduction.reselect(sites, existing, copies, 8, tumor=True).collect()) == [100, 500]


def test_genotypes_of_known_records(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        gt = rng.choice(["0/1", "1/1", "FP", None])
        clips = {"0/1": 10, "1/1": 20, "FP": 0, None: 10}[gt] + rng.randint(0, 2)
        rows.append(("1", i, gt, clips, 20 - min(20, clips), clips, 20, 4, 4, 0, 0, 5, 5, 5, 5, 0, 30.0, 30.0))
    df = spark.createDataFrame(rows, "chrom string, pos long, genotype string, n_af_clip int, n_full_map int, n_disc int, n_conc int, n_l_raw int, n_r_raw int, n_lpolya int, n_rpolya int, n_lclip int, n_rclip int, n_ldisc int, n_rdisc int, n_indel int, lcov double, rcov double")
    got = {r.pos: r.genotype for r in genotype.predict(genotype.train(df.filter("pos < 200")), df).collect()}
    want = {r[1]: {"FP": "0/0"}.get(r[2], r[2]) for r in rows if r[2] and r[1] >= 200}
    assert all(got[i] == gt for i, gt in want.items()) and len(got) == 300


def test_fractions_and_presence(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.05, 0.2), (0.1, None)], "a double, b double")
    assert population.within_fractions(df, ["a", "b"], 0.1, 0.2).count() == 1
    assert [r.dosage for r in population.presence(spark.createDataFrame([("s", "p", "1", 5, 2)], "sample string, population string, chrom string, site long, dosage int")).collect()] == [1]


def test_rows_meet_regions_once(spark):
    """Rows of any length, each one row on its way to the regions, against all pairs."""
    rng = random.Random(5)
    lengths = [0, 1, 40, 100, 127, 128, 129, 1000, 1024, 5000, 70_000]
    rows = [(rng.choice("ab"), (s := rng.randint(-300, 6000)), s + rng.choice(lengths), k) for k in range(400)]
    regions = [(rng.choice("ab"), (s := rng.randint(-200, 6000)), s + rng.choice([0, 1, 60, 100]), k) for k in range(60)]
    got = met(spark.createDataFrame(regions, "chrom string, start long, `end` long, site int"), spark.createDataFrame(rows, "chrom string, start long, `end` long, k int"), 100)
    want = sorted((r[3], x[3]) for r in regions for x in rows if r[0] == x[0] and r[1] < x[2] and x[1] < r[2] and r[1] < r[2] and x[1] < x[2])
    assert sorted((r.site, r.k) for r in got.collect()) == want and want


def test_genotypes_exchange_reads_once(spark):
    """One aggregation of the reads around sites and one of names, instead of five that each joined reads with sites."""
    plan = QUERIES["genotype_evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") <= 2, plan.count("Join Inner")
