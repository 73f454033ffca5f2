"""Records, labels, features, transductions and text forms on rows made by hand."""

import pytest
from pyspark.sql import functions as F

from siteloom import schema
from siteloom.operators import caller, consistency, features, reads, rules, scan, transduction
from siteloom.sources import sinks, text
from test_scan import read


def near(spark, rows, site=1000):
    return scan.around(spark.createDataFrame(rows, schema.READ), spark.createDataFrame([("1", site)], "chrom string, pos long"), 300)


def test_genotype_features(spark):
    rows = [
        read("l1", 1000, "20S80M", seq="C" * 15 + "AAAAA" + "ACGT" * 20, mate=("1", 1200)), read("l2", 1002, "25S75M"), read("l3", 1003, "20S80M"), read("l_far", 1100, "20S80M"),  # exact within 3, raw within 100
        read("r1", 920, "80M15S", mate=("1", 1300)), read("r_rc", 915, "85M15S", seq="ACGT" * 21 + "A" + "T" * 5 + "C" * 10, is_reverse=True), read("extra", 1000, "20S80M", is_supplementary=True),
        read("full_mid", 950, "100M"), read("full_right", 980, "100M"), read("full_left", 920, "100M"), read("full_off", 1001, "100M"),
        read("far_mate", 900, "100M", mate=("1", 9000)), read("other", 900, "50M5I45M", mate=("2", 5)), read("decoy", 900, "100M", mate=("hs37d5", 5)), read("lost", 900, "100M", mate=(None, None), mate_is_unmapped=True),
        read("span", 800, "100M", mate=("1", 1250)), read("no_span", 800, "100M", mate=("1", 850)), read("l1", 820, "100M", mate=("1", 1000)),  # of a pair that is clipped near the site
    ]
    r = features.genotype_evidence(near(spark, rows)).first()
    assert (r.n_af_clip, r.clip_lens, r.n_l_raw, r.n_r_raw) == (2, [20, 25], 3, 2)
    assert r.n_full_map == 2  # with left clips those that end just after the site aren't counted: full_mid and full_right
    assert (r.n_large_indel, r.n_disc) == (1, 2)
    assert r.n_conc >= 1 and r.n_mate_chroms == 2
    assert r.n_polya == 2  # the left clip's end; of a right clip on the other strand the end as well
    more = features.genotype_evidence(near(spark, [*rows, read("r2", 920, "80M15S"), read("r3", 921, "79M12S")])).first()
    assert (more.n_af_clip, more.clip_lens, more.n_full_map) == (4, [12, 15, 15, 15], 5)  # now the right side has more, and full_right goes
    assert features.genotype_evidence(near(spark, rows).limit(0)).count() == 0


def test_labels(spark):
    base = dict(lcov=30.0, rcov=30.0, mean_cov=30.0, tsd=12, n_lpolya=2, n_rpolya=0, n_l_raw=10, n_r_raw=10, td_src="not_transduction", lc=1, rc=1, ld=1, rd=1, low=False)
    cases = [
        ({}, "two_side_tprt_both", True), ({"tsd": None}, "two_side_tprt", True), ({"tsd": 0, "n_lpolya": 0}, "two_side", True), ({"n_lpolya": 10, "n_rpolya": -9}, "polyA_dominant_both-side_may_low_confident", True),
        ({"n_lpolya": 0, "n_rpolya": 0, "tsd": 200}, "two_side", True), ({"ld": None}, "one_half_side_tprt_both", True), ({"ld": None, "tsd": 300, "n_lpolya": 0}, "one_half_side", True), ({"ld": None, "n_lpolya": 20}, "polyA_dominant_one-half-side_may_low_confident", False),
        ({"ld": None, "rc": None}, "one_side", False), ({"ld": None, "rc": None, "low": True}, "one_side_coverage_conflict", False), ({"ld": None, "td_src": "1:5-9~0"}, "one_side_and_half_transduction", False), ({"td_src": "1:5-9~0"}, "two_side_tprt_both", True),
        ({"lcov": 91.0}, "high_coverage_island_low_confident", False), ({"lc": None, "ld": None}, "other_type_low_confident", False), ({"ld": None, "td_src": "may_two_side_with_one_side_on_flanking"}, "may_two_side_with_one_side_on_flanking", False),
    ]
    rows = [(k, *{**base, **c}.values()) for k, (c, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, lcov double, rcov double, mean_cov double, tsd int, n_lpolya int, n_rpolya int, n_l_raw int, n_r_raw int, td_src string, lc int, rc int, ld int, rd int, low boolean")
    df = df.withColumns({f"{x}_{e}": F.col(x) for x in ("lc", "rc", "ld", "rd") for e in ("start", "end")})
    label, sure = rules.site_label(F.col("low"))
    got = [(r.label, bool(r.sure)) for r in df.select("k", label.alias("label"), sure.alias("sure")).orderBy("k").collect()]
    assert got == [(x, y) for _, x, y in cases]


@pytest.fixture(scope="module")
def insertion(spark):
    """Reads of one insertion at 5000 with a target site of 12 bases, and what an aligner tells of their parts."""
    rows, clips, mates = [], [], []
    for k in range(8):
        rows += [read(f"l{k}", 5000, "30S70M", mate=("1", 5200), seq="ACGGTCATTCGA" * 2 + "CAAAAA" + "ACGT" * 17 + "AC"), read(f"r{k}", 4942, "70M30S", mate=("1", 4700), seq="ACGT" * 17 + "AC" + "GGCATTGCACCA" * 2 + "GATTAC")]
        clips += [(f"l{k}", "L", 6000 + k % 3, [(0, 30)], False, 60, False), (f"r{k}", "R", 5900 + k % 3, [(0, 30)], False, 60, False)]
        rows += [read(f"dl{k}", 4700 + 20 * k, "100M", mate=("7", 100)), read(f"dr{k}", 5050 + 20 * k, "100M", mate=("7", 900), is_reverse=True)]
        mates += [(f"dl{k}", 5800 + 5 * k, [(0, 100)], True, 60, False, "ACGT" * 25), (f"dr{k}", 5900 + 5 * k, [(0, 100)], False, 60, False, "ACGT" * 25)]
        rows += [read(f"f{k}", 4950 + k, "100M", mate=("1", 5100))]
    cigar = "cigar array<struct<op:int,len:int>>"
    return (spark.createDataFrame(rows, schema.READ), spark.createDataFrame([("1", 5001), ("1", 9000), ("2", 5000)], "chrom string, pos long"),
            spark.createDataFrame(clips, f"qname string, side string, start int, {cigar}, is_rc boolean, mapq int, is_unmapped boolean"), spark.createDataFrame(mates, f"qname string, start int, {cigar}, is_rc boolean, mapq int, is_unmapped boolean, seq string"))


def test_reads_to_records(insertion):
    r = caller.records(*insertion, caller.Call(extend=400, window=200)).collect()
    assert len(r) == 1
    r = r[0]
    assert list(r.asDict()) == [*schema.SITE.names, "high_confident"]
    assert (r.pos, r.lclip_pos, r.rclip_pos, r.tsd) == (5000, 5000, 5012, 12)
    assert (r.n_all_lclip, r.n_all_rclip, r.n_all_ldisc, r.n_all_rdisc, r.n_all_lpolya, r.n_lpolya) == (8, 8, 8, 8, 8, 8)
    assert (r.lclip_cns, r.rclip_cns) == ("6000:6002", "5930:5932")
    assert (r.sub_type, r.consistent, r.hit_end, r.high_confident) == ("two_side_tprt_both", "both_end_consistent", "hit_end_of_consensus", True)
    assert r.n_af_clip == 8 and r.td_src is None and r.genotype is None and r.ins_len > 0
    assert caller.records(insertion[0].limit(0), *insertion[1:]).count() == 0


def test_reads_are_looked_at_once(insertion, spark):
    """Whatever records ask of reads comes from one pass over them."""
    reads_, *rest = insertion
    rows, seen = reads_.collect(), spark.sparkContext.accumulator(0)

    def count(r):
        seen.add(1)
        return r

    counted = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(count), schema.READ)
    assert caller.records(counted, *rest, caller.Call(extend=400, window=200)).count() == 1
    assert seen.value == len(rows)


@pytest.mark.parametrize("extend, window", [(400, 200), (150, 300)])
def test_depths_have_their_own_window(insertion, extend, window):
    """The one join with sites is as wide as the wider of both; neither sees the other's reads."""
    reads_, sites, clips, mates = insertion
    got = caller.records(reads_, sites, clips, mates, caller.Call(extend=extend, window=window)).first()
    want = scan.window_statistics(reads_, sites, window).filter("chrom = '1' and site = 5001").first()
    assert (got.lcov, got.rcov) == (want.lcov, want.rcov)
    told = features.genotype_evidence(scan.around(reads_, sites, extend)).filter("chrom = '1' and site = 5001").first()
    assert (got.n_full_map, got.n_conc, got.n_disc, got.n_l_raw) == (told.n_full_map, told.n_conc, told.n_disc, told.n_l_raw)


def test_polya_only_counts_for_types_that_have_it(insertion, spark):
    reads_, sites, clips, mates = insertion
    none = reads_.withColumn("seq", F.regexp_replace("seq", "CAAAAA", "CGCGCG"))
    early = clips.withColumn("start", F.col("start") - 3000)
    mid = mates.withColumn("start", F.col("start") - 3000)
    assert caller.records(none, sites, early, mid, caller.Call(extend=400)).count() == 0  # neither polyA nor the end
    steps, _ = consistency.evidence_rules(3, 5, 550, 5950, rna_mediated=False)
    assert [n for n, _ in steps] == ["td_depth", "no_side_consistent", "clips_without_pairs", "no_polya", "no_end"]


def test_transductions_called_out_and_added(spark):
    pairs = spark.createDataFrame([("1", 10, 1000, "9:5-9", 700 + 10 * k, 900 + k) for k in range(5)] + [("1", 10, 1000, "9:5-9", 50_000, 1100)] + [("1", 20, 1000, "9:5-9", 10_000 * k, 900) for k in range(5)] + [("1", 30, 1000, "9:5-9", 700, 900)], "chrom string, site long, clip_pos long, source string, ref_at long, anchor long")
    clips = spark.createDataFrame([("1", 10, "L", 1001)] * 3 + [("1", 10, "L", 1050), ("1", 10, "R", 990), ("1", 20, "L", 5), ("1", 40, "R", 77)], "chrom string, site long, side string, ref_pos long")
    tails = spark.createDataFrame([("1", 10, 4, 1), ("1", 20, 1, 1), ("1", 40, 0, 6)], "chrom string, site long, n_lpolya long, n_rpolya long")
    orphans = spark.createDataFrame([("1", 40, "8", 3, 4), ("1", 50, "8", 3, 4)], "chrom string, site long, source string, n_left long, n_right long")
    got = transduction.called_out(pairs, clips, tails, ["chrom", "site"], "clip_pos", 200, 0.4, orphans)
    # 20's places are far apart, 30 has no clips, 50 neither
    assert {r.site: tuple(r)[2:] for r in got.collect()} == {10: (True, 5, "9:5-9~700-740", 3, 1001, 4), 40: (False, 7, "8~orphan", 1, 77, 6)}
    cols = ("lclip_pos", "rclip_pos", "n_lclip", "n_rclip", "n_all_lclip", "n_all_rclip", "n_all_ldisc", "n_all_rdisc", "n_all_lpolya", "n_all_rpolya", "n_td_clip", "n_td_disc", "n_td_polya")
    records = spark.createDataFrame([("1", s, 1, 2, 2, 2, 2, 2, 1, 1, 0, 0, 0, 0, 0, None) for s in (10, 40, 60)], "chrom string, site long, " + ", ".join(f"{c} long" for c in cols) + ", td_src string")
    out = {r.site: r for r in transduction.with_transductions(records, got, ["chrom", "site"]).collect()}
    assert (out[10].lclip_pos, out[10].rclip_pos, out[10].n_all_lclip, out[10].n_all_rdisc, out[10].n_all_lpolya, out[10].td_src, out[10].n_td_disc) == (1001, 2, 5, 6, 4, "9:5-9~700-740", 5)
    assert (out[40].rclip_pos, out[40].n_all_rclip, out[40].n_all_ldisc, out[40].n_all_rpolya) == (2, 3, 8, 6)  # one clip isn't more than its own two
    assert (out[60].td_src, out[60].n_all_lclip) == (None, 2)


def test_lines_with_nulls(spark):
    rows = [("chr2", 5, "<L1>"[1:-1], 10, "0/1"), ("chr10", 7, None, None, None), (None, None, "L1", 3, "1/1")]
    df = spark.createDataFrame(rows, "chrom string, pos long, svtype string, ins_len int, genotype string")
    got = [r.value.split("\t") for r in sinks.vcf_lines(df).collect()]
    assert all(len(x) == 10 for x in got)
    assert got[0] == ["chr2", "5", ".", ".", "<L1>", ".", "PASS", "SVTYPE=L1;SVLEN=10", "GT", "0/1"]
    assert got[1][4:8] == [".", ".", "PASS", "."] and got[2][:2] == [".", "."]
    af = spark.createDataFrame([(3, 1), (0, 0), (None, 4)], "n_af_clip int, n_full_map int").select(sinks.allele_frequency().alias("af")).collect()
    assert [r.af for r in af] == [0.75, None, None]


def test_site_table_forms(spark, tmp_path):
    cols = ("pos", "site", "lclip_pos", "rclip_pos", "n_all_lclip", "n_all_rclip", "n_all_ldisc", "n_all_rdisc", *(f"{x}_{e}" for x in ("lc", "rc", "ld", "rd") for e in ("start", "end")))
    df = spark.createDataFrame([("1", *range(1, 17)), ("2", 9, 8, None, 7, *[None] * 12)], "chrom string, " + ", ".join(f"{c} long" for c in cols))
    assert [r.value for r in sinks.original_site_lines(df).collect()] == ["1\t2\t1\t3\t4", "2\t8\t9\t-1\t7"]
    path = str(tmp_path / "before")
    sinks.before_filter_lines(df).write.text(path)
    back = text.before_filter(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.drop("site").collect()), key=str)
    assert [r.value for r in sinks.deletion_lines(spark.createDataFrame([("1", 5, -1), ("1", None, 9)], "chrom string, start long, `end` long")).collect()] == ["1\t5\t-1", "1\t-1\t9"]


def test_small_functions_without_a_test_so_far(spark):
    df = spark.createDataFrame([(5, 9, None, None), (400, 500, 3, 8), (None, None, 200, 300)], "a int, b int, c int, d int")
    df = df.select(*(F.col(x).alias(y) for x, y in (("a", "lc_start"), ("a", "ld_start"), ("c", "rc_start"), ("c", "rd_start"))))
    assert [r[0] for r in df.select(consistency.full_length(10)).collect()] == [True, True, False]
    assert spark.range(1).select(reads.raw_coverage(F.lit(1000), F.lit(150), 3000)).first()[0] == 50.0
    parts = spark.createDataFrame([("1", 5, 2, 3, "a"), ("1", 5, 4, 5, "b")], "chrom string, pos long, n_disc long, n_conc long, clip_lens string")
    assert tuple(reads.merge_features(parts).first()) == ("1", 5, 6, 8)
