"""Realigned parts, each rule with a part made by hand."""

import re

import pytest

from siteloom.operators import realigned

OPS = {"M": 0, "I": 1, "D": 2, "S": 4, "H": 5}
SCHEMA = """name string, chrom string, site long, ref_pos long, sample string, side string, is_rc boolean, mapq int, is_unmapped boolean, start int, cigar array<struct<op:int,len:int>>, seq string, copy_chrom string, copy_start long, copy_end long,
  src_chrom string, src_start long, src_end long, src_rc boolean, flank_side string, anchor long, anchor_rc boolean, mate_rc boolean, anchor_lclip boolean, anchor_rclip boolean"""
PLAIN = "ACGGTTCAATC" * 3 + "ACG"


def part(name, cigar="36M", ref_pos=1000, side="L", rc=False, mapq=30, start=60, seq=PLAIN, copy=("7", 5000, 5300), source=("7", 90_000, 96_000, False), flank_side="R", unmapped=False, site=1000):
    g = [(OPS[o], int(n)) for n, o in re.findall(r"(\d+)([A-Z])", cigar)]
    return (name, "1", site, ref_pos, "s", side, rc, mapq, unmapped, start, g, seq, *copy, *(source or (None,) * 4), flank_side, ref_pos, False, False, False, False)


def rows(spark, *parts):
    # one site for each part tells them apart in results
    return spark.createDataFrame([(*p[:2], 1000 * (k + 1), p[3] + 1000 * k, *p[4:]) for k, p in enumerate(parts)], SCHEMA)


def by_site(df):
    return {r.site // 1000 - 1: r for r in df.collect()}


@pytest.fixture(scope="module")
def repeats(spark):
    return spark.createDataFrame([("7", 5000, 100, 400, False), ("8", 5000, 100, 400, True)], "chrom string, start long, cns_start long, cns_end long, is_rc boolean")


def test_clips_on_the_consensus(spark):
    a = "C" * 16 + "CGGAAAAACGTCGTCGTCGC"
    got = by_site(realigned.clips_on_consensus(rows(spark, part("left"), part("right", side="R"), part("left_rc", rc=True), part("right_rc", side="R", rc=True), part("far", ref_pos=1051), part("near", ref_pos=950), part("lost", unmapped=True), part("short", "23M13S"), part("both", "9S18M9S"),
                                                    part("a", seq=a), part("a_right", side="R", seq=a), part("a_rc", rc=True, seq=a), part("a_right_rc", side="R", rc=True, seq=a), part("t", seq=a.replace("A", "T")))))
    assert {k: r.cns for k, r in got.items()} == {0: 60, 1: 96, 2: 96, 3: 60, 5: 60, 9: 60, 10: 96, 11: 96, 12: 60, 13: 60}
    assert {k for k, r in got.items() if r.polya} == {9, 12}  # next to the breakpoint
    n = by_site(realigned.polya_counts(realigned.clips_on_consensus(rows(spark, part("a", seq=a), part("b", side="R", rc=True, seq=a)))))
    assert [tuple(n[k])[2:] for k in (0, 1)] == [(1, 0, 1, 0), (0, 1, 0, 0)]


def test_clips_on_copies(spark, repeats):
    run = "AAAAA" + PLAIN[5:]
    other = ("8", 5000, 5300)
    got = by_site(realigned.clips_on_copies(rows(spark, part("body"), part("before", start=44), part("at", start=45), part("last", start=345), part("beyond", start=346), part("poor", start=44, mapq=9), part("run", start=44, seq=run), part("body_run", seq=run), part("right", side="R"), part("other", copy=other), part("unknown", copy=("9", 1, 301))), repeats, 50))
    assert {k: r.kind for k, r in got.items()} == {0: "body", 1: "flank", 2: "body", 3: "body", 4: "flank", 5: "lost", 6: "lost", 7: "body", 8: "body", 9: "body", 10: "body"}
    assert (got[1].source, got[1]["at"], got[1].cns) == ("7~5000~5300", 44, None)
    assert [got[k].cns for k in (0, 8, 9, 10)] == [110, 146, 390, -1]  # 100 + 60 - 50; past 36 bases; from the copy's other end; unknown
    assert {k for k, r in got.items() if r.polya} == {6, 7}


def test_pairs(spark, repeats):
    run = "AAAAA" + PLAIN[5:]
    got = by_site(realigned.pairs_on_copies(rows(spark, part("body"), part("before", start=34), part("at", start=35), part("poor", start=34, mapq=9), part("beyond", start=336, mapq=0), part("run", start=34, seq=run), part("unknown", copy=("9", 1, 301)), part("short", "25M11S")), repeats, 50))
    assert {k: r.kind for k, r in got.items()} == {0: "body", 1: "flank", 2: "body", 3: "body", 4: "flank", 5: "body", 6: "body"}
    assert (got[0].cns, got[6].cns, got[4]["at"]) == (128, None, 336)
    both = by_site(realigned.pairs_on_consensus(rows(spark, part("a"), part("b", rc=True), part("c", seq="TTATT" + PLAIN[5:]))))
    assert [(both[k].cns, both[k].same_ori, both[k].polya) for k in range(3)] == [(78, False, False), (78, True, False), (78, False, True)]


def test_clips_on_flanks(spark):
    tail = {"a": PLAIN[:26] + "GAAAAAGCGC", "t": PLAIN[:26] + "GTTTTTGCGC", "both": PLAIN[:26] + "AAAAATTATT"}
    parts = [part("plain"), part("left_flank", flank_side="L"), part("decoy", source=None)]
    parts += [part(n, seq=s) for n, s in tail.items()] + [part(n, side="R", seq=s[::-1]) for n, s in tail.items()] + [part("a_rc", side="R", rc=True, seq=tail["a"])]
    df = rows(spark, *parts)
    got = by_site(realigned.clips_on_flanks(df, 300))
    assert (got[0].source, got[0].ref_at, got[1].ref_at) == ("7:90000-96000~0", 96_060, 90_000 - 300 + 60)
    assert (got[2].source, got[2].ref_at) == (None, got[2].site)
    assert [got[k].base for k in range(10)] == [None, None, None, "A", "T", "AT", "A", "T", "AT", "T"]  # on the other strand A was T
    n = by_site(realigned.tail_counts(realigned.clips_on_flanks(df, 300)))
    assert [tuple(n[k])[2:] for k in range(3, 9)] == [(1, 0, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0), (0, 0, 0, 0, 1, 0), (0, 1, 0, 0, 0, 0), (0, 0, 0, 1, 0, 0), (0, 0, 0, 0, 0, 1)]


def test_a_source_is_not_its_own(spark):
    near = [part(str(d), source=("1", 1000 + d, 9000 + d, True), site=1000) for d in (0, 999, 1000, -1000, -8999, -8001, -7001, -7000)]
    df = spark.createDataFrame([(*p[:4], str(k), *p[5:]) for k, p in enumerate(near)], SCHEMA)
    kept = {r.source for r in realigned.clips_on_flanks(df, 300).collect()}
    # the breakpoint is at 1000; a border within 1000 of it leaves the clip out
    assert kept == {"1:2000-10000~1", "1:0-8000~1", "1:-6000-2000~1"}
