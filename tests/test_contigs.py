"""Insertions on contigs, on flanks made by hand."""

import re

import pytest
from pyspark.sql import functions as F

from siteloom.functions import cigar as C
from siteloom.operators import contigs

OPS = {"M": 0, "I": 1, "D": 2, "S": 4, "H": 5}
SCHEMA = "chrom string, pos long, `group` string, flank string, contig string, start int, cigar array<struct<op:int,len:int>>, is_rc boolean, is_secondary boolean, is_supplementary boolean, is_unmapped boolean, is_duplicate boolean"


def elements(text):
    return [(OPS[o], int(n)) for n, o in re.findall(r"(\d+)([A-Z])", text)]


def flank(pos, side, contig, start, cigar="500M", rc=False, group="all", **flags):
    return ("1", pos, group, side, contig, start, elements(cigar), rc, *(bool(flags.get(k)) for k in ("secondary", "supplementary", "unmapped", "duplicate")))


@pytest.fixture(scope="module")
def flanks(spark):
    rows = [
        flank(1, "left", "a", 0), flank(1, "right", "a", 560),  # 60 bases between
        flank(2, "left", "a", 0), flank(2, "right", "a", 510),  # 10
        flank(3, "left", "a", 700, rc=True), flank(3, "right", "a", 100, rc=True),  # on the other strand, 100 between
        flank(4, "left", "a", 0), flank(4, "right", "a", 700, rc=True),  # strands differ
        flank(5, "left", "a", 0), flank(5, "right", "b", 40),  # different contigs
        flank(6, "left", "a", 0),  # one flank
        flank(7, "left", "a", 0, "200M300S"), flank(7, "right", "a", 700),  # too little mapped
        flank(8, "left", "a", 0, "390M110S"), flank(8, "right", "a", 700, "110S390M"),  # clipped at the inner ends
        flank(9, "left", "a", 0, "110S390M"), flank(9, "right", "a", 700, "390M110S"),  # at the outer ends
        flank(10, "left", "a", 600), flank(10, "right", "a", 400),  # in the wrong order
        flank(11, "left", "a", 0), flank(11, "right", "a", 560, secondary=True), flank(11, "right", "a", 560, unmapped=True),
        flank(5, "left", "a", 0, group="hap1"), flank(5, "right", "a", 600, group="hap1"), flank(6, "right", "c", 50, group="hap2"), flank(1, "left", "a", 0, group="hap2"),
        flank(12, "left", "a", 0, group="hap1"), flank(12, "right", "a", 600, group="hap1"),  # without contigs of all reads
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def parts(spark, flanks):
    seqs = [("1", p, g, c, "".join("ACGT"[(k * k + ord(c)) % 4] for k in range(1300))) for p in range(1, 13) for g in ("all", "hap1", "hap2") for c in "abc"]
    return contigs.inserted(contigs.paired(flanks, 500, 0.6, 30), spark.createDataFrame(seqs, "chrom string, pos long, `group` string, contig string, seq string"))


def test_pairing(flanks):
    got = {(r.pos, r.group): (r.verdict, r.first, r.last) for r in contigs.paired(flanks, 500, 0.6, 30).collect()}
    assert {k[0]: v for k, v in got.items() if k[1] == "all"} == {
        1: ("strict", 500, 560), 2: ("none", 500, 510), 3: ("strict", 600, 700), 4: ("none", 500, 700), 5: ("loose", None, None), 6: ("loose", None, None), 7: ("loose", None, None), 9: ("strict", 390, 700), 10: ("none", 1100, 400), 11: ("loose", None, None)}


def test_inserted_parts(parts):
    got = {(r.pos, r.group, r.part): len(r.seq) for r in parts.collect()}
    assert got[1, "all", "whole"] == 60 and got[3, "all", "whole"] == 100 and got[9, "all", "whole"] == 310
    assert (got[5, "all", "left"], got[5, "all", "right"], got[5, "hap1", "whole"]) == (800, 40, 100)
    assert got[6, "all", "left"] == 800 and got[6, "hap2", "right"] == 50
    assert got[7, "all", "right"] == 700 and not {k for k in got if k[0] in (2, 4, 8, 10)}
    seq = {(r.pos, r.part): r.seq for r in parts.filter("`group` = 'all'").collect()}
    contig = "".join("ACGT"[(k * k + ord("a")) % 4] for k in range(1300))
    assert seq[1, "whole"] == contig[500:560] and seq[6, "left"] == contig[500:]


def test_labels_and_calls(spark, flanks, parts):
    labels = contigs.labelled(parts, flanks.filter("`group` = 'all'"))
    got = sorted((r.pos, r["rank"], r.label) for r in labels.collect())
    assert [x for x in got if x[0] == 1] == [(1, 3, "homoTEI")]  # the haplotypes aren't looked at
    assert [x[2] for x in got if x[0] == 5] == ["allL", "allR", "hap1"]
    assert [x[2] for x in got if x[0] == 6] == ["allL", "hap2R"]
    assert not [x for x in got if x[0] == 12]
    rows = [("1", p, label, elements(c)) + (False,) * 4 for p, label, c in ((1, "homoTEI", "40M20S"), (5, "allL", "700M100S"), (5, "hap1", "60M40S"), (6, "allL", "500M300S"), (6, "hap2R", "20M30S"), (3, "homoTEI", "60M40S"), (9, "homoTEI", "100M210S"))]
    copies = spark.createDataFrame(rows, "chrom string, pos long, label string, cigar array<struct<op:int,len:int>>, is_secondary boolean, is_supplementary boolean, is_unmapped boolean, is_duplicate boolean")
    calls = {r.pos: (r.label, r.n, r.both) for r in contigs.called(labels, copies).collect()}
    assert calls == {1: ("homoTEI", 40, True), 3: ("homoTEI", 60, True), 5: ("hap1", 60, True), 6: ("allL", 500, False)}


def test_plain_sites(flanks):
    kept = sorted(r.pos for r in contigs.without_plain_sites(flanks.filter("`group` = 'all'"), 500, 0.95, 30).collect())
    assert kept == [1, 3, 4, 5, 6, 7, 8, 9, 11]  # 2 and 10 have nothing between their flanks


def test_masked_parts(spark):
    rows = [("1", 1, "L", 40, elements("100M"), "A" * 100, False), ("1", 1, "R", 20, elements("30S60M"), "C" * 30 + "G" * 60, False), ("1", 1, "R", 5, elements("80S20M"), "T" * 100, False), ("1", 2, "L", 7, elements("10S70M15S"), "A" * 10 + "C" * 70 + "G" * 15, False), ("1", 3, "L", 7, elements("100M"), "A" * 100, True)]
    masked, rest = contigs.masked_parts(spark.createDataFrame(rows, "chrom string, pos long, side string, start int, cigar array<struct<op:int,len:int>>, seq string, is_unmapped boolean"), 50)
    assert sorted((r.pos, r.start, r.seqs) for r in masked.collect()) == [(1, 20, ["A" * 100, "G" * 60]), (2, 7, ["C" * 70])]
    assert sorted((r.pos, r.side, r.end, r.part) for r in rest.collect()) == [(1, "R", "L", "C" * 30), (2, "L", "L", "A" * 10), (2, "L", "R", "G" * 15)]


def test_walk_both_ways(spark):
    df = spark.createDataFrame([(100, elements("5S10M2I10M3D10M4H"))], "pos int, cigar array<struct<op:int,len:int>>")
    want = {4: None, 5: 100, 14: 109, 15: None, 16: None, 17: 110, 26: 119, 27: 123, 36: 132, 37: None}
    row = df.select(*(C.to_reference(F.col("pos"), F.col("cigar"), F.lit(k)).alias(str(k)) for k in want)).first()
    assert row.asDict() == {str(k): v for k, v in want.items()}
    back = {v: k for k, v in want.items() if v is not None} | {99: None, 120: None, 122: None, 133: None}
    row = df.select(*(C.to_sequence(F.col("pos"), F.col("cigar"), F.lit(k)).alias(str(k)) for k in back)).first()
    assert row.asDict() == {str(k): v for k, v in back.items()}


def test_parts_are_read_once(spark):
    parts = spark.createDataFrame([("1", 5, "all", "whole", "a", "A" * 40), ("1", 5, "hap1", "left", "a", "A" * 40), ("1", 9, "hap1", "left", "a", "A" * 40), ("1", 9, None, "left", "a", "A" * 40)], "chrom string, pos long, group string, part string, contig string, seq string")
    got = contigs.labelled(parts, parts.select("chrom", "pos"))
    assert sorted((r.pos, r.label or "") for r in got.collect()) == [(5, "homoTEI"), (9, ""), (9, "hap1L")]
    assert "Join LeftOuter" not in got._jdf.queryExecution().optimizedPlan().toString()
