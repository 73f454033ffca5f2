"""Orphan transductions on reads made by hand: each verdict, the fold over samples, the matching."""

import random
import shutil
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from siteloom import schema
from siteloom.operators import orphans
from siteloom.plans.queries import ORACLES, QUERIES
from test_scan import read
from verify import rows

S = orphans.Orphans(extend=1000, coverage=30.0)


def pair(k, at, reverse, mate, chrom="1", sample="s", **more):
    return read(f"p{k}", at, more.pop("cigar", "100M"), mate=mate, is_reverse=reverse, chrom=chrom, sample=sample, **more)


def insertion(chrom, site, source=("9", 500_000), n=6, sample="s", flip=False, right_mates=None, polya="T" * 20, spread=0):
    """Reads of one insertion: forward ones before it, reverse ones after, mates on both ends of the source, clips of polyT."""
    rows = []
    for k in range(n):
        rows.append(pair(f"{chrom}{site}l{k}", site - 150 - 10 * k, flip, (source[0], source[1] + 10 * k + spread * k), chrom, sample))
        rows.append(pair(f"{chrom}{site}r{k}", site + 20 + 10 * k, not flip, (right_mates[k % len(right_mates)] if right_mates else (source[0], source[1] + 1000 + 10 * k)), chrom, sample))
        rows.append(read(f"{chrom}{site}c{k}", site - 80, "80M20S", seq="ACGT" * 20 + polya, chrom=chrom, sample=sample, mate=(chrom, site)))
    return rows


def sources(spark, chrom="9", start=499_000, n=60, mapq=60, sample="s"):
    return [read(f"src{chrom}{k}", start + 50 * k, "100M", chrom=chrom, sample=sample, mapq=mapq, mate=(chrom, start)) for k in range(n)]


@pytest.fixture(scope="module")
def world(spark):
    rows = insertion("1", 10_000) + insertion("2", 10_000, flip=True) + insertion("3", 10_000, polya="ACGT" * 5) + insertion("4", 10_000, right_mates=[(str(11 + k), 700_000 + 20_000 * k) for k in range(6)])
    rows += insertion("5", 10_000, right_mates=[(str(11 + k), 900_000 + 20_000 * k) for k in range(6)]) + insertion("6", 10_000, source=("8", 300_000)) + insertion("7", 10_000, spread=100_000)
    rows += sources(spark) + sources(spark, "8", 299_000, mapq=3)
    reads = spark.createDataFrame(rows, schema.READ)
    sites = spark.createDataFrame([(str(c), 10_000) for c in range(1, 8)], "chrom string, pos long")
    repeats = spark.createDataFrame([(str(11 + k), 900_000 + 20_000 * k - 100, 900_000 + 20_000 * k + 100) for k in range(6)], "chrom string, start long, `end` long")
    return reads, sites, repeats


def test_verdicts(world):
    reads, sites, repeats = world
    got = {r.chrom: r for r in orphans.evidence(reads, sites, repeats, 4, 8, S).filter("chrom < '8'").collect()}
    assert all(got[c].depth_ok and got[c].placed_ok for c in got)
    one = got["1"]
    assert (one.n_l, one.n_r, one.n_l_nrc, one.n_l_rc, one.n_r_rc, one.n_rclip, one.n_rpolyt) == (6, 6, 6, 0, 6, 6, 6)
    assert (one.l_chrom, one.l_pos, one.r_pos, one.consistent, one.polya, one.inner) == ("9", 500_030, 501_030, True, True, True)
    assert not got["2"].consistent and not got["2"].inner  # strands the other way: the source of one
    assert not got["3"].polya and got["3"].consistent
    assert not got["4"].consistent  # the right side's mates are anywhere
    assert got["5"].consistent and got["5"].r_pos == -1  # or in repeats
    assert not got["7"].l_cluster and not got["7"].consistent


def test_calls(world, spark):
    reads, sites, repeats = world
    none = spark.createDataFrame([], "chrom string, start long, `end` long")
    got = {r.chrom: (r.src_chrom, r.src_start, r.src_end, r.n_l, r.n_r, r.n_rclip) for r in orphans.calls(reads, sites, repeats, none, 4, 8, S).collect()}
    # 6 has a poorly placed source; 5's source contig is the right side's, where no read is
    assert got == {"1": ("9", 500_030, 501_030, 6, 6, 6)}
    black = spark.createDataFrame([("1", 9_000, 11_000)], "chrom string, start long, `end` long")
    assert orphans.calls(reads, sites, repeats, black, 4, 8, S).count() == 0
    assert orphans.calls(reads, sites, repeats, none, 4, 14, S).count() == 0  # half of 14 pairs on each side
    assert [r.chrom for r in orphans.sources_among(orphans.evidence(reads, sites, repeats, 4, 8, S)).collect()] == ["2"]
    assert orphans.calls(reads.limit(0), sites, repeats, none, 4, 8, S).count() == 0


def test_samples_add_up(spark):
    cols = "sample string, chrom string, site long, src_chrom string, l_pos long, r_pos long, " + ", ".join(f"{c} {'double' if c.endswith('cov') else 'long'}" for c in orphans.COUNTERS)
    n = len(orphans.COUNTERS)
    rows = [("a", "1", 5, "9", 100, 1100, *([1.0 if c.endswith("cov") else 1 for c in orphans.COUNTERS])), ("b", "1", 5, "9", 1500, 2500, *([1.0 if c.endswith("cov") else 1 for c in orphans.COUNTERS])),
            ("c", "1", 5, "9", 3000, 4000, *([1.0 if c.endswith("cov") else 1 for c in orphans.COUNTERS])), ("d", "1", 5, "8", 3000, 4000, *([1.0 if c.endswith("cov") else 1 for c in orphans.COUNTERS])), ("e", "1", 5, "9", 9000, 4000, *([1.0 if c.endswith("cov") else 1 for c in orphans.COUNTERS]))]
    r = orphans.merged(spark.createDataFrame(rows, cols)).first()
    # c agrees with b, which was taken, if not with a; d and e agree with none
    assert (r.src_chrom, r.src_start, r.src_end, r.n_lclip, r.lcov) == ("9", 3000, 4000, 3, 3.0) and n == 12


def greedy(rows):
    out, a, b = [], set(), set()
    for m, h, s, i in sorted(rows):
        if s not in a and i not in b:
            a.add(s), b.add(i), out.append((s, i, -m))
    return sorted(out)


def test_matching(spark):
    rng = random.Random(1)
    edges = [(f"s{rng.randint(0, 60)}", f"i{rng.randint(0, 60)}", rng.choice([1, 1, 1, 2, 3])) for _ in range(400)] + [(None, "i1", 9), ("s1", "i1", None)]
    edges += [(f"t{k}", f"j{k}", 1) for k in range(40)] + [(f"t{k + 1}", f"j{k}", 1) for k in range(40)]  # a long chain of ties
    df = spark.createDataFrame(edges, "source string, insertion string, support int")
    best = df.dropna().groupBy("source", "insertion").agg(F.max("support").alias("support"))
    want = greedy([(-r.support, r.h, r.source, r.insertion) for r in best.withColumn("h", F.xxhash64("source", "insertion")).collect()])
    got = sorted((r.source, r.insertion, r.support) for r in orphans.matched(df).collect())
    assert got == want
    assert orphans.matched(df.limit(0)).count() == 0


def test_matching_deals_edges(spark, monkeypatch):
    """However many edges there are, no task groups many; supports of repeated edges can be added up."""
    tables = []
    monkeypatch.setattr(orphans, "EDGES", 100)
    monkeypatch.setattr(orphans, "written", lambda df, name: tables.append(df) or df.localCheckpoint())
    edges = [(f"s{k % 57}", f"i{k % 64}", 1) for k in range(3000)] + [("s0", "i0", 1), ("s0", "i1", 1)]
    df = spark.createDataFrame(edges, "source string, insertion string, support long").repartition(2)
    got = sorted((r.source, r.insertion, r.support) for r in orphans.matched(df, F.sum).collect())
    sums = df.groupBy("source", "insertion").agg(F.sum("support").alias("support"), F.xxhash64("source", "insertion").alias("h"))
    assert got == greedy([(-r.support, r.h, r.source, r.insertion) for r in sums.collect()])
    first = [r["count"] for r in tables[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(first) > 20 and max(first) < 300


def test_sites_where_mates_lie(spark, tmp_path):
    """Keys beyond 150,000 put sites where other reads' mates lie: these aren't reads around the sites."""
    db = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if p.stem == "lineitem":
            db.execute(f"COPY (SELECT t.* REPLACE (l_orderkey + k AS l_orderkey) FROM '{p}' t, (VALUES (0), (1500), (149600)) x(k)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
        else:
            shutil.copy(p, tmp_path)
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{tmp_path}/{p.name}'")
    df = QUERIES["orphan_evidence"](spark, str(tmp_path))
    cur = db.execute(ORACLES["orphan_evidence"])
    got = rows(df.columns, df.collect())
    assert got and got == rows([x[0] for x in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["orphan_evidence", "orphan_candidates"])
def test_rows_where_mates_lie(spark, tmp_path, name):
    """More orders on both sides of 150,000, so that candidates too have other reads' mates around them."""
    db = duckdb.connect()
    for p in (Path("/root/testdata/sf0.001") / f"{x}.parquet" for x in ("lineitem", "part")):
        if p.stem == "lineitem":
            db.execute(f"COPY (SELECT t.* REPLACE (l_orderkey + k AS l_orderkey) FROM '{p}' t, (VALUES (0), (1500), (3000), (4500), (148500), (150000), (151500), (153000)) x(k)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
        else:
            shutil.copyfile(p, tmp_path / p.name)
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{tmp_path}/{p.name}'")
    df = QUERIES[name](spark, str(tmp_path))
    cur = db.execute(ORACLES[name])
    got = rows(df.columns, df.collect())
    assert len(got) > 30 and got == rows([x[0] for x in cur.description], cur.fetchall())
