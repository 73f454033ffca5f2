"""Layers of forests on held-out records, and results that are used again."""

import random

import pytest
from pyspark.sql import functions as F

from siteloom.operators import genotype
from siteloom.sources import bam, reuse
from test_scan import read
from siteloom import schema

FIELDS = ("n_all_lclip", "n_all_rclip", "n_all_ldisc", "n_all_rdisc", "n_all_lpolya", "n_all_rpolya", "n_af_clip", "n_full_map", "n_l_raw", "n_r_raw", "n_disc", "n_conc")


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(2)
    rows = []
    for k in range(1500):
        g = rng.choice([0, 1, 2])
        depth = rng.randint(20, 40)
        clip = sum(rng.random() < (0.03, 0.4, 0.9)[g] for _ in range(depth))
        disc = sum(rng.random() < (0.05, 0.35, 0.85)[g] for _ in range(depth))
        rows.append(("1", k, float(depth), float(rng.randint(20, 40)), *(rng.randint(0, 5) for _ in range(6)), clip, depth - clip, clip // 2, clip // 3, disc, depth - disc, ("0/0", "0/1", "1/1")[g]))
    return spark.createDataFrame(rows, "chrom string, pos long, lcov double, rcov double, " + ", ".join(f"{f} int" for f in FIELDS) + ", genotype string").cache()


def test_layers_on_held_out_records(records):
    known, rest = records.filter("pos % 3 > 0"), records.filter("pos % 3 = 0")
    model = genotype.train_layers(known, levels=2, trees=10, depth=4)
    got = genotype.predict_layers(model, rest.drop("genotype"))
    right = got.withColumnRenamed("genotype", "told").join(rest, ["chrom", "pos"]).agg(F.avg((F.col("told") == F.col("genotype")).cast("double"))).first()[0]
    assert right > 0.95 and model.accuracy[0] > 0.95
    assert list(model.accuracy) == sorted(model.accuracy)
    again = genotype.predict_layers(genotype.train_layers(known.repartition(5), levels=2, trees=10, depth=4), rest)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    assert genotype.predict_layers(model, rest.limit(0)).count() == 0


def test_records_are_dealt_once(records, monkeypatch):
    """Forests of all levels and folds read rows that are kept: no fit deals them anew."""
    plans, fit = [], genotype.RandomForestClassifier.fit

    def seen(self, df, *more):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return fit(self, df, *more)

    monkeypatch.setattr(genotype.RandomForestClassifier, "fit", seen)
    genotype.train_layers(records, levels=2, trees=3, depth=2)
    assert len(plans) == 12 and all("Repartition" not in p.split("InMemoryRelation")[0] and "InMemoryRelation" in p for p in plans)


def test_kept_rows_are_dealt_by_their_number(records, monkeypatch):
    """More rows make more partitions, not larger ones."""
    sizes, fit = [], genotype.RandomForestClassifier.fit

    def seen(self, df, *more):
        sizes.append(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
        return fit(self, df, *more)

    monkeypatch.setattr(genotype, "PART_ROWS", 50, raising=False)
    monkeypatch.setattr(genotype.RandomForestClassifier, "fit", seen)
    genotype.train_layers(records, levels=1, trees=2, depth=2)
    assert all(len(x) == 30 and max(x) < 100 for x in sizes)


def test_unknown_labels_and_zero_coverage(records, spark):
    odd = records.limit(20).withColumns({"lcov": F.lit(0.0), "genotype": F.lit("?")})
    model = genotype.train_layers(records.filter("pos < 300").unionByName(odd), levels=1, trees=5, depth=3)
    assert genotype.predict_layers(model, odd).count() == 20


def test_results_are_used_again(spark, tmp_path):
    made = []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("one")

    def make():
        made.append(1)
        return spark.range(len(made))

    def run(force=False, **parameters):
        return reuse.reused(spark, str(tmp_path / "kept"), "x", [str(tmp_path / "in")], parameters, make, force).count()

    assert (run(), run(), len(made)) == (1, 1, 1)
    assert (run(window=5), run(window=5), len(made)) == (2, 2, 2)  # other parameters
    assert (run(force=True), run(), len(made)) == (3, 3, 3)
    (tmp_path / "in" / "b").write_text("two")  # other files
    assert (run(), len(made)) == (4, 4)

    def broken():
        raise ValueError("breaks off")

    with pytest.raises(ValueError):
        reuse.reused(spark, str(tmp_path / "kept"), "y", [], {}, broken)
    assert not list((tmp_path / "kept").glob("y-*"))


def test_basic_info_reads_no_alignments_twice(spark, tmp_path):
    rng = random.Random(1)
    rows = [read(f"q{k}", rng.randrange(0, 3000), "100M", mate=("1", rng.randrange(0, 3000))) for k in range(900)]
    reads, opened = spark.createDataFrame(rows, schema.READ), []
    files = {}
    for name in ("a", "b"):
        files[name] = str(tmp_path / name)
        bam.write_alignments(reads, files[name], [("1", 10_000)], 1)

    def alignments(path, sample):
        opened.append(sample)
        return bam.alignments(spark, path, sample=sample)

    sites = spark.createDataFrame([("1", 1000), ("1", 1500), ("1", 2000)], "chrom string, pos long")

    def run(**more):
        return reuse.basic_info(spark, str(tmp_path / "kept"), files, alignments, sites, 200, **more)

    first = sorted(map(tuple, run().collect()))
    assert opened == ["a", "b"] and [r[0] for r in first] == ["a", "b"] and first[0][2] == 100
    assert sorted(map(tuple, run().collect())) == first and opened == ["a", "b"]
    run(force=True)
    assert opened == ["a", "b"] * 2
    total = reuse.combined(run()).first()
    assert (total.coverage, total.read_length) == (first[0][1] * 2, 100.0)
    assert tuple(reuse.combined(run().limit(0)).first()) == (0.0, 0.0, 0.0, 0.0)
