"""Seeds: minimizers by hand, planted places found, exact ones all found."""

import random

import numpy as np
import pytest

from siteloom.operators import seeds

COMPLEMENT = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(12)
    return ["".join(rng.choices("ACGT", k=6000)) for _ in range(8)]


def changed(seq, rng, rate):
    out = []
    for c in seq:
        r = rng.random()
        out.append("" if r < rate / 3 else c + rng.choice("ACGT") if r < 2 * rate / 3 else rng.choice("ACGT") if r < rate else c)
    return "".join(out)


@pytest.mark.parametrize("strands", [False, True])
def test_minimizers_by_windows(genome, strands, monkeypatch):
    text, k, w = genome[0][:700], 9, 6
    h = {}
    for i in range(len(text) - k + 1):
        a = int(seeds.minimizers(text[i : i + k], k, 1, False)[0][0])
        b = int(seeds.minimizers(text[i : i + k].translate(COMPLEMENT)[::-1], k, 1, False)[0][0])
        h[i] = (min(a, b), b < a) if strands else (a, False)
    want = sorted({min(range(i, i + w), key=lambda j: (h[j][0], j)) for i in range(len(h) - w + 1)})
    for piece in (1 << 20, 100):
        monkeypatch.setattr(seeds, "PIECE", piece)
        seed, place, back = seeds.minimizers(text, k, w, strands)
        assert place.tolist() == want
        assert [(int(s), bool(b)) for s, b in zip(seed, back)] == [h[i] for i in want]
    assert [len(x) for x in seeds.minimizers("ACG", k, w, strands)] == [0, 0, 0]


def test_planted_places(spark, genome):
    """Parts of 400 letters with 3 % changes, half of them on the other strand: each is found, and where it is."""
    rng = random.Random(3)
    truth, rows = {}, []
    for q in range(60):
        t, at, back = rng.randrange(8), rng.randrange(5500), rng.random() < 0.5
        part = changed(genome[t][at : at + 400], rng, 0.03)
        rows.append((f"q{q}", part.translate(COMPLEMENT)[::-1] if back else part))
        truth[f"q{q}"] = (f"t{t}", back, at)
    rows += [("none", "".join(rng.choices("ACGT", k=400))), ("null", None), ("empty", ""), ("short", "ACGTACGT")]
    targets = spark.createDataFrame([(f"t{k}", g) for k, g in enumerate(genome)] + [("tn", None)], "id string, seq string")
    got = {}
    for r in seeds.placed(spark.createDataFrame(rows, "id string, seq string"), targets, k=13, w=8, gap=30, share=0.2).collect():
        if r.id not in got or r.n > got[r.id].n:
            got[r.id] = r
    assert set(got) == set(truth)
    for q, (t, back, at) in truth.items():
        # on the other strand the sum of places: the query's start lies at the part's end
        where = at + 400 - 13 if back else at
        assert (got[q].target, got[q].reverse) == (t, back) and abs(got[q].first - where) < 60, q


def test_all_exact_places(spark, genome):
    rng = random.Random(5)
    hot = "ACGTTGCAACGGTTAACCGGATATCGCGTA" * 3  # on every target, many times
    texts = [hot + g[:1500] + hot + g[1500:2500] + hot for g in genome] + [hot * 3]
    rows = [(k, t[a : a + 120]) for k, (t, a) in enumerate((rng.choice(texts), rng.randrange(100, 2000)) for _ in range(40))] + [(100, hot), (101, hot[:10]), (102, "N" * 50)]
    want = sorted((k, t, i) for k, q in rows for t, text in enumerate(texts) for i in range(len(text) - len(q) + 1) if len(q) >= 24 and text.startswith(q, i))
    df, targets = spark.createDataFrame(rows, "id int, seq string"), spark.createDataFrame(list(enumerate(texts)), "id int, seq string")
    for most, least in ((1000, 3), (5, 2)):
        got = sorted((r.id, r.target, r.place) for r in seeds.exact_places(df, targets, k=15, w=10, most=most, least=least).collect())
        assert got == want
    assert seeds.exact_places(df.limit(0), targets).count() == 0 == seeds.exact_places(df, targets.limit(0)).count()


def test_a_query_of_frequent_seeds_only(spark):
    t = spark.createDataFrame([(k, "ACGTTGCAACGGTTAACCGGATATCGCGTA") for k in range(300)], "id int, seq string")
    used = seeds.chosen(seeds.seeds(t.limit(1)), seeds.seeds(t), most=10, least=2)
    assert used.count() == 2  # its rarest, though all are frequent
    n = np.array([r.n for r in seeds.hits(used, seeds.seeds(t)).collect()])
    assert len(n) == 300 and (n == 2).all()


def test_targets_are_read_once(spark):
    """Only seeds that a query has too are counted and hit; what finds them isn't part of later plans."""
    t = spark.createDataFrame([("a", "ACGTTGCATTGACCAGTATTACGGATCCAGTTTGACA" * 2), ("b", "TTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTT")], "id string, seq string")
    for df in (seeds.placed(t.limit(1), t), seeds.exact_places(t.limit(1), t)):
        assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    q, kept = seeds.met(t.limit(1), t, 15, 10, False)
    assert {r.id for r in kept.collect()} == {"a"} and kept.count() == q.count()
