"""Learning from positive and unlabelled texts: the risk, its steps, and held-out texts."""

import random
import zlib

import numpy as np
import pytest

from siteloom.llm import toxicity
from siteloom.llm.toxicity import Settings, risk, score_toxicity, signs_of, train

BAD = ["grumpf", "blarghs", "snorkel", "twaddle"]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, toxic = [], {}
    for k in range(1500):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic[k] = int(rng.random() < 0.15)
        for _ in range(toxic[k] * rng.randint(1, 5)):
            text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(["", "", "ing", "er"]))
        docs.append((k, " ".join(text), toxic[k]))
    return docs


def test_held_out_texts(spark, corpus):
    rng = random.Random(8)
    extra = [(2001, None), (2002, ""), (2003, "!?"), (2004, "Grumpf! " + "a b " * 600_000), (2004, "Grumpf! " + "a b " * 600_000), (None, "no id blarghs blarghs")]
    df = spark.createDataFrame([(d, t, "z") for d, t, _ in corpus] + [(d, t, "z") for d, t in extra], "doc_id long, text string, toxic string").repartition(4)
    known = [(d, y) for d, _, y in corpus if rng.random() < 0.4]
    labels = spark.createDataFrame([*known, (None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    rows = score_toxicity(df, labels).collect()
    assert len(rows) == len(corpus) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in rows)
    got = {r.doc_id: r for r in rows}
    wrong = [d for d, _, y in corpus if held(d) and got[d].predicted != y]
    assert len(wrong) <= 0.02 * sum(held(d) for d, _, _ in corpus)
    assert got[2001].score == got[2002].score == got[2003].score < 0.3
    assert got[2004].predicted == 1 and got[None].predicted == 1
    # labels of held-out documents change nothing
    other = spark.createDataFrame([(d, 1 - y if held(d) else y) for d, y in known], "doc_id long, toxic int")
    again = score_toxicity(df, other).collect()
    assert [r.score for r in sorted(again, key=repr)] == pytest.approx([r.score for r in sorted(rows, key=repr)])


def test_nothing_to_learn_from(spark, corpus):
    df = spark.createDataFrame(corpus[:50], "doc_id long, text string, n int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in score_toxicity(df, none).collect()] == pytest.approx([toxicity.UNKNOWN_PRIOR] * 50)
    assert score_toxicity(df.limit(0), none).count() == 0
    only = spark.createDataFrame([(d, 1) for d, _, y in corpus[:50] if y], "doc_id long, toxic int")
    assert score_toxicity(df, only).count() == 50


def test_copies_count_once(spark, corpus):
    text = "one two three four five six seven eight nine ten " * 5
    near = [(9000 + k, text + f" extra{k}", 1) for k in range(300)]
    df = spark.createDataFrame(corpus + near + [(9500 + k, text, 1) for k in range(300)], "doc_id long, text string, toxic int")
    n = toxicity._least(df.select("text", "toxic"), 5000, 5).count()
    assert len(corpus) <= n < len(corpus) + 100


def test_risk_never_counts_below_nothing():
    rng = np.random.default_rng(1)
    p, u = rng.normal(2, 1, 50), np.concatenate([rng.normal(2, 1, 20), rng.normal(-2, 1, 80)])
    positive, negative = risk(p, u, 0.2)
    # by hand
    assert positive == pytest.approx(0.2 * np.mean(np.log1p(np.exp(-p))))
    assert negative == pytest.approx(np.mean(np.log1p(np.exp(u))) - 0.2 * np.mean(np.log1p(np.exp(p))))
    assert risk(p * 20, -np.abs(u) * 20, 0.9)[1] < 0


def test_unlabelled_positives_are_scored_as_such():
    """A fifth of the unlabelled sample is like the positive one; a classifier that took it for clean would say less."""
    rng = np.random.default_rng(3)
    x = (rng.random((4000, 6)) < 0.2).astype(np.float32)
    x[:800, 0] = 1
    x[800:, 0] = 0
    p = (rng.random((300, 6)) < 0.2).astype(np.float32)
    p[:, 0] = 1
    w, bias = train(p, x, 0.2, Settings())
    score = 1 / (1 + np.exp(-(x @ w + bias)))
    # taken for clean, 300 positives against 800 like them would say 0.27
    assert score[:800].mean() > 0.85 and score[:800].min() > 0.6 and score[800:].max() < 0.2
    half, bias = train(p, x, 0.1, Settings())  # with half the prior every other one of them is clean
    assert (1 / (1 + np.exp(-(x @ half + bias))))[:800].mean() == pytest.approx(0.5, abs=0.06)


def test_signs():
    assert signs_of("ab") == ["ab "]
    assert signs_of("abcd") == ["abcd ", "abc", "abcd"]
    assert signs_of("abcdefghijk")[-1] == "abcdefgh"
