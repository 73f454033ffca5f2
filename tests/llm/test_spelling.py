"""Spelling variants against all pairs of words."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from siteloom.llm import spelling
from siteloom.llm.spelling import WaveletTree, spelling_variants


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcÿ") for _ in range(rng.randint(4, 7))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "l" * 300, "l" * 301, "colour", "color", "colours", "÷×àéü"]

    def typo(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÿ") + w[k:], w[:k] + rng.choice("abcÿ") + w[k + 1 :], w.upper().replace("Ÿ", "ÿ").replace("SS", "ss")])

    out = [(None, None), (1, None), (2, ""), (3, "12 !?"), (None, "Colour colour COLOUR")]
    for k in range(150):
        words = [w if rng.random() < 0.7 else typo(w) for w in rng.choices(base, [1 / (1 + j) for j in range(len(base))], k=rng.randint(1, 60))]
        out.append((10 + k % 140, rng.choice([" ", "-", ", "]).join(words)))
    return out


@pytest.mark.parametrize("block", [spelling.BLOCK, 16])
def test_against_all_pairs(spark, rows, block):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(3)
    got = sorted(map(tuple, spelling_variants(df, block).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    want = brute(rows)
    assert got == want
    assert len({r[2] for r in want if r[1] and r[2] != r[1]}) > 0  # ways of several forms
    assert spelling_variants(df.limit(0)).count() == 0


def test_runs_across_pieces(monkeypatch):
    text = "Abc dé" * 50 + "x" * 3000 + " End"
    whole = re.findall("[a-zÀ-ÿ]+", text.translate(spelling._LOWER))
    monkeypatch.setattr(spelling, "PIECE", 7)
    assert [r for some in spelling.runs(text) for r in some] == whole


def test_altered_is_counted_alike():
    runs = [f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(2000)]
    changed = [r for r in runs if spelling.altered("7", r) != r]
    assert 5 < len(changed) < 60
    assert all(len(spelling.altered("7", r)) == len(r) - 1 for r in changed)


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 200):
        values = rng.permutation(n)
        tree = WaveletTree(values)
        lo, least = rng.integers(0, n, 50), rng.integers(0, n, 50)
        hi, most = np.minimum(n, lo + rng.integers(0, n + 1, 50)), np.minimum(n, least + rng.integers(0, n + 1, 50))
        query, value = tree.report(lo, hi, least, most)
        got = sorted(zip(query.tolist(), value.tolist()))
        assert got == sorted((q, int(v)) for q in range(50) for v in values[lo[q] : hi[q]] if least[q] <= v < most[q])
