"""The text operators against brute force, and their defined results on nulls, empty tables, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteloom.llm import cross_entropy, langid, minhash, mixing, pieces, pii, quality_rules, repeats, rule_ensemble, webp

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", " \t\n", "a", "A a", "é😀 ü", "x" * 5000, "one two three " * 900, "same line\nsame line\nother\n", "same text here to see twice", "same text here to see twice", "mail a.b@c.de and 10.0.0.1, +1 (234) 567-8901 or 4111 1111 1111 1111"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)] + ["the", "of", "and", "to", "der", "la"] * 10
    base = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(12)]
    near = [" ".join(w if rng.random() > 0.02 else rng.choice(vocabulary) for w in t.split()) for t in base for _ in range(4)]
    texts = EDGES + base + near + base[:3]
    rows = [(i, t, random.Random(i).choice(["de", "en", None]), f"s{i % 4}" if i % 5 else None, len(t or ""), i, "x") for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "no id at all in this row", "en", "s1", 3, 1, "y")]
    # columns that operators use as names inside, too
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, copies string").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def bag(rows):
    return sorted(map(repr, rows))


def test_every_operator_on_an_empty_table(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for f in (quality_rules.quality_rules, minhash.near_duplicates, pii.find_pii, mixing.mix, pieces.segment, webp.texts_as_images, repeats.remove_repeats, langid.identify):
        assert f(empty).count() == 0, f.__name__
    assert rule_ensemble.score_quality(empty, labels).count() == 0
    assert cross_entropy.cross_entropy_difference(empty, labels).count() == 0
    for f in (quality_rules.keep_good, minhash.keep_one_of_each, pii.sanitise, mixing.resample):
        out = f(empty)
        assert out.count() == 0 and out.columns == docs.columns, f.__name__


def test_every_operator_keeps_rows(spark, docs):
    n = docs.count()
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    for out in (quality_rules.quality_rules(docs), minhash.near_duplicates(docs), pii.find_pii(docs), mixing.mix(docs), pieces.segment(docs), webp.texts_as_images(docs), repeats.remove_repeats(docs), langid.identify(docs),
                rule_ensemble.score_quality(docs, labels), cross_entropy.cross_entropy_difference(docs, labels)):
        assert out.count() == n, out.columns


def test_quality(docs):
    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = {g: grams.count(g) for g in set(grams)} if len(grams) < 500 else {g: 2 for g in set(grams)}
        covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)

    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(docs).collect()]
    assert bag(got) == bag([(i, *brute(t)) for i, t in texts_of(docs)])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= quality_rules.quality_rules(docs).filter("kept").count()


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, width, percent):
    sets = {}
    for i, t in texts_of(docs):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        if i is not None:
            sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and both:
                x, y = sorted((find(a), find(b)))
                least[y] = x
    got = minhash.near_duplicates(docs, width, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(i, len(sets[i]), find(i), find(i) == i) for i in ids}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    stay = minhash.keep_one_of_each(docs, width, percent)
    assert sorted(r.doc_id for r in stay.filter("doc_id is not null").collect()) == sorted(i for i in ids if find(i) == i)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 2000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        s = minhash.fast_sketch(a, 180)
        assert (s != np.uint64(2**64 - 1)).all() and (s == minhash.fast_sketch(a[::-1], 180)).all()
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 2**63, 100).astype(np.uint64)])
    same = (minhash.fast_sketch(a, 1000) == minhash.fast_sketch(b, 1000)).mean()
    assert abs(same - 900 / 1100) < 0.05


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = []
    for k, (name, p) in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if not (name == "ip" and max(map(int, m.group().split("."))) > 255 or name == "card" and not (14 <= len(d) <= 19 and luhn(d)) or name == "phone" and not 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


HARD = ["a@b.c_d@e.f x@y@z.w", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 0000255.1.1.1 1.1.1.0001234", "4111 1111 1111 1111 4111-1111-1111-1111, 4111  11 411111111111111100", "+1 (988) 555-2485 ++12345678901( +123", "é😀 a.b+c@mail.example.com 😀 10.0.0.1",
        "9" * 5000, "a" * 30000, "a@" + "b." * 5000 + "c", "1.1." * 3000, None, "", "x@y.z@w.q", "0 " * 3000 + "1", "\n\n7@8.9\t"]


def test_pii_base_spans(spark):
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")).collect()
    for r in rows:
        want = brute_spans(HARD[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in want).encode()).hexdigest()


def test_disclosing_terms(spark):
    rows = [(i, f"some words number{'abcdefgh'[i]} before zorblatt wrote from spy@mail.org and more common text") for i in range(5)]
    rows += [(10 + i, f"common text and more words of some before wrote from {'klmnopqr'[i % 8]} again {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    for i in range(5):
        t = rows[i][1]
        terms = {t[int(s) : int(e)] for k, s, e in (x.split(":") for x in got[i].spans.split(",")) if k == "term"}
        assert "zorblatt" in terms and not terms & {"common", "more", "wrote", "and"}
    assert all(got[10 + i].spans == "" for i in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("zorblatt" not in clean[i] and "spy@" not in clean[i] and "<EMAIL>" in clean[i] for i in range(5))
    assert clean[10] == rows[5][1]


def found_terms(df):
    text = {r.doc_id: r.text for r in df.collect()}
    return {r.doc_id: {text[r.doc_id][int(s) : int(e)] for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "term"} for r in pii.find_pii(df).collect()}


def test_terms_of_an_entity_in_one_text(spark):
    """An entity in a single text, or in copies of one, has revealing terms; what chance explains isn't one."""
    rows = [(i, f"common words of text {i % 7} and more") for i in range(3000)]
    rows += [(4000, "common zorblatt spy@mail.org and more"), (4001, "common quixly 10.1.2.3 and more"), (4002, "common quixly 10.1.2.3 and more")]
    got = found_terms(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[4000] == {"zorblatt"} and got[4001] == got[4002] == {"quixly"} and not any(got[i] for i in range(3000))
    few = found_terms(spark.createDataFrame(rows[-20:], "doc_id long, text string"))
    assert few[4000] == set()  # one of 20 documents


def test_terms_anywhere_in_the_document(spark):
    """Every occurrence counts, however far from the entity, and whatever letters the word has."""
    far = "Jean-Luc, O'Brien (jsmith42) é😀 " + "common words and more " * 60 + "spy@mail.org or 10.1.2.3. " + "common words and more " * 60 + "Again: jean-luc!"
    rows = [(i, f"common words and more of spy {i % 7}") for i in range(3000)] + [(4000, far), (None, far.replace("spy", "boss")), (4001, far), (4001, far)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found_terms(df)
    assert {"Jean-Luc", "O'Brien", "jsmith42", "jean-luc"} <= got[4000] and got[4000] == got[4001] == got[None] and not got[4000] & {"common", "words", "and", "more"}
    clean = [r.text for r in pii.sanitise(df).collect() if "<EMAIL>" in r.text]
    assert len(clean) == 4 and not any(w in t.lower() for t in clean for w in ("jean-luc", "o'brien", "jsmith42"))


def water(sizes):
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    cap, fixed = {s: 3 * sizes[s] for s in sizes}, {}
    while True:
        left, w = sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in sizes if s not in fixed)
        t = {s: left * weight[s] / w for s in sizes if s not in fixed}
        over = [s for s in t if t[s] > cap[s]]
        if not over:
            return fixed | t
        fixed |= {s: cap[s] for s in over}


def test_mix(spark, docs):
    rng = random.Random(8)
    more = spark.createDataFrame([(1000 + i, "w " * int(rng.paretovariate(1.1) * 20 % 3000 + 1), f"s{i % 7}" if i % 6 else None) for i in range(400)], "doc_id long, text string, source string")
    for df in (docs, more):
        rows = df.select("doc_id", "source", "text").collect()
        sizes: dict = {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
        want = water(sizes)
        rows_ = mixing.mix(df).collect()
        source = {r.doc_id: r.source for r in rows}
        got = [r for r in rows_ if r.doc_id is not None]
        assert bag((r.doc_id, r.taken) for r in rows_) == bag((r.doc_id, r.taken) for r in mixing.mix(df.repartition(3)).collect())
        taken: dict = {}
        for r in got:
            assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
            assert abs(r.target - want[source[r.doc_id]]) <= 1e-6 * max(1, want[source[r.doc_id]])
            taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        for s, t in want.items():
            assert abs(taken.get(s, 0) - t) <= 0.02 * t + 60, (s, taken.get(s, 0), t)
    again = mixing.resample(more).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in again} == {r.doc_id: r.copies for r in got if r.copies and r.size}


def test_dual_against_bisection(spark):
    """The multipliers solve sum(size * n * min(3, exp(l * x))) = target; targets of plain cells and skewed ones."""
    rng = random.Random(4)
    cells = [(f"s{i}", size, n) for i in range(6) for size, n in {rng.randint(1, 10 ** (1 + i % 4)): rng.randint(1, 50) for _ in range(30)}.items()] + [("zero", 0, 5), (None, 7, 3)]
    df = spark.createDataFrame(cells, "source string, size long, n long")
    targets = {r.source: r for r in mixing.source_targets(df).collect()}
    got = {r.source: r for r in mixing.multipliers(df, mixing.source_targets(df)).collect()}
    assert {s for s, r in targets.items() if r.source_size and r.target < 3 * r.source_size} == set(got)
    for s, r in got.items():
        mine = [(size, n) for x, size, n in cells if x == s]
        mean = targets[s].source_size / sum(n for _, n in mine)
        assert r.mean == pytest.approx(mean)

        def words(l):
            return sum(size * n * min(3.0, math.exp(min(50.0, l * size / mean))) for size, n in mine)

        low, high = -1e4, 1e4
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if words(mid) < targets[s].target else (low, mid)
        assert words(r.l) == pytest.approx(targets[s].target, rel=1e-6) and r.l == pytest.approx(low, rel=1e-3, abs=1e-3)


def test_dual_by_halving_alone_and_an_error_where_it_isnt_settled(spark):
    cells = spark.createDataFrame([("a", 1, 40), ("a", 900, 2), ("b", 5, 30), ("b", 80, 9), ("c", 3, 100)], "source string, size long, n long")
    targets = mixing.source_targets(cells)
    newton = {r.source: r.l for r in mixing.multipliers(cells, targets).collect()}
    halved = {r.source: r.l for r in mixing.multipliers(cells, targets, steps=0).collect()}
    assert halved == pytest.approx(newton, rel=1e-5, abs=1e-6)
    with pytest.raises(ArithmeticError, match="off its target"):
        mixing.multipliers(cells, targets, steps=1, halvings=0)


def brute_repeats(texts):
    k, seen = repeats.K, {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - k + 1):
            seen[b[i : i + k]] = seen.get(b[i : i + k], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - k + 1):
            if seen[b[i : i + k]] > 1:
                gone[i : i + k] = True
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def digests(df):
    """The bytes, the bytes and runs removed, and the digest of what is left, of each document."""
    out = []
    for r in repeats.remove_repeats(df).collect():
        assert sum(x.end - x.start for x in r.removed) == r.n_bytes - len(r.kept)
        out.append((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()))
    return out


def test_repeats(spark, docs):
    rng = random.Random(6)

    def rnd(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    long, p, q = rnd(900), rnd(150), rnd(190)
    texts = [None, "", "a" * 1000, "ab" * 300, long, long, long[:500] + rnd(5) + long[505:], rnd(100) + long[100:330] + rnd(50), rnd(30) + long[100:299] + rnd(30), rnd(30) + long[400:620] + rnd(77) + long[400:700], q + "X" + p + p, q + "Y" + p, "x" * 199, "x" * 200, rnd(20) + "ab" * 101 + rnd(20)]
    texts += [rnd(5) + long[200:440] + rnd(5) for _ in range(20)] + [long[:k] + "#" + long[k + 1 :] for k in range(20, 880, 61)]
    for df in (spark.createDataFrame([(i % 30, t) for i, t in enumerate(texts)], "doc_id long, text string"), docs):
        rows = texts_of(df)
        assert bag(digests(df)) == bag((i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows])))


def test_every_suffix(spark):
    """Plain refinement over all suffixes and the anchors agree, on repeats of all lengths around 200 bytes, nested and overlapping, and on repeated rows."""
    rng = random.Random(16)
    base = "".join(rng.choices("abcd", k=700))
    texts = [base, None, "", base[:300] + "#" + base[300:], base[100:299], base[150:350] + "é" + base[:199], "ab" * 160, "x" * 199 + "#" + "x" * 200, base[500:] + base[:250]]
    df = spark.createDataFrame([*enumerate(texts), (0, base), (None, base[20:260]), (None, base[20:260])], "doc_id long, text string")
    plain = sorted((r.doc_id, r.n_bytes, r.removed, bytes(r.kept)) for r in repeats.remove_repeats(df.filter("doc_id is not null"), repeats.every_suffix).collect())
    assert plain == sorted((r.doc_id, r.n_bytes, r.removed, bytes(r.kept)) for r in repeats.remove_repeats(df.filter("doc_id is not null")).collect())
    whole = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove_repeats(df, repeats.every_suffix).collect()]
    rows = texts_of(df)
    assert bag(whole) == bag((i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows]))) == bag(digests(df))


def test_anchors_in_chunks(monkeypatch):
    """Long texts are cut in chunks; anchors don't depend on where."""
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(97, 100, 3000), np.full(700, 98), rng.integers(97, 123, 900)]).astype(np.uint8)
    whole = repeats.anchors(data)
    monkeypatch.setattr(repeats, "CHUNK", 512)
    monkeypatch.setattr(repeats, "_POWERS", [])
    cut = repeats.anchors(data)

    def starts(x):
        return {(int(c), int(p) - int(j)) for c, _, p, j0, j1 in zip(*x) for j in range(j0, j1 + 1)}

    assert starts(whole) == starts(cut) and len({s for _, s in starts(whole)}) == len(data) - repeats.K + 1


def test_a_text_of_several_chunks(spark):
    """No anchor counts twice where a chunk ends; nothing else of a long text goes."""
    rng = random.Random(5)
    twice = "".join(rng.choices("abcdefgh", k=300))
    text = "".join(rng.choices("abcdefgh", k=2 * repeats.CHUNK)) + twice + "#" + "".join(rng.choices("abcdefgh", k=5000))
    rows = [(1, text), (2, "!" + twice + "?")]
    got = {x[0]: x[2:] for x in digests(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {k: (300, 1, hashlib.sha256(t.replace(twice, "").encode()).hexdigest()) for k, t in rows}


def test_anchors_once_a_place(monkeypatch):
    data = np.frombuffer(random.Random(6).randbytes(20_000), np.uint8)
    whole = repeats.anchors(data)
    monkeypatch.setattr(repeats, "CHUNK", 512)
    for x, y in zip(whole, repeats.anchors(data)):
        assert x.tolist() == y.tolist()


@pytest.fixture(scope="module")
def lattice():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Lattice(f.read(), 5)


def all_paths(lattice, part):
    arcs: dict = {i: [(i, j, *lattice.table[part[i:j]]) for j in range(i + 1, len(part) + 1) if part[i:j] in lattice.table] for i in range(len(part))}
    for i, found in arcs.items():
        if part[i] not in lattice.table:
            found.append((i, i + 1, lattice.unknown_score, -1))
    out = []

    def go(i, score, path):
        if i == len(part):
            out.append((score, lattice._ids(part, path)))
            return
        for a in arcs[i]:
            go(a[1], score + a[2], [*path, (a[0], a[1], a[3])])

    go(0, 0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the", "a cat", "aaaaaa", "é😀x", "  two", "Don't.stop", "x\ny", "1,2 (3)!"])
def test_n_best(lattice, text):
    every = all_paths(lattice, pieces.MARK + text.replace(" ", pieces.MARK))
    ids, scores, ways = lattice.encode(text)
    assert scores == [s for s, _ in every[: lattice.n_best]]
    lists = [ids.tolist()] + [pieces.apply_changes(ids.tolist(), w) for w in ways]
    assert len({tuple(x) for x in lists}) == len(lists)
    valid = {(s, tuple(x)) for s, x in every}
    assert all((s, tuple(x)) in valid and lattice.decode(x) == text for s, x in zip(scores, lists))


@pytest.mark.parametrize("part", ["abcab" * 2000, "é" * 5000, "aaaab" * 1500 + "😀"])
def test_n_best_of_long_parts(lattice, part):
    """Long parts go by arrays and a pruned agenda, with the same results as a plain table of the N best of each place."""
    best = [[(0, ())]]
    for j in range(1, len(part) + 1):
        found = []
        for i in range(max(0, j - lattice.deep), j):
            x = lattice.table.get(part[i:j]) or ((lattice.unknown_score, -1) if j == i + 1 else None)
            if x:
                found += [s + x[0] for s in (y[0] for y in best[i])]
        best.append([(s, ()) for s in sorted(found, reverse=True)[: lattice.n_best]])
    got = lattice.search(part)
    assert [s for s, _ in got] == [s for s, _ in best[-1]] and len({tuple(x) for _, x in got}) == len(got)
    ids, loss, score = lattice.best(part)
    assert np.frombuffer(ids, np.int32).tolist() == got[0][1] and score == got[0][0] and loss == (got[0][0] - got[1][0] if len(got) > 1 else pieces.ALONE)


def test_segment_rows(docs):
    for r in pieces.segment(docs).collect():
        assert r.round_trip and r.n_pieces == len(r.ids) and list(r.scores) == sorted(r.scores, reverse=True) and len(r.alternatives) == max(0, len(r.scores) - 1)


def test_language(spark):
    rng = random.Random(1)
    alphabets = {"xx": "abcde", "yy": "vwxyz", "zz": "éèçêà"}
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(60)), lang) for i, (lang, a) in enumerate(list(alphabets.items()) * 60)]
    rows += [(1000, None, "xx"), (1001, "12 34 !?", "yy"), (1002, "", None), (1003, "abcde " * 3000, None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [r for r in rows if got[r[0]].held_out and r[0] < 1000]
    assert held and sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred == "xx"
    none = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)


def test_language_scores_do_not_depend_on_the_batch():
    net = langid.train([("abc " * 50, "a"), ("xyz " * 50, "b")])
    s = langid.Scorer(net)
    texts = [b"abc xyz", b"x" * 127, b"y" * 128, b"abc" * 300]
    together = s.many(texts)
    assert all(np.allclose(together[k], s.many([t])[0], atol=1e-6) for k, t in enumerate(texts))


def test_gradients():
    s = langid.Settings(window=12, widths=(2, 3), filters=3, embedding=4)
    net = langid.Network(["a", "b", "c"], s)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 257, (4, 12)), np.array([0, 1, 2, 1])
    _, g = net.step(x, y)
    for name in ("out", "bytes", "filter2", "bias3"):
        w = net.w[name]
        at = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        old = w[at]
        w[at] = old + 1e-5
        up = net.step(x, y)[0]
        w[at] = old - 1e-5
        down = net.step(x, y)[0]
        w[at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name


def test_rule_ensemble(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        w = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(60)]
        rows.append((i, " ".join(x + "###" for x in w) if i % 3 == 0 else " ".join(w), int(i % 3 != 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = rule_ensemble.score_quality(df, df.select("doc_id", "quality")).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.97 * len(held)
    one = rule_ensemble.score_quality(df, df.limit(0).select("doc_id", "quality")).select("score").distinct().collect()
    assert [r.score for r in one] == [0.5]


def test_statistics_against_brute_force(docs):
    def brute(t):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        chars = len(re.sub(r"[\x20\x09-\x0D]", "", t))

        def count(some):
            return sum(t.count(c) for c in some)

        n, c, m = max(1, len(w)), max(1, chars), max(1, len(lines))
        return (len(w), chars / n, count("#*$%&<>@^~=_\\{}") / n, count("!?") / n, count("|") / n, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / c, count("0123456789") / c, sum(x.lower() in rule_ensemble.STOP_WORDS for x in w) / n, len(set(w)) / n, len(set(lines)) / m, len(w) / m, count(".,;:") / n)

    some = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = dict(texts_of(some))
    for r in rule_ensemble.statistics(some).collect():
        assert list(r)[1:] == pytest.approx(brute(texts[r.doc_id])), texts[r.doc_id]


def test_rules_compile_to_the_same_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, len(rule_ensemble.FEATURES)))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    e = rule_ensemble.fit(x, y)
    assert 0 < len(e.rules) < 120 and ((e.predict(x) > 0.5) == y).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(rule_ensemble.FEATURES))
    assert np.allclose([r[0] for r in df.select(e.column()).collect()], e.predict(x))


def brute_cross_entropy(rows, good):
    """rows: (doc_id, text); each document's own counts are left out."""
    words = [WORD.findall(t or "") for _, t in rows]
    mine = [i in good for i, _ in rows]
    order, weight = cross_entropy.ORDER, cross_entropy.WEIGHT

    def count(w):
        return collections.Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))

    each = [count(w) for w in words]
    every, target = sum(each, collections.Counter()), sum((c for c, m in zip(each, mine) if m), collections.Counter())
    n, m = sum(map(len, words)), sum(len(w) for w, x in zip(words, mine) if x)
    v = len({x for w in words for x in w}) + 1
    scale = m / n if n else 0
    out = []
    for (i, _), w, c, x in zip(rows, words, each, mine):
        losses = []
        for total, own, size, s in ((target, x, m, 1), (every, True, n, scale)):
            def at(g):
                return s * (total[g] - own * c[g])

            loss = 0.0
            for k in range(len(w)):
                p = (at((w[k],)) + 1) / (s * (size - own * len(w)) + v)
                for j in range(1, min(order, k + 1)):
                    p = (at(tuple(w[k - j : k + 1])) + weight * p) / (at(tuple(w[k - j : k])) + weight)
                loss -= math.log(p)
            losses.append(loss / len(w) if w else None)
        out.append((i, len(w), *losses))
    return out


def close(got, want):
    got = sorted(got, key=repr)
    want = sorted(want, key=repr)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want):
        assert [x is None for x in g[2:4]] == [x is None for x in w[2:4]] and all(x is None or x == pytest.approx(y, abs=1e-9) for x, y in zip(g[2:4], w[2:4])), (g, w)
        assert g[4] is None or g[4] == pytest.approx(g[2] - g[3], abs=1e-12)


def test_cross_entropy(spark, docs):
    texts = [(1, "the cat sat on the cat"), (2, "the cat sat there"), (5, "zz zz zz the"), (3, None), (4, " \t"), (6, "cat"), (6, "cat"), (None, "the cat")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    good = spark.createDataFrame([(1,), (2,), (2,), (77,), (None,)], "doc_id long")
    close([tuple(r) for r in cross_entropy.cross_entropy_difference(df, good).collect()], brute_cross_entropy(texts, {1, 2}))
    close([tuple(r) for r in cross_entropy.cross_entropy_difference(df, good.limit(0)).collect()], brute_cross_entropy(texts, set()))
    some = docs.filter("doc_id % 3 = 0").select("doc_id")
    for block in (300, 1 << 23):  # many blocks, or one
        got = [tuple(r) for r in cross_entropy.cross_entropy_difference(docs, some, block).collect()]
        close(got, brute_cross_entropy(texts_of(docs), {r.doc_id for r in some.collect()}))


def test_cross_entropy_of_many_grams():
    """More than 2^21 n-grams in one bucket are told apart, counts of frequent ones are whole, and those that occur once are 0."""
    rng = np.random.default_rng(2)
    blocks = [np.sort(rng.integers(0, 2**64, 1_100_000, dtype=np.uint64)) for _ in range(2)]
    blocks[1][::7] = blocks[0][::7]
    counts = [rng.integers(1, 3, len(b)) * 1_500_000_000 for b in blocks]
    counts[0][:1000] = 1
    rows = pa.table([pa.array([5, 5]), pa.array([3, 8]), pa.array([0, 1], pa.int32()), *(pa.array(x, pa.binary()) for x in ([cross_entropy._gaps(b) for b in blocks], [cross_entropy._packed(c, np.uint32) for c in counts], [cross_entropy._packed(c // 2, np.uint32) for c in counts]))], ["bucket", "block", "size", "codes", "n", "t"])
    got = {r["block"]: r for r in cross_entropy._answer(rows).to_pylist()}
    want = [c + np.where(np.arange(len(c)) % 7 == 0, other, 0) for c, other in zip(counts, counts[::-1])]
    for b, n in zip((3, 8), want):
        assert (cross_entropy._unpacked(got[b]["n"], np.int64) == np.where(n > 1, n, 0)).all()
    assert got[-1]["vocabulary"] == 1_100_000 and got[-1]["words"] == int(want[0].sum())


def test_cross_entropy_finds_copies(spark):
    """A document that occurs twice is told from the others by the background's loss; one in the target is held out of it."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=80))) for i in range(200)]
    rows += [(1000, rows[7][1]), (1001, rows[9][1])]
    got = {r.doc_id: r for r in cross_entropy.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(0, 200, 8)], "doc_id long")).collect()}
    twice = {7, 9, 1000, 1001}
    assert min(got[i].difference for i in twice) > max(got[i].difference for i in got if i not in twice)


def test_images_of_texts(docs):
    """All values of every text; the media are read again and hold the payload's pixels."""
    some = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    stored = {r.doc_id: bytes(r.media) for r in webp.store_texts(some).collect()}
    pixels = {r.doc_id: r for r in webp.read_media(webp.store_texts(some)).collect()}
    texts = dict(texts_of(some))
    for r in webp.texts_as_images(some).collect():
        payload, n = webp.padded(texts[r.doc_id])
        media, p = stored[r.doc_id], pixels[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and media[:4] == b"RIFF" and media[8:16] == b"WEBPVP8L"
        assert b"".join(bytes(x.pixels) for x in p.images) == payload and all(x.width * x.height * 4 == len(x.pixels) for x in p.images)
        each = np.frombuffer(payload, np.uint8).reshape(-1, 4)
        assert r.feature == p.feature and f"mean={each[:, 0].mean():.3f},{each[:, 1].mean():.3f},{each[:, 2].mean():.3f},{each[:, 3].mean():.3f};" in r.feature


def test_media_column(spark):
    """Null media give null arrays, media without images none; clashing columns do no harm."""
    text = webp.store(webp.padded("some text")[0])
    rows = [(1, None, "x"), (2, b"", "y"), (3, text + text, "z")]
    got = {r.doc_id: r for r in webp.read_media(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, media binary, feature string, images int")).collect()}
    assert got[1].images is None and got[2].images == [] and got[2].feature is None and len(got[3].images) == 2 and got[3].images[0] == got[3].images[1]


LONG = 1_000_000


def test_long_texts(spark):
    """Texts of about a million characters, each twice: results as defined, and in time in proportion to the text."""
    rng = random.Random(3)
    texts = [
        " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(LONG // 7)), "".join(rng.choices("abcdefgh", k=LONG)), " ".join(f"word{i % 50} u{i}@mail{i % 7}.org" for i in range(20_000)), "é" * (LONG // 2), "short text",
    ]
    rows = [(i, t, "de" if i % 2 else "en", "s") for i, t in enumerate(texts)]
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = one.unionByName(spark.createDataFrame([(10 + i, *r) for i, *r in rows], one.schema))
    whole = {r.doc_id: r for r in pii.find_pii(one).collect()}
    assert [whole[i].n_email for i in range(5)] == [0, 0, 20_000, 0, 0]
    spans = [tuple(map(int, x.split(":")[1:])) for x in whole[2].spans.split(",") if x.startswith("email")]
    assert all("@" in texts[2][a:b] and " " not in texts[2][a:b] for a, b in spans)
    clean = {r.doc_id: r.text for r in pii.sanitise(one).collect()}
    assert clean[2].count("<EMAIL>") == 20_000 and "@" not in clean[2] and clean[0] == texts[0] and clean[3] == texts[3]
    assert all(r.round_trip for r in pieces.segment(one).collect())
    assert {r.doc_id: len(r.kept) for r in repeats.remove_repeats(df).collect()} == {k + i: 0 if i < 4 else 10 for i in range(5) for k in (0, 10)}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == {k + i: i for i in range(5) for k in (0, 10)}
    assert langid.identify(one).count() == 5 and quality_rules.quality_rules(one).count() == 5
    assert cross_entropy.cross_entropy_difference(df, one.limit(0).select("doc_id")).count() == 10
    assert {r.doc_id: r.n_bytes for r in webp.texts_as_images(one).collect()} == {i: len(t.encode()) for i, t in enumerate(texts)}


def test_names_that_operators_use_inside(spark):
    """Columns with any of these names go through the operators that return the table's columns, untouched."""
    names = ["_kept", "_all", "_size", "_row", "_key", "_k", "_rank", "_copy", "_copies", "_rows", "_text", "_th", "_d", "_h", "_hash", "_w", "base", "terms", "size", "copies", "n_words", "kept", "rep", "label", "_P", "key"]
    rows = [(i, f"the word of document {i} and some more of the same kind " * 12 + f"mail me{i}@x.org", "en", "s", *range(i, i + len(names))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    for f in (quality_rules.keep_good, minhash.keep_one_of_each, pii.sanitise, mixing.resample):
        out = f(df)
        assert out.columns == df.columns
        for r in out.collect():
            assert list(r)[4:] == list(range(r.doc_id, r.doc_id + len(names))), f.__name__


def test_repeated_rows(spark):
    """Repeated rows share out the mix's copies exactly; of rows with one doc_id the same one always stays."""
    rows = [(i % 10, "w " * (i % 10 + 1) + "x" * (i // 10), f"s{i % 3}") for i in range(40)] + [(1, "w w x", "s1")] * 5 + [(None, "w w w", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df).agg(F.sum("taken")).first()[0]
    again = mixing.resample(df)
    assert again.agg(F.sum(F.size(F.split(F.trim("text"), " +")))).first()[0] == mixed
    assert bag(map(tuple, again.collect())) == bag(map(tuple, mixing.resample(df.repartition(3)).collect()))
    one = minhash.keep_one_of_each(df)
    assert bag(map(tuple, one.collect())) == bag(map(tuple, minhash.keep_one_of_each(df.repartition(3)).collect()))


def test_convolution_against_brute_force():
    """The scorer's windows, one at a time and one place after the other, on the network's own weights."""
    s = langid.Settings(window=16, widths=(2, 3), filters=3, embedding=4, epochs=1)
    net = langid.train([("abc " * 40, "a"), ("xyz " * 40, "b"), ("éèà " * 30, "c")], s)
    text = "abc xyz éè and more of it".encode()
    stream = np.concatenate([np.frombuffer(text, np.uint8).astype(int), np.full(40, langid.PAD)])
    probabilities = []
    for at in range(0, len(text) + 2, s.window):  # as many windows as hold the text and the places a filter reaches beyond
        h = []
        for k in s.widths:
            value = [sum(net.w["bytes"][stream[p + j]] @ net.w[f"filter{k}"][j] for j in range(k)) for p in range(at, at + s.window)]
            h.append(np.maximum(np.max(value, axis=0) + net.w[f"bias{k}"], 0))
        z = np.concatenate(h) @ net.w["out"] + net.w["out_bias"]
        probabilities.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert np.allclose(langid.Scorer(net).many([text])[0], np.mean(probabilities, axis=0), atol=1e-5)
    many = b"abc xyz " * 20_000
    assert np.allclose(langid.Scorer(net).many([many, text])[1], np.mean(probabilities, axis=0), atol=1e-5)
