"""The stages over a small corpus, each against brute force in plain Python, and the whole."""

import collections
import math
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from siteloom.llm import mixing, pii, quality_rules  # noqa: E402

from test_text_operators import PATTERNS, WORD, brute_spans, water  # noqa: E402

SF = "/root/testdata/sf0.001"


def good(text):
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    n = max(1, len(w))
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    has = {"n_words": len(w), "mean_word_chars": sum(map(len, w)) / n, "symbol_ratio": sum(c in "#*$%&|<>" for c in t) / n, "exclamation_ratio": t.count("!") / n, "stop_word_ratio": sum(x.lower() in quality_rules.STOP_WORDS for x in w) / n,
           "dup_line_ratio": (len(lines) - len(set(lines))) / max(1, len(lines)), "repeat_word_ratio": len(covered) / n}
    return all((r.low is None or has[r.metric] >= r.low) and (r.high is None or has[r.metric] <= r.high) for r in quality_rules.RULES)


def least_of_each(texts, width=5, percent=80):
    """texts: doc_id -> text; the least doc_ids of the components of near-duplicates."""
    sets, where = {}, collections.defaultdict(set)
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        for g in sets[i]:
            where[g].add(i)
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in sorted(sets):
        for b, both in collections.Counter(b for g in sets[a] for b in where[g] if b > a).items():
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {i for i in sets if find(i) == i}


def normal(kind, text):
    return text.lower() if kind == "email" else text if kind == "ip" else re.sub("[^0-9]", "", text)


def brute_sanitise(texts, p=pii.Disclosure()):
    """texts: doc_id -> text; (spans of terms, sanitised text) by the definition of the terms."""
    base = {i: brute_spans(t) for i, t in texts.items()}
    tokens, entities = {}, {}
    n = len(texts)
    seen = collections.Counter()
    for i, t in texts.items():
        seen.update({w.strip(pii.PUNCTUATION).lower() for w in WORD.findall(t or "")})
        entities[i] = {normal(PATTERNS[k][0], t[s:e]) for s, k, e in base[i]}
        blank = list(t or "")
        for s, _, e in base[i]:
            blank[s:e] = " " * (e - s)
        tokens[i] = []
        for m in WORD.finditer("".join(blank)):
            w = m.group().strip(pii.PUNCTUATION)
            if w:
                at = m.start() + len(m.group()) - len(m.group().lstrip(pii.PUNCTUATION))
                tokens[i].append((w.lower(), at, at + len(w)))
    n_c, n_ct = collections.Counter(), collections.Counter()
    for i in texts:
        n_c.update(entities[i])
        n_ct.update((c, w) for c in entities[i] for w in {x[0] for x in tokens[i]})
    share = {}
    for (c, w), k in n_ct.items():
        n_t, known = max(seen[w], k), math.log(n / n_c[c])
        expected = n_c[c] * n_t / n
        s = math.log(k * n / (n_c[c] * n_t)) / known if known > 0 else 0
        if s >= p.disclosure and k * math.log(k / expected) - k + expected >= p.bound:
            share[c, w] = s
    out = {}
    for i, t in texts.items():
        terms = []
        for w, a, b in tokens[i]:
            found = [share[c, w] for c in entities[i] if (c, w) in share]
            if found:
                terms.append((a, b, "" if max(found) >= p.removal else "<TERM>"))
        pieces, at = [], 0
        for s, e, tag in sorted([*((s, e, f"<{PATTERNS[k][0].upper()}>") for s, k, e in base[i]), *terms]):
            if s >= at:
                pieces += [t[at:s], tag]
            at = max(at, e)
        out[i] = ([x[:2] for x in terms], None if t is None else "".join([*pieces, t[at:]]))
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_stages_against_brute_force(spark, sf):
    """sf0.01 is the first that has revealing terms."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, sf).cache()
    want = {i: t for i, t in texts.items() if good(t)}
    assert {r.doc_id: r.text for r in kept.collect()} == want
    unique = stages["MinHash near-dedup"](spark, kept, sf).cache()
    want = {i: want[i] for i in least_of_each(want)}
    assert {r.doc_id: r.text for r in unique.collect()} == want
    clean = stages["PII"](spark, unique, sf).cache()
    after = brute_sanitise(want)
    assert {r.doc_id: r.text for r in clean.collect()} == {i: t for i, (_, t) in after.items()}
    rows = clean.collect()
    sizes: dict = collections.Counter()
    longest: dict = collections.Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text))
        longest[r.source] = max(longest[r.source], len(WORD.findall(r.text)))
    target = water(sizes)
    mixed = stages["mixing"](spark, clean, sf).cache()
    got = mixed.collect()
    taken: dict = collections.Counter()
    for r in got:
        taken[r.source] += len(WORD.findall(r.text))
    of = {r.doc_id: r for r in rows}
    assert all(of[r.doc_id] == r for r in got) and max(collections.Counter(r.doc_id for r in got).values()) <= mixing.MOST
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 for s in target)
    cut = stages["SentencePiece"](spark, mixed, sf)
    assert all(r.round_trip and r.scores == sorted(r.scores, reverse=True) for r in cut.collect()) and cut.count() == len(got)


def test_terms_against_brute_force(spark):
    """All term spans of sf0.01, which has some."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {i: sorted(terms) for i, (terms, _) in brute_sanitise({r.doc_id: r.text for r in docs.collect()}).items()}
    got = {r.doc_id: sorted(tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term")) for r in pii.find_pii(docs).collect()}
    assert got == want and sum(map(len, want.values())) > 0


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and counts[1] < counts[0]
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, tuple(r.ids)) for r in got.collect()) == sorted((r.doc_id, tuple(r.ids)) for r in docs.collect())


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
