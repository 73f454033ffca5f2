"""Tokenizer alignment against a walk over the tokens of one text after the other."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siteloom.llm import alignment
from siteloom.llm.alignment import A_FILE, B_FILE, MARK, Aligner, align_tokenizers


@pytest.fixture(scope="module")
def aligner():
    return Aligner(open(A_FILE, "rb").read(), open(B_FILE, "rb").read())


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def walked(rows, tokenizers, bytes_a, bytes_b):
    """The contract's columns by a walk along both token lists."""
    a_tok, b_tok = tokenizers
    found, total = [], collections.Counter()
    for doc_id, text in rows:
        a, b = (a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[i] for i in a) != raw or b"".join(bytes_b[i] for i in b) != raw:
            found.append((doc_id, 0, 0, [], []))
            continue
        i = j = 0
        end_a, end_b = len(bytes_a[a[0]]), len(bytes_b[b[0]])
        links, groups, own = [], [], [[a[0]], [b[0]]]
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a and step_b:
                groups.append("|".join(",".join(map(str, x)) for x in own))
                own = [[], []]
                if end_a == len(raw):
                    break
            if step_a:
                i += 1
                end_a += len(bytes_a[a[i]])
                own[0].append(a[i])
            if step_b:
                j += 1
                end_b += len(bytes_b[b[j]])
                own[1].append(b[j])
        total.update(links)
        found.append((doc_id, len(a), len(b), groups, links))
    highest = collections.Counter()
    for (_, y), n in total.items():
        highest[y] = max(highest[y], n)
    return sorted(((d, na, nb, len(g), len(x), sum(total[p] == highest[p[1]] for p in x), sum(total[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, x in found), key=repr)


def test_against_a_walk(spark, aligner, tokenizers, monkeypatch):
    rng = random.Random(5)
    words = ["the", "ation", "über", "naïve", "日本", "😀", "x1y2", "don't", "<|endoftext|>", "</s>", "12345", "é", " ", "a\nb", "\t\t", "  ", "<0x41>", "ﬁ"]
    texts = [None, "", " ", "  lead", "trail ", "\n", "▁", f"a{MARK}b", "\x00", "<|endoftext|>", "same twice", "same twice", "x" * 5000, " " * 5000 + "y", "ab " * 3000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    rows = [(k, t, "z") for k, t in enumerate(texts)] + [(None, "no id", "z"), (3, "  lead", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string").repartition(3)
    want = walked([r[:2] for r in rows], tokenizers, aligner.a.bytes_of, aligner.b.bytes_of)
    assert sorted(map(tuple, align_tokenizers(df).collect()), key=repr) == want
    assert align_tokenizers(df.limit(0)).count() == 0


def test_pieces_units_and_blocks_change_nothing(aligner, tokenizers, monkeypatch):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdeéü ") for _ in range(rng.randint(1, 9))) for _ in range(900))
    whole = aligner.tokens(" " + text)
    monkeypatch.setattr(alignment, "PIECE", 50)
    parts = [aligner.tokens(p) for p in aligner.pieces(" " + text)]
    assert len(parts) > 50
    assert all((np.concatenate([p[k] for p in parts]) == whole[k]).all() for k in (0, 1))
    one, two = aligner.align([whole], np.zeros(1, int), 1), aligner.align(parts, np.zeros(len(parts), int), 1)
    assert (one[0] == two[0]).all() and one[1] == two[1] and all((x == y).all() for x, y in zip(one[2:], two[2:]))


def test_a_long_text_in_many_units(spark, aligner, tokenizers):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    text = " ".join(rng.choice(words) for _ in range(700_000))  # over 4 MB: several units, a block of its own
    rows = [(1, text), (2, text[:1000]), (3, "y" * 600_000)]
    got = sorted(map(tuple, align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == walked(rows, tokenizers, aligner.a.bytes_of, aligner.b.bytes_of)


def test_the_fast_encoder_is_the_general_one(aligner, tokenizers):
    assert aligner.a.fast
    own = [t.decode() for t in aligner.a.bytes_of if t and not t.decode("utf-8", "replace").count("�")]
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    lines = own + ["".join(f" {c}a{c}{c}  {c}'s" for c in chars[k : k + 64]) for k in range(0, len(chars), 64)]
    want = tokenizers[0].encode_batch(lines, add_special_tokens=False)
    assert all(aligner.a.encode(t).tolist() == w.ids for t, w in zip(lines, want))
