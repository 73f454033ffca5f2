"""Alignment of two tokenizers over the same bytes.

The tokens of both are laid end to end over the bytes of many texts at once, with the texts' byte offsets beside them.
One count of token ends per byte for each tokenizer gives everything: where both end is a cut between groups, where either
ends closes one link (a link is a stretch of bytes within one token of each), and running sums of the ends are the places
in the token lists. Differences of running sums at the texts' borders are the results of each text.

How often ids are linked over the corpus is counted by blocks of texts: a block sends its distinct id pairs with counts,
totals come from one grouping by pair, and each block gets the totals of its own pairs back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: The pattern that splits text before byte pairs are merged (a fixed value of this kind of tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters: of a piece of text that is encoded at once, of the pieces that are aligned at once, of a block of texts.
PIECE, UNIT, BLOCK = 1 << 18, 1 << 20, 4 << 20
#: A pair of ids is a * 2^SHIFT + b.
SHIFT = 20
DOCS = "array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,at:array<int>,n:array<int>>>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


class ByteLevel:
    """Tokenizer A: byte pairs, from its own file (bytes).

    Where the file's merges are listed in the order of their ids, as is usual, a faster encoder with the same ranks serves;
    runs of one kind that are long for it go to the general one, as does all text otherwise. Results are the same.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        self.general = Tokenizer.from_str(raw.decode())
        self.general.encode_special_tokens = True
        vocabulary = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        # the letters that stand for bytes: printable ones for themselves, others from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
        special = {t["content"] for t in spec["added_tokens"]}
        tokens = {bytes(letter[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]))
        for t, i in tokens.items():
            self.bytes_of[i] = t
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"] and not model.get("dropout") and not model.get("ignore_merges")
        #: Whether texts may be cut before a space that follows a letter or sign.
        self.cuts = plain
        self.fast = None
        if plain and all(vocabulary.get(x + y) == 256 + k for k, (x, y) in enumerate(merges)) and set(range(256)) == {vocabulary[c] for c in letter if c in vocabulary}:
            import tiktoken

            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={}).encode_to_numpy

    def encode(self, text: str) -> np.ndarray:
        if self.fast and not _LONG_RUN.search(text):
            return self.fast(text, disallowed_special=()).astype(np.int64)
        return np.array(self.general.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """Tokenizer B: a model of pieces (bytes), which puts a mark before the text by itself."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        m = self.model
        self.bytes_of = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(m.get_piece_size())]
        #: Whether a mark only ever begins a piece; then texts may be cut before a single space.
        self.cuts = not any(MARK in m.id_to_piece(i).lstrip(MARK) for i in range(m.get_piece_size()))

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


class Aligner:
    """Both tokenizers and tables over their ids."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.a, self.b = ByteLevel(a_file), Pieces(b_file)
        self.size_a, self.size_b = (np.array([len(t) for t in x.bytes_of], np.int64) for x in (self.a, self.b))
        top = max(len(self.size_a), len(self.size_b))
        assert top <= 1 << SHIFT
        #: Decimal ids followed by each of the three signs.
        self.signs = [f"{i}{c}".encode() for c in ",|;" for i in range(top)]
        self.top = top

    def pieces(self, text: str) -> Iterator[str]:
        """A text in pieces that both tokenizers treat alike alone and in place: each begins with one space after a letter or sign."""
        at = 0
        while len(text) - at > PIECE and self.a.cuts and self.b.cuts:
            m = _CUT.search(text, at + PIECE)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def tokens(self, piece: str) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Ids of both for a piece that begins with a space, and its bytes; None if either doesn't give the bytes back."""
        raw = piece.encode()
        a, b = self.a.encode(piece), self.b.encode(piece[1:])
        for ids, tok in ((a, self.a), (b, self.b)):
            table = tok.bytes_of
            if b"".join([table[i] for i in ids.tolist()]) != raw:
                return None
        return a, b, len(raw)

    def align(self, parts: list[tuple[np.ndarray, np.ndarray, int]], owner: np.ndarray, texts: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Parts of texts (owner: of which, ascending) -> (n_a, n_b, n_groups, n_links) of each text, its groups spelled out,

        and (text, pair, count) for the distinct linked pairs of each text.
        """
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        offsets = np.cumsum([p[2] for p in parts])
        total = int(offsets[-1])
        ends_a, ends_b = (np.bincount(np.cumsum(size[ids]) - 1, minlength=total).astype(bool) for size, ids in ((self.size_a, a), (self.size_b, b)))
        upto_a, upto_b = np.cumsum(ends_a), np.cumsum(ends_b)  # tokens that have ended, this byte included
        links = np.flatnonzero(ends_a | ends_b)
        cut = np.flatnonzero(ends_a & ends_b)
        # the tokens that hold the byte where a link closes
        pair = (a[upto_a[links] - ends_a[links]] << SHIFT) | b[upto_b[links] - ends_b[links]]
        border = np.zeros(texts + 1, np.int64)
        np.maximum.at(border, owner + 1, offsets)
        border = np.maximum.accumulate(border)
        run_a, run_b = (np.concatenate([[0], x])[border] for x in (upto_a, upto_b))
        run_cut, run_link = np.searchsorted(cut, border), np.searchsorted(links, border)
        numbers = np.stack([np.diff(x) for x in (run_a, run_b, run_cut, run_link)], 1)
        # groups: A's tokens of a group, then B's; a token's place is its own plus the other's that come before
        group_a, group_b = upto_a[cut], upto_b[cut]  # tokens of each up to the end of a group
        size_a, size_b = np.diff(group_a, prepend=0), np.diff(group_b, prepend=0)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(group_b - size_b, size_a)] = a
        codes[np.arange(len(b)) + np.repeat(group_a, size_b)] = b
        codes[group_a + group_b - size_b - 1] += self.top  # the last of A's in a group: |
        codes[group_a + group_b - 1] += 2 * self.top  # of B's: ;
        signs = self.signs
        spelled = []
        for k in range(texts):
            spelled.append(b"".join([signs[c] for c in codes[run_a[k] + run_b[k] : run_a[k + 1] + run_b[k + 1]].tolist()]))
        text_of = np.repeat(np.arange(texts), numbers[:, 3])
        keys, n = np.unique((text_of << (2 * SHIFT)) | pair, return_counts=True)
        return numbers, spelled, keys >> (2 * SHIFT), keys & ((1 << (2 * SHIFT)) - 1), n


class _Text:
    """What is known of a text whose pieces come one after the other."""

    def __init__(self, doc_id: int | None):
        self.doc_id, self.numbers, self.sha, self.last = doc_id, np.zeros(4, np.int64), hashlib.sha256(), b""
        self.pairs, self.counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        self.good = True

    def add(self, numbers: np.ndarray, spelled: bytes, pairs: np.ndarray, counts: np.ndarray) -> None:
        self.numbers += numbers
        self.sha.update(self.last + spelled[:-1])
        self.last = spelled[-1:]
        self.pairs.append(pairs)
        self.counts.append(counts)
        if len(self.pairs) > 8:
            self.shrink()

    def shrink(self) -> None:
        pairs, back = np.unique(np.concatenate(self.pairs), return_inverse=True)
        counts = np.bincount(back, np.concatenate(self.counts), len(pairs)).astype(np.int64)
        self.pairs, self.counts = [pairs], [counts]

    def close(self) -> None:
        if not self.good:
            self.__init__(self.doc_id)
        if len(self.pairs) > 2:
            self.shrink()
        self.pairs, self.counts = [np.concatenate(self.pairs)], [np.concatenate(self.counts)]


def _blocks(a_file: bytes, b_file: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_file, b_file)
        numbers = count(TaskContext.get().partitionId() << 33)
        texts: list[_Text] = []
        waiting: list[tuple[int, tuple]] = []
        size = held = 0

        def align() -> None:
            nonlocal waiting, size
            own = sorted({k for k, _ in waiting})
            place = {k: j for j, k in enumerate(own)}
            if waiting:
                figures, spelled, of, pair, n = aligner.align([p for _, p in waiting], np.array([place[k] for k, _ in waiting]), len(own))
                border = np.searchsorted(of, np.arange(len(own) + 1))
                for j, k in enumerate(own):
                    texts[k].add(figures[j], spelled[j], pair[border[j] : border[j + 1]], n[border[j] : border[j + 1]])
            waiting, size = [], 0

        def block() -> pa.RecordBatch:
            nonlocal texts, held
            align()
            for t in texts:
                t.close()
            every, each = (np.concatenate([x for t in texts for x in getattr(t, k)]) for k in ("pairs", "counts"))
            pairs, back = np.unique(every, return_inverse=True)
            counts = np.bincount(back, each, len(pairs)).astype(np.int64)
            ends = np.cumsum([len(t.pairs[0]) for t in texts])
            at = np.split(back.astype(np.int32), ends[:-1])
            docs = [{"doc_id": t.doc_id, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), t.numbers.tolist())), "groups_sha256": t.sha.hexdigest() if t.numbers[0] else "", "at": at[k], "n": t.counts[0].astype(np.int32)} for k, t in enumerate(texts)]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))]))
            texts, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), pa.array([docs], kind), pa.array([pairs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], ["block", "docs", "pairs", "counts"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1)):
                text = text.as_py()
                t = _Text(doc_id)
                texts.append(t)
                for piece in aligner.pieces(" " + text) if text else ():
                    found = aligner.tokens(piece)
                    if found is None:
                        t.good = False
                        waiting = [w for w in waiting if w[0] != len(texts) - 1]
                        break
                    waiting.append((len(texts) - 1, found))
                    size += len(piece)
                    held += len(piece)
                    if size >= UNIT:
                        align()
                if held >= BLOCK or len(texts) >= 20_000:
                    yield block()
        if texts:
            yield block()

    return run


def _answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """One block: its texts, and for each of its distinct pairs the corpus' count and whether that is its B id's highest."""
    right = right.sort_by("pair")
    n, best = right["total"].to_numpy(), right["best"].to_numpy().astype(bool)
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")}
    for docs in left["docs"].combine_chunks():
        for d in docs.values if docs.is_valid else ():
            at, own = (np.asarray(d[k].values, np.int64) for k in ("at", "n"))
            for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"):
                out[k].append(d[k].as_py())
            out["n_best"].append(int(own[best[at]].sum()))
            out["count_sum"].append(int((own * n[at]).sum()))
    types = {"groups_sha256": pa.string()}
    return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})


def align_tokenizers(df: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per row of df (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    a_file and b_file are the tokenizers' files; the driver reads them. Texts that are null, empty or not given back by
    either tokenizer byte for byte have no tokens: zeros and ''. Special tokens' strings are plain text. Ties for the
    highest count all count as best. Repeated rows give repeated rows and count each; a null doc_id stays null; other
    columns aren't read. An empty table gives none. Texts of any length are encoded in pieces.
    """
    with open(a_file, "rb") as a, open(b_file, "rb") as b:
        run = _blocks(a.read(), b.read())
    blocks = materialise(df.select("doc_id", "text").mapInArrow(run, f"block long, docs {DOCS}, pairs array<long>, counts array<long>"), "alignment")
    totals = materialise(blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("total")), "alignment-pairs")
    b_id = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    # one row for each id of B at most
    highest = F.broadcast(totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("highest")))
    known = totals.withColumn("b", b_id).join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    answers = blocks.select(F.col("block").alias("asked_by"), F.explode("pairs").alias("pair")).join(known, "pair")
    return blocks.select("block", "docs").groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(_answered, RESULT)
