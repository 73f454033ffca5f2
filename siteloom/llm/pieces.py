"""SentencePiece encoding and decoding with the N best segmentations of a text.

The piece lattice of a text falls apart where no piece can cross: before a run of word marks, around characters that only
stand alone, and, if the model has no piece across, after a letter before anything else. Each part gets a forward Viterbi pass. Its scores are exact heuristics for an A* search that runs back
from the end of the part: what it takes from its agenda is always on one of the N best paths. The N best of the text
are sums over the parts; a part's loss by its second-best path, which the forward pass gives as well, tells which N - 1
parts can differ at all in the N best of the text, and only these are searched.

Byte-pair models hold merge ranks and not log-probabilities; ranks become scores by Zipf's law. Scores are whole
thousandths, so sums are exact and ties are ties.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: The loss by the second best of a part that has but one segmentation.
ALONE = 1 << 60
#: Results of parts of up to so many characters are held; parts beyond LONG have their scores in arrays.
KEPT, LONG = 64, 4096
SCHEMA = "doc_id long, n_pieces long, ids array<int>, scores array<long>, alternatives array<array<struct<at:int,drop:int,ids:array<int>>>>, round_trip boolean"


class Lattice:
    """The pieces of a model (its bytes), and segmentation with them."""

    #: Short parts held with their results; then all are dropped.
    most = 1_000_000

    def __init__(self, proto: bytes, n_best: int = N_BEST):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = model.get_piece_size()
        ranks = sorted((-model.get_score(i), i) for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)))
        whole = all(x == int(x) for x, _ in ranks) and len({x for x, _ in ranks}) > len(ranks) // 2
        norm = math.log(sum(1 / (r + 1) for r in range(len(ranks))))
        self.n_best = n_best
        self.table: dict[str, tuple[int, int]] = {}
        self.bytes_of: list[bytes] = [b""] * size
        joined: set[str] = set()
        crossing = False
        worst = 0
        for rank, (cost, i) in enumerate(ranks):
            piece = model.id_to_piece(i)
            score = -round(1000 * (math.log(rank + 1) + norm)) if whole else -round(1000 * cost)
            worst = min(worst, score)
            self.table[piece] = (score, i)
            self.bytes_of[i] = piece.encode()
            if len(piece) > 1:
                joined |= set(piece)
                crossing |= MARK in piece.lstrip(MARK)
        # the pieces as a tree by character: each node has its children, and the score and id of the piece that ends there
        self.tree: dict[str, list] = {}
        for piece, (score, i) in self.table.items():
            children = self.tree
            for c in piece:
                node = children.setdefault(c, [{}, None, -1])
                children = node[0]
            node[1:] = score, i
        self.deep = max(map(len, self.table), default=1)
        self.unknown_score = worst - 10_000
        self.unknown = model.unk_id()
        self.byte_ids = {}
        for i in range(size):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[1:-1], 16)
                self.byte_ids[b] = i
                self.bytes_of[i] = bytes([b])
        letters = {c for c in joined if c.isalpha()}
        glue, alpha, rest = ("".join(map(re.escape, sorted(x))) for x in (joined - {MARK}, letters, joined - letters - {MARK}))
        pattern = rf"{MARK}*[{glue}]+|{MARK}+|[^{glue}{MARK}]"
        if crossing:
            pattern = "(?s:.+)"
        elif rest and not any(x in letters and y not in letters for p in self.table for x, y in zip(p, p[1:])):
            # no piece goes on after a letter with anything but letters, so parts end there
            pattern = rf"{MARK}*[{rest}]*[{alpha}]+|{MARK}*[{rest}]+|{MARK}+|[^{glue}{MARK}]"
        self.parts = re.compile(pattern).findall
        self.known: dict[str, tuple[bytes, int, int]] = {}
        self.lists: dict[str, list[tuple[int, list[int]]]] = {}

    def _ending(self, part: str, at: int) -> list[tuple[int, int, int]]:
        """(start, score, id) of the pieces that end at a place, the shortest first; an id of -1 is a character without a piece."""
        out = []
        for n in range(1, min(self.deep, at) + 1):
            x = self.table.get(part[at - n : at])
            if x is not None:
                out.append((at - n, *x))
            elif n == 1:
                out.append((at - 1, self.unknown_score, -1))
        return out

    def _ids(self, part: str, path: list[tuple[int, int, int]]) -> list[int]:
        out = []
        for i, j, piece in path:
            if piece >= 0:
                out.append(piece)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in part[i:j].encode()]
            else:
                out.append(self.unknown)
        return out

    def _forward(self, part: str) -> tuple[Sequence[int], Sequence[int], Sequence[int], Sequence[int]]:
        """The best and the second-best score of each place, and the start and id of the best last piece there."""
        tree, n, least, deep = self.tree, len(part), -(1 << 60), self.deep
        if n > LONG:
            first, second, back, piece_at = array("q", [least]) * (n + 1), array("q", [least]) * (n + 1), array("q", [0]) * (n + 1), array("i", [0]) * (n + 1)
        else:
            first, second, back, piece_at = [least] * (n + 1), [least] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        first[0] = 0
        for i in range(n):
            one, children, single = first[i], tree, False
            j = i
            for c in part[i : i + deep]:
                node = children.get(c)
                if node is None:
                    break
                children, s, piece = node
                j += 1
                if s is not None:
                    t = one + s
                    if t > first[j]:  # of equal ones the first, so the longest last piece
                        u = first[j]
                        s += second[i]
                        second[j] = u if u > s else s
                        first[j] = t
                        back[j] = i
                        piece_at[j] = piece
                    elif t > second[j]:
                        second[j] = t
                    if j == i + 1:
                        single = True
            if not single:
                j = i + 1
                t = one + self.unknown_score
                if t > first[j]:
                    second[j] = max(first[j], second[i] + self.unknown_score)
                    first[j] = t
                    back[j] = i
                    piece_at[j] = -1
                elif t > second[j]:
                    second[j] = t
        return first, second, back, piece_at

    def best(self, part: str) -> tuple[bytes, int, int]:
        """The best segmentation's ids as 32-bit numbers, the loss by the second best, and the score."""
        first, second, back, piece_at = self._forward(part)
        n = len(part)
        path, j, strange = array("i"), n, False
        while j:
            piece = piece_at[j]
            path.append(piece)
            strange |= piece < 0
            j = back[j]
        path.reverse()
        if strange:
            steps, j = [], n
            while j:
                steps.append((back[j], j, piece_at[j]))
                j = back[j]
            path = array("i", self._ids(part, steps[::-1]))
        loss = first[n] - second[n] if second[n] > -(1 << 59) else ALONE
        return path.tobytes(), loss, first[n]

    def search(self, part: str) -> list[tuple[int, list[int]]]:
        """The N best segmentations of a part as (score, ids), the best first; of equal ones, those with longer last pieces.

        Each entry of the agenda completes to a path with just its total, so all but its N best can go.
        """
        out = self.lists.get(part)
        if out is None:
            if len(self.lists) >= self.most // 20:
                self.lists.clear()
            forward = self._forward(part)[0]
            out, serial = [], 0
            # an agenda by the total of forward and path score; of equal ones the last pushed, which is the furthest on
            agenda = [(-forward[len(part)], 0, len(part), 0, None)]
            while agenda and len(out) < self.n_best:
                _, _, at, behind, path = heapq.heappop(agenda)
                if not at:
                    steps = []
                    while path:
                        steps.append(path[0])
                        path = path[1]
                    out.append((behind, self._ids(part, steps)))
                    continue
                for i, s, piece in self._ending(part, at):  # the longest piece is pushed last
                    serial -= 1
                    heapq.heappush(agenda, (-(forward[i] + s + behind), serial, i, behind + s, ((i, at, piece), path)))
                if len(agenda) > 16 * self.n_best:
                    agenda = heapq.nsmallest(self.n_best, agenda)
            if len(part) <= KEPT:
                self.lists[part] = out
        return out

    def encode(self, text: str) -> tuple[np.ndarray, list[int], list[list[tuple[int, int, list[int]]]]]:
        """The best ids, the scores of the N best, and for each but the best how it differs from it: (place, ids dropped, ids there instead)."""
        parts = self.parts(MARK + text.replace(" ", MARK))
        found = list(map(self.known.get, parts))
        if None in found:
            if len(self.known) >= self.most:
                self.known.clear()
            for k, x in enumerate(found):
                if x is None:
                    x = self.known.get(parts[k])
                    if x is None:
                        x = self.best(parts[k])
                        if len(parts[k]) <= KEPT:
                            self.known[parts[k]] = x
                    found[k] = x
        pieces, losses, points = zip(*found)
        ids = np.frombuffer(b"".join(pieces), np.int32)
        total = sum(points)
        order = np.argsort(np.array(losses, np.int64), kind="stable")[: self.n_best - 1]
        chosen = sorted(k for k in order.tolist() if losses[k] < ALONE)
        lists = [self.search(parts[k]) for k in chosen]
        # choices are tuples of places in the lists; every one but the first is reached once, by raising its last place that isn't 0
        agenda, scores, ways = [(-total, (0,) * len(chosen), 0)], [], []
        while agenda and len(scores) < self.n_best:
            loss, choice, first = heapq.heappop(agenda)
            scores.append(-loss)
            ways.append(choice)
            for k in range(first, len(chosen)):
                if choice[k] + 1 < len(lists[k]):
                    new = (*choice[:k], choice[k] + 1, *choice[k + 1 :])
                    heapq.heappush(agenda, (loss + lists[k][choice[k]][0] - lists[k][choice[k] + 1][0], new, k))
        if len(ways) > 1:
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in pieces])])
        return ids, scores, [[(int(at[k]), len(pieces[k]) // 4, lists[x][way[x]][1]) for x, k in enumerate(chosen) if way[x]] for way in ways[1:]]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text.removeprefix(" ")


def apply_changes(ids: list[int], changes: list[tuple[int, int, list[int]]]) -> list[int]:
    """The ids of one of the N best from the best ones and the changes that encode() returns."""
    out = list(ids)
    for at, drop, new in reversed(changes):
        out[at : at + drop] = new
    return out


def _encoder(proto: bytes, n_best: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    change = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what is held are tuples of numbers and bytes, without cycles; looking through them for cycles takes a tenth of the time
        gc.disable()
        try:
            yield from rows(batches)
        finally:
            gc.enable()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(proto, n_best)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids, scores, changes, same = [], [], [], []
                for value in part.column(1):
                    text = value.as_py() or ""
                    if not text:
                        ids.append(np.empty(0, np.int32)), scores.append([]), changes.append([]), same.append(True)
                        continue
                    best, points, ways = lattice.encode(text)
                    ids.append(best), scores.append(points)
                    changes.append([[{"at": a, "drop": d, "ids": i} for a, d, i in way] for way in ways])
                    same.append(lattice.decode(best.tolist()) == text)
                n = np.array([len(x) for x in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n), lists, pa.array(scores, pa.list_(pa.int64())), pa.array(changes, change), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids", "scores", "alternatives", "round_trip"])

    return run


def segment(df: DataFrame, model: str = MODEL, n_best: int = N_BEST) -> DataFrame:
    """One row per row of df (doc_id, text): the ids of the best segmentation, the scores of the N best (in thousandths),

    the changes that make the others of the best ids, and whether the ids decode to the text. Null and empty texts have no
    ids, scores or alternatives. A text may have fewer than N segmentations. A text with the word mark itself as a
    character doesn't decode to itself, as in every such model. Other columns aren't read; an empty df gives no rows.
    The model file is read on the driver and sent along.
    """
    with open(model, "rb") as f:
        proto = f.read()
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoder(proto, n_best), SCHEMA)
