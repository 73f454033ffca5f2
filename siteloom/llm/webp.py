"""Lossless WebP in numpy: a decoder of the whole format, and an encoder that can use all of it.

Prefix codes are decoded without a step per bit: for every bit place of a block the length of the pixel that would start
there is looked up, then the true starts are followed through that table, and the pixels at them are decoded at once.
Copies and cache codes are resolved in order afterwards.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the order of code length codes, and the (x, y) offsets of short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTHS = 24
BLOCK = 1 << 17
_REVERSED: dict[int, np.ndarray] = {}
_SHIFTS = np.arange(8, dtype=np.uint32)


def _reversed_bits(n: int) -> np.ndarray:
    if n not in _REVERSED:
        x = np.arange(1 << n)
        out = np.zeros_like(x)
        for k in range(n):
            out |= (x >> k & 1) << (n - 1 - k)
        _REVERSED[n] = out
    return _REVERSED[n]


def _bytes_of(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) channels blue, green, red, alpha of packed pixels."""
    return np.ascontiguousarray(pixels, "<u4").reshape(-1).view(np.uint8).reshape(-1, 4)


def _packed(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, np.uint8).view("<u4").reshape(-1)


# ---------------------------------------------------------------- decoding


class Code:
    """A canonical prefix code as tables over the next `bits` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.bits = 0
            self.symbol, self.length = np.array([used[0] if len(used) else 0], np.int32), np.zeros(1, np.int32)
            return
        n = lengths[used]
        order = np.argsort(n, kind="stable")
        used, n = used[order], n[order]
        self.bits = int(n[-1])
        span = 1 << (self.bits - n)
        if span.sum() != 1 << self.bits:
            raise ValueError("incomplete prefix code")
        back = _reversed_bits(self.bits)
        self.symbol = np.repeat(used.astype(np.int32), span)[back]
        self.length = np.repeat(n.astype(np.int32), span)[back]


class Reader:
    def __init__(self, data: bytes):
        self.data = data + b"\0" * 16
        self.at = 0
        self.last: tuple = (0, 0, 0, 0, None)
        self.spelled = 0

    def bits(self, n: int) -> int:
        k = self.at >> 3
        out = int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7) & (1 << n) - 1
        self.at += n
        return out

    def symbol(self, code: Code) -> int:
        if not code.bits:
            return int(code.symbol[0])
        k = self.at >> 3
        x = int.from_bytes(self.data[k : k + 4], "little") >> (self.at & 7) & (1 << code.bits) - 1
        self.at += int(code.length[x])
        return int(code.symbol[x])

    def value(self, prefix: int) -> int:
        """The number for a length or distance prefix."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.bits(extra) + 1

    def code(self, size: int) -> Code:
        """The code at the reader. One that is spelled like the last one is that one, for as many symbols or if the spelling doesn't hang on their number."""
        bits, spelling, of, symbols, code = self.last
        k = self.at >> 3
        if code and (size == of or 0 < symbols <= size) and int.from_bytes(self.data[k : k + (bits >> 3) + 2], "little") >> (self.at & 7) & (1 << bits) - 1 == spelling:
            self.at += bits
            return code
        begin = self.at
        code = self._read_code(size)
        bits = self.at - begin
        k = begin >> 3
        self.last = (bits, int.from_bytes(self.data[k : k + (bits >> 3) + 2], "little") >> (begin & 7) & (1 << bits) - 1, size, self.spelled, code)
        return code

    def _read_code(self, size: int) -> Code:
        """A code; `spelled` is how many symbols its spelling told of, 0 if it ended with the alphabet."""
        self.spelled = 256
        lengths = np.zeros(size, np.int64)
        if self.bits(1):
            two, wide = self.bits(1), self.bits(1)
            lengths[self.bits(8 if wide else 1)] = 1
            if two:
                lengths[self.bits(8)] = 1
            return Code(lengths)
        first = np.zeros(19, np.int64)
        for k in range(4 + self.bits(4)):
            first[LENGTH_ORDER[k]] = self.bits(3)
        of_lengths = Code(first)
        left = size
        if self.bits(1):
            left = 2 + self.bits(2 + 2 * self.bits(3))
        at, last = 0, 8
        symbol, length, bits = of_lengths.symbol.tolist(), of_lengths.length.tolist(), (1 << of_lengths.bits) - 1
        out: list[int] = []
        x, fresh = 0, 0  # the next `fresh` bits are in x
        while len(out) < size and left:
            left -= 1
            if fresh < 16:
                k = self.at >> 3
                x, fresh = int.from_bytes(self.data[k : k + 128], "little") >> (self.at & 7), 1016
            n = length[x & bits]
            s = symbol[x & bits]
            x >>= n
            if s < 16:
                out.append(s)
                last = s or last
            elif s == 16:
                out += [last] * (3 + (x & 3))
                x >>= 2
                n += 2
            elif s == 17:
                out += [0] * (3 + (x & 7))
                x >>= 3
                n += 3
            else:
                out += [0] * (11 + (x & 127))
                x >>= 7
                n += 7
            fresh -= n
            self.at += n
        self.spelled = 0 if left else len(out)
        lengths[: len(out)] = out[:size]
        return Code(lengths)


def _windows(data: np.ndarray, start: int, count: int) -> np.ndarray:
    """The next 15 bits at `count` bit places from start, a multiple of 8."""
    k = start >> 3
    b = data[k : k + (count + 7 >> 3) + 2].astype(np.uint32)
    three = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    return ((three[:, None] >> _SHIFTS) & 0x7FFF).reshape(-1)[:count].astype(np.int32)


def _pixel_lengths(codes: list[Code], w: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bit place: the bits of a literal pixel there, and the green symbol."""
    green, red, blue, alpha = codes[:4]
    far = len(w) - 1

    def then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = first + _PLACES[: len(w)]
        np.minimum(at, far, out=at)
        return first + second.take(at)

    if green is red is blue is alpha and green.bits:
        one = green.length.take(w & ((1 << green.bits) - 1))
        two = then(one, one)
        total = then(two, two)
    else:
        total = n = last = None
        for code in (alpha, blue, red, green):
            if code.bits:
                n = n if code is last else code.length.take(w & ((1 << code.bits) - 1))
                total, last = n if total is None else then(n, total), code
        if total is None:
            total = np.zeros(len(w), np.int32)
    if green.bits:
        symbol = green.symbol.take(w[:count] & ((1 << green.bits) - 1))
    else:
        symbol = np.full(count, green.symbol[0], np.int32)
    return total[:count], symbol


_PLACES = np.arange(BLOCK + 128, dtype=np.int32)
#: What stands after the places of a block, as far as a pixel can reach.
_BEYOND = np.full(64, -1, np.int32)


def _literals(codes: list[Code], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pixels that start at the bit places b of a block with the windows w."""
    channel = []
    for code in codes[:4]:
        if not code.bits:
            channel.append(np.uint32(code.symbol[0]))
            continue
        x = w.take(b) & ((1 << code.bits) - 1)
        channel.append(code.symbol.take(x).view(np.uint32))
        b = b + code.length.take(x)
    green, red, blue, alpha = channel
    return np.broadcast_to(alpha << 24 | red << 16 | green << 8 | blue, len(b))


def _pixels(r: Reader, w: int, h: int, main: bool) -> np.ndarray:
    """The entropy-coded image at the reader: w * h packed pixels."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    total = w * h
    groups, group_of = 1, None
    if main and r.bits(1):
        shift = r.bits(3) + 2
        gw, gh = -(-w >> shift), -(-h >> shift)
        meta = (_pixels(r, gw, gh, False).astype(np.int64) >> 8 & 0xFFFF).reshape(gh, gw)
        groups = int(meta.max()) + 1
        group_of = meta[np.arange(h)[:, None] >> shift, np.arange(w)[None, :] >> shift].reshape(-1).tolist()
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[r.code(n) for n in sizes] for _ in range(groups)]
    data = np.frombuffer(r.data, np.uint8)

    starts: list[np.ndarray] = []  # bit places of literals
    places: list[int] = []  # first literal of each run of them, and how many there are
    counts: list[int] = []
    events: list[tuple[int, int, int]] = []  # (place, length, distance), or (place, 0, cache index)
    done, at, base, held, only = 0, r.at, None, 0, None
    if all(not c.bits for c in codes[0][:4]) and groups == 1 and codes[0][0].symbol[0] < 256:
        c = codes[0]
        places, counts, done = [0], [total], total
        only = np.full(total, c[3].symbol[0] << 24 | c[1].symbol[0] << 16 | c[0].symbol[0] << 8 | c[2].symbol[0], np.uint32)
    follow: list[memoryview] = []
    values: list[np.ndarray] = []  # pixels of the blocks that are done
    padded = read = None

    def block() -> None:
        """The pixels at the starts found in the block, by its windows."""
        nonlocal starts, read
        if not starts:
            return
        b = np.concatenate(starts) if len(starts) > 1 else starts[0]
        starts = []
        if groups == 1:
            x = _literals(codes[0], padded, b)
        else:
            of, x = np.array(read), np.empty(len(b), np.uint32)
            read = []
            for k, c in enumerate(codes):
                mine = np.flatnonzero(of == k)
                if len(mine):
                    x[mine] = _literals(c, padded, b[mine])
        values.append(x)

    read = []
    while done < total:
        if base is None or at >= base + held:
            block()
            base = at & ~7
            held = min(BLOCK, max(8, 8 * len(data) - 64 - base))
            padded = _windows(np.concatenate([data[: (base + held + 256 >> 3) + 3], np.zeros(40, np.uint8)]) if base + held + 256 >> 3 >= len(data) - 3 else data, base, held + 64)
            follow = []
            for c in codes:
                n, symbol = _pixel_lengths(c, padded, held)
                n = n + _PLACES[:held]
                n[symbol >= 256] = -1
                follow.append(memoryview(np.concatenate([n, _BEYOND])))
        p, first = at - base, done
        if group_of is None:
            f = follow[0]
            taken = []
            push = taken.append
            for _ in range(total - done):
                q = f[p]
                if q < 0:
                    break
                push(p)
                p = q
            done += len(taken)
            if taken:
                starts.append(np.array(taken, np.int32))
        else:
            taken = []
            while done < total:
                q = follow[group_of[done]][p]
                if q < 0:
                    break
                taken.append(p)
                read.append(group_of[done])
                p = q
                done += 1
            if taken:
                starts.append(np.array(taken, np.int32))
        if done > first:
            places.append(first)
            counts.append(done - first)
        at = p + base
        if done < total and p < held:
            c = codes[group_of[done] if group_of else 0]
            r.at = at
            s = r.symbol(c[0])
            if s >= 256 + LENGTHS:
                events.append((done, 0, s - 256 - LENGTHS))
                done += 1
            else:
                n = r.value(s - 256)
                d = r.value(r.symbol(c[4]))
                if d > 120:
                    d -= 120
                else:
                    x, y = NEAR[d - 1]
                    d = max(1, x + y * w)
                n = min(n, total - done)
                if d > done:
                    raise ValueError("a distance reaches before the image")
                events.append((done, n, d))
                done += n
            at = r.at
    block()
    r.at = at
    if only is not None:
        return only
    if len(counts) == 1 and not events:
        return values[0] if len(values) == 1 else np.concatenate(values)

    out = np.zeros(total, np.uint32)
    if counts:
        where = np.repeat(np.array(places) - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(sum(counts))
        out[where] = np.concatenate(values)
    cache, put = np.zeros(1 << cache_bits, np.uint32), 0
    for place, n, d in events:
        if n:
            if d >= n:
                out[place : place + n] = out[place - d : place - d + n]
            else:
                out[place : place + n] = np.resize(out[place - d : place], n)
        else:
            new = out[put:place]
            cache[(new * np.uint32(HASH)) >> np.uint32(32 - cache_bits)] = new  # of equal places the last stays
            put = place
            out[place] = cache[d]
    return out


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, l, t, tr, tl):
    """Predictions by a mode, on integer arrays (..., 4) of neighbours."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255]), np.shape(t))
    if mode < 5:
        return (l, t, tr, tl)[mode - 1]
    if mode < 11:
        return (lambda: _average(_average(l, tr), t), lambda: _average(l, tl), lambda: _average(l, t), lambda: _average(tl, t), lambda: _average(t, tr), lambda: _average(_average(l, tl), _average(t, tr)))[mode - 5]()
    if mode == 11:
        left = np.abs(t - tl).sum(-1, keepdims=True)  # how far the estimate l + t - tl is from l
        top = np.abs(l - tl).sum(-1, keepdims=True)
        return np.where(left < top, l, t)
    if mode == 12:
        return np.clip(l + t - tl, 0, 255)
    a = _average(l, t)
    return np.clip(a + ((a - tl) / 2).astype(np.int64), 0, 255)


#: Modes that don't look at the left neighbour.
_ABOVE = (0, 2, 3, 4, 8, 9)


def _undo_predictor(pixels: np.ndarray, w: int, h: int, shift: int, modes: np.ndarray) -> np.ndarray:
    x = _bytes_of(pixels).reshape(h, w, 4).astype(np.int64)
    modes = modes.reshape(-(-h >> shift), -(-w >> shift))
    x[0, 0, 3] += 255
    x[0] = np.cumsum(x[0], axis=0) & 255
    for y in range(1, h):
        row, up = x[y], x[y - 1]
        row[0] = (row[0] + up[0]) & 255
        line = modes[y >> shift]
        edges = [0, *(np.flatnonzero(np.diff(line)) + 1).tolist(), len(line)]
        for k in range(len(edges) - 1):
            a, b, mode = max(1, edges[k] << shift), min(w, edges[k + 1] << shift), int(line[edges[k]])
            if a >= b:
                continue
            if mode == 1:
                row[a - 1 : b] = np.cumsum(row[a - 1 : b], axis=0) & 255
            elif mode in _ABOVE or mode > 13:
                after = up[a + 1 : b + 1] if b < w else np.concatenate([up[a + 1 :], row[:1]])
                row[a:b] = (row[a:b] + _predict(mode, None, up[a:b], after, up[a - 1 : b - 1])) & 255
            else:
                for i in range(a, b):
                    tr = up[i + 1] if i + 1 < w else row[0]
                    row[i] = (row[i] + _predict(mode, row[i - 1], up[i], tr, up[i - 1])) & 255
    return _packed(x.reshape(-1, 4))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int64)


def _cross(pixels: np.ndarray, w: int, h: int, shift: int, elements: np.ndarray, undo: bool) -> np.ndarray:
    x = _bytes_of(pixels).reshape(h, w, 4).copy()
    e = _bytes_of(elements).reshape(-(-h >> shift), -(-w >> shift), 4)[np.arange(h)[:, None] >> shift, np.arange(w)[None, :] >> shift]
    green = _signed(x[..., 1])
    red_by_green, blue_by_green, blue_by_red = (_signed(e[..., k]) for k in (0, 1, 2))
    by = red_by_green * green >> 5
    red = x[..., 2].astype(np.int64) + (by if undo else -by)
    blue = (blue_by_green * green >> 5) + (blue_by_red * _signed((red if undo else x[..., 2]) & 255) >> 5)
    x[..., 0] = (x[..., 0] + (blue if undo else -blue)) & 255
    x[..., 2] = red & 255
    return _packed(x.reshape(-1, 4))


def _bundle(colours: int) -> int:
    """log2 of the pixels in one when indices are bundled."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _decode_stream(data: bytes) -> np.ndarray:
    r = Reader(data)
    if r.bits(8) != 0x2F:
        raise ValueError("not a lossless stream")
    w, h = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    undo, width = [], w
    while r.bits(1):
        kind = r.bits(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = r.bits(3) + 2
            undo.append((kind, width, shift, _pixels(r, -(-width >> shift), -(-h >> shift), False)))
        elif kind == PALETTE:
            size = r.bits(8) + 1
            table = _packed(np.cumsum(_bytes_of(_pixels(r, size, 1, False)), axis=0, dtype=np.uint8))
            undo.append((kind, width, _bundle(size), table))
            width = -(-width >> _bundle(size))
        else:
            undo.append((kind, width, 0, None))
    x = _pixels(r, width, h, True)
    for kind, width, shift, more in reversed(undo):
        if kind == PREDICTOR:
            x = _undo_predictor(x, width, h, shift, (more >> 8 & 255).astype(np.int64))
        elif kind == CROSS_COLOUR:
            x = _cross(x, width, h, shift, more, True)
        elif kind == SUBTRACT_GREEN:
            b = _bytes_of(x).copy()
            b[:, 0] += b[:, 1]
            b[:, 2] += b[:, 1]
            x = _packed(b)
        else:
            index = (x >> 8 & 255).reshape(h, -1)
            if shift:
                each = 8 >> shift
                index = (index[:, :, None] >> (np.arange(1 << shift, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(h, -1)[:, :width]
            table = np.zeros(256, np.uint32)
            table[: len(more)] = more
            x = table[index.reshape(-1)]
    return x.reshape(h, w)


def decode(media: bytes) -> list[np.ndarray]:
    """The images of one or more files, one after the other, each as (height, width) packed pixels 0xAARRGGBB."""
    out, at = [], 0
    while at < len(media):
        kind, size, form = struct.unpack_from("<4sI4s", media, at)
        if kind != b"RIFF" or form != b"WEBP":
            raise ValueError("not a WebP file")
        end, k = at + 8 + size + (size & 1), at + 12
        while k < at + 8 + size:
            name, n = struct.unpack_from("<4sI", media, k)
            if name == b"VP8L":
                out.append(_decode_stream(media[k + 8 : k + 8 + n]))
            k += 8 + n + (n & 1)
        at = end
    return out


# ---------------------------------------------------------------- encoding


class Writer:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(counts: np.ndarray, most: int = 12) -> np.ndarray:
    """Lengths of a complete prefix code: rounded-up information, then the slack goes to the likeliest symbols."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    c = counts[used]
    most = max(most, int(len(used) - 1).bit_length())
    n = np.clip(np.ceil(np.log2(c.sum() / c)).astype(np.int64), 1, most)
    while (1 << (most - n)).sum() > 1 << most:  # the clipping can make them too short
        long = np.flatnonzero(n < most)
        n[long[np.argmin(c[long])]] += 1
    slack = (1 << most) - int((1 << (most - n)).sum())
    order = np.argsort(-c, kind="stable").tolist()
    lengths = n.tolist()
    while slack:
        for k in order:
            more = 1 << (most - lengths[k])
            if more <= slack and lengths[k] > 1:
                slack -= more
                lengths[k] -= 1
                if not slack:
                    break
    out[used] = lengths
    return out


def codewords(lengths: np.ndarray) -> np.ndarray:
    """The canonical codewords, their first bit lowest."""
    out = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    n = lengths[used]
    order = np.argsort(n, kind="stable")
    most = int(n.max())
    span = 1 << (most - n[order])
    first = np.cumsum(span) - span
    back = _reversed_bits(most)
    out[used[order]] = back[first]  # a codeword stands in the upper bits of first, so in the lower ones reversed
    return out


def _put_code(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        a = int(used[0]) if len(used) else 0
        out.put(1, 1)
        out.put(int(len(used) == 2), 1)
        out.put(int(a > 1), 1)
        out.put(a, 8 if a > 1 else 1)
        if len(used) == 2:
            out.put(int(used[1]), 8)
        return
    out.put(0, 1)
    tokens: list[tuple[int, int, int]] = []
    size, lengths = len(lengths), lengths[: used[-1] + 1]
    edges = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
    for a, b in zip(edges, edges[1:]):
        n, s = b - a, int(lengths[a])
        if s:
            tokens.append((s, 0, 0))
            n -= 1
            while n >= 3:
                k = min(n, 6)
                tokens.append((16, k - 3, 2))
                n -= k
        else:
            while n >= 3:
                k = min(n, 138)
                tokens.append((18, k - 11, 7) if k > 10 else (17, k - 3, 3))
                n -= k
        tokens += [(s, 0, 0)] * n
    first = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    if np.count_nonzero(first) == 1:
        first[1 if first[0] else 0] = 1  # a code with one length would take no bits; two are clearer
    count = max(4, 1 + max(k for k in range(19) if first[LENGTH_ORDER[k]]))
    out.put(count - 4, 4)
    for k in range(count):
        out.put(int(first[LENGTH_ORDER[k]]), 3)
    if len(tokens) < 2 or len(lengths) == size:
        out.put(0, 1)
        if len(lengths) < size:
            raise AssertionError("a code of more than two symbols has more tokens")
    else:
        out.put(1, 1)
        n = (max(len(tokens) - 2, 1).bit_length() - 1) // 2
        out.put(n, 3)
        out.put(len(tokens) - 2, 2 + 2 * n)
    words, sizes = codewords(first).tolist(), first.tolist()
    value, n = 0, 0
    for s, extra, bits in tokens:
        value |= (words[s] | extra << sizes[s]) << n
        n += sizes[s] + bits
    out.put(value, n)


def _prefix(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits' value, how many) of numbers from 1 on."""
    v = x.astype(np.int64) - 1
    top = np.where(v < 2, 0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64))
    n = np.where(v < 2, 0, top - 1)
    prefix = np.where(v < 2, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1))
    return prefix, np.where(v < 2, 0, v & ((1 << n) - 1)), n


def _copies(pixels: np.ndarray, least: int = 4) -> list[tuple[int, int, int]]:
    """(place, length, distance) of runs to copy, left to right: the last place with the same `least` pixels is tried."""
    n = len(pixels) - least + 1
    if n < 2:
        return []
    h = np.zeros(n, np.uint64)
    for k in range(least):
        h = (h ^ pixels[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return []
    before = np.full(n, -1)
    before[order[same + 1]] = order[same]
    out, end = [], 0
    for i in np.flatnonzero(before >= 0).tolist():
        if i < end:
            continue
        j, k = int(before[i]), 0
        while k < 1 << 19:  # by blocks, as far as they are alike
            step = min(1024 if k else 64, len(pixels) - i - k)
            differ = np.flatnonzero(pixels[i + k : i + k + step] != pixels[j + k : j + k + step])
            k += int(differ[0]) if len(differ) else step
            if len(differ) or not step:
                break
        k = min(k, 4096)
        if k >= least:
            out.append((i, k, i - j))
            end = i + k
    return out


def _put_pixels(out: Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0, copies: bool = True, groups: np.ndarray | None = None, group_shift: int = 2, width: int = 0, alike: bool = False) -> None:
    """An entropy-coded image. alike: red, blue and alpha share one code, and green too if there are but literals. groups: for the main image, the code group of each block of pixels, as (rows, columns)."""
    total = len(pixels)
    runs = _copies(pixels) if copies else []
    if alike and 20 * sum(n for _, n, _ in runs) < total:
        runs = []  # not worth their codes
    lead = np.ones(total, bool)
    for i, n, _ in runs:
        lead[i + 1 : i + n] = False
    at = np.flatnonzero(lead)
    symbol = (pixels[at] >> 8 & 255).astype(np.int64)
    cached = np.zeros(len(at), bool)
    run = np.zeros(len(at), bool)
    if runs:
        place, length, distance = (np.array(x) for x in zip(*runs))
        index = np.searchsorted(at, place)
        run[index] = True
        lp, le, ln = _prefix(length)
        dp, de, dn = _prefix(distance + 120)
        symbol[index] = 256 + lp
    if cache_bits:
        key = (pixels * np.uint32(HASH)) >> np.uint32(32 - cache_bits)
        order = np.argsort(key, kind="stable")
        last = np.full(total, -1)
        again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        last[order[again + 1]] = order[again]
        hit = (last[at] >= 0) & ~run
        hit[hit] = pixels[last[at[hit]]] == pixels[at[hit]]
        cached = hit
        symbol[cached] = 256 + LENGTHS + key[at[cached]]
    literal = ~(run | cached)
    out.put(int(bool(cache_bits)), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    n_groups, of = 1, None
    if main:
        out.put(int(groups is not None), 1)
        if groups is not None:
            n_groups = int(groups.max()) + 1
            out.put(group_shift - 2, 3)
            _put_pixels(out, (groups.astype(np.uint32) << 8).reshape(-1), False)
            of = groups[at // width >> group_shift, at % width >> group_shift]
    b = _bytes_of(pixels)[at]
    sizes = 256 + LENGTHS + (1 << cache_bits if cache_bits else 0)
    word = np.zeros(len(at), np.uint64)
    bits = np.zeros(len(at), np.uint64)
    for g in range(n_groups):
        mine = np.ones(len(at), bool) if of is None else of == g
        lit, mine_run = mine & literal, mine & run
        every = n_groups == 1 and bool(literal.all())  # then all arrays are taken whole
        mine_, lit_ = (slice(None), slice(None)) if every else (mine, lit)
        channels = [(symbol, mine_, sizes), (b[:, 2], lit_, 256), (b[:, 0], lit_, 256), (b[:, 3], lit_, 256)]
        common = None
        for values, where, size in channels:
            v = values[where]
            if common is None or not alike or size != 256:
                share = b[lit_] if alike and every else b[lit_][:, [0, 2, 3]] if alike and size == 256 else v
                n = code_lengths(np.bincount(share.reshape(-1), minlength=size))
                written = Writer()
                _put_code(written, n)
                words = codewords(n)
                if np.count_nonzero(n) == 1:
                    n = np.zeros_like(n)
                n = n.astype(np.uint64)
                if size == 256 or every:
                    common = n
            out.put(written.value, written.n)
            if every:
                word |= words.take(v) << bits
                bits += n.take(v)
            else:
                word[where] |= words[v] << bits[where]
                bits[where] += n[v]
        if runs:
            k = mine_run[index]
            n = code_lengths(np.bincount(dp[k], minlength=40))
            _put_code(out, n)
            words = codewords(n)
            if np.count_nonzero(n) == 1:
                n = np.zeros_like(n)
            i = index[k]
            for value, count in ((le[k], ln[k]), (words[dp[k]], n[dp[k]]), (de[k], dn[k])):
                word[i] |= value.astype(np.uint64) << bits[i]
                bits[i] += count.astype(np.uint64)
        else:
            _put_code(out, np.zeros(40, np.int64))
    # all words at their bit places: those that begin in a 64-bit cell are joined, one may reach into the next
    place = np.cumsum(bits) - bits + np.uint64(out.n & 63)
    cell, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
    cells = np.zeros(int(cell[-1]) + 3, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    cells[cell[starts]] = np.bitwise_or.reduceat(word << shift, starts)
    over = np.flatnonzero(shift + bits > np.uint64(64))
    cells[cell[over] + 1] |= word[over] >> (np.uint64(64) - shift[over])
    n = int(bits.sum())
    body = int.from_bytes(cells.tobytes(), "little")
    out.value |= body << (out.n - (out.n & 63))
    out.n += n


def encode(image: np.ndarray, transforms: tuple = (), cache_bits: int = 0, copies: bool = True, groups: np.ndarray | None = None, group_shift: int = 2, alike: bool = False) -> bytes:
    """A file of an image of packed pixels (height, width).

    transforms, in the order of the file: ("predictor", shift, modes), ("cross", shift, elements), ("subtract",), ("palette",).
    """
    h, w = image.shape
    out = Writer()
    for value, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    x, width = np.ascontiguousarray(image, np.uint32).reshape(-1), w
    for t in transforms:
        out.put(1, 1)
        out.put({"predictor": PREDICTOR, "cross": CROSS_COLOUR, "subtract": SUBTRACT_GREEN, "palette": PALETTE}[t[0]], 2)
        if t[0] == "predictor":
            _, shift, modes = t
            out.put(shift - 2, 3)
            _put_pixels(out, (modes.astype(np.uint32) << 8 | 0xFF000000).astype(np.uint32).reshape(-1), False)
            v = _bytes_of(x).reshape(h, width, 4).astype(np.int64)
            flat = np.concatenate([np.zeros((width + 1, 4), np.int64), v.reshape(-1, 4), np.zeros((1, 4), np.int64)])
            here = np.arange(h * width) + width + 1
            l, up, tr, tl = (flat[here - d].reshape(h, width, 4) for d in (1, width, width - 1, width + 1))
            each = modes[np.arange(h)[:, None] >> shift, np.arange(width)[None, :] >> shift]
            guess = np.zeros_like(v)
            for mode in np.unique(each):
                guess = np.where((each == mode)[..., None], _predict(int(mode), l, up, tr, tl), guess)
            guess[0], guess[:, 0] = l[0], up[:, 0]
            guess[0, 0] = (0, 0, 0, 255)
            x = _packed(((v - guess) & 255).reshape(-1, 4))
        elif t[0] == "cross":
            _, shift, elements = t
            out.put(shift - 2, 3)
            _put_pixels(out, elements.reshape(-1), False)
            x = _cross(x, width, h, shift, elements, False)
        elif t[0] == "subtract":
            b = _bytes_of(x).copy()
            b[:, 0] -= b[:, 1]
            b[:, 2] -= b[:, 1]
            x = _packed(b)
        else:
            table, index = np.unique(x, return_inverse=True)
            if len(table) > 256:
                raise ValueError("too many colours for a palette")
            out.put(len(table) - 1, 8)
            steps = np.diff(_bytes_of(table), axis=0, prepend=np.zeros((1, 4), np.uint8))
            _put_pixels(out, _packed(steps), False)
            shift = _bundle(len(table))
            index = index.reshape(h, width).astype(np.uint32)
            if shift:
                each, many = 8 >> shift, 1 << shift
                index = np.pad(index, ((0, 0), (0, -width % many))).reshape(h, -1, many)
                index = (index << (np.arange(many, dtype=np.uint32) * each)).sum(-1, dtype=np.uint32)
            width = index.shape[1]
            x = (index << 8 | 0xFF000000).astype(np.uint32).reshape(-1)
    out.put(0, 1)
    _put_pixels(out, x, True, cache_bits, copies, groups, group_shift, width, alike)
    n = -(-out.n // 8)
    body = (out.value & (1 << out.n) - 1).to_bytes(n, "little")
    pad = b"\0" * (n & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + n + len(pad), b"WEBP", b"VP8L", n) + body + pad


# ---------------------------------------------------------------- texts as images

UNIT = 576
ROW = UNIT // 4
MOST_ROWS = 4096
CACHED_UP_TO = 1152


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes, filled up with 255 to a positive multiple of UNIT, and how many there were."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


#: Modes that are tried as an image's predictor, the shift of blocks (one holds 512 x 512 pixels), a symbol's share of a code's spelling in bits, and the pixels looked at together.
TRIED, WIDEST, SPELLED, TOGETHER = (1, 2, 7, 12), 9, 5, 1 << 18


def _residuals(v: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(mode, residuals) of images in one array of pixels (n, 4), rows of ROW; first: the rows that images begin with."""
    flat = np.concatenate([np.zeros((ROW + 1, 4), np.uint8), v])
    n = len(v)
    l, t, tl = (flat[ROW + 1 - d : ROW + 1 - d + n] for d in (1, ROW, ROW + 1))
    for mode in TRIED:
        if mode in (1, 2):
            guess = (l, t)[mode - 1].copy()
        elif mode == 7:
            guess = (l & t) + ((l ^ t) >> 1)  # the average, rounded down
        else:
            guess = np.clip(l.astype(np.int16) + t - tl, 0, 255).astype(np.uint8)
        rows = guess.reshape(-1, ROW, 4)
        rows[:, 0] = t.reshape(-1, ROW, 4)[:, 0]
        rows[first] = l.reshape(-1, ROW, 4)[first]
        rows[first, 0] = (0, 0, 0, 255)
        yield mode, v - guess


class Several:
    """Images in one array of pixels (n, 4), looked at together: `count` pixels each."""

    def __init__(self, images: list[np.ndarray]):
        self.count = np.array([x.size for x in images])
        self.first = (np.cumsum(self.count) - self.count) // ROW
        self.cell = np.repeat(np.arange(len(images)) << 8, self.count)
        self.pixels = _bytes_of(np.concatenate([x.reshape(-1) for x in images]))

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.reshape(len(self.pixels) // ROW, -1).sum(axis=1, dtype=np.int64), self.first)

    def counts(self, channel: np.ndarray) -> np.ndarray:
        return np.bincount(self.cell + channel, minlength=len(self.count) << 8)

    def bits(self, counts: np.ndarray) -> np.ndarray:
        """For each image the bits of these symbols and of their code's spelling."""
        n, used = len(self.count), np.flatnonzero(counts)
        c, of = counts[used].astype(np.float64), used >> 8
        total = np.bincount(of, c, n)
        return total * np.log2(total) - np.bincount(of, c * np.log2(c), n) + SPELLED * np.bincount(of, minlength=n)

    def slope(self, of: np.ndarray, by: np.ndarray) -> np.ndarray:
        """For each image how a channel follows another, in 32nds, as a signed byte."""
        a, b = (x.view(np.int8).astype(np.int32) for x in (of, by))
        return np.clip(np.rint(32 * self.sums(a * b) / np.maximum(self.sums(b * b), 1)), -128, 127).astype(np.int64)

    def less(self, of: np.ndarray, by: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return of - (np.repeat(slope.astype(np.int16), self.count) * by.view(np.int8) >> 5).astype(np.uint8)

    def predicted(self) -> tuple[np.ndarray, np.ndarray]:
        """For each image the mode of least absolute residuals among TRIED; these residuals."""
        best = mode = rest = None
        for m, r in _residuals(self.pixels, self.first):
            size = self.sums(np.minimum(r, -r))
            if best is None:
                best, mode, rest = size, np.full(len(size), m), r
            else:
                better = size < best
                rows = np.repeat(better, self.count // ROW)
                best, mode = np.where(better, size, best), np.where(better, m, mode)
                rest.reshape(-1, 4 * ROW)[rows] = r.reshape(-1, 4 * ROW)[rows]
        return mode, rest


def choose_transforms(images: list[np.ndarray]) -> list[tuple]:
    """For each image, rows of ROW pixels, the transforms that promise the fewest bits: none, or subtract-green, a predictor, cross-colour.

    Pixels count as literals, by the entropy of their channels. A predictor's mode is the one of least absolute residuals
    among TRIED; subtract-green or cross-colour may follow it, the latter as fitted to its residuals.
    """
    out: list[tuple] = []
    k = 0
    while k < len(images):
        n, j = images[k].size, k + 1
        while j < len(images) and n + images[j].size <= TOGETHER:
            n, j = n + images[j].size, j + 1
        x = Several(images[k:j])
        mode, rest = x.predicted()
        channels = [[np.ascontiguousarray(v[:, c]) for c in range(4)] for v in (x.pixels, rest)]
        plain, left = ([x.counts(c) for c in v] for v in channels)
        (blue, green, red, _), (l_blue, l_green, l_red, _) = channels
        of_red, of_blue = x.slope(l_red, l_green), x.slope(l_blue, l_green)

        def bits(counts: list[np.ndarray], *more: np.ndarray) -> np.ndarray:
            """Four codes: of all channels, or of green, alpha and these two."""
            return sum(map(x.bits, (counts[1], counts[3], *map(x.counts, more)) if more else counts))

        sizes = np.stack([x.bits(sum(plain)), bits(plain, blue - green, red - green), bits(left), bits(left, l_blue - l_green, l_red - l_green), bits(left, x.less(l_blue, l_green, of_blue), x.less(l_red, l_green, of_red))])
        for image, which, m, a, b in zip(images[k:j], sizes.argmin(axis=0).tolist(), mode.tolist(), of_red.tolist(), of_blue.tolist()):
            blocks = (-(-len(image) >> WIDEST), 1)
            predict = ("predictor", WIDEST, np.full(blocks, m))
            cross = ("cross", WIDEST, np.full(blocks, 0xFF000000 | (b & 255) << 8 | a & 255, np.uint32))
            out.append(((), (("subtract",),), (predict,), (predict, ("subtract",)), (predict, cross))[which])
        k = j
    return out


def images_of(payload: bytes) -> list[np.ndarray]:
    """The payload as images of ROW pixels a row, MOST_ROWS rows each."""
    pixels = np.frombuffer(payload, "<u4").reshape(-1, ROW)
    return [pixels[k : k + MOST_ROWS] for k in range(0, len(pixels), MOST_ROWS)]


def store(payload: bytes, transforms: list[tuple] | None = None) -> bytes:
    """The payload as lossless images, one for each of images_of().

    Up to 256 colours, if a quarter of the pixels at most, make a palette; small images use a colour cache of 64. Where
    transforms (by default of choose_transforms()) promise fewer bits, both ways are tried and the shorter one is kept.
    """
    images, out = images_of(payload), []
    for image, chosen in zip(images, choose_transforms(images) if transforms is None else transforms):
        most = min(256, image.size // 4)  # a palette has to be worth its table
        few = image.size > 4 * ROW and len(np.unique(image[:4])) <= most and len(np.unique(image)) <= most
        plain = encode(image, (("palette",),) if few else (), 6 if len(payload) <= CACHED_UP_TO and not few else 0, alike=not few)
        out.append(min(plain, encode(image, chosen), key=len) if chosen else plain)
    return b"".join(out)


def _feature(images: list[np.ndarray]) -> str:
    """A few numbers on pixel arrays, as text."""
    every = np.concatenate([x.reshape(-1) for x in images])
    b = _bytes_of(every)
    green = b[:, 1].astype(np.int16)
    step = np.abs(green[1:] - green[:-1]).sum() / (len(b) - 1) if len(b) > 1 else 0.0
    return f"images={len(images)};size={ROW}x{sum(len(x) for x in images)};mean=" + ",".join(f"{int((every >> k & 255).sum()) / len(b):.3f}" for k in (0, 8, 16, 24)) + f";step={step:.3f};first={every[0]:08x}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> doc_id, n_bytes, media; some MB at once."""
    for part in _some(batches, "text"):
        payloads, n = zip(*(padded(value.as_py()) for value in part.column("text")))
        images = [images_of(x) for x in payloads]
        chosen = iter(choose_transforms([x for several in images for x in several]))
        media = [store(x, [next(chosen) for _ in several]) for x, several in zip(payloads, images)]
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _some(batches: Iterator[pa.RecordBatch], name: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut where a column of strings or bytes has that many bytes; a longer value is alone."""
    for batch in batches:
        sizes = np.array([x or 0 for x in pc.binary_length(batch.column(name)).to_pylist()], np.int64)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, start + int(np.searchsorted(np.cumsum(sizes[start:]), most, "right")))
            yield batch.slice(start, end - start)
            start = end


_PIXELS = "doc_id long, n_bytes long, media binary, images array<struct<width:int,height:int,pixels:binary>>, feature string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, media) -> _PIXELS."""
    kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))
    for part in _some(batches, "media"):
        arrays, features = [], []
        for value in part.column("media"):
            images = decode(value.as_py()) if value.is_valid else []
            arrays.append([{"width": x.shape[1], "height": x.shape[0], "pixels": x.astype("<u4").tobytes()} for x in images] if value.is_valid else None)
            features.append(_feature(images) if images else None)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), part.column("media"), pa.array(arrays, kind), pa.array(features, pa.string())], ["doc_id", "n_bytes", "media", "images", "feature"])


def store_texts(df: DataFrame) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, n_bytes and the text as lossless WebP. Null texts count as empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def read_media(df: DataFrame) -> DataFrame:
    """One row per row of df (doc_id, media): the pixel arrays of its images, and a feature string.

    media holds one or more files; pixels are rows of 32-bit numbers 0xAARRGGBB, the lowest byte first. Null media give
    null arrays; media without an image give none and no feature. What isn't WebP is an error. A column n_bytes goes along.
    """
    n = F.col("n_bytes").cast("long") if "n_bytes" in df.columns else F.lit(None).cast("long").alias("n_bytes")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), n, "media").mapInArrow(_read, _PIXELS)


def texts_as_images(df: DataFrame) -> DataFrame:
    """One row per row of df (doc_id, text): the text is stored as lossless WebP and read back; digests, sizes, a feature.

    Null texts count as empty and give one unit of padding. The digests are of the bytes read back. Other columns aren't
    read; repeated rows give repeated rows, and equal texts equal values; an empty df gives no rows.
    """
    # store_texts() and read_media(), in one go for each batch
    back = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _read(_stored(batches)), _PIXELS)
    back = back.select("doc_id", "n_bytes", "media", F.expr("aggregate(images, x'', (a, x) -> concat(a, x.pixels))").alias("payload"), "feature")
    tail = F.expr("substring(payload, -32, 32)")
    return back.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
                       F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")
