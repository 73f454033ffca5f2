"""Word shingles of a text as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .common import U, mix

_PLACE = np.array([0x9E3779B97F4A7C15 * (2 * j + 1) % 2**64 for j in range(64)], U)

#: Bytes hashed at once; words of over half of it are hashed on their own.
PIECE = 1 << 19
_ODD = 0x9E3779B97F4A7C15
_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_POWERS: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_ODD, pow(_ODD, -1, 2**64)):
            x = np.full(PIECE + 1, base, U)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS


def _piece_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and starts of the words in some bytes: sums of bytes times powers, as differences of one running sum,

    brought to the same power.
    """
    up, down = _power_tables()
    edges = np.empty(len(raw) + 2, bool)
    edges[0] = edges[-1] = False
    np.logical_not((raw == 32) | ((raw >= 9) & (raw <= 13)), out=edges[1:-1])
    cuts = np.flatnonzero(edges[1:] != edges[:-1])
    start, end = cuts[::2], cuts[1::2]
    terms = raw.astype(U)
    terms += U(1)
    terms *= up[: len(raw)]
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(terms, out=sums[1:])
    size = end - start
    out = mix((sums[end] - sums[start]) * down[start] + size.astype(U) * U(0xC2B2AE3D27D4EB4F))
    for k in np.flatnonzero(size > PIECE // 2).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]])
    return out, start


def _long_hashes(text: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(text):
        till = at + PIECE
        if till < len(text):
            spaces = [m for c in b" \t\n\x0b\x0c\r" if (m := text.rfind(bytes([c]), at, till)) > at]
            if not spaces:  # a word of over half a piece: to its end, on its own
                rest = _SPACES.search(text, till)
                word = text[at : rest.start() if rest else len(text)]
                out.append(np.array([xxhash.xxh3_64_intdigest(word.strip())], U))
                at += len(word)
                continue
            till = max(spaces)
        out.append(_piece_hashes(np.frombuffer(text[at:till], np.uint8))[0])
        at = till
    return np.concatenate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of some texts, one text after the other, and how many words each has; equal words have equal ones."""
    sizes = np.zeros(len(texts), np.int64)
    out, k = [np.empty(0, U)], 0
    while k < len(texts):
        if len(texts[k]) > PIECE:
            out.append(_long_hashes(texts[k]))
            sizes[k] = len(out[-1])
            k += 1
            continue
        first, n = k, 0
        while k < len(texts) and n + len(texts[k]) <= PIECE:  # with a line feed after each text but the last
            n += len(texts[k]) + 1
            k += 1
        h, start = _piece_hashes(np.frombuffer(b"\n".join(texts[first:k]), np.uint8))
        ends = np.cumsum([len(t) + 1 for t in texts[first:k]])
        sizes[first:k] = np.diff(np.searchsorted(start, ends), prepend=0)
        out.append(h)
    return np.concatenate(out), sizes


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The distinct shingles of width words of each text, as sorted hashes. A-Z are lower-cased; a text of fewer words is one

    shingle, one of no words (or null) has none.
    """
    h, sizes = word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    ends = np.cumsum(sizes)
    whole = _shingles(h, width)
    out = []
    for n, end in zip(sizes.tolist(), ends.tolist()):
        if n >= width:
            x = np.sort(whole[end - n : end - width + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        else:
            out.append(_shingles(h[end - n : end], n) if n else np.empty(0, U))
    return out


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.full(n, U(k))
    for j in range(k):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[j : j + n] + _PLACE[j % 64])
    return out


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return shingle_sets([text], width)[0]


def members(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which items of a are in b; both are sorted sets."""
    if not len(b):
        return np.zeros(len(a), bool)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return b[at] == a
