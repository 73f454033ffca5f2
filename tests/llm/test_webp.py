import base64
import struct

import numpy as np
import pytest

from siteloom.llm import webp


def images():
    rng = np.random.default_rng(5)
    smooth = (np.add.outer(np.arange(37), np.arange(53)) * 3 & 255).astype(np.uint32)
    yield "noise", rng.integers(0, 2**32, (37, 53), dtype=np.uint64).astype(np.uint32)
    yield "smooth", smooth | smooth << 8 | (255 - smooth) << 16 | np.uint32(0xFF000000)
    yield "flat", np.full((9, 11), 0xFF102030, np.uint32)
    yield "one", np.array([[0x01020304]], np.uint32)
    yield "rows", np.tile(rng.integers(0, 2**32, (1, 64), dtype=np.uint64).astype(np.uint32), (40, 1))
    yield "wide", rng.integers(0, 4, (2, 1000)).astype(np.uint32) * np.uint32(0x01030507)


ALL = list(images())


@pytest.mark.parametrize("name,image", ALL, ids=[n for n, _ in ALL])
@pytest.mark.parametrize("cache", [0, 1, 6, 11])
@pytest.mark.parametrize("copies", [False, True])
def test_codes_copies_and_cache(name, image, cache, copies):
    assert (webp.decode(webp.encode(image, cache_bits=cache, copies=copies))[0] == image).all()


@pytest.mark.parametrize("name,image", ALL, ids=[n for n, _ in ALL])
def test_transforms(name, image):
    rng = np.random.default_rng(1)
    h, w = image.shape
    blocks = (-(-h >> 2), -(-w >> 2))
    elements = rng.integers(0, 2**24, blocks).astype(np.uint32) | np.uint32(0xFF000000)
    every = rng.integers(0, 14, blocks)
    for t in [(("subtract",),), (("cross", 2, elements),), (("predictor", 2, every),), (("predictor", 2, every), ("cross", 2, elements), ("subtract",)), (("subtract",), ("predictor", 2, every))]:
        assert (webp.decode(webp.encode(image, t))[0] == image).all(), t
    for mode in range(14):
        assert (webp.decode(webp.encode(image, (("predictor", 2, np.full(blocks, mode)),)))[0] == image).all(), mode


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 2**32, colours, dtype=np.uint64).astype(np.uint32)
    image = table[rng.integers(0, colours, (13, 29))]
    assert (webp.decode(webp.encode(image, (("palette",),)))[0] == image).all()


def test_code_groups():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (24, 40)).astype(np.uint32) * np.uint32(0x01010101)
    image[:, 20:] //= np.uint32(9)
    groups = rng.integers(0, 3, (6, 10))
    for copies in (False, True):
        assert (webp.decode(webp.encode(image, (), 0, copies, groups, 2))[0] == image).all()
        assert (webp.decode(webp.encode(image, (("subtract",),), 5, copies, groups, 2))[0] == image).all()


def pixels(media):
    return b"".join(x.astype("<u4").tobytes() for x in webp.decode(media))


@pytest.mark.parametrize("text", [None, "", "a", "x" * 576, "y" * 577, "é😀 lorem " * 400, "Enäen " * 3000, "".join(chr(33 + i * i % 90) for i in range(200_000))])
def test_texts(text):
    payload, n = webp.padded(text)
    assert len(payload) % 576 == 0 and payload[:n] == (text or "").encode() and set(payload[n:]) <= {255}
    assert pixels(webp.store(payload)) == payload


def test_several_images(monkeypatch):
    monkeypatch.setattr(webp, "MOST_ROWS", 3)
    payload, _ = webp.padded("some words to store " * 300)
    media = webp.store(payload)
    assert len(webp.decode(media)) > 1 and pixels(media) == payload


def test_short_distances_are_all_different():
    assert len(set(webp.NEAR)) == 120


@pytest.mark.parametrize("text,pixel", [("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", 0x00000000), ("UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=", None)])
def test_files_of_other_encoders(text, pixel):
    """The one-pixel images by which web pages find out whether a browser can show lossless files."""
    (image,) = webp.decode(base64.b64decode(text))
    assert image.shape == (1, 1) and (pixel is None or image[0, 0] == pixel)


def test_a_file_put_together_by_hand():
    """Two by one pixels without transforms: codes of one and two symbols of one bit each, written bit by bit from the format's text."""
    bits = []

    def put(value, n):
        bits.extend(value >> k & 1 for k in range(n))

    for value, n in ((0x2F, 8), (1, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):  # signature, sizes, alpha, version; no transform, cache or groups
        put(value, n)
    put(1, 1), put(1, 1), put(1, 1), put(0x10, 8), put(0x20, 8)  # green: simple, two symbols, the first of 8 bits
    put(1, 1), put(0, 1), put(1, 1), put(0x30, 8)  # red: one symbol
    put(1, 1), put(0, 1), put(0, 1), put(1, 1)  # blue: one symbol of one bit, 1
    put(1, 1), put(1, 1), put(1, 1), put(0xFF, 8), put(0x80, 8)  # alpha: two symbols; the lower one has the code 0
    put(1, 1), put(0, 1), put(0, 1), put(0, 1)  # distances: one symbol
    put(1, 1), put(0, 1), put(0, 1), put(1, 1)  # pixels: green, alpha, each one bit
    body = bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))
    pad = b"\0" * (len(body) & 1)
    media = b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad
    (image,) = webp.decode(media)
    # codes of equal length go to the symbols in order, so 0x10 and 0x80 are the bit 0
    assert [f"{x:08x}" for x in image[0]] == ["80302001", "ff301001"]


def test_transforms_are_chosen():
    """Payloads that a predictor, subtract-green or cross-colour suits take them, and get shorter; the choice hangs on the image alone."""
    rng = np.random.default_rng(1)
    slope = (np.arange(576 * 40) // 4 * 3 + rng.integers(0, 3, 576 * 40)) % 128
    walk = 64 + np.cumsum(rng.integers(-1, 2, (144 * 40, 1)), axis=0) % 50 + np.arange(4)
    g = rng.integers(0, 128, 144 * 40)
    grey = np.stack([g + 5, g, g + 9, g * 0 + 60], axis=1)
    tied = np.stack([g // 2 + rng.integers(0, 2, g.size) + 3, g, g // 2 + 9, g * 0 + 60], axis=1)
    payloads = [np.asarray(x, np.uint8).tobytes() for x in (slope, walk, grey, tied)] + [webp.padded("".join(rng.choice(list("etaoin shrdlu"), 3000)))[0]]
    images = [x for p in payloads for x in webp.images_of(p)]
    chosen = webp.choose_transforms(images)
    assert [[t[0] for t in webp.choose_transforms([x])[0]] for x in images] == [[t[0] for t in c] for c in chosen]
    assert {t[0] for c in chosen for t in c} == {"predictor", "subtract", "cross"} and chosen[-1] == ()
    shorter = 0
    for p, c in zip(payloads, chosen):
        media = webp.store(p)
        assert pixels(media) == p and media == webp.store(p, [c]) and len(media) <= len(webp.store(p, [()]))
        shorter += len(media) < len(webp.store(p, [()]))
    assert shorter >= 2


def test_codes_spelled_alike():
    """A code spelled as the one before is taken over only where its spelling doesn't end with the alphabet."""
    rng = np.random.default_rng(2)
    for top in (200, 256):
        image = np.frombuffer(rng.integers(0, top, 576 * 8).astype(np.uint8).tobytes(), "<u4").reshape(-1, 144)
        for alike in (False, True):
            assert (webp.decode(webp.encode(image, alike=alike))[0] == image).all()
            assert (webp.decode(webp.encode(np.tile(image, (3, 1)), alike=alike))[0] == np.tile(image, (3, 1))).all()
