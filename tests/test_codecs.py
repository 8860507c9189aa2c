import struct
import zlib

import numpy as np
import pytest

from foliospark.functions import codecs as C


@pytest.mark.parametrize("seed", range(5))
def test_packbits_round_trip(seed):
    rng = np.random.default_rng(seed)
    data = np.repeat(rng.integers(0, 4, 300), rng.integers(1, 200, 300)).astype(np.uint8).tobytes() + rng.bytes(500)
    assert C.unpackbits(C.packbits(data)) == data
    assert C.packbits(b"") == b""
    assert C.packbits(b"aaaa") == bytes((253, 97))


@pytest.mark.parametrize("width", [1, 2, 64, 300])
def test_packbits_of_rows_at_once(width):
    rng = np.random.default_rng(width)
    x = np.repeat(rng.integers(0, 4, 400), rng.choice([1, 2, 3, 127, 128, 129, 130, 131, 257], 400)).astype(np.uint8)
    rows = x[: len(x) // width * width].reshape(-1, width)
    assert C.packbits_rows(rows) == b"".join(C.packbits(r.tobytes()) for r in rows)


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(1)
    for shape in ((7, 5), (6, 4, 3)):
        x = rng.integers(0, 256, shape).astype(np.uint8)
        assert (C.png_decode(C.png_encode(x)) == x).all()
    x = rng.integers(0, 256, (5, 9)).astype(np.int64)
    rows = b""
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        left = np.r_[0, x[y, :-1]]
        up = x[y - 1] if y else np.zeros(9, np.int64)
        corner = np.r_[0, up[:-1]]
        p = left + up - corner
        near = [min((abs(a - q), 0, a), (abs(b - q), 1, b), (abs(c - q), 2, c))[2] for a, b, c, q in zip(left, up, corner, p, strict=True)]
        guess = {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: np.array(near)}[kind]
        rows += bytes([kind]) + ((x[y] - guess) % 256).astype(np.uint8).tobytes()

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", 9, 5, 8, 0, 0, 0, 0)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (C.png_decode(png) == x).all()


def test_tiff_pages_and_loop():
    pages = [np.zeros((4, 10), bool), np.ones((3, 9), bool), np.full((2, 2), 7, np.uint8)]
    data = C.tiff_encode(pages, 150)
    assert C.tiff_page_count(data) == 3
    looped = bytearray(C.tiff_encode(pages[:1], 150))
    at = struct.unpack("<I", looped[4:8])[0]
    n = struct.unpack("<H", looped[at : at + 2])[0]
    looped[at + 2 + 12 * n : at + 6 + 12 * n] = struct.pack("<I", at)
    with pytest.raises(ValueError, match="loop"):
        C.tiff_page_count(bytes(looped))


def test_density_and_page():
    assert C.image_density(C.png_encode(np.zeros((3, 4), np.uint8))) == (4, 3, 0.0)
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x01\x00\x96\x00\x96\x00\x00\xff\xc0\x00\x0b\x08\x00\x20\x00\x40\x01\x01\x11\x00"
    assert C.image_density(jpeg) == (64, 32, 150.0)
    assert C.natural_page(300, 150, 150.0) == (144.0, 72.0)
    assert C.natural_page(1224, 100, 0.0) == (612.0, 50.0)


def test_images():
    x = np.full((5, 5), 255, np.uint8)
    x[1:3, 1:3] = 0
    x[4, 4] = 0
    ink = x < 128
    assert C.ink_ratio(x) == pytest.approx(5 / 25)
    assert C.despeckle(ink, 2).sum() == 4
    assert C.box_mean(x.astype(float), 1)[0, 0] == pytest.approx((255 * 3 + 0) / 4)
    assert C.bilevel(x)[1].tolist() == [0b01100000]
    assert C.grey(np.array([[[255, 0, 0]]], np.uint8)).tolist() == [[76]]


def test_entities():
    assert C.decode_entities("&#65;&#x42;&amp;lt;&nope;&#0;") == "AB&lt;&nope;&#0;"
