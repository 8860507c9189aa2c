"""Binary codecs that Spark lacks, on numpy, and pandas UDFs around them."""

from __future__ import annotations

import html as html_entities
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PNG = b"\x89PNG\r\n\x1a\n"


def packbits(data: bytes) -> bytes:
    """Run-length coding: n literal bytes as n - 1 and the bytes; n equal ones (3 to 128) as 257 - n and the byte."""
    return packbits_rows(np.frombuffer(data, np.uint8).reshape(1, -1))


def packbits_rows(rows: np.ndarray) -> bytes:
    """Each row of bytes coded by itself as by packbits(), one after another; all of them in one pass."""
    x, width = np.ascontiguousarray(rows).reshape(-1), rows.shape[1]
    if not x.size:
        return b""
    at = np.arange(len(x))
    new = np.r_[True, x[1:] != x[:-1]] | (at % width == 0)
    run = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    lengths = np.diff(np.r_[starts, len(x)])
    # of a run, all but a rest of one or two beyond whole packets is repeated
    repeated = np.where(lengths % 128 < 3, lengths // 128 * 128, lengths)
    inside, repeats = at - starts[run], repeated[run]
    literal = inside >= repeats
    # neighbouring literal bytes of a row are one piece, in parts of 128
    first = literal & np.r_[True, ~literal[:-1]] | literal & (at % width == 0)
    pieces = np.flatnonzero(first)
    ends = np.flatnonzero(literal & np.r_[~literal[1:] | (at[1:] % width == 0), True]) + 1
    piece = np.cumsum(first) - 1
    k = np.where(literal, at - pieces[piece] if len(pieces) else 0, inside)
    head = k % 128 == 0
    left = np.where(literal, ends[piece] - at if len(pieces) else 0, repeats - inside)
    size = np.where(literal, 1 + head, 2 * head)
    to = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    own, again = literal & head, ~literal & head
    out[to[own]] = np.minimum(left[own], 128) - 1
    out[(to + head)[literal]] = x[literal]
    out[to[again]] = 257 - np.minimum(left[again], 128)
    out[to[again] + 1] = x[again]
    return out.tobytes()


def unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def png_encode(pixels: np.ndarray) -> bytes:
    """8-bit grey (h, w) or RGB (h, w, 3), filter 0."""
    grey = pixels.ndim == 2
    h, w = pixels.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if grey else 2, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """8-bit grey, RGB or RGBA without interlacing; all five filters."""
    if data[:8] != _PNG:
        raise ValueError("no PNG")
    at, body, head = 8, b"", b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = data[at + 8 : at + 8 + n]
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlace or colour not in (0, 2, 6):
        raise ValueError("only 8-bit grey, RGB and RGBA without interlacing")
    bpp = {0: 1, 2: 3, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * bpp + 1)
    out = np.zeros((h, w * bpp), np.int64)
    above = np.zeros(w * bpp, np.int64)
    for y in range(h):
        kind, line = int(rows[y, 0]), rows[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line.reshape(w, bpp), axis=0).reshape(-1)
        elif kind in (3, 4):
            for k in range(w * bpp):
                a = line[k - bpp] if k >= bpp else 0
                b, c = above[k], above[k - bpp] if k >= bpp else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[k] = (line[k] + guess) % 256
        out[y] = above = line % 256
    return out.astype(np.uint8).reshape((h, w) if bpp == 1 else (h, w, bpp))


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma by BT.601."""
    return np.floor(rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114 + 0.5).astype(np.uint8)


def bilevel(values: np.ndarray, threshold: int = 128) -> np.ndarray:
    """Rows of bits, most significant first, 1 for dark."""
    return np.packbits(values < threshold, axis=1)


def ink_ratio(values: np.ndarray, white: int = 250) -> float:
    return float((values < white).mean()) if values.size else 0.0


def box_mean(values: np.ndarray, radius: int) -> np.ndarray:
    """Mean over the square around each pixel, cut at the edges, by a summed-area table."""
    s = np.zeros((values.shape[0] + 1, values.shape[1] + 1))
    s[1:, 1:] = values.cumsum(0).cumsum(1)
    y, x = np.arange(values.shape[0])[:, None], np.arange(values.shape[1])[None, :]
    y0, y1 = np.maximum(0, y - radius), np.minimum(values.shape[0], y + radius + 1)
    x0, x1 = np.maximum(0, x - radius), np.minimum(values.shape[1], x + radius + 1)
    return (s[y1, x1] - s[y0, x1] - s[y1, x0] + s[y0, x0]) / ((y1 - y0) * (x1 - x0))


def despeckle(ink: np.ndarray, least: int) -> np.ndarray:
    """Without 4-neighbour components of fewer than `least` pixels: labels spread until none changes."""
    labels = np.where(ink, np.arange(1, ink.size + 1).reshape(ink.shape), 0)
    while True:
        padded = np.pad(labels, 1)
        around = np.max([padded[1:-1, 1:-1], padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]], axis=0)
        grown = np.where(ink, around, 0)
        if (grown == labels).all():
            break
        labels = grown
    sizes = np.bincount(labels.ravel())
    return ink & (sizes[labels] >= least)


def tiff_encode(pages: list[np.ndarray], dpi: int) -> bytes:
    """Multi-page bilevel or grey TIFF with PackBits strips, little-endian."""
    out = bytearray(b"II*\x00\x00\x00\x00\x00")
    link = 4
    for k, pixels in enumerate(pages):
        h, w = pixels.shape
        is_bits = pixels.dtype == bool
        rows = np.packbits(pixels, axis=1) if is_bits else pixels
        strip = packbits_rows(rows)
        data_at = len(out)
        out += strip + b"\x00" * (len(strip) % 2)
        ratio_at = len(out)
        out += struct.pack("<II", dpi, 1)
        # Tag, type (3 short, 4 long, 5 ratio), value.
        entries = [
            (254, 4, 2 if len(pages) > 1 else 0), (256, 4, w), (257, 4, h), (258, 3, 1 if is_bits else 8), (259, 3, 32773),
            (262, 3, 0 if is_bits else 1), (273, 4, data_at), (277, 3, 1), (278, 4, h), (279, 4, len(strip)), (282, 5, ratio_at),
            (283, 5, ratio_at), (296, 3, 2),
        ]
        ifd_at = len(out)
        out[link : link + 4] = struct.pack("<I", ifd_at)
        out += struct.pack("<H", len(entries))
        for tag, kind, value in entries:
            out += struct.pack("<HHII", tag, kind, 1, value)
        link = len(out)
        out += b"\x00\x00\x00\x00"
        del k
    return bytes(out)


def tiff_page_count(data: bytes) -> int:
    """Pages of a TIFF, by its chain of directories; a chain that loops is an error."""
    order = "<" if data[:2] == b"II" else ">"
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen or len(seen) >= 100_000:
            raise ValueError("the directories loop")
        seen.add(at)
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        at = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return len(seen)


def image_density(data: bytes) -> tuple[int, int, float] | None:
    """Width, height and dots per inch of a PNG or JPEG header; 0 where it says none."""
    if data[:8] == _PNG:
        w, h = struct.unpack(">II", data[16:24])
        at = data.find(b"pHYs", 8, 4096)
        dpi = struct.unpack(">I", data[at + 4 : at + 8])[0] * 0.0254 if at > 0 and data[at + 12] == 1 else 0.0
        return w, h, dpi
    if data[:2] == b"\xff\xd8":
        dpi, at = 0.0, 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if kind == 0xE0 and data[at + 4 : at + 8] == b"JFIF":
                unit, x = data[at + 11], struct.unpack(">H", data[at + 12 : at + 14])[0]
                dpi = float(x) if unit == 1 else x * 2.54 if unit == 2 else 0.0
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h, dpi
            at += n + 2
    return None


def natural_page(width: int, height: int, dpi: float) -> tuple[float, float]:
    """Page size in points: by density if that gives 3 to 14,400 points, else the largest fit on a letter page."""
    if dpi > 0:
        w, h = width * 72 / dpi, height * 72 / dpi
        if 3 <= min(w, h) and max(w, h) <= 14400:
            return w, h
    scale = min(612 / width, 792 / height)
    return width * scale, height * scale


def packbits_udf(c: Column) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else packbits(bytes(b)))

    return run(c)


def unpackbits_udf(c: Column) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else unpackbits(bytes(b)))

    return run(c)


_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|amp|lt|gt|quot|apos|nbsp);")


def _entity(m: re.Match) -> str:
    name = m[1]
    if name[0] != "#":
        return " " if name == "nbsp" else html_entities.unescape(f"&{name};")
    n = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]


def decode_entities(text: str) -> str:
    """Named, decimal and hex entities in one pass; unknown ones stay."""
    return _ENTITY.sub(_entity, text)


def decode_entities_udf(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else decode_entities(t))

    return run(c)


def letter_count_udf(c: Column) -> Column:
    """Letters and digits after NFKC."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        import unicodedata

        return x.map(lambda t: sum(ch.isalnum() for ch in unicodedata.normalize("NFKC", t or "")))

    return run(c)
