"""Queries of image codecs and pixel operators.

Every document's bytes stand for a grey picture, 64 wide and as high as they need, so the work follows the table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..session import load, ship
from .registry import query

WIDTH = 64


def picture(data: bytes) -> np.ndarray:
    """All bytes row by row, the last row filled up with white."""
    x = np.frombuffer(data, np.uint8)
    whole = np.full(max(1, -(-len(x) // WIDTH)) * WIDTH, 255, np.uint8)
    whole[: len(x)] = x
    return whole.reshape(-1, WIDTH)


def _per_picture(spark: SparkSession, sf_dir: str, kind: str, f: Callable[[np.ndarray], object], name: str) -> DataFrame:
    ship(spark)

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: f(picture(bytes(b or b""))))

    return load(spark, sf_dir, "documents").select("doc_id", run(F.col("text").cast("binary")).alias(name))


@query(r"""SELECT doc_id, length(regexp_replace(t, '[^\x01-\x63]', '', 'g'))::DOUBLE / (greatest(1, (octet_length(encode(t)) + 63) // 64) * 64) AS ink
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def agg22_ink_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_picture(spark, sf_dir, "double", lambda p: C.ink_ratio(p, 100), "ink")


@query()
def agg23_despeckle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink pixels left after components of fewer than four have gone."""
    return _per_picture(spark, sf_dir, "long", lambda p: int(C.despeckle(p < 100, 4).sum()), "ink")


@query()
def win21_box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest distance of a pixel from the mean around it, by a summed-area table."""
    return _per_picture(spark, sf_dir, "double", lambda p: float(np.abs(C.box_mean(p.astype(float), 3) - p).max()), "contrast")


@query(r"""SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\x01-\x64]', '', 'g')) AS dark FROM documents""")
def scl28_bilevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark bits of each picture after packing to one bit a pixel."""
    return _per_picture(spark, sf_dir, "long", lambda p: int(np.unpackbits(C.bilevel(p, 101)).sum()), "dark")


@query("SELECT doc_id, true AS same FROM documents")
def scl29_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every picture as PNG and back."""
    return _per_picture(spark, sf_dir, "boolean", lambda p: bool((C.png_decode(C.png_encode(p)) == p).all()), "same")


@query("SELECT doc_id, 2 AS pages FROM documents")
def snk5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grey and a bilevel page as one TIFF; its pages are counted by walking its directories (also SRC-10)."""
    return _per_picture(spark, sf_dir, "long", lambda p: C.tiff_page_count(C.tiff_encode([p, p < 100], 150)), "pages")


@query(
    """SELECT doc_id, least(612.0::DOUBLE / 64.0::DOUBLE, 792.0::DOUBLE / h::DOUBLE) * 64.0::DOUBLE AS page_width FROM
(SELECT doc_id, greatest(1, (octet_length(encode(coalesce(text, ''))) + 63) // 64) AS h FROM documents)"""
)
def src9_image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page width of each picture, from the header of its PNG: without a density the largest fit on a letter page."""

    def width(p: np.ndarray) -> float:
        w, h, dpi = C.image_density(C.png_encode(p))
        return C.natural_page(w, h, dpi)[0]

    return _per_picture(spark, sf_dir, "double", width, "page_width")


@query()
def cmp21_clean_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature clean-up: distance from the local paper, a threshold by Otsu's rule, despeckled, cropped: pixels left."""

    def clean(p: np.ndarray) -> int:
        ink = np.maximum(0, C.box_mean(p.astype(float), 6) - p)
        n = np.bincount(ink.astype(int).ravel(), minlength=256)[:256]
        w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
        some = (w0 > 0) & (w0 < w0[-1])
        if not some.any():
            return 0
        w, s = w0[some], s0[some]
        gap = s / w - (s0[-1] - s) / (w0[-1] - w)
        threshold = np.flatnonzero(some)[int(np.argmax(w * (w0[-1] - w) * gap * gap))]
        kept = C.despeckle(ink > max(18, threshold), 4)
        rows, columns = np.flatnonzero(kept.any(1)), np.flatnonzero(kept.any(0))
        return int((np.ptp(rows) + 1) * (np.ptp(columns) + 1)) if len(rows) else 0

    return _per_picture(spark, sf_dir, "long", clean, "box")
