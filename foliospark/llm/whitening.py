"""Operator 12, embedding whitening: exact second moments from bit planes, then principal axes of the integers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Rows whose bit planes are held and multiplied at a time: 256 words a plane stay in a core's cache.
BLOCK_ROWS = 16_384
#: Eigenvalues not above this share of the largest are zero to double precision.
RANK_SHARE = 1e-13


@dataclass(frozen=True)
class Axes:
    """What the fit list says: its size, its sums by dimension, and its principal axes."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one unit column each
    trace: float


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * entry) of each entry, as double, as a long (at the limits of a long where it would exceed them);
    null if the vector is null or has an entry that is null or not finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), width)


def bit_planes(x: np.ndarray, low: list[int], bits: list[int]) -> np.ndarray:
    """One row of 64-bit words for each bit of each dimension of x - low, rows of x being bits of the words; last, a row of
    ones, whose products are the sums and the count."""
    words = -(-len(x) // 64)
    out = np.zeros((sum(bits) + 1, words), dtype=np.uint64)
    padded = np.zeros(words * 64, dtype=np.uint8)
    at = 0
    for d, (least, n_bits) in enumerate(zip(low, bits, strict=True)):
        # a difference modulo 2**64 is right for any two longs
        shifted = x[:, d].view(np.uint64) - np.uint64(least % 2**64)
        for b in range(n_bits):
            padded[: len(x)] = (shifted >> np.uint64(b)) & np.uint64(1)
            out[at] = np.packbits(padded).view(np.uint64)
            at += 1
    padded[: len(x)] = 1
    out[at] = np.packbits(padded).view(np.uint64)
    return out


def _products(fit: DataFrame, low: list[int], bits: list[int]) -> DataFrame:
    """(a, b, weight, n): how many times bits of dimensions a <= b with places that add up to weight are set together;
    dimension len(low) is the constant 1."""
    width = len(low)
    dimension = np.r_[np.repeat(np.arange(width), bits), width]
    place = np.concatenate([*[np.arange(b) for b in bits], [0]]).astype(np.int64)
    weights = 2 * max([*bits, 1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1) * (width + 1) * weights, dtype=np.int64)

        def add(x: np.ndarray) -> None:
            planes = bit_planes(x, low, bits)
            for k in range(len(planes)):
                both = np.bitwise_count(planes[k] & planes[k:]).sum(axis=1, dtype=np.int64)
                cell = (dimension[k] * (width + 1) + dimension[k:]) * weights + place[k] + place[k:]
                # of two different bits of one dimension, only one order is met here; both count
                twice = (dimension[k:] == dimension[k]) & (place[k:] != place[k])
                np.add.at(total, cell, both << twice)

        held: list[np.ndarray] = []
        for batch in batches:
            x = _matrix(batch.column(0), width)
            held.append(x)
            if sum(map(len, held)) >= BLOCK_ROWS:
                add(np.concatenate(held))
                held = []
        if held:
            add(np.concatenate(held))
        cells = np.flatnonzero(total)
        pair, weight = np.divmod(cells, weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pair // (width + 1), pa.int32()), pa.array(pair % (width + 1), pa.int32()), pa.array(weight, pa.int32()), pa.array(total[cells])],
            ["a", "b", "weight", "n"],
        )

    found = fit.select("x").mapInArrow(count, "a int, b int, weight int, n long")
    return found.groupBy("a", "b", "weight").agg(F.sum("n").alias("n"))


def moments(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums and the cross-products of the longs in column x of fit, all exact."""
    at = F.posexplode("x").alias("d", "v")
    # least and largest entry of each dimension: as many rows as dimensions come to the driver
    ends = {r["d"]: (r["low"], r["high"]) for r in fit.select(at).groupBy("d").agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    low = [ends[d][0] for d in range(width)]
    bits = [(ends[d][1] - ends[d][0]).bit_length() for d in range(width)]
    shifted = [[0] * (width + 1) for _ in range(width + 1)]
    # dimensions**2 times bits numbers, however many rows there are
    for r in _products(fit, low, bits).toLocalIterator():
        shifted[r["a"]][r["b"]] += r["n"] << r["weight"]
    n = shifted[width][width]
    own = [shifted[d][width] for d in range(width)]
    sums = [own[d] + n * low[d] for d in range(width)]
    cross = [[0] * width for _ in range(width)]
    for a in range(width):
        for b in range(a, width):
            # sum (u + la)(v + lb) of the shifted entries u, v
            cross[a][b] = cross[b][a] = shifted[a][b] + low[b] * own[a] + low[a] * own[b] + n * low[a] * low[b]
    return n, sums, cross


def fit_axes(fit: DataFrame, width: int) -> Axes:
    """Principal axes of the vectors in column x. The covariance (divisor n) is centred as integers, so that only its last
    division rounds."""
    n, sums, cross = moments(fit, width)
    centred = [[n * cross[a][b] - sums[a] * sums[b] for b in range(width)] for a in range(width)]
    covariance = np.array([[c / (n * n) for c in row] for row in centred], dtype=np.float64).reshape(width, width)
    values, vectors = np.linalg.eigh(covariance)
    trace = sum(centred[a][a] for a in range(width)) / (n * n)
    return Axes(n, sums, values[::-1], vectors[:, ::-1], trace)


def _long(d: int) -> int | None:
    return d if d < 2**63 else None


def _whitened(x: np.ndarray, axes: Axes, components: int) -> tuple[np.ndarray, list[int | None]]:
    """(components by row, squared deviations): x - S/n on each axis over the root of its eigenvalue, and the sum of
    (n*x - S)**2 over all dimensions, None where that is no long. NaN on axes without variance."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * axes.n + max(map(abs, axes.sums), default=0)
    if most < 2**62:
        off = x * np.int64(axes.n) - np.array(axes.sums, dtype=np.int64)
        about = (off.astype(np.float64) ** 2).sum(axis=1)
        deviation: list[int | None] = (off * off).sum(axis=1).tolist()
        for k in np.flatnonzero(about > 9e18).tolist():  # whole numbers of any size for the few near the limit
            deviation[k] = _long(sum(v * v for v in off[k].tolist())) if about[k] < 1e19 else None
    else:
        off = x.astype(object) * axes.n - np.array(axes.sums, dtype=object)
        deviation = [_long(d) for d in (off * off).sum(axis=1).tolist()]
    centred = off.astype(np.float64) / axes.n
    with np.errstate(divide="ignore", invalid="ignore"):
        e = axes.values[:components]
        root = np.where(e > RANK_SHARE * max(axes.values.max(initial=0.0), 0.0), np.sqrt(e), np.nan)
        return centred @ axes.vectors[:, :components] / root, deviation


def whiten(
    vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error.

    Entries become whole numbers x = floor(scale * entry). The fit list is each distinct x once: n vectors with sums S. Its
    cross-products are counted exactly: each dimension's entries, less the dimension's least one, are cut into bit planes,
    packed over rows into words, and the set bits of `plane AND plane` are counted and added up in Spark by the weight of
    their places. The covariance is centred as integers before its eigenvectors are taken. whitened is x - S/n on the
    component over the root of its eigenvalue, explained the eigenvalue's share of the trace, deviation the exact sum of
    (n*x - S)**2, and identity_error the largest difference between the identity and the covariance of `whitened` over
    the fit list, measured on the values themselves.

    Rows are left out if the vector is null, has a null or non-finite entry, or another length than most vectors (of two as
    frequent lengths, the larger one holds); null ids stay; repeated rows each give their rows, but count once in the fit.
    Components are at most as many as dimensions. A component without variance (also: all x equal) has whitened null and
    no part in identity_error, which is null if no component has variance. explained is 0 where the trace is. deviation
    is null where it is no long. An empty table, or one without usable rows, gives none. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(
        vectors.schema[id_col].dataType.simpleString()
    )
    usable = vectors.select(F.col(id_col).alias("vec_id"), scaled(F.col(vector_col), scale).alias("x")).where("size(x) > 0")
    lengths = usable.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    width = lengths["width"]
    usable = usable.where(F.size("x") == width)
    # equal vectors meet in the map tasks already, so a frequent one is no hot key
    fit = written(usable.select("x").distinct(), "whitening-fit")
    axes = fit_axes(fit, width)
    m = min(components, width)
    live = [k for k in range(m) if axes.values[k] > RANK_SHARE * max(axes.values[0], 0.0)]

    def on_axes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, _ = _whitened(_matrix(batch.column(0), width), axes, m)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in live], [f"w{k}" for k in live])

    error = None
    if live:
        # Spark's covariance centres before it multiplies
        pairs = [(a, b) for a in live for b in live if a <= b]
        found = fit.mapInArrow(on_axes, ", ".join(f"w{k} double" for k in live)).agg(
            *[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]
        )
        error = max(abs(c - (a == b)) for c, (a, b) in zip(found.first(), pairs, strict=True))
    discard(fit)
    explained = [float(axes.values[k] / axes.trace) if axes.trace > 0 else 0.0 for k in range(m)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, deviation = _whitened(_matrix(batch.column(1), width), axes, m)
            n = len(w)
            flat = w.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(n), m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * m, axes.n, dtype=np.int64)),
                    pa.array([d for d in deviation for _ in range(m)], pa.int64()),
                    pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(np.array(explained), n)),
                    pa.array([error if error is None or math.isfinite(error) else None] * (n * m), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable.mapInArrow(rows, schema)
