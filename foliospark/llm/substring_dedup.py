"""Operator 6, substring dedup: Rabin-Karp hashes of every window of words, counted in Spark."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mixed
from .packed import bucket_count, exchange

#: Odd bases of the two polynomials, and the keys of the word hashes that they are over.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_KEYS = ("first window key", "other window key")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def window_hashes(text: bytes, window: int) -> np.ndarray:
    """Two independent hashes, 64 and 16 bits, of the words i .. i + window - 1 for every i: polynomials in odd bases
    modulo 2**64 over the words' 64-bit hashes, rolled by doubling (a window of 2k words is two windows of k)."""
    words = text.split()
    full, other = (_rolled(mixed(hash_words(words, key)), base, window) for key, base in zip(_KEYS, _BASES, strict=True))
    return np.stack([full, other >> np.uint64(48)])


def _rolled(level: np.ndarray, base: int, window: int) -> np.ndarray:
    n = len(level) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out: np.ndarray | None = None
    done, power, size = 0, np.uint64(base), 1
    while True:
        if window & size:
            part = level[done : done + n]
            out = part.copy() if out is None else out * power + part
            done += size
        size *= 2
        if size > window:
            return mixed(out)
        half = size // 2
        level = level[: len(level) - half] * power + level[half:]
        power = np.uint64(int(power) * int(power) % 2**64)


def repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, starts): places of windows that also start earlier, as little-endian 32-bit numbers, for documents that
    have any. docs: (doc_id long, text)."""

    def rows(doc: np.ndarray, place: np.ndarray) -> list[pa.RecordBatch]:
        if not len(doc):
            return []
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order].astype("<u4")
        edges = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)]
        starts = [place[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [pa.RecordBatch.from_arrays([pa.array(doc[edges[:-1]]), pa.array(starts, pa.binary())], ["doc_id", "starts"])]

    def later(new: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Mask: not at the place of the first one with its words (a repeated row is)."""
        at = np.flatnonzero(new)[np.cumsum(new) - 1]
        return (doc != doc[at]) | (place != place[at])

    def local(new: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple:
        gone = later(new, doc, place)
        return new, rows(doc[gone], place[gone])

    def judge(new: np.ndarray, doc: np.ndarray, place: np.ndarray) -> list[pa.RecordBatch]:
        gone = later(new, doc, place)
        return rows(doc[gone], place[gone])

    def combine(found: pa.Table) -> pa.Table:
        doc, starts = found.column(0).to_numpy(), found.column(1).to_pylist()
        order = np.argsort(doc, kind="stable")
        edges = np.r_[np.flatnonzero(np.r_[True, doc[order][1:] != doc[order][:-1]]), len(doc)]
        joined = [b"".join([starts[k] for k in order[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"doc_id": doc[order][edges[:-1]], "starts": pa.array(joined, pa.binary())})

    schema = "doc_id long, starts binary"
    return exchange(docs, bucket_count(docs), lambda text: window_hashes(text, window), local, judge, schema, combine, schema)


def _removals(docs: DataFrame, window: int, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, starts) and the columns of carry as c0, c1, ...; texts are compressed."""
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]
    )
    names = base.columns
    found = repeated_windows(base.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text"), window)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [None if t is None else packer.compress(t) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), *batch.columns[2:]], names)

    # texts travel once, and compressed: they are the larger part of what this join shuffles
    schema = f"doc_id long, text binary{_kinds(docs, carry)}"
    return base.mapInArrow(squeeze, schema).join(found, "doc_id", "left").select("doc_id", "text", "starts", *base.columns[2:])


def _kinds(docs: DataFrame, carry: tuple[str, ...]) -> str:
    return "".join(f", c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    unpacker = zstandard.ZstdDecompressor()
    return [None if t is None else unpacker.decompress(t) for t in batch.column(1).to_pylist()]


def _covered(starts: bytes, n: int, window: int) -> np.ndarray:
    """Which of n words the windows cover: their union of intervals."""
    steps = np.zeros(n + 1, dtype=np.int64)
    at = np.unique(np.frombuffer(starts, dtype="<u4")).astype(np.int64)
    at = at[at + window <= n]  # rows that share an id with a longer text
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return np.cumsum(steps[:-1]) > 0


def _without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the removed intervals; the white space behind an interval goes with it."""
    spans = np.array([m.span() for m in _WORD.finditer(text)], dtype=np.int64)
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    out, at = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(text[at : spans[a][0]])
        at = int(spans[b][0]) if b < len(spans) else len(text)
    return b"".join([*out, text[at:]])


def substring_dedup(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: doc_id, kept_text, n_words, n_removed, spans (array of removed word intervals), and the
    columns of `carry` as c0, c1, ..., unchanged.

    A word goes when it is covered by a window of `window` consecutive words (`[^\\x20\\x09-\\x0D]+`, unchanged) whose
    sequence also starts earlier: in a document with a smaller id, or earlier in its own. All windows are hashed and
    compared across the corpus on the input as it is; overlapping windows merge into maximal intervals. Windows are
    the same when 80 bits of hashes of them are: among 10**10 windows (30 GB) a false match has a chance of 0.004 %.

    Texts without repeats stay byte for byte; null texts stay null and have no words; rows with a null id stay as they
    are; rows with equal ids and texts count as one place. Other columns are not read.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, removed, spans = [], [], [], []
            for text, starts in zip(_texts(batch), batch.column(2).to_pylist(), strict=True):
                words = len((text or b"").split())
                gone = _covered(starts, words, window) if starts else np.zeros(0, bool)
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).tolist()
                texts.append(None if text is None else _without(text, gone).decode() if edges else text.decode())
                n.append(words)
                removed.append(int(gone.sum()))
                spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            found = [pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *found, *batch.columns[3:]],
                ["doc_id", "kept_text", "n_words", "n_removed", "spans", *[f"c{k}" for k in range(len(carry))]],
            )

    return _removals(docs, window, id_col, text_col, carry).mapInArrow(
        apply,
        f"doc_id long, kept_text string, n_words long, n_removed long, spans array<struct<start:long,end:long>>{_kinds(docs, carry)}",
    )


def kept_digests(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """substring_dedup() as n_words, n_removed and the SHA-256 of the kept words joined by a blank."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sha = [], [], []
            for text, starts in zip(_texts(batch), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                n.append(len(words))
                if starts:
                    gone = _covered(starts, len(words), window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(n[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return _removals(docs, window, id_col, text_col).mapInArrow(
        apply, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
