"""Operator 4, document fingerprints: I-Match over several randomised lexicon subsets."""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mixed, shuffle_partitions

#: Share of all documents that a term of the lexicon is in, least and most: the band of inverse document frequency.
BAND = (0.001, 0.2)
#: A subset of rate k holds each lexicon term with probability 2**-k; so many subsets are drawn at each rate. The
#: sparsest subset of a draw is the one term with its smallest number, whatever the number of terms.
RATES, DRAWS = range(11), 16
#: Hex digits of a subset's hash; zeros stand for a subset of which no term occurs.
DIGITS = 3
_TOP = -(1 << 63)
_DRAW_KEYS = np.array([k * 0x9E3779B9 + 1 for k in range(DRAWS)], dtype=np.uint64)
_HEX = [f"{v:0{DIGITS}x}" for v in range(16**DIGITS)]


def terms(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the words, A-Z lower-cased."""
    return np.unique(hash_words(text.lower().split()))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the terms whose document frequency lies in the band (and is at least 2).

    Frequencies are counted over all documents. The result is bounded: with d distinct terms in an average document,
    at most d / band[0] terms can be in that share of the documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], ["term", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                held.append(terms(text.as_py() or b""))
                size += len(held[-1])
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    total = docs.count()
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    chosen = found.where((F.col("n") >= max(2, band[0] * total)) & (F.col("n") <= max(2, band[1] * total)))
    return np.sort(np.array([r["term"] for r in chosen.select("term").collect()], dtype=np.int64).view(np.uint64))


def fingerprint(found: np.ndarray, words: np.ndarray) -> str:
    """Hex digits: 16 for all lexicon terms, then DIGITS for each subset, draw by draw, from full to a single term.

    found: the document's sorted distinct terms; words: the sorted lexicon. A document without a lexicon term is
    fingerprinted by all its terms.
    """
    at = np.searchsorted(words, found)
    kept = found[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == found)] if len(words) else found[:0]
    if not len(kept):
        kept = found
    # a term's number in each draw: the zero bits that it begins with say up to which rate the term is in
    numbers = mixed(mixed(kept[None, :] ^ _DRAW_KEYS[:, None]))
    level = np.minimum(63 - np.log2(np.maximum(numbers, 1).astype(np.float64)).astype(np.int64), len(RATES) - 1)
    cell = (level + np.arange(DRAWS)[:, None] * len(RATES)).ravel()
    # a subset's hash: the sum of its terms' hashes, from the sparse subsets to the full ones that hold them
    sums = np.zeros(DRAWS * len(RATES), dtype=np.uint64)
    np.add.at(sums, cell, numbers.ravel())
    sums = np.cumsum(sums.reshape(DRAWS, -1)[:, ::-1], axis=1)[:, ::-1]
    counts = np.bincount(cell, minlength=DRAWS * len(RATES)).reshape(DRAWS, -1)
    some = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] > 0
    shown = np.where(some, (mixed(sums) % np.uint64(16**DIGITS - 1)).astype(np.int64) + 1, 0)
    lone = numbers.min(axis=1) if len(kept) else np.zeros(DRAWS, dtype=np.uint64)
    lone = np.where(len(kept) > 0, (mixed(mixed(lone)) % np.uint64(16**DIGITS - 1)).astype(np.int64) + 1, 0)
    shown = np.concatenate([shown, lone[:, None]], axis=1)
    return hashlib.md5(kept.tobytes()).hexdigest()[:16] + "".join([_HEX[v] for v in shown.ravel().tolist()])


def likeness(a: str, b: str) -> float:
    """Over all draws, how often the sparsest subset, a single term, agrees; 1 for equal fingerprints. The share is near
    that of common terms among all terms of both, at any number of terms."""
    if a == b:
        return 1.0
    width = (len(RATES) + 1) * DIGITS
    ends = range(16 + width, 17 + DRAWS * width, width)
    return sum(a[end - DIGITS : end] == b[end - DIGITS : end] for end in ends) / DRAWS


def fingerprints(docs: DataFrame, words: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint. Null texts are empty; equal texts (in fact equal term sets) have
    equal fingerprints. Row by row; repeated rows and null ids are no matter; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(terms(t.as_py() or b""), shared.value) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fingerprint string"
    )


def edited_fingerprints(docs: DataFrame, words: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, and their likeness.

    Edited text: the last floor(n/2) code points are replaced by as many first ones of the next document in
    descending id (after the last, the first one). Rows are dealt by ranges of ids; each task walks its rows in
    order, and the first row of a range is sent to the range before it as well, so no task sees more than a range.
    Rows without an id come last; rows that tie follow one another in any order; a lone document is its own next.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    n = shuffle_partitions(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_TOP)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most one bound and one head a partition come to the driver
    bounds = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else None
    bounds = sorted(set(bounds or []))
    last = len(bounds)
    range_id = F.lit(0)
    if bounds:
        # descending: range 0 has the largest ids
        range_id = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b >= F.col("doc_id")))
    heads = {r["range_id"]: r["head"] for r in rows.groupBy(range_id.alias("range_id")).agg(F.max("doc_id").alias("head")).collect()}
    used = sorted(heads)
    before = {k: used[i - 1] for i, k in enumerate(used)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        down = [-b for b in reversed(bounds)]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                at = bisect.bisect_right(down, -doc_id)
                blob = zlib.compress(text, 1)
                out.append((at, 0, doc_id, blob))
                if heads.get(at) == doc_id:
                    out.append((before[at], 1, doc_id, blob))
                if len(out) >= 1000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        out: list[tuple] = []
        for batch in batches:
            for at, extra, doc_id, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = zlib.decompress(blob)
                own = fingerprint(terms(text), shared.value)
                if held and held[0] == at:
                    out.append(_edited(*held[1:], text, own, shared.value))
                # a range ends with the first head that follows it
                held = None if extra else (at, doc_id, text, own)
                if len(out) >= 1000:
                    yield _results(out)
                    out = []
        if out:
            yield _results(out)

    dealt = rows.mapInArrow(deal, "range_id int, extra int, doc_id long, blob binary")
    ordered = dealt.repartitionById(last + 1, F.col("range_id")).sortWithinPartitions("range_id", "extra", F.desc("doc_id"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    found = ordered.mapInArrow(walk, schema)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != _TOP, F.col("doc_id")))


def _edited(doc_id: int, text: bytes, own: str, following: bytes, its: str, words: np.ndarray) -> tuple:
    chars, other = text.decode(), following.decode()
    half = len(chars) // 2
    edited = (chars[: len(chars) - half] + other[:half]).encode()
    changed = fingerprint(terms(edited), words)
    return doc_id, len(chars), hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, its)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.binary())],
        ["range_id", "extra", "doc_id", "blob"],
    )


def _results(out: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
