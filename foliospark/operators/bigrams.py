"""Bigrams that the pages of a document share, counted without pairing pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that a task works on at once, some 60 bytes each; no page is cut.
CHUNK_CHARS = 1_000_000
#: Counts that make up this share of all pages' bigrams are held by every task: 1 / HEAD_SHARE of them at most.
HEAD_SHARE = 1e-6


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, row of each bigram, bigram): the distinct pairs of neighbouring characters of each text, the last column."""
    for batch in batches:
        start, held, texts = 0, 0, []
        for k, text in enumerate(batch.column(batch.num_columns - 1)):
            texts.append(text.as_py())
            held += len(texts[-1])
            if held >= CHUNK_CHARS or k == batch.num_rows - 1:
                chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
                # a row and the places of two characters among the chunk's make up one number
                there = np.zeros(0x110000, dtype=bool)
                there[chars] = True
                letters = np.flatnonzero(there)
                place = np.cumsum(there) - 1
                place, n = place[chars], len(letters)
                row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                own = ((row[:-1] * n + place[:-1]) * n + place[1:])[row[1:] == row[:-1]]
                own.sort()
                own = own[np.r_[len(own) > 0, own[1:] != own[:-1]][: len(own)]]
                own, second = np.divmod(own, max(1, n))
                own, first = np.divmod(own, max(1, n))
                yield batch.slice(start, k + 1 - start), own, letters[first] << 21 | letters[second]
                start, held, texts = k + 1, 0, []


def shared_bigrams(pages: DataFrame) -> DataFrame:
    """(page long, shared): with how many other pages of its document a page shares each of its bigrams, summed up.

    pages: doc, page, text, of which rows without a doc are left out. Bigrams are counted by document in each task, before
    they are exchanged. Every task holds the counts that are a share of the whole; a page's other bigrams meet theirs in a
    join by document and bigram.
    """
    rows = pages.where("doc IS NOT NULL AND text IS NOT NULL").select(F.col("doc").cast("string"), F.col("page").cast("long"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, row, both in _chunks(batches):
            docs = some.column(0).dictionary_encode()
            kinds, place = np.unique(both, return_inverse=True)
            own = docs.indices.to_numpy()[row].astype(np.int64) * len(kinds) + place
            own, n = np.unique(own, return_counts=True)
            doc = docs.dictionary.take(pa.array(own // max(1, len(kinds))))
            yield pa.RecordBatch.from_arrays([doc, pa.array(kinds[own % max(1, len(kinds))]), pa.array(n)], ["doc", "g", "n"])

    counts = rows.mapInArrow(count, "doc string, g long, n long").groupBy("doc", "g").agg(F.sum("n").alias("n"))
    counts = counts.persist()  # some numbers for each document
    often = max(2.0, HEAD_SHARE * (counts.agg(F.sum("n")).first()[0] or 0))
    head = counts.where(F.col("n") >= often).toArrow()
    docs = head.column("doc").combine_chunks().dictionary_encode() if head.num_rows else pa.array([], pa.string()).dictionary_encode()
    number = {d: k for k, d in enumerate(docs.dictionary.to_pylist())}
    # a million of documents at most and twice 21 bits of a character fit a number
    key = docs.indices.to_numpy().astype(np.int64) << 42 | head.column("g").to_numpy()
    order = np.argsort(key)
    shared = pages.sparkSession.sparkContext.broadcast((number, key[order], head.column("n").to_numpy()[order]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, n = shared.value
        for some, row, both in _chunks(batches):
            doc = np.array([number.get(d, -1) for d in some.column(0).to_pylist()], dtype=np.int64)[row]
            asked = np.where(doc >= 0, doc << 42 | both, -1)
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            known = keys[at] == asked if len(keys) else np.zeros(len(asked), dtype=bool)
            sums = np.bincount(row[known], n[at[known]] - 1, some.num_rows).astype(np.int64)
            rest, whole = row[~known], pa.array(np.r_[np.arange(some.num_rows), row[~known]])
            # a page's sum stands under a number of its own, that is no bigram's
            g = np.r_[-1 - some.column(1).fill_null(0).to_numpy(), both[~known]]
            yield pa.RecordBatch.from_arrays(
                [some.column(0).take(whole), some.column(1).take(whole), pa.array(g), pa.array(np.r_[sums, np.zeros(len(rest), np.int64)])],
                ["doc", "page", "g", "known"],
            )

    found = rows.mapInArrow(look_up, "doc string, page long, g long, known long")
    tail = counts.where((F.col("n") < often) & (F.col("n") > 1))
    return found.join(tail, ["doc", "g"], "left").groupBy("page").agg(F.sum(F.col("known") + F.coalesce(F.col("n") - 1, F.lit(0))).alias("shared"))
