"""Operator 7, packing: deficit round-robin over source queues fills fixed windows to target token proportions."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running_totals, written

#: Entries of a worker's word memory; it is emptied when full, which costs time only.
MEMORY_WORDS = 500_000
_TOKENIZERS: dict[str, _Words] = {}


class _Words:
    """A worker's tokenizer with the ids of the words met so far."""

    def __init__(self, path: str):
        # Spark's tasks already use all cores
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError(f"ids are packed as 16-bit numbers; {path} has larger ones")
        whole, *parts = self._encode(["Left, RIGHT.\tends", "left", ",", "right", ".", "ends"])
        if whole.tolist() != np.concatenate(parts).tolist():
            raise ValueError(f"{path} doesn't lower-case or has tokens that reach across white space or signs")
        self.tails = {m.encode(): self._encode([m])[0].astype("<u2").tobytes() for m in (",", ".")}
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memory: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: set[bytes]) -> None:
        """Adds the ids of words. A comma or full stop behind an ASCII letter is a token of its own, so that the
        tokenizer sees the word without it; words of letters alone, each of which is one run of tokens with an end
        mark, are given to it many at once."""
        memory = self.memory
        stems = {w[:-1] if w[-1:] in self.tails and w[-2:-1].isalpha() else w for w in new}.difference(memory)
        plain, rest = [], []
        for w in stems:
            (plain if (t := w.decode()).isalpha() else rest).append((w, t))
        groups = [plain[at : at + 200] for at in range(0, len(plain), 200)]
        for some, ids in zip(groups, self._encode([" ".join([t for _, t in g]) for g in groups]), strict=True):
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 2
            if len(stops) != len(some):  # lower-casing made something else of a letter
                rest += some
                continue
            raw, start = ids.astype("<u2").tobytes(), 0
            for (w, _), stop in zip(some, stops.tolist(), strict=True):
                memory[w] = raw[start:stop]
                start = stop
        for (w, _), ids in zip(rest, self._encode([t for _, t in rest]), strict=True):
            memory[w] = ids.astype("<u2").tobytes()
        for w in new:
            if w not in memory:
                memory[w] = memory[w[:-1]] + self.tails[w[-1:]]


def _words(path: str) -> _Words:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Words(path)
    return _TOKENIZERS[path]


def token_bytes(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of each text as little-endian 16-bit numbers.

    The tokenizer drops white space, no token reaches across it, and letters are lower-cased; so it is asked once for
    each new lower-case word. Only its special tokens, which begin with `<|`, mind the case.
    """
    words = _words(path)
    memory = words.memory
    cut = [t.split() if b"<|" in t else t.lower().split() for t in texts]
    new = set().union(*cut).difference(memory)
    if len(memory) + 2 * len(new) > MEMORY_WORDS:
        memory.clear()
        new = set().union(*cut)
    words.learn(new)
    return [b"".join(map(memory.__getitem__, own)) for own in cut]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked).

    Every document is its tokens and end_id. Every source whose share of a window is a token or more is a queue, so
    there are at most `window` of them; the other sources share the last queue. A window serves the queues in turn. Each
    round a queue gains credit for its share of all tokens; it is served the whole part of its credit and carries the
    rest, its deficit, into the next window. As shares are fixed, the credit served to the first j queues up to window k
    is floor(k * window * T_j / T), T_j being these queues' tokens and T all: so any task can tell which windows hold a
    document's tokens, deficits carry across partitions, all queues end together, and only the last window can be short.
    (For a smaller share in front of other queues the difference of two floors may fall, so the closed form needs that
    bound.) In the last queue documents come in the order of the share of their source's tokens up to their middle, so
    that each source is spread evenly over all windows, to a document.

    The order within a source is that of the written token table (partition, then row within it). Null texts are empty; null
    sources form one source; repeated rows are packed each; other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[str, int] = {}
        for batch in batches:
            sources = batch.column(2).to_pylist()
            texts = batch.column(1).cast(pa.large_binary())
            for at in range(0, batch.num_rows, 500):
                # about 2 MB of text at once
                part = [t or b"" for t in texts.slice(at, 500).to_pylist()]
                ids = [e + int(end_id).to_bytes(2, "little") for e in token_bytes(part, tokenizer_path)]
                before = []
                for s, e in zip(sources[at : at + 500], ids, strict=True):
                    before.append(used.get(s, 0))
                    used[s] = before[-1] + len(e) // 2
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, 500), pa.array(sources[at : at + 500], pa.string()),
                        pa.array([len(e) // 2 for e in ids], pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "source", "n", "before", "ids"],
                )

    source = F.coalesce(F.col(source_col).cast("string"), F.lit("\x00")) if source_col in docs.columns else F.lit("\x00")
    tokens = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), source.alias("source"))
        .mapInArrow(tokenize, f"doc_id {kind}, source string, n long, before long, ids binary")
        .withColumn("part", F.spark_partition_id()),
        "pack-tokens",
    )
    parts = written(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "pack-parts")
    total = parts.agg(F.sum("n")).first()[0] or 0
    sums = parts.groupBy("source").agg(F.sum("n").alias("own"))
    # at most `window` rows
    large = [(r["source"], int(r["own"])) for r in sums.where(F.col("own") * window >= total).orderBy("source").collect()]
    shares = [n for _, n in large]
    shares.append(total - sum(shares))
    queues = spark.createDataFrame([(name, k) for k, (name, _) in enumerate(large)], "source string, queue int")
    in_source = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        parts.withColumn("base", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
        .drop("n")
        .join(sums, "source")
        .join(F.broadcast(queues), "source", "left")
    )
    n_bases = parts.count()
    if n_bases <= 200_000:  # partitions times sources; else Spark chooses
        bases = F.broadcast(bases)
    ahead = [0, *np.cumsum(shares).tolist()]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def served(j: int, k: int) -> int:
            """Tokens of the first j queues in the first k windows."""
            return k * window * ahead[j] // total if k * window < total else ahead[j]

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, n, ids, q, at in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                every = np.frombuffer(ids, dtype="<u2").astype("<u4")
                # the first window that has served beyond `at` tokens of the queue
                k = max(0, at * total // (shares[q] * window) - 1)
                while served(q + 1, k + 1) - served(q, k + 1) <= at:
                    k += 1
                done = 0
                while done < n:
                    upto = served(q + 1, k + 1) - served(q, k + 1)
                    since = served(q + 1, k) - served(q, k)
                    take = min(n - done, upto - (at + done))
                    if take > 0:
                        own = every[done : done + take]
                        # queues in front of this one come first in the window
                        offset = served(q, k + 1) - served(q, k) + at + done - since
                        rows.append((doc_id, done, take, zlib.crc32(own), n, k, offset, own.astype("i4") if keep_ids else None))
                        done += take
                    k = max(k + 1, (at + done) * total // (shares[q] * window) - 1)
                if len(rows) >= 20_000:
                    yield _piece_batch(rows, keep_ids)
                    rows = []
            if rows:
                yield _piece_batch(rows, keep_ids)

    placed = tokens.join(bases, ["part", "source"]).withColumn("at", F.col("base") + F.col("before"))
    columns = ["doc_id", "n", "ids", "queue", "at"]
    if shares[-1]:
        middle = ((F.col("at") + F.col("n") / 2) / F.col("own")).alias("middle")
        small = placed.where("queue is null").select(F.lit(len(large)).alias("queue"), middle, "source", "doc_id", "n", "ids")
        ordered = running_totals(small, ["queue"], ["middle", "source"], "n", "pack-small")
        placed = placed.where("queue is not null").select(columns).unionByName(ordered.withColumnRenamed("before", "at").select(columns))
    else:
        placed = placed.select(columns)
    extra = ", ids array<int>" if keep_ids else ""
    return placed.mapInArrow(
        place,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{extra}",
    )


def _piece_batch(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c) for c in columns[:7]]
    if keep_ids:
        names, arrays = [*names, "ids"], [*arrays, pa.array(columns[7], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, names)
