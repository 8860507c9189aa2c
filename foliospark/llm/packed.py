"""Exchange of hashed places in packed form, for operators that compare every shingle or window of a corpus.

A row per hash would cost some 35 shuffled bytes. Here a map task sorts the hashes of a chunk of documents and sends
each bucket (a range of hash values) one row: the differences of the sorted hashes, further hashes and the places as byte
planes, compressed. A bucket is small, as the number of buckets follows the corpus; equal hashes of a chunk are sent
once, so that a hash that half of all documents hold adds one entry per chunk. A row holds one hash at least, so there
are never more rows than hashes, however many buckets there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, shuffle_partitions

#: Words of a chunk: bounds the memory of a map task (about 80 bytes a word).
CHUNK_WORDS = 500_000
#: Hashes a bucket should hold: bounds the memory of a reduce task (about 120 bytes a hash).
BUCKET_HASHES = 400_000


def _planes(x: np.ndarray) -> list[bytes]:
    """The first bytes of an integer array, the second ones, and so on."""
    return [row.tobytes() for row in np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T]


def pack_buckets(bucket: np.ndarray, arrays: list[np.ndarray], packer: zstandard.ZstdCompressor) -> Iterator[tuple[list[int], list[bytes]]]:
    """(buckets, bodies), some at a time, of integer arrays sorted by bucket (all of them) and the first one (within each)."""
    edges = np.r_[np.flatnonzero(np.r_[len(bucket) > 0, bucket[1:] != bucket[:-1]][: len(bucket)]), len(bucket)]
    for at in range(0, len(edges) - 1, 64):
        some = edges[at : at + 65].tolist()
        bodies = []
        for a, b in zip(some[:-1], some[1:], strict=True):
            own = [x[a:b] for x in arrays]
            own[0] = np.r_[own[0][:1], np.diff(own[0])]
            # each plane by itself, as their bytes are spread differently
            planes = [packer.compress(p) for x in own for p in _planes(x)]
            bodies.append(b"".join([np.array([len(p) for p in planes], dtype="<u4").tobytes(), *planes]))
        yield bucket[some[:-1]].tolist(), bodies


def unpack_bodies(bodies: pa.ChunkedArray, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of many bodies, one after the other."""
    unpacker = zstandard.ZstdDecompressor()
    parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    n_planes = sum(np.dtype(k).itemsize for k in kinds)
    for body in bodies:
        if not body.is_valid:
            continue
        raw = body.as_py()
        ends = np.cumsum(np.frombuffer(raw, "<u4", n_planes)) + 4 * n_planes
        planes = iter([unpacker.decompress(raw[a:b]) for a, b in zip([4 * n_planes, *ends[:-1]], ends, strict=True)])
        for own, kind in zip(parts, kinds, strict=True):
            rows = [np.frombuffer(next(planes), np.uint8) for _ in range(np.dtype(kind).itemsize)]
            own.append(np.ascontiguousarray(np.stack(rows).T).view(kind).ravel())
        parts[0][-1] = np.cumsum(parts[0][-1], dtype=kinds[0])
    return [np.concatenate(own) for own in parts]


def bucket_width(n_buckets: int) -> np.uint64:
    """Hash values of a bucket."""
    return np.uint64(math.ceil(2**64 / n_buckets) if n_buckets > 1 else 2**64 - 1)


def _in_order(keys: np.ndarray, doc: np.ndarray, place: np.ndarray, dealt: bool) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys, doc, place, and which entries begin a new key. dealt: they come by doc and place."""
    order = np.argsort(keys[0], kind="stable") if dealt else np.lexsort((place, doc, keys[0]))
    new = _new(np.take(keys[:1], order, axis=1))
    if len(keys) > 1 and (_new(np.take(keys, order, axis=1)) != new).any():  # equal in the first hash only
        order = np.lexsort((place, doc, *keys[::-1]))
        new = _new(np.take(keys, order, axis=1))
    return order, new


def _new(keys: np.ndarray) -> np.ndarray:
    return np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]


def bucket_count(docs: DataFrame, text_col: str = "text", hashes: int = BUCKET_HASHES) -> int:
    """Buckets for about one hash a word, the words being estimated from the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), math.ceil(total / 6 / hashes))


def exchange(
    docs: DataFrame,
    n_buckets: int,
    hashes_of: Callable[[bytes], np.ndarray],
    local: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple],
    judge: Callable[[np.ndarray, np.ndarray, np.ndarray], list[pa.RecordBatch]],
    parts: str,
    combine: Callable[[pa.Table], pa.Table],
    result: str,
) -> DataFrame:
    """docs: (doc_id long, text). Returns what combine() makes of each document's findings, a row a document.

    hashes_of(text) gives a document's keys in order of their places 0, 1, ...: a row of hashes (uint64, spread evenly),
    and maybe rows of independent ones below 2**16, that together make up the key. local(new, doc_id, place), of a chunk sorted by key,
    doc_id and place, in which new marks the first entry of each key, gives (rows to send as a mask, batches of findings
    to return at once). judge(new, doc_id, place) gets a bucket in the same order and gives such batches, of the schema
    `parts`, whose first column is doc_id. Findings go back packed as well, one row from each bucket to each group of
    documents; combine() gets all findings of a group.
    """
    width = bucket_width(n_buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        ids: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.fromiter((p.shape[1] for p in parts), np.int64, len(parts))
            keys = np.concatenate(parts, axis=1)
            doc = np.repeat(np.array(ids, dtype=np.int64), sizes)
            place = (np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
            order, new = _in_order(keys, doc, place, _sorted(ids))
            keys, doc, place = np.take(keys, order, axis=1), doc[order], place[order]
            mask, found = local(new, doc, place)
            for b in found:
                yield wrap(b)
            keys, doc, place = np.compress(mask, keys, axis=1), doc[mask], place[mask]
            bucket = (keys[0] // width).astype(np.int32)
            for some, bodies in pack_buckets(bucket, [keys[0], *keys[1:].astype(np.uint16), doc, place], packer):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(bodies, pa.binary()), pa.nulls(len(some), pa.binary())], ["bucket", "body", "done"]
                )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                found = hashes_of(text.as_py() or b"")
                found = np.atleast_2d(found)
                if found.shape[1]:
                    ids.append(doc_id)
                    parts.append(found)
                    held += found.shape[1]
                if held >= CHUNK_WORDS:
                    yield from flush()
                    ids, parts, held = [], [], 0
                    pa.default_memory_pool().release_unused()
        if parts:
            yield from flush()

    def reduce(table: pa.Table) -> pa.Table:
        done = [unpack_table(x.as_py()) for x in table.column("done") if x.is_valid]
        *keys, doc, place = unpack_bodies(table.column("body"), ["u8"] + ["u2"] * (n_keys - 1) + ["i8", "u4"])
        if len(doc):
            order, new = _in_order(np.stack([k.astype(np.uint64) for k in keys]), doc, place, dealt=False)
            done += [pa.Table.from_batches([b]) for b in judge(new, doc[order], place[order])]
        pa.default_memory_pool().release_unused()
        return to_groups(done, parts_schema, n_buckets)

    def gather(table: pa.Table) -> pa.Table:
        return combine(pa.concat_tables([unpack_table(x.as_py()) for x in table.column("findings")])).cast(result_schema)

    parts_schema, result_schema = arrow_schema(parts), arrow_schema(result)
    n_keys = len(np.atleast_2d(hashes_of(b"")))
    sent = docs.mapInArrow(send, "bucket int, body binary, done binary")
    # findings of a chunk itself have a negative bucket and only pass through
    judged = sent.groupBy("bucket").applyInArrow(reduce, "group int, findings binary")
    return judged.groupBy("group").applyInArrow(gather, result)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def to_groups(found: list[pa.Table], schema: pa.Schema, n_groups: int) -> pa.Table:
    """Findings packed by groups of documents, one row a group."""
    out: dict[str, list] = {"group": [], "findings": []}
    if found:
        table = pa.concat_tables([t.cast(schema) for t in found])
        group = (mixed(table.column(0).to_numpy().view(np.uint64)) % np.uint64(n_groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(rows):
                out["group"].append(int(group[rows[0]]))
                out["findings"].append(pack_table(table.take(pa.array(rows))))
    return pa.table({"group": pa.array(out["group"], pa.int32()), "findings": pa.array(out["findings"], pa.binary())})


def _sorted(ids: list[int]) -> bool:
    return all(a <= b for a, b in zip(ids, ids[1:], strict=False))


def wrap(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row that passes findings by the buckets."""
    # dealt out by the batch's first id, so that no one task gets all of them
    key = -1 - int(batch.column(0)[0].as_py() or 0) % 4096
    done = pa.array([pack_table(pa.Table.from_batches([batch]))], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.nulls(1, pa.binary()), done], ["bucket", "body", "done"])


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack_table(b: bytes) -> pa.Table:
    with pa.ipc.open_stream(b) as r:
        return r.read_all()
