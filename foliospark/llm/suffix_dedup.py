"""Operator 13, suffix-array dedup: byte strings that start at two places, by hash-compared sorting of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mixed, row_key, written
from .packed import arrow_schema, bucket_count, bucket_width, pack_buckets, pack_table, to_groups, unpack_bodies, unpack_table, wrap

#: Bytes of the pieces whose least hash anchors a window; a power of two below every window.
GRAM = 64
#: Suffixes sorted at a time: bounds the memory of a reduce task (about 400 bytes each).
SORTED_AT_ONCE = 100_000
_PIECE = 1 << 17
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
#: A 64-bit value for each byte.
_BYTES = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
REPEATED, SORT, SPLIT = 1, 2, 3


@dataclass(frozen=True)
class Limits:
    """What bounds the memory of a task; results are the same under any."""

    #: Distinct surroundings of an anchor that are sorted in one task; more are compared by the digests of single windows.
    sorted: int = 4096
    #: Distinct surroundings of one anchor that a chunk of documents sends; more also go by single windows.
    sent: int = 16
    #: Anchors, bytes and windows of a chunk.
    anchors: int = 100_000
    size: int = 8 << 20
    windows: int = 100_000


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    level, power, size = _BYTES[raw], np.uint64(_BASE), 1
    while size < GRAM:
        level = level[:-size] * power + level[size:]
        power = np.uint64(int(power) * int(power) % 2**64)
        size *= 2
    return mixed(level)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, offset, n): all windows of a text, in runs of n consecutive ones from `start` with one anchor, `offset`
    behind the first. A window's anchor is its leftmost GRAM bytes of least hash, so equal windows have equal anchors at
    equal places."""
    raw = np.frombuffer(text, np.uint8)
    windows = len(raw) - width + 1
    found = []
    for base in range(0, windows, _PIECE):
        m = min(_PIECE, windows - base)
        h = _gram_hashes(raw[base : base + m + width - 1])
        at = (_sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), width - GRAM + 1) & _LOW).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        # hashes that are the least of many are small; mixed again, they spread evenly over buckets
        found.append((mixed(mixed(h[at[edge]])), base + edge, at[edge] - edge, np.diff(np.r_[edge, m])))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Which entries of sorted keys begin a new key."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def common(sums: np.ndarray, scale: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Lengths, up to limit, of the common beginnings of the suffixes at x and at y: a binary search on prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), limit, np.int64)
    sx, sy, kx, ky = sums[x], sums[y], scale[x], scale[y]
    for _ in range(limit.bit_length()):
        mid = (low + high + 1) >> 1
        same = (sums[x + mid] - sx) * kx == (sums[y + mid] - sy) * ky
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def prefix_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, scale): the polynomial hash of bytes a .. b - 1 is (sums[b] - sums[a]) * scale[a] modulo 2**64."""
    powers = np.full(len(raw) + 1, _BASE, np.uint64)
    powers[0] = 1
    inverse = np.full(len(raw) + 1, pow(_BASE, -1, 2**64), np.uint64)
    inverse[0] = 1
    powers, inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * powers[:-1], out=sums[1:])
    return sums, inverse


def suffix_order(raw: np.ndarray, x: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes at x by their first `limit` bytes inside each group (group: sorted numbers).

    Returns (order, equal): equal marks a suffix whose first bytes are those of the one before it in its group. A bottom-up
    mergesort: each round, every suffix finds its rank in the neighbouring run by binary search, comparing by prefix hashes.
    Neighbours are then compared byte by byte; a group that a hash collision has put in a wrong order is sorted by its bytes.
    """
    sums, scale = prefix_hashes(raw)
    first = np.flatnonzero(_firsts(group))
    size = np.diff(np.r_[first, len(group)])
    head, size = np.repeat(first, size), np.repeat(size, size)
    order = np.arange(len(x))
    length = 1
    while length < size.max(initial=0):
        some = np.flatnonzero(size > length)  # places in groups of more than one run
        q = some - head[some]
        left = (q // length) % 2 == 0
        other = np.where(left, q // length + 1, q // length - 1) * length
        low, high = np.minimum(other, size[some]), np.minimum(other + length, size[some])
        begin = low.copy()
        mine = x[order[some]]
        for _ in range(length.bit_length()):
            mid = (low + high) >> 1
            open_ = low < high
            at = np.where(open_, head[some] + mid, some)
            theirs = x[order[at]]
            c = common(sums, scale, mine, theirs, limit)
            same, inside = c >= limit, np.minimum(c, limit - 1)
            before = np.where(same, ~left, raw[theirs + inside] < raw[mine + inside])  # theirs comes first
            low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
        place = head[some] + (q // (2 * length)) * 2 * length + q % length + (low - begin)
        moved = order[some]
        order[place] = moved
        length *= 2
    equal = np.zeros(len(x), bool)
    wrong = set()
    view = np.lib.stride_tricks.sliding_window_view(raw, limit) if len(raw) >= limit else None
    pairs = np.flatnonzero(~_firsts(group))
    for at in range(0, len(pairs), 20_000):
        b = pairs[at : at + 20_000]
        xa, xb = x[order[b - 1]], x[order[b]]
        differ = view[xa] != view[xb]
        true = np.where(differ.any(axis=1), differ.argmax(axis=1), limit)
        inside = np.minimum(true, limit - 1)
        equal[b] = true == limit
        bad = (true != common(sums, scale, xa, xb, limit)) | ((true < limit) & (raw[xa + inside] > raw[xb + inside]))
        wrong.update(head[b[bad]].tolist())
    for a in wrong:
        own = order[a : a + size[a]]
        content = [raw[p : p + limit].tobytes() for p in x[own].tolist()]
        by_bytes = sorted(range(len(own)), key=content.__getitem__)
        order[a : a + size[a]] = own[by_bytes]
        equal[a : a + size[a]] = [k > 0 and content[j] == content[by_bytes[k - 1]] for k, j in enumerate(by_bytes)]
    return order, equal


def _marks(row: np.ndarray, start: np.ndarray, n: np.ndarray, kind: int | np.ndarray, anchor: np.ndarray, offset: np.ndarray) -> list[pa.Table]:
    """Findings: n windows of a row from `start`, and what is known of them or to be done with them."""
    if not len(row):
        return []
    what = ((start.astype(np.int64) << 18) | (offset.astype(np.int64) << 10) | (n.astype(np.int64) << 2) | kind).astype(np.int64)
    return [pa.table({"row": row.astype(np.int64), "what": what, "anchor": anchor.view(np.int64)})]


_MARKS = "row long, what long, anchor long"


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, offset, n of a place, whose lowest two bits are flags."""
    place = place.astype(np.int64)
    return place >> 18, (place >> 10) & 255, (place >> 2) & 255


def judge_surroundings(anchor: np.ndarray, d1: np.ndarray, d2: np.ndarray, row: np.ndarray, place: np.ndarray, most: int) -> list[pa.Table]:
    """Of all runs with an anchor: those with equal bytes repeat; of different ones, one each is asked for its bytes."""
    order = np.lexsort((place, row, d2, d1, anchor))
    anchor, d1, d2, row, place = (v[order] for v in (anchor, d1, d2, row, place))
    split = row < 0  # only tells that some chunk has many surroundings of this anchor; a row's key is never negative
    new = _firsts(anchor, d1, d2)
    runs = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    group = np.cumsum(_firsts(anchor)) - 1
    kinds = np.bincount(group, weights=new & ~split).astype(np.int64)[group]
    by_window = np.bincount(group, weights=split)[group] > 0
    start, offset, n = _unpacked(place)
    whole = (runs > 1) & ~split
    asked = new & ~split & ((kinds > 1) | by_window)
    kind = np.where(by_window | (kinds > most), SPLIT, SORT)
    return [
        *_marks(row[whole], start[whole], n[whole], REPEATED, np.zeros(int(whole.sum()), np.uint64), offset[whole]),
        *_marks(row[asked], start[asked], n[asked], kind[asked], anchor[asked], offset[asked]),
    ]


def judge_suffixes(table: pa.Table, width: int) -> list[pa.Table]:
    """(anchor, row, start, offset, n, bytes) of runs: sorts their windows as suffixes, marks those equal to another."""
    found: list[pa.Table] = []
    anchor = table.column("anchor").to_numpy()
    by_anchor = np.argsort(anchor, kind="stable")
    n_all = table.column("n").to_numpy()[by_anchor]
    new = _firsts(anchor[by_anchor])
    total = np.cumsum(n_all)
    # whole groups, about SORTED_AT_ONCE suffixes at a time
    part = (total[np.flatnonzero(new)[np.cumsum(new) - 1]] // SORTED_AT_ONCE) if len(n_all) else total
    for rows in np.split(by_anchor, np.flatnonzero(np.diff(part)) + 1):
        if not len(rows):
            continue
        some = table.take(pa.array(rows))
        row, start, offset, n = (some.column(c).to_numpy() for c in ("row", "start", "offset", "n"))
        pieces = some.column("bytes").to_pylist()
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        base = np.cumsum([0, *[len(p) for p in pieces[:-1]]])
        piece = np.repeat(np.arange(len(n)), n)
        w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        group = (np.cumsum(_firsts(some.column("anchor").to_numpy())) - 1)[piece] * 256 + offset[piece] - w
        by_group = np.argsort(group, kind="stable")
        order, equal = suffix_order(raw, (base[piece] + w)[by_group], group[by_group], width)
        repeated = np.zeros(len(w), bool)
        back = by_group[order]
        repeated[back[equal]] = True
        repeated[back[np.flatnonzero(equal) - 1]] = True
        edge = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (repeated[1:] != repeated[:-1])])
        span = np.diff(np.r_[edge, len(w)])
        keep = repeated[edge]
        edge, span = edge[keep], span[keep]
        zero = np.zeros(len(edge), np.int64)
        found += _marks(row[piece[edge]], start[piece[edge]] + w[edge], span, REPEATED, zero.view(np.uint64), zero)
    return found


def judge_windows(d1: np.ndarray, d2: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[pa.Table]]:
    """(first entry of each digest, marks for all entries whose digest others have too)."""
    order = np.lexsort((start, row, d2, d1))
    new = _firsts(d1[order], d2[order])
    several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
    hit = order[several]
    zero = np.zeros(len(hit), np.int64)
    return order[new], _marks(row[hit], start[hit], zero + 1, REPEATED, zero.view(np.uint64), zero)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            yield key, text.as_py() or b""


def _first_exchange(docs: DataFrame, n_buckets: int, width: int, limits: Limits) -> DataFrame:
    """(bucket, body, done): each run's anchor and a digest of its bytes, packed by anchor."""
    step = bucket_width(n_buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        # flat bytes: small arrays that stay between large ones that go would keep their memory from being used again
        anchor_bytes, key_bytes, place_bytes, digests = (bytearray() for _ in range(4))
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            anchor = np.frombuffer(bytes(anchor_bytes), np.uint64)
            row, place = (np.frombuffer(bytes(b), np.int64) for b in (key_bytes, place_bytes))
            d1, d2 = np.frombuffer(bytes(digests), "<u8").reshape(-1, 2).T
            order = np.lexsort((d2, d1, anchor))
            anchor, row, place, d1, d2 = (v[order] for v in (anchor, row, place, d1, d2))
            new = _firsts(anchor, d1, d2)
            run = np.cumsum(new) - 1
            several = np.bincount(run)[run] > 1
            start, offset, n = _unpacked(place)
            for t in _marks(row[several], start[several], n[several], REPEATED, np.zeros(int(several.sum()), np.uint64), offset[several]):
                yield from map(wrap, t.to_batches())
            # one entry for each anchor and digest goes on, or, of too many digests of an anchor, none but a note
            group = np.cumsum(_firsts(anchor)) - 1
            many = np.bincount(group, weights=new)[group] > limits.sent
            ask = new & many
            for t in _marks(row[ask], start[ask], n[ask], SPLIT, anchor[ask], offset[ask]):
                yield from map(wrap, t.to_batches())
            note = many & _firsts(anchor)
            send_on = (new & ~many) | note
            row = np.where(note, -1, row)
            d1, d2 = np.where(note, 0, d1), np.where(note, 0, d2)
            anchor, d1, d2, row, place = (v[send_on] for v in (anchor, d1, d2, row, place))
            for some, bodies in pack_buckets((anchor // step).astype(np.int32), [anchor, d1, d2, row, place], packer):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(bodies, pa.binary()), pa.nulls(len(some), pa.binary())], ["bucket", "body", "done"]
                )

        for key, text in _texts(batches):
            anchor, start, offset, n = anchors(text, width)
            if len(anchor):
                anchor_bytes += anchor.tobytes()
                key_bytes += np.full(len(anchor), key, np.int64).tobytes()
                place_bytes += ((start << 18) | (offset << 10) | (n << 2)).tobytes()
                for a, b in zip(start.tolist(), (start + n + width - 1).tolist(), strict=True):
                    digests += _digest(text[a:b])
                size += len(anchor)
            if size >= limits.anchors:
                yield from flush()
                for b in (anchor_bytes, key_bytes, place_bytes, digests):
                    b.clear()
                size = 0
                pa.default_memory_pool().release_unused()
        if size:
            yield from flush()

    return docs.mapInArrow(send, "bucket int, body binary, done binary")


def _second_exchange(asked: DataFrame, n_buckets: int, width: int, limits: Limits) -> DataFrame:
    """asked: (key, text compressed, asks). (bucket, runs, windows, done): bytes of the runs to be sorted, by anchor, and
    digests of the windows to be counted, by digest."""
    step = bucket_width(n_buckets)

    def by_bucket(table: pa.Table, key: np.ndarray) -> dict[int, bytes]:
        bucket = (key // step).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order])) + 1
        return {int(bucket[rows[0]]): pack_table(table.take(pa.array(rows))) for rows in np.split(order, edges) if len(rows)}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        runs: list[tuple] = []
        windows: list[tuple[np.ndarray, np.ndarray]] = []
        digests: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows: dict[int, list] = {}
            if runs:
                columns = list(zip(*runs, strict=True))
                kinds = [pa.uint64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["anchor", "row", "start", "offset", "n", "bytes"]
                table = pa.table({c: pa.array(v, k) for c, v, k in zip(names, columns, kinds, strict=True)})
                for b, body in by_bucket(table, table.column("anchor").to_numpy()).items():
                    rows[b] = [body, None]
            if digests:
                row, start = (np.concatenate(v) for v in zip(*windows, strict=True))
                d1, d2 = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2).T
                first, marks = judge_windows(d1, d2, row, start)
                for t in marks:
                    for batch in t.to_batches():
                        w = wrap(batch)
                        yield pa.RecordBatch.from_arrays([w.column(0), w.column(1), w.column(1), w.column(2)], ["bucket", "runs", "windows", "done"])
                table = pa.table({"d1": d1[first], "d2": d2[first], "row": row[first], "start": start[first]})
                for b, body in by_bucket(table, d1[first]).items():
                    rows.setdefault(b, [None, None])[1] = body
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(rows), pa.int32()),
                        pa.array([v[0] for v in rows.values()], pa.binary()),
                        pa.array([v[1] for v in rows.values()], pa.binary()),
                        pa.nulls(len(rows), pa.binary()),
                    ],
                    ["bucket", "runs", "windows", "done"],
                )

        for batch in batches:
            for key, packed, asks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = unpacker.decompress(packed.as_py())
                what, anchor = np.frombuffer(asks.as_py(), "<i8").reshape(-1, 2).T
                starts, offsets, ns = _unpacked(what)
                for a, s, o, n, kind in zip(anchor.view(np.uint64).tolist(), starts.tolist(), offsets.tolist(), ns.tolist(), (what & 3).tolist(), strict=True):
                    if kind == SORT:
                        runs.append((a, key, s, o, n, text[s : s + n + width - 1]))
                        size += n + width
                    else:
                        windows.append((np.full(n, key, np.int64), np.arange(s, s + n)))
                        digests += [_digest(text[p : p + width]) for p in range(s, s + n)]
                    if size >= limits.size or len(digests) >= limits.windows:
                        yield from flush()
                        runs, windows, digests, size = [], [], [], 0
                        pa.default_memory_pool().release_unused()
        yield from flush()

    return asked.mapInArrow(send, "bucket int, runs binary, windows binary, done binary")


def _gathered(sent: DataFrame, judge: Callable[[pa.Table], list[pa.Table]], n_buckets: int) -> DataFrame:
    """(row, marks, asks): what the buckets say of each row's windows, packed on its way."""
    schema = arrow_schema(_MARKS)

    def reduce(table: pa.Table) -> pa.Table:
        done = [unpack_table(x.as_py()) for x in table.column("done") if x.is_valid]
        found = to_groups(done + judge(table), schema, n_buckets)
        pa.default_memory_pool().release_unused()
        return found

    def gather(table: pa.Table) -> pa.Table:
        found = pa.concat_tables([unpack_table(x.as_py()) for x in table.column("findings")])
        row, what, anchor = (found.column(c).to_numpy() for c in ("row", "what", "anchor"))
        order = np.argsort(row, kind="stable")
        row, what, anchor = row[order], what[order], anchor[order]
        edges = np.r_[np.flatnonzero(_firsts(row)), len(row)]
        marks, asks = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = what[a:b]
            told = (own & 3) == REPEATED
            marks.append(own[told].tobytes() or None)
            asks.append(np.stack([own[~told], anchor[a:b][~told]], axis=1).tobytes() or None)
        return pa.table({"key": pa.array(row[edges[:-1]], pa.int64()), "marks": pa.array(marks, pa.binary()), "asks": pa.array(asks, pa.binary())})

    judged = sent.groupBy("bucket").applyInArrow(reduce, "group int, findings binary")
    return judged.groupBy("group").applyInArrow(gather, "key long, marks binary, asks binary")


def repeated_windows(docs: DataFrame, n_buckets: int, width: int, limits: Limits) -> DataFrame:
    """docs: (key, text). (key, marks): runs of windows whose bytes also start elsewhere, as packed places; written."""

    def first(table: pa.Table) -> list[pa.Table]:
        entries = unpack_bodies(table.column("body"), ["u8", "u8", "u8", "i8", "i8"])
        return judge_surroundings(*entries, most=limits.sorted) if len(entries[0]) else []

    def second(table: pa.Table) -> list[pa.Table]:
        found: list[pa.Table] = []
        runs = [unpack_table(x.as_py()) for x in table.column("runs") if x.is_valid]
        if runs:
            found += judge_suffixes(pa.concat_tables(runs), width)
        windows = [unpack_table(x.as_py()) for x in table.column("windows") if x.is_valid]
        if windows:
            w = pa.concat_tables(windows)
            found += judge_windows(*[w.column(c).to_numpy() for c in ("d1", "d2", "row", "start")])[1]
        return found

    surroundings = written(_gathered(_first_exchange(docs, n_buckets, width, limits), first, n_buckets), "suffix-surroundings")
    asked = _squeezed(docs).join(surroundings.where("asks is not null").select("key", "asks"), "key")
    suffixes = _gathered(_second_exchange(asked.select("key", "text", "asks"), n_buckets, width, limits), second, n_buckets)
    marks = surroundings.where("marks is not null").select("key", "marks").unionByName(suffixes.select("key", "marks"))
    found = written(marks.groupBy("key").agg(F.collect_list("marks").alias("marks")), "suffix-marks")
    discard(surroundings)
    return found


def _squeezed(docs: DataFrame) -> DataFrame:
    """(key, text compressed, other columns): texts are most of what a join shuffles."""
    names = docs.columns

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [packer.compress(t or b"") for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), *batch.columns[2:]], names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema} | {"text": "binary"}
    return docs.mapInArrow(squeeze, ", ".join(f"{c} {kinds[c]}" for c in names))


def suffix_dedup(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (removed byte intervals), kept (binary).

    A byte goes when it is covered by a string of `width` bytes of its document that also starts anywhere else, in another
    document or in the same one, overlaps included; strings are judged on the input. No first occurrence stays.

    1. Each window of `width` bytes has an anchor, the GRAM bytes of least hash in it, so that equal windows share theirs.
       Windows with one anchor follow one another: a run, some 70 windows. Runs meet by anchor, with a 128-bit digest of
       their bytes. Runs with equal digests repeat as a whole.
    2. Where an anchor has different runs, one of each kind sends its bytes. Their windows are sorted as suffixes, within
       anchor and offset, by a mergesort that compares by prefix hashes and binary search; neighbours with equal first
       `width` bytes repeat, which is verified byte by byte.
    3. Anchors with very many different runs (a common line in ever other surroundings) send digests of single windows
       instead, which are counted; so no group is larger than limits.sorted, and one key is sent once by each chunk.

    Null and empty texts have no bytes; those shorter than `width` stay. Rows with null or equal ids are documents of their
    own, so repeated rows of `width` bytes or more go wholly. Removed bytes may cut a character in two, so what is kept is
    binary. Other columns are not read; an empty table gives no row.
    """

    def cut(text: bytes, removed: list[tuple[int, int]]) -> dict:
        kept, at = [], 0
        for a, b in removed:
            kept.append(text[at:a])
            at = b
        return {"spans": [{"start": a, "end": b} for a, b in removed], "kept": b"".join([*kept, text[at:]])}

    return _cut(docs, width, id_col, text_col, limits, cut, "spans array<struct<start:long,end:long>>, kept binary")


def suffix_digests(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """suffix_dedup() as n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes."""

    def digest(text: bytes, removed: list[tuple[int, int]]) -> dict:
        sha, at = hashlib.sha256(), 0
        for a, b in removed:
            sha.update(text[at:a])
            at = b
        sha.update(text[at:])
        return {"n_spans": len(removed), "kept_sha256": sha.hexdigest()}

    return _cut(docs, width, id_col, text_col, limits, digest, "n_spans long, kept_sha256 string")


def _cut(docs: DataFrame, width: int, id_col: str, text_col: str, limits: Limits, make: Callable, ddl: str) -> DataFrame:
    if width <= GRAM or width > GRAM + 255:
        raise ValueError(f"width must be between {GRAM + 1} and {GRAM + 255}")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    keyed = base.select(row_key(base, "doc_id", "text").alias("key"), "text", "doc_id")
    marks = repeated_windows(keyed.where(F.octet_length("text") >= width).select("key", "text"), bucket_count(base, hashes=4_000_000), width, limits)
    full = f"doc_id {kind}, n_bytes long, n_removed long, {ddl}"
    schema = arrow_schema(full)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, own in zip(batch.column("text"), batch.column("marks").to_pylist(), strict=True):
                text = unpacker.decompress(packed.as_py())
                removed = covered(b"".join(own or []), width)
                rows.append({"n_bytes": len(text), "n_removed": sum(b - a for a, b in removed)} | make(text, removed))
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema.names)

    return _squeezed(keyed).join(marks, "key", "left").select("doc_id", "text", "marks").mapInArrow(apply, full)


def covered(marks: bytes, width: int) -> list[tuple[int, int]]:
    """The maximal byte intervals that the marked windows cover."""
    if not marks:
        return []
    start, _, n = _unpacked(np.unique(np.frombuffer(marks, "<i8")))
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + n + width - 1)[order])
    new = np.r_[True, start[1:] > end[:-1]]
    edges = np.flatnonzero(new)
    last = np.r_[edges[1:] - 1, len(end) - 1]
    return list(zip(start[edges].tolist(), end[last].tolist(), strict=True))
