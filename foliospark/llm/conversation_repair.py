"""Operator 11, conversation structure repair: cheapest edits that make turns alternate, by a Viterbi run in parallel chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, written

#: Turns and bytes of text of a chunk: bound the memory of every later task.
CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 20
#: Consecutive chunks that the first fix-up pass walks through in one task; each further pass takes twice as many.
FIRST_RUN = 64

Vector = tuple[int, int, int, int]
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a turn that is inserted or given another role: the one role of user and assistant that is legal here.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Least cost of insertions that end the conversation legally.
END: Vector = (0, 4, 2, 0)
#: A symbol is a turn's role initial (s, u, a, other) and 4 if it is truncated; GONE turns must be deleted.
GONE = 8
KEEP_AT: dict[int, dict[int, int]] = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}, 3: {}}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_SPACE = " \t\n\x0b\x0c\r"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


@lru_cache(maxsize=None)  # some dozens of vectors differ by more than a constant
def before(after: Vector, symbol: int) -> tuple[Vector, int]:
    """Least costs to the end from in front of a turn, given those behind it, as (vector with minimum 0, constant)."""
    if symbol == GONE:
        return after, 3
    late, kept = symbol >> 2, KEEP_AT[symbol & 3]
    v = [min(3 + after[s], 2 + late + after[NEXT[s]], late + after[kept[s]] if s in kept else 99) for s in range(4)]
    # insertions in front of the turn
    v[USER], v[ASSISTANT] = min(v[USER], 2 + v[ASSISTANT]), min(v[ASSISTANT], 2 + v[USER])
    v[START], v[SYSTEM] = min(v[START], 2 + v[USER]), min(v[SYSTEM], 2 + v[USER])
    least = min(v)
    return tuple(x - least for x in v), least


def sweep(symbols: bytes, end: Vector) -> Vector:
    """The vector in front of a chunk, up to a constant."""
    for symbol in reversed(symbols):
        end, _ = before(end, symbol)
    return end


def sweep_again(symbols: bytes, old_end: Vector, old_out: Vector, end: Vector) -> Vector:
    """sweep() from another vector; ends as soon as the two runs' vectors differ only by a constant."""
    for symbol in reversed(symbols):
        if end == old_end:
            return old_out
        end, _ = before(end, symbol)
        old_end, _ = before(old_end, symbol)
    return end


def trace(symbols: bytes, end: Vector, states: list[int]) -> list[tuple[str, int, int]]:
    """(audit, state behind, cost) for each state in front: of the cheapest edits the ASCII-least, D < I < K < R."""
    vectors, shifts = [end], []
    for symbol in reversed(symbols):
        v, shift = before(vectors[-1], symbol)
        vectors.append(v)
        shifts.append(shift)
    vectors.reverse()
    shifts.reverse()
    found = []
    for state in states:
        audit, cost = [], 0
        for k, symbol in enumerate(symbols):
            v, after, shift = vectors[k], vectors[k + 1], shifts[k]
            late = symbol >> 2 if symbol != GONE else 0
            while True:
                here = v[state] + shift
                kept = KEEP_AT[symbol & 3].get(state) if symbol != GONE else None
                if 3 + after[state] == here:
                    audit.append("D")
                    cost += 3
                elif 2 + v[NEXT[state]] + shift == here:
                    audit.append("I")
                    cost, state = cost + 2, NEXT[state]
                    continue
                elif kept is not None and late + after[kept] == here:
                    audit.append("K")
                    cost, state = cost + late, kept
                else:
                    audit.append("R")
                    cost, state = cost + 2 + late, NEXT[state]
                break
        found.append(("".join(audit), state, cost))
    return found


def closing(state: int) -> str:
    """The insertions behind the last turn."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


def rebuilt(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired turns as `role:text`."""
    out, k = [], 0
    for edit in audit:
        if edit in "IR":
            state = NEXT[state]
            out.append(f"{ROLE[state]}:{texts[k] if edit == 'R' else ''}")
        elif edit == "K":
            out.append(f"{roles[k]}:{texts[k]}")
            state = KEEP_AT[_initial(roles[k])][state]
        k += edit != "I"
    return out


def _initial(role: str) -> int:
    return max(0, "sua".find(role[:1])) if role[:1] and role[0] in "sua" else 3


def local_faults(roles: list[str], texts: list[str], keys: list[bytes]) -> bytearray:
    """The first fault of each turn, with duplicates among these turns only."""
    out, seen = bytearray(), set()
    for text, key in zip(texts, keys, strict=True):
        rest = text.rstrip(_SPACE)
        out.append(BLANK if not rest else DUPLICATE if key in seen else FINE if rest[-1] in ".!?" else TRUNCATED)
        seen.add(key)
    return out


def to_symbols(roles: list[str], faults: bytes) -> bytes:
    return bytes(GONE if f in (BLANK, DUPLICATE) else _initial(r) + 4 * (f == TRUNCATED) for r, f in zip(roles, faults, strict=True))


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, dropped): turns damaged by crc32("conv_id:turn") % 20, where null reads as one blank.

    0 drops the turn (the row stays, marked, to name its conversation), 1 empties its text, 2 removes full stops, exclamation
    and question marks, 3 repeats it, 4 makes its role user.
    """

    def read(c: str) -> F.Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", read(conv_col), read(turn_col)).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(read(text_col), "[.!?]", "")).otherwise(read(text_col))
    return turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(read(role_col)).alias("role"),
        text.alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


class _Chunk:
    """Consecutive turns of one conversation."""

    def __init__(self) -> None:
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.keys: list[bytes] = []
        self.size = 0
        self.first: int | None = None
        self.last: int | None = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, key: bytes) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.keys.append(key)
        self.size += len(text)
        if turn is not None:
            self.distinct += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn

    def result(self) -> dict:
        """The answer for a conversation that is this chunk alone: its vector at the end is known."""
        faults = local_faults(self.roles, self.texts, self.keys)
        ((audit, state, cost),) = trace(to_symbols(self.roles, faults), END, [START])
        audit += closing(state)
        return {
            "gaps": 0 if self.first is None else self.last - self.first + 1 - self.distinct,
            "blank": faults.count(BLANK),
            "duplicate": faults.count(DUPLICATE),
            "truncated": faults.count(TRUNCATED),
            "illegal": _illegal([r[:1] for r in self.roles]),
            "cost": cost + END[state],
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(rebuilt(audit, START, self.roles, self.texts)).encode()).hexdigest(),
        }

    def parts(self) -> dict:
        return {
            "roles": self.roles, "texts": self.texts, "keys": b"".join(self.keys),
            "faults": bytes(local_faults(self.roles, self.texts, self.keys)),
            "first": self.first, "last": self.last, "n_turns": self.distinct,
        }


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PARTS = "roles array<string>, texts array<string>, keys binary, faults binary, first long, last long, n_turns long"


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _in_batches(schema: pa.Schema, rows: Iterator[tuple[dict, int]]) -> Iterator[pa.RecordBatch]:
    """Batches of some megabytes from (row, size)."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 200
        if size > 4 << 20:
            yield _rows(schema, held)
            held, size = [], 0
    if held:
        yield _rows(schema, held)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield from batch.slice(at, 512).to_pylist()


def _cut(turns: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Conversations that lie inside one range of the sorted turns, answered; the others as chunks with seq in order."""
    from .packed import arrow_schema

    conv = turns.schema["conv_id"].dataType.simpleString()
    # the last key deals out equal turns, whose order is no matter
    order = ["conv_id", "turn", "role", "key", "copy"]
    keyed = turns.select(
        "conv_id", "turn", "role", "text", "dropped",
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("key"),
        F.monotonically_increasing_id().alias("copy"),
    )
    n = shuffle_partitions(turns.sparkSession)
    ranged = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ddl = f"conv_id {conv}, gid string, seq long, {_RESULT}, {_PARTS}"
    schema = arrow_schema(ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[dict, int]]:
            chunk, conv_id, n_chunks, whole, part = _Chunk(), None, 0, True, 0

            def out(alone: bool) -> tuple[dict, int]:
                nonlocal n_chunks
                head = {"conv_id": conv_id, "gid": "none" if conv_id is None else f"id {conv_id}", "seq": (part << 32) + n_chunks}
                n_chunks += 1
                return head | (chunk.result() if alone else chunk.parts()), 0 if alone else 2 * chunk.size

            began = False
            for r in _each(batches):
                if not began or r["conv_id"] != conv_id:
                    if began:
                        # the first one of a range may have begun in the range before
                        yield out(alone=whole and first_done)
                    first_done, began = began, True
                    chunk, conv_id, whole, part = _Chunk(), r["conv_id"], True, r["part"]
                elif len(chunk.roles) >= chunk_rows or chunk.size >= chunk_bytes:
                    yield out(alone=False)
                    chunk, whole = _Chunk(), False
                if not r["dropped"]:
                    chunk.add(r["turn"], r["role"], r["text"], r["key"])
            if began:
                yield out(alone=False)

        yield from _in_batches(schema, made())

    return written(ranged.select("conv_id", "turn", "role", "text", "dropped", "key", "part").mapInArrow(cut, ddl), "repair-cut")


def _repeated_elsewhere(chunks: DataFrame) -> DataFrame:
    """(gid, seq, again): places in a chunk whose turn is in an earlier chunk of the conversation."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            places = [k for k, f in enumerate(r["faults"]) if f in (FINE, TRUNCATED)]
            if places:
                key = pa.array([r["keys"][32 * k : 32 * k + 32] for k in places], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["gid"]] * len(places)), pa.array([r["seq"]] * len(places)), pa.array(places, pa.int32()), key],
                    ["gid", "seq", "place", "key"],
                )

    several = chunks.groupBy("gid").count().where("count > 1").select("gid")
    found = chunks.select("gid", "seq", "faults", "keys").join(several, "gid", "left_semi").mapInArrow(keys, "gid string, seq long, place int, key binary")
    earliest = found.groupBy("gid", "key").agg(F.min("seq").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = found.join(earliest, ["gid", "key"]).where("seq > least")
    return again.groupBy("gid", "seq").agg(F.collect_list("place").alias("again"))  # at most a chunk's turns


def _with_symbols(chunks: DataFrame) -> DataFrame:
    """The chunks without their texts: symbols, counts, neighbours' numbers, and what must be known at their edges."""
    ddl = (
        "gid string, seq long, symbols binary, n long, blank long, duplicate long, truncated long, illegal long, "
        "head string, tail string, first long, last long, n_turns long"
    )
    from .packed import arrow_schema

    schema = arrow_schema(ddl)

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[dict, int]]:
            for r in _each(batches):
                faults = bytearray(r["faults"])
                for k in r["again"] or ():
                    faults[k] = DUPLICATE
                roles = [x[:1] for x in r["roles"]]
                row = {k: r[k] for k in ("gid", "seq", "first", "last", "n_turns")} | {
                    "symbols": to_symbols(r["roles"], faults), "n": len(roles),
                    "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
                    "illegal": _illegal(roles), "head": roles[0] if roles else None, "tail": roles[-1] if roles else None,
                }
                yield row, len(roles)

        yield from _in_batches(schema, made())

    found = chunks.select("gid", "seq", "roles", "faults", "first", "last", "n_turns").join(_repeated_elsewhere(chunks), ["gid", "seq"], "left")
    slim_chunks = written(found.mapInArrow(slim, ddl), "repair-slim")
    # two numbers a chunk; a chunk stands for thousands of turns
    in_order = Window.partitionBy("gid").orderBy("seq")
    numbers = slim_chunks.select("gid", "seq", F.row_number().over(in_order).alias("k"), F.lead("seq").over(in_order).isNull().alias("final"))
    numbered = written(slim_chunks.join(numbers, ["gid", "seq"]), "repair-slim")
    discard(slim_chunks)
    return numbered


def converged(slim: DataFrame, first_run: int = FIRST_RUN) -> DataFrame:
    """(gid, k, symbols, ends): the cost vector behind each chunk, up to a constant, written.

    All chunks start at once from the speculative vector END. In a fix-up pass, a chunk whose successor came out with
    another vector is run again from that one, until the vectors differ only by constants; passes go on until no chunk
    changes. A task walks through a run of consecutive chunks, and runs double from pass to pass, so that also turns which
    never forget a vector (say, user turns only) take a logarithmic number of passes.
    """
    ddl = "gid string, k int, final boolean, symbols binary, ends array<int>, out array<int>, changed boolean"
    from .packed import arrow_schema

    schema = arrow_schema(ddl)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(schema, ((r | {"ends": END, "out": sweep(r["symbols"], END), "changed": False}, len(r["symbols"])) for r in _each(batches)))

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[dict, int]]:
            came = None
            for r in _each(batches):
                behind = came and came["gid"] == r["gid"] and came["k"] == r["k"] + 1
                wanted = END if r["final"] else tuple(came["out"] if behind else r["next_out"])
                ends = tuple(r["ends"])
                changed = wanted != ends
                out = sweep_again(r["symbols"], ends, tuple(r["out"]), wanted) if changed else tuple(r["out"])
                came = r | {"ends": wanted, "out": out, "changed": changed}
                yield came, len(r["symbols"])

        yield from _in_batches(schema, made())

    now = written(slim.select("gid", "k", "final", "symbols").mapInArrow(start, ddl), "repair-pass")
    run = first_run
    while True:
        following = now.select("gid", (F.col("k") - 1).alias("k"), F.col("out").alias("next_out"))
        runs = now.drop("changed").join(following, ["gid", "k"], "left").withColumn("run", F.floor(F.col("k") / run))
        runs = runs.repartition(shuffle_partitions(slim.sparkSession), "gid", "run").sortWithinPartitions("gid", F.desc("k"))
        then, now = now, written(runs.drop("run").mapInArrow(fix, ddl), "repair-pass")
        discard(then)
        if now.where("changed").isEmpty():
            return now
        run *= 2


def _entered(slim: DataFrame, passes: DataFrame) -> DataFrame:
    """(gid, seq, k, symbols, ends, state) of each chunk, with the state in front of it; the final chunk of a conversation also has
    its results except for the repaired text. A chunk's exits by entry are known by itself, so this walk is over chunks."""
    from .packed import arrow_schema

    added = "exits array<int>, costs array<long>"
    exits_schema = arrow_schema(f"gid string, k int, symbols binary, ends array<int>, {added}")

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[dict, int]]:
            for r in _each(batches):
                found = trace(r["symbols"], tuple(r["ends"]), [START, SYSTEM, USER, ASSISTANT])
                yield r | {"exits": [x[1] for x in found], "costs": [x[2] for x in found]}, len(r["symbols"])

        yield from _in_batches(exits_schema, made())

    traced = passes.select("gid", "k", "symbols", "ends").mapInArrow(exits, f"gid string, k int, symbols binary, ends array<int>, {added}")
    traced = written(traced, "repair-traced")
    walk_ddl = "gid string, k int, state int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    walk_schema = arrow_schema(walk_ddl)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[dict, int]]:
            gid, total, state, tail, ends, distinct = None, {}, START, None, [None, None], 0
            for r in _each(batches):
                if r["gid"] != gid:
                    gid, total, state, tail, ends, distinct = r["gid"], dict.fromkeys((*_COUNTS, "cost"), 0), START, None, [None, None], 0
                row = {"gid": gid, "k": r["k"], "state": state}
                for c in _COUNTS:
                    total[c] += r[c]
                total["cost"] += r["costs"][state]
                if r["n"]:
                    total["illegal"] += tail is not None and tail + r["head"] not in ("su", "ua", "au")
                    tail = r["tail"]
                if r["first"] is not None:
                    distinct += r["n_turns"] - (r["first"] == ends[1])
                    ends = [r["first"] if ends[0] is None else ends[0], r["last"]]
                state = r["exits"][state]
                if r["final"]:
                    row |= total | {"gaps": 0 if ends[0] is None else ends[1] - ends[0] + 1 - distinct, "cost": total["cost"] + END[state]}
                yield row, 0

        yield from _in_batches(walk_schema, made())

    facts = slim.drop("symbols", "seq").join(traced.select("gid", "k", "exits", "costs"), ["gid", "k"])
    walked = facts.repartition(shuffle_partitions(slim.sparkSession), "gid").sortWithinPartitions("gid", "k").mapInArrow(walk, walk_ddl)
    found = slim.select("gid", "seq", "k", "final").join(traced.select("gid", "k", "symbols", "ends"), ["gid", "k"]).join(walked, ["gid", "k"])
    found = written(found, "repair-entered")
    discard(traced)
    return found


def _finished(chunks: DataFrame, entered: DataFrame, conv: str) -> DataFrame:
    """The conversations of several ranges or chunks: repaired texts chunk by chunk, then one hash over each conversation's."""
    from .packed import arrow_schema

    counts = ["gaps", *_COUNTS, "cost"]
    ddl = f"conv_id {conv}, gid string, k int, final boolean, audit string, body binary, filled boolean, " + ", ".join(f"{c} long" for c in counts)
    schema = arrow_schema(ddl)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[dict, int]]:
            for r in _each(batches):
                ((audit, state, _),) = trace(r["symbols"], tuple(r["ends"]), [r["state"]])
                audit += closing(state) if r["final"] else ""
                lines = rebuilt(audit, r["state"], r["roles"], r["texts"])
                body = "\n".join(lines).encode()
                yield r | {"audit": audit, "body": body, "filled": bool(lines)}, len(body)

        yield from _in_batches(schema, made())

    texts = chunks.select("conv_id", "gid", "seq", "roles", "texts").join(entered, ["gid", "seq"]).mapInArrow(repaired, ddl)
    out_ddl = f"conv_id {conv}, {_RESULT}"
    out_schema = arrow_schema(out_ddl)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[dict, int]]:
            digest, audits, any_line, gid = hashlib.sha256(), [], False, None
            for r in _each(batches):
                if r["gid"] != gid:
                    digest, audits, any_line, gid = hashlib.sha256(), [], False, r["gid"]
                if r["filled"]:
                    digest.update(b"\n" * any_line + r["body"])
                    any_line = True
                audits.append(r["audit"])
                if r["final"]:
                    row = {"conv_id": r["conv_id"], "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}
                    yield row | {c: r[c] for c in counts}, len(row["audit"])

        yield from _in_batches(out_schema, made())

    ordered = texts.repartition(shuffle_partitions(chunks.sparkSession), "gid").sortWithinPartitions("gid", "k")
    return ordered.mapInArrow(hashed, out_ddl)


def repair(turns: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, first_run: int = FIRST_RUN) -> DataFrame:
    """turns: (conv_id, turn, role, text, dropped), as damage() gives them. One row per conversation: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A turn's first fault counts: blank (white space only), duplicate (role and text seen earlier in the conversation), truncated
    (its last character that is no white space is none of `.!?`). Edits: Keep 0, Rerole to user or assistant 2, Delete 3
    (blank and duplicate turns must go), Insert an empty user or assistant turn 2; a truncated turn that stays adds 1. The
    cheapest edits that leave role initials `(s?(ua)+)?` are taken, of several the ones with the ASCII-least initials. gaps
    counts missing turn numbers, illegal the neighbours whose role initials are not su, ua or au.

    Turns are range-partitioned by conversation and turn, so that a conversation of any length spreads over tasks, and cut
    into chunks. A conversation inside one range is one chunk, whose Viterbi starts from the known vector; the others go
    through converged(): speculative vectors, fix-up passes, then the traces of all chunks from every state, stitched by
    the states in which chunks are entered. Only SHA-256 must take a conversation's repaired text in order: one task reads it
    chunk by chunk, in bounded memory.

    Turns come by number, null first; ties by role, then by SHA-256 of role and text, so that input order is no matter.
    Null ids make one conversation; null roles and texts must have been replaced (damage() reads them as one blank). A role
    that begins with none of s, u, a can't be kept. A conversation whose turns are all dropped has zeros, an empty audit and
    the hash of nothing; an empty table gives no row. Repeated rows are turns of their own. Other columns are not read.
    """
    conv = turns.schema["conv_id"].dataType.simpleString()
    cut = _cut(turns, chunk_rows, chunk_bytes)
    names = [c.split()[0] for c in _RESULT.split(", ")]
    done = cut.where("roles is null").select("conv_id", *names)
    chunks = cut.where("roles is not null")
    slim = _with_symbols(chunks)
    passes = converged(slim, first_run)
    entered = _entered(slim, passes)
    discard(slim)
    discard(passes)
    return done.unionByName(_finished(chunks, entered, conv).select("conv_id", *names))
