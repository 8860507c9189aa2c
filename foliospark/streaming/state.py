"""Time- and state-dependent behaviours, each in a form that batch and streaming share where Spark allows it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: A batch of opened files closes this long after the last one.
QUIET_WINDOW = "1500 milliseconds"
UNDO_DEPTH = 10


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Timestamps without zone as UTC instants, which watermarks ask for."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def quiet_batches(events: DataFrame, key: str, path: str, ts: str = "ts", window: str = QUIET_WINDOW, delay: str | None = None) -> DataFrame:
    """key, started, ended, n, paths (sorted, distinct): arrivals with no pause as long as `window` are one batch.

    Two arrivals exactly one window apart are one batch. For a stream give `delay`, the watermark: later rows are
    dropped, and a batch is emitted once the watermark has passed its end.
    """
    e = event_time(events, ts)
    if delay:
        e = e.withWatermark(ts, delay)
    found = e.groupBy(key, F.session_window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.collect_set(path).alias("paths"))
    return found.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", F.array_sort("paths").alias("paths"))


def fold_history(actions: list[tuple[str, str]], past: list[str], future: list[str], depth: int = UNDO_DEPTH) -> list[tuple[int, int, str | None]]:
    """Applies (action, tag) in order: edit pushes its tag and clears the redo stack, undo and redo move one tag.
    Returns (undoable, redoable, tag on top) after each; past and future change in place."""
    out = []
    for action, tag in actions:
        if action == "undo":
            if past:
                future.append(past.pop())
        elif action == "redo":
            if future:
                past.append(future.pop())
        else:
            past.append(tag)
            future.clear()
        del past[:-depth]
        out.append((len(past), len(future), past[-1] if past else None))
    return out


_HISTORY = StructType(
    [
        StructField("key", LongType()), StructField("seq", LongType()), StructField("undoable", LongType()),
        StructField("redoable", LongType()), StructField("top", StringType()),
    ]
)


def history(events: DataFrame, depth: int = UNDO_DEPTH) -> DataFrame:
    """Batch form. events: key, seq, action, tag. One row an event: key, seq, undoable, redoable, top.

    A key's events are folded in order; a key is one group, so its history should fit a task.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        states = fold_history(list(zip(rows["action"], rows["tag"], strict=True)), [], [], depth)
        return pd.DataFrame(
            {
                "key": rows["key"].to_numpy(), "seq": rows["seq"].to_numpy(), "undoable": [s[0] for s in states],
                "redoable": [s[1] for s in states], "top": [s[2] for s in states],
            }
        )

    return events.select("key", "seq", "action", "tag").groupBy("key").applyInPandas(run, _HISTORY)


def history_stream(events: DataFrame, depth: int = UNDO_DEPTH) -> DataFrame:
    """Streaming form of history(): the stacks live in the state store, in update or append mode."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, future = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        states = fold_history(list(zip(rows["action"], rows["tag"], strict=True)), past, future, depth)
        state.update((past, future))
        yield pd.DataFrame(
            {
                "key": rows["key"].to_numpy(), "seq": rows["seq"].to_numpy(), "undoable": [s[0] for s in states],
                "redoable": [s[1] for s in states], "top": [s[2] for s in states],
            }
        )

    return (
        events.select("key", "seq", "action", "tag")
        .groupBy("key")
        .applyInPandasWithState(run, _HISTORY, "past array<string>, future array<string>", "append", GroupStateTimeout.NoTimeout)
    )


def decisions(proposals: DataFrame, answers: DataFrame, minutes: int = 5) -> DataFrame:
    """Each proposal with its decision: answers come within `minutes`, others are stale; none in time means refused.

    proposals: id, at; answers: id, answered, answer. For streams, put watermarks on both times before.
    """
    in_time = (
        (F.col("p.id") == F.col("a.id"))
        & (F.col("a.answered") >= F.col("p.at"))
        & (F.col("a.answered") <= F.col("p.at") + F.expr(f"INTERVAL {minutes} MINUTES"))
    )
    joined = proposals.alias("p").join(answers.alias("a"), in_time, "left_outer")
    return joined.select(F.col("p.id").alias("id"), F.col("p.at").alias("at"), F.coalesce(F.col("a.answer"), F.lit("refused")).alias("decision"))


def assembled(deltas: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """The deltas of each request joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))
    return deltas.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"), F.count(F.lit(1)).alias("deltas"))


def latest(events: DataFrame, key: str, ts: str, *columns: str) -> DataFrame:
    """Latest state of each key, by time."""
    return events.groupBy(key).agg(F.max(ts).alias(ts), *[F.max_by(c, ts).alias(c) for c in columns])
