"""Widths of text set in Times."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Advance widths of the characters 32 to 126 in thousandths of the size (the published metrics of the face),
# and of any other character.
WIDTHS = [
    250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278,
    500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 278, 278, 564, 564, 564, 444,
    921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722,
    556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500,
    333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500,
    500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541,
]
OTHER = 556


def _classes() -> list[tuple[int, str]]:
    """(width, the characters that are as wide), without those of the default width."""
    by_width: dict[int, str] = {}
    for code, w in enumerate(WIDTHS, 32):
        by_width[w] = by_width.get(w, "") + chr(code)
    return sorted((w, chars) for w, chars in by_width.items() if w != OTHER)


def times_units(text: Column) -> Column:
    """Width in thousandths of the size: a table by bytes, summed up over whole batches of texts by numpy. Counting characters by
    class of width in the JVM walks a text once for each of some twenty classes, and again wherever Spark repeats the expression."""
    widths = np.full(256, OTHER, dtype=np.int64)
    widths[32 : 32 + len(WIDTHS)] = WIDTHS
    widths[128:192] = 0  # the later bytes of a character

    def units(texts: pa.Array) -> pa.Array:
        if texts.buffers()[2] is None:
            sums = np.zeros(len(texts), dtype=np.int64)
        else:
            kind = np.int32 if pa.types.is_string(texts.type) else np.int64
            ends = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(widths[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]])])
            sums = np.diff(upto[ends - ends[0]])
        return pa.array(sums, pa.int32(), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(units, "int")(text)


def word_units(text: Column) -> Column:
    """The widths of the words between single blanks, in thousandths of the size, for each line of a text: as many lines as
    F.split(text, "\n") has, and as many words as F.split(line, " ")."""
    widths = np.full(256, OTHER, dtype=np.int64)
    widths[32 : 32 + len(WIDTHS)] = WIDTHS
    widths[128:192] = 0

    def units(texts: pa.Array) -> pa.Array:
        kind = np.int32 if pa.types.is_string(texts.type) else np.int64
        ends = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends -= ends[0]
        upto = np.concatenate([[0], np.cumsum(widths[data])])
        breaks = np.flatnonzero((data == 32) | (data == 10))
        # a word ends at each blank, line break and end of a text; the breaks before the end of a text come first
        row = np.searchsorted(ends, breaks, side="right") - 1
        at = np.arange(len(breaks)) + row
        last = np.cumsum(np.bincount(row, minlength=len(texts)) + 1) - 1
        n = len(breaks) + len(texts)
        begins, stops, line_ends = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        stops[at], stops[last] = breaks, ends[1:]
        begins[at + 1], begins[np.append(0, last[:-1] + 1)[: len(texts)]] = breaks + 1, ends[:-1]
        line_ends[at], line_ends[last] = data[breaks] == 10, True
        lines = np.append(0, np.flatnonzero(line_ends) + 1)
        words = pa.ListArray.from_arrays(pa.array(lines, pa.int32()), pa.array(upto[stops] - upto[begins], pa.int32()))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(lines, np.append(0, last + 1)), pa.int32()), words)

    return F.arrow_udf(units, "array<array<int>>")(F.coalesce(text, F.lit("")))


def times_units_sql(text: str) -> str:
    """The same for DuckDB."""
    terms = [f"{OTHER} * length({text})"]
    for w, chars in _classes():
        quoted = chars.replace("'", "''")
        terms.append(f"({w - OTHER}) * (length({text}) - length(translate({text}, '{quoted}', '')))")
    return "(" + " + ".join(terms) + ")"
