"""Fidelity of an export: words of two versions of a page aligned in order, and how far they moved.

words: key (one or more columns that name the page), word (in reading order), text, x, y (baseline), right, page_width.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

# Fixed values of the format.
MARGIN_SHARE, NUMBER_TOLERANCE = 0.18, 0.5


def word_key(text: Column) -> Column:
    """A word with plain quotes and without white space."""
    return F.when(text.rlike(r"[‘’“”\s]"), F.regexp_replace(F.translate(text, "‘’“”", "''\"\""), r"\s+", "")).otherwise(text)


def is_margin_number(words: DataFrame) -> Column:
    # the place first: few words stand there, so few are matched
    return (F.col("right") < F.col("page_width") * MARGIN_SHARE) & F.trim("text").rlike("^[0-9]{1,2}$")


def common_subsequence(a: list[str], b: list[str], room: int = 1 << 28) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence; where both sides could be left out, the first side's word is.

    A row of the table is a whole number: bit len(b) - 1 - j is set where b[j:] has one more in common with a[i:] than b[j + 1:],
    so its low len(b) - j bits count what b[j:] has. A row follows from the one below by an addition. Of a table beyond `room`
    bits only every so many rows are kept, and those between them are made again.
    """
    n, m = len(a), len(b)
    full = (1 << m) - 1
    where: dict[str, int] = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << (m - 1 - j)
    step = 1 if n * m <= room else math.isqrt(n) + 1

    def above(row: int, i: int) -> int:
        unset, match = full & ~row, where.get(a[i], 0)
        return full & ~((unset + (unset & match)) | (unset & ~match))

    kept, row = {n: 0}, 0
    for i in range(n - 1, -1, -1):
        row = above(row, i)
        if i % step == 0:
            kept[i] = row
    rows = kept if step == 1 else {}
    pairs, i, j, left = [], 0, 0, row.bit_count()
    while left:
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j, left = i + 1, j + 1, left - 1
            continue
        if i + 1 not in rows:
            end = min(n, ((i + 1) // step + 1) * step)
            rows = {end: kept[end]}
            for k in range(end - 1, i, -1):
                rows[k] = above(rows[k + 1], k)
        if (rows[i + 1] & ((1 << (m - j)) - 1)).bit_count() == left:
            i += 1
        else:
            j += 1
    return pairs


@F.arrow_udf(StructType([StructField("at", ArrayType(IntegerType())), StructField("to", ArrayType(IntegerType())), StructField("common", LongType())]))
def _aligned(a: pa.Array, b: pa.Array) -> pa.Array:
    """Positions of the words of two lists that are aligned, and how many words both have, wherever they stand."""
    words = pa.chunked_array([a.flatten(), b.flatten()], pa.string()).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    sizes = [np.cumsum([0, *pc.list_value_length(side).to_pylist()]) for side in (a, b)]
    pairs, common = [], []
    for i in range(len(a)):
        x, y = words[sizes[0][i] : sizes[0][i + 1]], words[sizes[0][-1] + sizes[1][i] : sizes[0][-1] + sizes[1][i + 1]]
        pairs.append(common_subsequence(x.tolist(), y.tolist()))
        common.append((Counter(x[x >= 0].tolist()) & Counter(y[y >= 0].tolist())).total())
    ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
    side = lambda k: pa.ListArray.from_arrays(ends, pa.array([p[k] for of in pairs for p in of], pa.int32()))
    return pa.StructArray.from_arrays([side(0), side(1), pa.array(common, pa.int64())], ["at", "to", "common"])


def _both(source: DataFrame, exported: DataFrame, key: list[str], **facts: Column) -> DataFrame:
    """key, facts, own: the words of both sides, and whether they are the source's. Sides dealt out by the key stay so."""
    side = lambda words, own: words.select(*key, *[c.alias(k) for k, c in facts.items()], F.lit(own).alias("own"))
    return side(source, True).unionByName(side(exported, False))


def _sides(words: DataFrame, key: list[str], of: Column, *more: Column) -> DataFrame:
    """(key, a, b, pairs, more): a row a page, with the words of either side for which `of` is true as structs in order, and the
    positions of those that are aligned (at, to), with the number of those that both have (common)."""
    own = lambda mine: F.sort_array(F.collect_list(F.when(of & (F.col("own") == mine), F.struct("word", "w", *[c for c in words.columns if c not in (*key, "word", "w", "own")]))))
    pages = words.groupBy(*key).agg(own(True).alias("a"), own(False).alias("b"), *more)
    return pages.withColumn("pairs", _aligned(F.col("a.w"), F.col("b.w")))


def _of_pairs(found: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with("pairs.at", "pairs.to", lambda i, j: found(F.get("a", i), F.get("b", j)))


def aligned_words(source: DataFrame, exported: DataFrame, key: list[str]) -> DataFrame:
    """(key, word, other): words of the source with the word of the export that they are aligned with. A page is one row; its
    table takes a bit for each pair of its words, and where these are very many, a few rows of it at a time."""
    words = _both(source, exported, key, word=F.col("word").cast("long"), w=word_key(F.col("text")))
    met = _of_pairs(lambda a, b: F.struct(a["word"].alias("word"), b["word"].alias("other")))
    return _sides(words, key, F.lit(True)).select(*key, F.inline(met))


def _at(values: Column, share: float) -> Column:
    """The element at floor(share * n) of sorted values, the last one at most; 0 for none."""
    n = F.size(values)
    return F.coalesce(F.get(values, F.least(n - 1, F.floor(F.lit(share) * n)).cast("int")), F.lit(0.0))


def _known(*names: str) -> Column:
    return reduce(and_, [F.col(k).isNotNull() for k in names])


def word_differences(source: DataFrame, exported: DataFrame, key: list[str]) -> DataFrame:
    """(key, missing, extra): how many words one side has more of than the other, wherever they stand."""
    words = _both(source, exported, key, w=word_key(F.col("text"))).groupBy(*key, "w").agg(F.count_if("own").alias("a"), F.count_if(~F.col("own")).alias("b"))
    more = lambda a, b: F.sum(F.greatest(F.col(a) - F.when(_known(*key, "w"), F.col(b)).otherwise(0), F.lit(0)))
    return words.groupBy(*key).agg(more("a", "b").alias("missing"), more("b", "a").alias("extra"))


def number_moves(source: DataFrame, exported: DataFrame, key: list[str]) -> DataFrame:
    """(key, word, dy): the margin numbers of the source, and how far the nearest equal one of the export is from there; null
    where there is none."""
    value, word = F.trim("text").cast("int"), F.col("word").cast("long")
    numbers = _both(source.where(is_margin_number(source)), exported.where(is_margin_number(exported)), key, value=value, word=word, y=F.col("y"))
    own = lambda mine, of: F.collect_list(F.when(F.col("own") == mine, of))
    met = numbers.groupBy(*key, "value").agg(own(True, F.struct("word", "y")).alias("here"), own(False, F.struct("word", "y")).alias("there"))
    met = met.select(*key, F.inline("here"), F.when(_known(*key), F.col("there")).alias("there"))
    dy = lambda t: t["y"] - F.col("y")
    nearest = F.array_min(F.transform("there", lambda t: F.struct(F.abs(dy(t)).alias("far"), t["word"].alias("other"), dy(t).alias("dy"))))
    return met.groupBy(*key, "word").agg(F.min(nearest)["dy"].alias("dy"))


def compared(source: DataFrame, exported: DataFrame, key: list[str]) -> DataFrame:
    """One row for each page of the source: source_words, exported_words, matched, missing, extra; median, p95 and max of how far
    matched words moved up or down, shift (the signed median), and of the margin numbers those off their lines (by more than
    NUMBER_TOLERANCE from the page's shift, or gone) and off the paper (from where they were).

    Sides that are dealt out by the key are not exchanged again."""
    c = F.col
    words = _both(source, exported, key, word=c("word").cast("long"), w=word_key(c("text")), y=c("y"), number=is_margin_number(source))
    sides = _sides(words, key, ~c("number"), F.bool_or("own").alias("own")).where("own")
    dy = _of_pairs(lambda a, b: b["y"] - a["y"])
    own, there = F.size("a").cast("long"), F.size("b").cast("long")
    counts = {"source_words": own, "exported_words": there, "missing": own - c("pairs.common"), "extra": there - c("pairs.common")}
    moves = sides.select(*key, *[v.alias(k) for k, v in counts.items()], F.sort_array(dy).alias("signed"))
    moves = moves.withColumn("far", F.sort_array(F.transform("signed", F.abs)))
    moves = moves.select(
        *key, *counts, F.size("far").cast("long").alias("matched"), _at(c("far"), 0.5).alias("median_dy"),
        _at(c("far"), 0.95).alias("p95_dy"), F.coalesce(F.array_max("far"), F.lit(0.0)).alias("max_dy"), _at(c("signed"), 0.5).alias("shift_dy"),
    )
    found = moves.join(number_moves(source, exported, key), key, "left")
    off = lambda d: F.count_if(c("word").isNotNull() & (c("dy").isNull() | (F.abs(d) > NUMBER_TOLERANCE)))
    facts = ["source_words", "exported_words", "matched", "missing", "extra", "median_dy", "p95_dy", "max_dy", "shift_dy"]
    return found.groupBy(*key).agg(
        *[F.first(f).alias(f) for f in facts], F.count("word").alias("numbers"), off(c("dy") - c("shift_dy")).alias("off_lines"), off(c("dy")).alias("off_paper")
    )
