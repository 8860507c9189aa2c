"""Operator 2, line dedup: winnowing over line hashes finds runs of lines that occurred before. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_WORD = r"[^\x20\x09-\x0D]+"


def _windows(run: int, words: int) -> Column:
    """Of a document's lines h: for each line the shortest window that begins there and has `words` words or `run` lines,
    with the line of its smallest hash (the last of equal ones) and a 128-bit hash of all its lines."""
    n = F.size("h")

    def size_at(start: Column) -> Column:
        held, size = F.get("h", start)["words"], F.when(F.get("h", start)["words"] >= words, 1)
        for more in range(1, run - 1):
            held = held + F.get("h", start + more)["words"]  # null beyond the last line
            size = size.when(held >= words, more + 1)
        return size.otherwise(run)

    def window(w: Column) -> Column:
        own = F.slice("h", w["start"] + 1, w["size"])
        hashes = F.transform(own, lambda x: x["a"])
        least = F.array_min(hashes)
        return F.struct(
            w["start"].alias("start"),
            (w["start"] + w["size"]).alias("end"),
            least.alias("fingerprint"),
            (w["start"] + w["size"] - F.array_position(F.reverse(hashes), least)).cast("int").alias("at"),
            F.xxhash64(own).alias("a"),
            F.xxhash64(F.lit(1), own).alias("b"),
        )

    sized = F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.struct(s.alias("start"), size_at(s).alias("size")))
    return F.transform(F.filter(sized, lambda w: w["start"] + w["size"] <= n), window)


def repeated_lines(docs: DataFrame, run: int = 3, words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, n_removed): the maximal runs [start, end) of lines to delete, from 0, for documents that have any.

    The window at a line is the shortest one with `words` words or `run` lines. A line goes when it lies in a window
    whose lines also make up a window that starts earlier (smaller id, or same document and earlier line). Steps: hash
    the lines; in every window select the minimum hash as fingerprint, which guarantees that equal windows select the
    same line of theirs; keep the fingerprints that occur at more than one position; extend each of these positions both
    ways to the windows that hold it, and compare these with their first occurrence, which takes the place of joining
    all pairs of positions. Windows that overlap or touch merge into runs.
    """
    lines = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"),
        F.transform(
            F.split(text_col, "\n"),
            lambda x: F.struct(
                F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.regexp_count(x, F.lit(_WORD)).alias("words")
            ),
        ).alias("h"),
    )
    windows = lines.select("doc_id", F.explode(_windows(run, words)).alias("w")).select("doc_id", "w.*")
    # a few bytes a line: all later steps read this table instead of the texts
    windows = written(windows, "line-windows")
    # line numbers have ten digits at most; a fixed-width number, so that hash aggregation keeps the first place
    def place(line: str) -> Column:
        return F.col("doc_id").cast("decimal(20,0)") * F.lit(10_000_000_000).cast("decimal(11,0)") + F.col(line).cast("decimal(10,0)")

    anchors = windows.groupBy("fingerprint").agg(F.min(place("at")).alias("low"), F.max(place("at")).alias("high"))
    common = anchors.where("low < high").select("fingerprint")
    around = windows.join(common, "fingerprint").select("doc_id", "start", "end", "a", "b", place("start").alias("place"))
    first = around.groupBy("a", "b").agg(F.min("place").alias("first"))
    later = around.join(first, ["a", "b"]).where(F.col("place") > F.col("first")).select("doc_id", "start", "end").distinct()
    in_order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.coalesce(F.col("start") > reach, F.lit(True)), 1).otherwise(0)
    numbered = later.withColumn("begins", begins).withColumn("part", F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("doc_id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"), F.sum(F.col("end") - F.col("start")).alias("n_removed")
    )


def line_dedup(docs: DataFrame, run: int = 3, words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, kept_text, n_lines, n_removed.

    Lines are the parts of the text between line feeds. They are compared by two independent 64-bit hashes: among 10**13
    lines two unlike ones agree with a chance of 10**-13. See repeated_lines() for which ones go: repeated runs of `run`
    lines, or of fewer that have `words` words together. Null texts have no lines and a null kept_text; rows whose id is
    null are left as they are. Repeated rows count as one place and share their removals. A text with nothing but
    repeated lines is empty afterwards. Other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = base.join(repeated_lines(base, run, words), "doc_id", "left")

    def rest(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["end"]))
        ends = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.size(lines)))
        kept = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))
        return F.array_join(F.flatten(kept), "\n")

    # the lambda's variable holds the lines of a text, which is thus split once
    kept = F.element_at(F.transform(F.array(F.split("text", "\n")), rest), 1)
    return joined.select(
        "doc_id",
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
    )
