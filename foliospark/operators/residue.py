"""Proof of a redaction: what of each term is still readable in a written file, in any way that a string can be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import census


def stored_forms(needle: str) -> list[str]:
    """A needle in lower case, as hex of its Latin-1 bytes (low bytes of its UTF-16 units) and as hex of UTF-16BE."""
    units = needle.encode("utf-16-be")
    return [needle.lower(), units[1::2].hex(), units.hex()]


def latin1_hex(c: Column) -> Column:
    """The low byte of each UTF-16 unit of a text, as hex."""
    return F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "[0-9a-f]{2}([0-9a-f]{2})", "$1")


def utf16_hex(c: Column) -> Column:
    return F.lower(F.hex(F.encode(c, "UTF-16BE")))


def times(text: Column, form: str) -> Column:
    """Occurrences of a form that don't overlap, from the left."""
    if not form:
        return F.lit(0).cast("long")
    return ((F.length(text) - F.length(F.replace(text, F.lit(form), F.lit("")))) / len(form)).cast("long")


def readable(files: DataFrame, key: list[str], needles: list[str], text: str) -> DataFrame:
    """(key, term, hits): how often each needle can still be read in each file, over all forms; needles without a hit are left
    out. Needles are a parameter, so one pass over a file serves all of them, and files with none give no row."""
    low = files.select(*key, F.lower(F.col(text)).alias("low"))
    found = [F.struct(F.lit(n.lower()).alias("term"), sum((times(F.col("low"), f) for f in stored_forms(n)), F.lit(0).cast("long")).alias("hits")) for n in needles]
    return low.select(*key, F.inline(F.filter(F.array(*found), lambda x: x["hits"] > 0)))


def proofs(before: DataFrame, after: DataFrame, marked: DataFrame, key: list[str], needles: list[str], text: str = "text") -> DataFrame:
    """(key, term, before, remaining, marked, destroyed, proved) of files as they were and as they were written; marked has key,
    term and hits of what was to go. A file that fails is only told by its own rows."""
    return census(readable(before, key, needles, text), readable(after, key, needles, text), marked, [*key, "term"])


def verdicts(proved: DataFrame, key: list[str]) -> DataFrame:
    """(key, destroyed, failed): the receipt of each file, with the terms whose destruction is not proved."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("proved"), F.col("term"))))
    return proved.groupBy(*key).agg(F.sum("destroyed").alias("destroyed"), failed.alias("failed"))
