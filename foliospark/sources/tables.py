"""The engine's row sets, read from or derived from the given tables.

`documents` stands for pages: its source is the document, and its rows, by doc_id, are the document's pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_starts
from ..operators.ordinals import numbered
from ..session import load

# Letter page, margins and the fixed-pitch face of text pages.
LEFT, TOP, COLUMN, LEADING = 72.0, 720.0, 6.6, 14.85


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, doc_id, text."""
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "doc_id", "text")
    return numbered(docs, ["doc"], "doc_id", "page")


def by_page(df: DataFrame, *key: str, n: int = 0) -> DataFrame:
    """Rows dealt out by a page's key while they are whole lines or texts, so that what is later grouped by it exchanges no words.
    The number of partitions is given, since adaptive execution would join them by the size of the texts, not of their words.
    Python functions go before: Spark forgets the partitioning behind them. n: partitions, if more than the session's number."""
    return df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *key)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, doc, line (from 1), text: the lines of every page, without page numbers."""
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("source").alias("doc"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select(
        "doc_id", "doc", (F.col("p") + 1).cast("long").alias("line"), "text"
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line, word, text, x, y, width, size: one text run a word, in fixed pitch; short lines are headings.

    Words are placed inside their line, and lines dealt out by page before they are cut.
    """
    placed = by_page(lines(spark, sf_dir).select("doc_id", "line", "text", word_starts(F.col("text")).alias("off")), "doc_id")
    words = placed.withColumn("text", F.split("text", " "))
    words = words.select("doc_id", "line", F.size("text").alias("n"), F.posexplode(F.arrays_zip("text", "off")).alias("p", "w"))
    words = words.select("doc_id", "line", "n", "p", "w.text", "w.off")
    return words.where("text <> ''").select(
        "doc_id",
        "line",
        (F.col("p") + 1).cast("long").alias("word"),
        "text",
        (F.lit(LEFT) + F.lit(COLUMN) * F.col("off")).alias("x"),
        (F.lit(TOP) - F.lit(LEADING) * (F.col("line") - 1)).alias("y"),
        (F.lit(COLUMN) * F.length("text")).alias("width"),
        F.when(F.col("n") <= 3, 14.0).otherwise(11.0).alias("size"),
    )


#: The same row sets for DuckDB.
PAGES_SQL = "pg AS (SELECT source AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, doc_id, text FROM documents)"
LINES_SQL = (
    "ln AS (SELECT doc_id, doc, i AS line, lines[i] AS text FROM (SELECT doc_id, source AS doc, string_split(text, chr(10)) AS lines "
    "FROM documents), unnest(range(1, len(lines) + 1)) AS r(i))"
)
RUNS_SQL = (
    LINES_SQL + ", ws AS (SELECT doc_id, line, j AS word, w[j] AS text, len(w) AS n, w FROM (SELECT doc_id, line, string_split(text, ' ') AS w "
    "FROM ln), unnest(range(1, len(w) + 1)) AS r(j)), wo AS (SELECT doc_id, line, word, text, n, coalesce(sum(length(text) + 1) OVER "
    "(PARTITION BY doc_id, line ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ws), "
    "rn AS (SELECT doc_id, line, word, text, 72.0::DOUBLE + 6.6::DOUBLE * off::DOUBLE AS x, 720.0::DOUBLE - 14.85::DOUBLE * (line - 1)::DOUBLE AS y, "
    "6.6::DOUBLE * length(text)::DOUBLE AS width, CASE WHEN n <= 3 THEN 14.0::DOUBLE ELSE 11.0::DOUBLE END AS size FROM wo WHERE text <> '')"
)
