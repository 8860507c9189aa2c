"""Order forms: a page for each order of `lineitem`, with drawn rules and text cells, for operators on ruled tables.

The table of a form has a row for each item and four columns. Rules are drawn in pieces, a little off their places, and some
are missing; some texts run over a column; a line stands above each table and a lone rule below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import load
from .tables import by_page

# Column edges, row height, first row edge.
COLUMNS, ROW, TOP = (72.0, 172.0, 292.0, 412.0, 540.0), 24.0, 700.0


#: Partitions for each split of `lineitem` that is read: a task holds the rules and texts of one, which are many times its size.
PARTS = 16


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` dealt out by order, so that what is made of a form and gathered by page is not exchanged."""
    items = load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page")
    return by_page(items, "page", n=PARTS * items.rdd.getNumPartitions())


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("page").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return _dealt(spark, sf_dir).select(
        "page", (F.row_number().over(w) - 1).alias("i"), "l_partkey", "l_suppkey", "l_quantity", "l_linenumber"
    )


def form_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, rule, x, y, width, height."""
    forms = _dealt(spark, sf_dir).groupBy("page").agg(F.count(F.lit(1)).cast("int").alias("n"))
    off = (F.col("page") * 7 + F.col("i") * 3 + F.col("k")) % 5 * 0.5 - 1.0
    level = forms.select("page", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i")).select("page", "i", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    level = level.where("(page + i * 5 + k) % 13 <> 0").select(
        "page", (F.col("i") * 10 + F.col("k")).cast("long").alias("rule"),
        F.when(F.col("k") == 0, COLUMNS[0]).otherwise(COLUMNS[2]).alias("x"), (TOP - ROW * F.col("i") + off).alias("y"),
        F.when(F.col("k") == 0, COLUMNS[2] - COLUMNS[0]).otherwise(COLUMNS[4] - COLUMNS[2]).alias("width"), F.lit(0.5).alias("height"),
    )
    upright = forms.select("page", "n", F.posexplode(F.array(*[F.lit(x) for x in COLUMNS])).alias("k", "edge")).where("(page + k * 3) % 7 <> 0").select(
        "page", (F.lit(100_000) + F.col("k")).cast("long").alias("rule"), (F.col("edge") + (F.col("page") + F.col("k")) % 3 * 0.5 - 0.5).alias("x"),
        (TOP - ROW * F.col("n")).alias("y"), F.lit(0.5).alias("width"), (ROW * F.col("n")).alias("height"),
    )
    lone = forms.select("page", F.lit(200_000).cast("long").alias("rule"), F.lit(90.0).alias("x"), F.lit(60.0).alias("y"), F.lit(120.0).alias("width"), F.lit(0.5).alias("height"))
    return level.unionByName(upright).unionByName(lone)


def form_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, line, cell, x, right, baseline: line 0 stands above the table."""
    cells = _items(spark, sf_dir).select(
        "page", "i", F.posexplode(F.array(*[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")])).alias("k", "text"), "l_quantity"
    )
    edge = F.get(F.array(*[F.lit(x) for x in COLUMNS]), F.col("k"))
    wide = F.when((F.col("k") == 3) & (F.col("l_quantity") == 50), -30.0).otherwise(4.0)
    inside = cells.select(
        "page", (F.col("i") + 1).cast("long").alias("line"), F.col("k").alias("cell"), (edge + wide).alias("x"),
        (edge + wide + 6.0 * F.length("text")).alias("right"), (TOP - ROW * (F.col("i") + 1) + 7.0).alias("baseline"),
    )
    above = cells.where("i = 0 AND k = 0").select(
        "page", F.lit(0).cast("long").alias("line"), F.lit(0).alias("cell"), F.lit(72.0).alias("x"), F.lit(300.0).alias("right"), F.lit(720.0).alias("baseline")
    )
    return inside.unionByName(above)


def form_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, left, right: every ninth frame is too narrow for its table."""
    forms = _dealt(spark, sf_dir).select("page").distinct()
    return forms.select("page", F.lit(72.0).alias("left"), F.when(F.col("page") % 9 == 0, 500.0).otherwise(540.0).alias("right"))


#: The same row sets for DuckDB: fr (rules), ft (text), ff (frames).
FORMS_SQL = """fn AS (SELECT l_orderkey AS page, count(*) AS n FROM lineitem GROUP BY 1),
fc AS (SELECT k, [72.0, 172.0, 292.0, 412.0, 540.0][k + 1]::DOUBLE AS edge FROM range(0, 5) AS t(k)),
fr AS (SELECT page, i * 10 + k AS rule, CASE WHEN k = 0 THEN 72.0::DOUBLE ELSE 292.0::DOUBLE END AS x,
         700.0::DOUBLE - 24.0::DOUBLE * i + ((page * 7 + i * 3 + k) % 5) * 0.5::DOUBLE - 1.0::DOUBLE AS y,
         CASE WHEN k = 0 THEN 220.0::DOUBLE ELSE 248.0::DOUBLE END AS width, 0.5::DOUBLE AS height
       FROM fn, unnest(range(0, n + 1)) AS r(i), range(0, 2) AS s(k) WHERE (page + i * 5 + k) % 13 <> 0
       UNION ALL SELECT page, 100000 + k, edge + ((page + k) % 3) * 0.5::DOUBLE - 0.5::DOUBLE, 700.0::DOUBLE - 24.0::DOUBLE * n, 0.5::DOUBLE, 24.0::DOUBLE * n
       FROM fn, fc WHERE (page + k * 3) % 7 <> 0
       UNION ALL SELECT page, 200000, 90.0::DOUBLE, 60.0::DOUBLE, 120.0::DOUBLE, 0.5::DOUBLE FROM fn),
fi AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i,
         l_quantity, [l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR, l_quantity::VARCHAR] AS texts FROM lineitem),
ft AS (SELECT page, i + 1 AS line, k AS cell, edge + CASE WHEN k = 3 AND l_quantity = 50 THEN -30.0::DOUBLE ELSE 4.0::DOUBLE END AS x,
         edge + CASE WHEN k = 3 AND l_quantity = 50 THEN -30.0::DOUBLE ELSE 4.0::DOUBLE END + 6.0::DOUBLE * length(texts[k + 1]) AS right,
         700.0::DOUBLE - 24.0::DOUBLE * (i + 1) + 7.0::DOUBLE AS baseline FROM fi, fc WHERE k < 4
       UNION ALL SELECT page, 0, 0, 72.0::DOUBLE, 300.0::DOUBLE, 720.0::DOUBLE FROM fn),
ff AS (SELECT page, 72.0::DOUBLE AS left, CASE WHEN page % 9 = 0 THEN 500.0::DOUBLE ELSE 540.0::DOUBLE END AS right FROM fn)"""
