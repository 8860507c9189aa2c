"""Queries over boxes of pictures and sightings of drawn rules, derived from `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pictures as P
from ..session import load
from .registry import query

D = "::DOUBLE"


@query(f"""WITH RECURSIVE s AS (SELECT l_partkey AS page, l_quantity::BIGINT AS band, l_linenumber * 30.0{D} + round(l_discount * 100) AS lo, l_linenumber * 30.0{D} + round(l_discount * 100) + 1 + round(l_tax * 100) % 4 AS hi FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY band, lo, hi) AS k, (lo + hi) / 2 AS mid FROM s),
f(page, k, chains) AS (SELECT DISTINCT page, 0::BIGINT, []::STRUCT(first BIGINT, last BIGINT, mid DOUBLE, mids DOUBLE[], sizes DOUBLE[])[] FROM o UNION ALL
  SELECT page, k, CASE WHEN home IS NULL THEN list_append(chains, {{'first': band, 'last': band, 'mid': m, 'mids': [m], 'sizes': [size]}})
    ELSE list_transform(chains, lambda c, i: CASE WHEN i = home THEN {{'first': c.first, 'last': band, 'mid': m, 'mids': list_append(c.mids, m), 'sizes': list_append(c.sizes, size)}} ELSE c END) END FROM
  (SELECT o.page, o.k, f.chains, o.band, o.mid AS m, o.hi - o.lo AS size, list_filter(range(1, len(f.chains) + 1), lambda i: f.chains[i].last < o.band AND o.band - f.chains[i].last <= 4
    AND abs(o.mid - f.chains[i].mid) <= 2 * (o.band - f.chains[i].last))[1] AS home FROM f JOIN o ON o.page = f.page AND o.k = f.k + 1)),
z AS (SELECT page, chains FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1),
c AS (SELECT page, i AS rule, chains[i] AS c FROM z, unnest(range(1, len(chains) + 1)) AS r(i))
SELECT page, rule, c.first AS first_band, c.last AS last_band, len(c.mids) AS seen, list_sort(c.mids)[len(c.mids) // 2 + 1] - list_sort(c.sizes)[len(c.sizes) // 2 + 1] / 2 AS at_place, list_sort(c.sizes)[len(c.sizes) // 2 + 1] AS thick
FROM c WHERE len(c.mids) >= 0.7{D} * (c.last - c.first + 1)""")
def win22_tracked_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of each part's scan: its items are sightings, their quantities bands, their line numbers places across."""
    lo = F.col("l_linenumber") * 30.0 + F.round(F.col("l_discount") * 100)
    seen = load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("page"), F.col("l_quantity").cast("long").alias("band"), lo.alias("lo"), (lo + 1 + F.round(F.col("l_tax") * 100) % 4).alias("hi")
    )
    return P.tracked_rules(seen, ["page"], 2.0).withColumnRenamed("at", "at_place")


_PAGES_SQL = f"""i AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS picture, l_partkey AS p, l_quantity AS q FROM lineitem),
b AS (SELECT page, picture, CASE WHEN p % 19 = 0 THEN 0.0{D} WHEN p % 3 = 0 THEN 540.0{D} - q * 6 WHEN p % 3 = 1 THEN 306.0{D} - q * 3 ELSE 60.0{D} + p % 50 END AS x, CASE WHEN p % 19 = 0 THEN 0.0{D} ELSE (p * 13 % 600){D} END AS y,
  CASE WHEN p % 19 = 0 THEN 600.0{D} WHEN p % 23 = 0 THEN 700.0{D} ELSE q * 6{D} END AS width, CASE WHEN p % 19 = 0 THEN 780.0{D} ELSE 5.0{D} + q END AS height FROM i),
r AS (SELECT page, 720.0{D} - 24 * picture AS y, p % 29 = 0 AS hidden FROM i WHERE p % 7 <> 0)"""


@query(f"""WITH {_PAGES_SQL}, n AS (SELECT page, count(*) FILTER (WHERE width >= 4 AND height >= 4) AS n FROM b GROUP BY 1), t AS (SELECT page, bool_or(hidden) AS hid FROM r GROUP BY 1),
l AS (SELECT b.*, n.n, t.hid, t.page IS NOT NULL AS txt, width >= 4 AND height >= 4 AS large, width * height >= 0.6{D} * 612 * 792 AS full_page,
  EXISTS (SELECT 1 FROM r WHERE r.page = b.page AND NOT hidden AND r.y >= b.y - 1 AND r.y <= b.y + height - 2) AS over FROM b JOIN n USING (page) LEFT JOIN t USING (page)),
p AS (SELECT *, CASE WHEN n > 12 AND large THEN 'many' WHEN NOT large THEN 'small' WHEN full_page AND coalesce(hid, false) THEN 'scan' WHEN full_page AND txt THEN 'backdrop' WHEN over THEN 'pinned' ELSE 'inline' END AS plan FROM l),
w AS (SELECT *, CASE plan WHEN 'inline' THEN width * least(1.0{D}, 468.0{D} / width) WHEN 'pinned' THEN width END AS plan_width, CASE plan WHEN 'inline' THEN height * least(1.0{D}, 468.0{D} / width) WHEN 'pinned' THEN height END AS plan_height FROM p),
g AS (SELECT *, x - 72 AS a, 540 - (x + plan_width) AS z FROM w)
SELECT page, picture, x, y, width, height, plan, CASE WHEN plan = 'pinned' THEN 'left' WHEN plan = 'inline' THEN CASE WHEN abs(z) <= 6 AND a > 6 THEN 'right' WHEN abs(a - z) <= 6 AND a > 6 THEN 'center' ELSE 'left' END END AS alignment,
CASE WHEN plan = 'pinned' THEN 0.0{D} WHEN plan = 'inline' THEN CASE WHEN (abs(z) <= 6 OR abs(a - z) <= 6) AND a > 6 THEN 0.0{D} ELSE greatest(0.0{D}, a) END END AS indent, plan_width, plan_height FROM g""")
def cmp19_planned_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the pictures on each order's page: a box for every item, lines of text for most of them."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    i = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.row_number().over(w).cast("long").alias("picture"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q")
    )
    p, q = F.col("p"), F.col("q")
    full = p % 19 == 0
    x = F.when(full, 0.0).when(p % 3 == 0, 540.0 - q * 6).when(p % 3 == 1, 306.0 - q * 3).otherwise(60.0 + p % 50)
    boxes = i.select(
        "page", "picture", x.alias("x"), F.when(full, 0.0).otherwise((p * 13 % 600).cast("double")).alias("y"),
        F.when(full, 600.0).when(p % 23 == 0, 700.0).otherwise(q * 6.0).alias("width"), F.when(full, 780.0).otherwise(5.0 + q).alias("height"),
    )
    runs = i.where(p % 7 != 0).select("page", (720.0 - 24 * F.col("picture")).alias("y"), F.lit("line").alias("text"), (p % 29 == 0).alias("hidden"))
    pages = i.select("page").distinct().select("page", F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), F.lit(72.0).alias("left"), F.lit(540.0).alias("right"))
    return P.planned_pictures(boxes, runs, pages, ["page"])
