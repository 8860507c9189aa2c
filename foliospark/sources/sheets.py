"""Positioned pages: every text of `documents` set on a page of its source, with the furniture of court paper.

A page holds all lines of its text, the closer the more there are. Two pages of five have line numbers beside the lines; one of
five is a condensed sheet of four small pages, each with numbers and a printed page number; the others have none. All but
condensed sheets have two lines at the head, a title, a page number in one of several forms, and a stamp at the foot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import PAGES_SQL, pages

WIDTH, HEIGHT = 612.0, 792.0


def sheet_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, item, text, x, y, width, height, page_width, page_height."""
    c = F.col
    page = pages(spark, sf_dir).withColumn("lines", F.split("text", "\n")).withColumn("n", F.size("lines")).withColumn("style", c("doc_id") % 5)
    line = page.select("doc", "page", "doc_id", "style", "n", F.posexplode("lines").alias("k", "text"))
    # condensed sheets: a quarter of the lines to each quadrant
    per = F.ceil(c("n") / 4)
    q = F.when(c("style") == 3, F.floor(c("k") / per)).otherwise(0)
    line = line.withColumn("q", q).withColumn("i", F.when(c("style") == 3, c("k") % per).otherwise(c("k")))
    pitch = F.when(c("style") == 3, F.least(F.lit(24.0), 320.0 / per)).otherwise(F.least(F.lit(48.0), 600.0 / c("n")))
    left = F.when(c("q") >= 2, 306.0).otherwise(0.0)
    top = F.when(c("style") != 3, 700.0).when(c("q") % 2 == 0, 740.0).otherwise(350.0)
    line = line.withColumn("left", left).withColumn("base", top - pitch * c("i")).withColumn("h", F.least(F.lit(10.0), pitch * 0.75))
    number = (c("i") % 28 + 1).cast("string")

    def items(rows: DataFrame, item: Column, text: Column, x: Column, y: Column, width: Column, height: Column) -> DataFrame:
        return rows.select("doc", "page", item.cast("long").alias("item"), text.alias("text"), x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))

    narrow = F.when(c("style") == 3, F.least(F.lit(200.0), 5.0 * F.length("text"))).otherwise(5.0 * F.length("text"))
    body = items(line.where("text <> ''"), c("k") * 10 + 100, c("text"), c("left") + 90.0, c("base"), narrow, c("h"))
    numbered = line.where("style IN (0, 1, 3)")
    numbers = items(numbered, c("k") * 10 + 101, number, c("left") + 72.0 - 6.0 * F.length(number), c("base"), 6.0 * F.length(number), c("h"))
    small = line.where("style = 3 AND i = 0")
    minis = items(small, c("q") + 10, F.concat(F.lit("Page "), (c("page") * 4 + c("q")).cast("string")), c("left") + 220.0, c("base") + 15.0, F.lit(40.0), F.lit(10.0))
    full = page.where("style <> 3")
    p = c("page").cast("string")
    form = F.when(c("doc_id") % 4 == 0, F.concat(F.lit("- "), p, F.lit(" -"))).when(c("doc_id") % 4 == 1, F.concat(F.lit("Page "), p, F.lit(" of 99")))
    form = form.when(c("doc_id") % 4 == 2, F.concat(F.lit("[["), p, F.lit("]]"))).otherwise(p)
    at = lambda k, text, x, y, width, rows=full: items(rows, F.lit(k), text, F.lit(x), F.lit(y), F.lit(width), F.lit(10.0))
    furniture = [
        at(1, F.concat("doc", F.lit(" volume "), p), 200.0, 765.0, 120.0),
        at(2, F.concat(F.lit("In re  "), "doc", F.lit(", no. "), p), 200.0, 730.0, 120.0),
        at(3, F.concat(F.lit("Declaration of "), "doc"), 200.0, 80.0, 120.0),
        at(4, form, 290.0, 40.0, 30.0, full.where("doc_id % 11 <> 0")),
        at(5, F.lit("12"), 100.0, 70.0, 10.0, full.where("doc_id % 13 = 0")),
        at(6, F.concat(F.lit("ABC"), F.lpad(c("doc_id").cast("string"), 7, "0")), 480.0, 20.0, 60.0),
        at(7, F.concat(F.lit("one-off "), F.md5(c("doc_id").cast("string"))), 200.0, 732.0, 120.0, full.where("style = 4")),
    ]
    every = body.unionByName(numbers).unionByName(minis)
    for part in furniture:
        every = every.unionByName(part)
    return every.withColumn("page_width", F.lit(WIDTH)).withColumn("page_height", F.lit(HEIGHT))


#: The same row set for DuckDB: it.
SHEETS_SQL = PAGES_SQL + """, sp AS (SELECT doc, page, doc_id, doc_id % 5 AS style, string_split(text, chr(10)) AS lines FROM pg),
sl AS (SELECT doc, page, doc_id, style, len(lines) AS n, k, lines[k + 1] AS text, ceil(len(lines) / 4)::BIGINT AS per FROM sp, unnest(range(0, len(lines))) AS r(k)),
sq AS (SELECT *, CASE WHEN style = 3 THEN k // per ELSE 0 END AS q, CASE WHEN style = 3 THEN k % per ELSE k END AS i,
         CASE WHEN style = 3 THEN least(24.0::DOUBLE, 320.0::DOUBLE / per) ELSE least(48.0::DOUBLE, 600.0::DOUBLE / n) END AS pitch FROM sl),
sb AS (SELECT *, CASE WHEN q >= 2 THEN 306.0::DOUBLE ELSE 0.0::DOUBLE END AS lft, CASE WHEN style <> 3 THEN 700.0::DOUBLE WHEN q % 2 = 0 THEN 740.0::DOUBLE ELSE 350.0::DOUBLE END - pitch * i AS base,
         least(10.0::DOUBLE, pitch * 0.75::DOUBLE) AS h, (i % 28 + 1)::VARCHAR AS num FROM sq),
fp AS (SELECT doc, page, doc_id, style FROM sp WHERE style <> 3),
i0 AS (SELECT doc, page, k * 10 + 100 AS item, text, lft + 90.0::DOUBLE AS x, base AS y, CASE WHEN style = 3 THEN least(200.0::DOUBLE, 5.0::DOUBLE * length(text)) ELSE 5.0::DOUBLE * length(text) END AS width, h AS height FROM sb WHERE text <> ''
 UNION ALL SELECT doc, page, k * 10 + 101, num, lft + 72.0::DOUBLE - 6.0::DOUBLE * length(num), base, 6.0::DOUBLE * length(num), h FROM sb WHERE style IN (0, 1, 3)
 UNION ALL SELECT doc, page, q + 10, 'Page ' || (page * 4 + q)::VARCHAR, lft + 220.0::DOUBLE, base + 15.0::DOUBLE, 40.0::DOUBLE, 10.0::DOUBLE FROM sb WHERE style = 3 AND i = 0
 UNION ALL SELECT doc, page, 1, doc || ' volume ' || page::VARCHAR, 200.0::DOUBLE, 765.0::DOUBLE, 120.0::DOUBLE, 10.0::DOUBLE FROM fp
 UNION ALL SELECT doc, page, 2, 'In re  ' || doc || ', no. ' || page::VARCHAR, 200.0::DOUBLE, 730.0::DOUBLE, 120.0::DOUBLE, 10.0::DOUBLE FROM fp
 UNION ALL SELECT doc, page, 3, 'Declaration of ' || doc, 200.0::DOUBLE, 80.0::DOUBLE, 120.0::DOUBLE, 10.0::DOUBLE FROM fp
 UNION ALL SELECT doc, page, 4, CASE doc_id % 4 WHEN 0 THEN '- ' || page::VARCHAR || ' -' WHEN 1 THEN 'Page ' || page::VARCHAR || ' of 99' WHEN 2 THEN '[[' || page::VARCHAR || ']]' ELSE page::VARCHAR END,
   290.0::DOUBLE, 40.0::DOUBLE, 30.0::DOUBLE, 10.0::DOUBLE FROM fp WHERE doc_id % 11 <> 0
 UNION ALL SELECT doc, page, 5, '12', 100.0::DOUBLE, 70.0::DOUBLE, 10.0::DOUBLE, 10.0::DOUBLE FROM fp WHERE doc_id % 13 = 0
 UNION ALL SELECT doc, page, 6, 'ABC' || lpad(doc_id::VARCHAR, 7, '0'), 480.0::DOUBLE, 20.0::DOUBLE, 60.0::DOUBLE, 10.0::DOUBLE FROM fp
 UNION ALL SELECT doc, page, 7, 'one-off ' || md5(doc_id::VARCHAR), 200.0::DOUBLE, 732.0::DOUBLE, 120.0::DOUBLE, 10.0::DOUBLE FROM fp WHERE style = 4),
it AS (SELECT *, x + width / 2 AS cx, y + height / 2 AS cy, x + width AS rgt, 612.0::DOUBLE AS pw, 792.0::DOUBLE AS ph,
         regexp_extract(trim(text), '^(?i:page\\s*)?[\\[(\\-–—\\s]*([0-9]{1,4})[\\])\\-–—\\s]*(?i:of\\s*[0-9]{1,4})?$', 1) AS found FROM i0)"""
