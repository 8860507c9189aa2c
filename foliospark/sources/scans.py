"""Recognised layers and tagged pages: the texts of `documents` as pages of volumes of eight.

Layers differ by volume: true sizes and baselines, erratic heights of ink, small sizes on bottoms of ink, true sizes on bottoms of
ink. Pages have line numbers, some misread, columns of brackets on a third of them, of which half stand too wide, and feet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import WIDTHS, times_units, times_units_sql, word_units
from ..operators.recognised import descent
from ..session import load
from .noted_pages import NOTED_SQL, noted_pages, noted_paragraphs
from .tables import PAGES_SQL, by_page, pages


#: Partitions for each split of `documents` that is read: a task sorts the words of one, which are many times its size.
PARTS = 16


def scanned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, run, text, role, hidden, x, y, width, size, units.

    Whole texts are dealt out by page, with the widths of their words, before they are cut; words are not exchanged. All that is
    read of them needs all columns of that exchange, and no condition can be taken before it, so Spark makes it once.
    """
    c = F.col
    base = pages(spark, sf_dir).withColumn("v", F.floor((c("page") - 1) / 8))
    base = base.select(F.concat_ws("-", "doc", c("v").cast("string")).alias("doc"), ((c("page") - 1) % 8 + 1).alias("page"), "doc_id", "text")
    base = base.where("page IS NOT NULL")  # none is; joins by page would say so for some of the readers
    parts = PARTS * load(spark, sf_dir, "documents").rdd.getNumPartitions()

    def dealt(rows: DataFrame) -> DataFrame:
        style = (F.substring_index("doc", "-", -1).cast("long") % 4).alias("style")
        return by_page(rows, "doc", "page", n=parts).select("*", style, (c("doc_id") % 9 != 0).alias("hidden"))

    line = dealt(base.where("text IS NOT NULL").withColumn("units", word_units(c("text"))))
    line = line.select("doc", "page", "doc_id", "style", "hidden", F.posexplode(F.arrays_zip(F.split("text", "\n").alias("text"), "units")).alias("k", "line"))
    line = line.select("*", F.split("line.text", " ").alias("words"), c("line.units").alias("units"))
    drop = lambda text, typed: F.when(c("style") >= 2, descent(text) * typed).otherwise(0.0)
    ground = 720.0 - 14.0 * c("k")
    of = lambda ch: WIDTHS[ord(ch) - 32]

    def items(rows: DataFrame, run: Column, text: Column, role: Column, x: Column, y: Column, width: Column, size: Column, units: Column) -> DataFrame:
        return rows.select(
            "doc", "page", run.cast("long").alias("run"), text.alias("text"), role.alias("role"), "hidden", x.alias("x"), y.alias("y"), width.alias("width"), size.alias("size"),
            units.cast("int").alias("units"),
        )

    word = line.select("doc", "page", "style", "hidden", "k", F.size("words").alias("n"), F.posexplode(F.arrays_zip("words", "units")).alias("p", "w"))
    word = word.select("doc", "page", "style", "hidden", "k", "n", "p", c("w.words").alias("text"), c("w.units").alias("units")).where("text <> ''")
    word = word.withColumn("typed", F.when(c("n") <= 3, 18.0).otherwise(12.0))
    ink = F.when(c("text").rlike("[A-Zbdfhklt0-9]"), 0.9).otherwise(0.65)
    seen = F.when(c("style") == 1, c("typed") * ink).when(c("style") == 2, c("typed") * 0.85).otherwise(c("typed"))
    width = c("units") / 1000 * c("typed") * (1 + ((c("p") * 7 + c("k") * 3) % 5 - 2) * 0.004)
    words = items(word, c("k") * 100000 + c("p") * 10 + 20, c("text"), F.lit("body"), 90.0 + 30.0 * c("p"), ground - drop(c("text"), c("typed")), width, seen, c("units"))
    number = (c("k") % 28 + 1).cast("string")
    misread = c("k") % 9 == 4
    small = F.when(c("style") == 1, 7.0).otherwise(12.0)
    numbers = items(
        line, c("k") * 100000, F.when(misread, F.concat(F.lit("l"), number)).otherwise(number), F.when(misread, "body").otherwise("line-number"),
        F.lit(60.0), ground, F.lit(8.0), small, of("0") * F.length(number) + F.when(misread, of("l")).otherwise(0),
    )
    wide = F.when(c("doc_id") % 6 == 0, 4.0).otherwise(0.5)
    few = F.when(c("k") < 10, ")")  # not a literal, as no condition on it may be one on the page alone
    brackets = items(
        line.where(F.when(c("doc_id") % 3 == 0, c("k") < 10)), c("k") * 100000 + 15, few, F.lit("body"), 306.0 + wide * (c("k") % 3), ground - drop(F.lit(")"), F.lit(12.0)), F.lit(4.0), small,
        F.lit(of(")")),
    )
    p = c("page").cast("string")
    foot = F.concat(F.lit("Declaration of "), "doc")
    said = F.when(c("doc_id") % 2 == 0, p).otherwise(F.concat(F.lit("Page "), p, F.lit(" of 99")))
    ends = base.select("doc", "page", "doc_id", foot.alias("foot"), said.alias("said"))
    ends = dealt(ends.withColumn("foot_units", times_units(c("foot"))).withColumn("said_units", times_units(c("said"))))
    feet = items(ends, F.lit(9_000_000_000_000), c("foot"), F.lit("footer"), F.lit(200.0), F.lit(40.0), c("foot_units") / 1000 * 9.0, F.lit(7.0), c("foot_units"))
    folios = items(ends, F.lit(9_000_000_000_001), c("said"), F.lit("page-number"), F.lit(300.0), F.lit(30.0), c("said_units") / 1000 * 10.0, F.lit(8.0), c("said_units"))
    return words.unionByName(numbers).unionByName(brackets).unionByName(feet).unionByName(folios)


def _descent_sql(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '[gjpqy]') THEN 0.22::DOUBLE WHEN regexp_matches({text}, '[()\\[\\]{{}}|/$@_]') THEN 0.18::DOUBLE WHEN regexp_matches({text}, '[,;]') THEN 0.13::DOUBLE ELSE 0::DOUBLE END"


#: The same row set for DuckDB: sr, with units (Times, thousandths) and low (share of a size below the line).
SCANS_SQL = PAGES_SQL + f""", sv AS (SELECT doc || '-' || ((page - 1) // 8)::VARCHAR AS doc, (page - 1) % 8 + 1 AS page, doc_id, ((page - 1) // 8) % 4 AS style, doc_id % 9 <> 0 AS hidden, string_split(text, chr(10)) AS lines FROM pg),
sl AS (SELECT doc, page, doc_id, style, hidden, k, string_split(lines[k + 1], ' ') AS w, 720.0::DOUBLE - 14.0::DOUBLE * k AS ground, (k % 28 + 1)::VARCHAR AS num FROM sv, unnest(range(0, len(lines))) AS r(k)),
sw AS (SELECT sl.* EXCLUDE (w), p, w[p + 1] AS text, CASE WHEN len(w) <= 3 THEN 18.0::DOUBLE ELSE 12.0::DOUBLE END AS typed FROM sl, unnest(range(0, len(w))) AS r(p)),
s0 AS (SELECT doc, page, k * 100000 + p * 10 + 20 AS run, text, 'body' AS role, hidden, 90.0::DOUBLE + 30.0::DOUBLE * p AS x, ground - CASE WHEN style >= 2 THEN ({_descent_sql("text")}) * typed ELSE 0 END AS y,
   {times_units_sql("text")}::DOUBLE / 1000 * typed * (1 + ((p * 7 + k * 3) % 5 - 2) * 0.004::DOUBLE) AS width,
   CASE style WHEN 1 THEN typed * CASE WHEN regexp_matches(text, '[A-Zbdfhklt0-9]') THEN 0.9::DOUBLE ELSE 0.65::DOUBLE END WHEN 2 THEN typed * 0.85::DOUBLE ELSE typed END AS size FROM sw WHERE text <> ''
 UNION ALL SELECT doc, page, k * 100000, CASE WHEN k % 9 = 4 THEN 'l' || num ELSE num END, CASE WHEN k % 9 = 4 THEN 'body' ELSE 'line-number' END, hidden, 60.0, ground, 8.0, CASE style WHEN 1 THEN 7.0 ELSE 12.0 END FROM sl
 UNION ALL SELECT doc, page, k * 100000 + 15, ')', 'body', hidden, 306.0::DOUBLE + CASE WHEN doc_id % 6 = 0 THEN 4.0::DOUBLE ELSE 0.5::DOUBLE END * (k % 3), ground - CASE WHEN style >= 2 THEN 0.18::DOUBLE * 12.0::DOUBLE ELSE 0 END, 4.0, CASE style WHEN 1 THEN 7.0 ELSE 12.0 END
   FROM sl WHERE doc_id % 3 = 0 AND k < 10
 UNION ALL SELECT doc, page, 9000000000000, 'Declaration of ' || doc, 'footer', hidden, 200.0, 40.0, {times_units_sql("('Declaration of ' || doc)")}::DOUBLE / 1000 * 9.0::DOUBLE, 7.0 FROM sv
 UNION ALL SELECT doc, page, 9000000000001, said, 'page-number', hidden, 300.0, 30.0, {times_units_sql("said")}::DOUBLE / 1000 * 10.0::DOUBLE, 8.0
   FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN page::VARCHAR ELSE 'Page ' || page::VARCHAR || ' of 99' END AS said FROM sv)),
sr AS (SELECT *, {times_units_sql("text")} AS units, {_descent_sql("text")} AS low FROM s0)"""


def tagged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, run, text, role, y, size, block: the pages with notes, classified by place alone: the last three or four
    paragraphs of a page are its foot, the first one of some is its head; two paragraphs of some pages share a block, some
    pages are outside the tree, and some have a foot of their own there."""
    c = F.col
    base = noted_pages(spark, sf_dir)
    p = noted_paragraphs(base).join(base.select("doc", "page", "doc_id", (c("n") + c("more")).alias("all")), ["doc", "page"])
    role = F.when(c("paragraph") > c("all") - 3 - (c("doc_id") % 2), "footer").when((c("doc_id") % 5 == 0) & (c("paragraph") == 1), "header").otherwise("body")
    block = F.when(c("doc_id") % 6 == 5, None).when(c("doc_id") % 3 == 0, F.floor(c("paragraph") / 2)).otherwise(c("paragraph"))
    text = F.when((c("doc_id") % 13 == 0) & (c("paragraph") == c("all")), " ").otherwise("words")
    runs = p.select("doc", "page", c("paragraph").alias("run"), text.alias("text"), role.alias("role"), c("first").alias("y"), "size", block.cast("long").alias("block"))
    foot = base.where("doc_id % 7 = 0").select(
        "doc", "page", F.lit(1_000_000_000).cast("long").alias("run"), F.lit("foot").alias("text"), F.lit("footer").alias("role"), F.lit(30.0).alias("y"), F.lit(9.0).alias("size"), F.lit(None).cast("long").alias("block")
    )
    return runs.unionByName(foot)


#: The same row set for DuckDB: tr.
TAGGED_SQL = NOTED_SQL + """, t0 AS (SELECT np.*, bn.n + bn.more AS alln FROM np JOIN bn USING (doc, page)),
tr AS (SELECT doc, page, paragraph AS run, CASE WHEN doc_id % 13 = 0 AND paragraph = alln THEN ' ' ELSE 'words' END AS text,
   CASE WHEN paragraph > alln - 3 - doc_id % 2 THEN 'footer' WHEN doc_id % 5 = 0 AND paragraph = 1 THEN 'header' ELSE 'body' END AS role, first AS y, size::DOUBLE AS size,
   CASE WHEN doc_id % 6 = 5 THEN NULL WHEN doc_id % 3 = 0 THEN paragraph // 2 ELSE paragraph END AS block FROM t0
 UNION ALL SELECT doc, page, 1000000000, 'foot', 'footer', 30.0, 9.0, NULL FROM bn WHERE doc_id % 7 = 0)"""
