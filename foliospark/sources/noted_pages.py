"""Pages with footnotes: the texts of `documents` as pages of volumes of eight, whose last lines are notes.

Faults are laid out by id: marks that are missing or stand twice, gaps in the numbers, two columns, no room above the notes,
separators that are too wide or underline the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import PAGES_SQL, pages


def noted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, doc_id and what the other row sets follow from: n lines, k notes from number start on, heights."""
    c = F.col
    base = pages(spark, sf_dir).withColumn("lines", F.filter(F.split("text", "\n"), lambda t: t != "")).withColumn("n", F.size("lines"))
    base = base.select(
        F.concat_ws("-", "doc", F.floor((c("page") - 1) / 8).cast("string")).alias("doc"), ((c("page") - 1) % 8 + 1).alias("page"), "doc_id", "n"
    )
    base = base.withColumn("k", F.when(c("n") - c("doc_id") % 3 >= 2, (c("doc_id") % 3)).otherwise(0).cast("long"))
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # eight pages
    base = base.withColumn("start", F.coalesce(F.sum("k").over(before), F.lit(0)) + 1)
    # the last note of some pages goes on in a second paragraph, which is one line more
    base = base.withColumn("more", F.when((c("doc_id") % 7 == 0) & (c("k") > 0), 1).otherwise(0))
    last = 700.0 - 16.0 * (c("n") - c("k") - 1)
    return base.withColumn("last", last).withColumn("top", last - F.when(c("doc_id") % 41 == 0, 14.0).otherwise(30.0))


def noted_paragraphs(noted: DataFrame) -> DataFrame:
    c = F.col
    p = noted.select("*", F.explode(F.sequence(F.lit(0), (c("n") + c("more") - 1).cast("int"))).alias("i")).where("i >= 0 AND n > 0")
    body = c("i") < c("n") - c("k")
    first = F.when(body, 700.0 - 16.0 * c("i")).otherwise(c("top") - 16.0 * (c("i") - (c("n") - c("k"))))
    size = F.when(body, 12.0).otherwise(9.0)
    return p.select(
        "doc", "page", (c("i") + 1).cast("long").alias("paragraph"), F.lit("text").alias("kind"), first.alias("first"), (first - 2.25).alias("bottom"), size.alias("size"),
        F.lit(11.25).alias("leading"), ((c("doc_id") % 43 == 0) & ~body).alias("hidden"), F.when((c("doc_id") % 37 == 0) & (c("i") == 0), 2).otherwise(1).alias("column"),
    )


def noted_marks(noted: DataFrame) -> DataFrame:
    c = F.col
    p = noted.where("k > 0").select("*", F.explode(F.sequence(F.lit(0), (c("k") - 1).cast("int"))).alias("j"))
    number = c("start") + c("j") + F.when((c("doc_id") % 23 == 0) & (c("j") > 0), 1).otherwise(0)
    own = p.select("doc", "page", (c("n") - c("k") + c("j") + 1).cast("long").alias("paragraph"), F.lit(1).alias("run"), number.alias("number"))
    text = p.where("NOT (doc_id % 19 = 0 AND j = 0)").select("doc", "page", (c("j") % (c("n") - c("k")) + 1).cast("long").alias("paragraph"), F.lit(2).alias("run"), number.alias("number"))
    twice = p.where("doc_id % 17 = 0 AND j = 0").select("doc", "page", F.lit(1).cast("long").alias("paragraph"), F.lit(9).alias("run"), number.alias("number"))
    return own.unionByName(text).unionByName(twice)


def noted_lines(noted: DataFrame) -> DataFrame:
    return noted_paragraphs(noted).select("doc", "page", F.col("first").alias("baseline"), F.lit(72.0).alias("x"), F.lit(500.0).alias("right"))


def noted_rules(noted: DataFrame) -> DataFrame:
    c = F.col
    y = F.when(c("doc_id") % 31 == 0, c("last") - 2.0).when(c("doc_id") % 41 == 0, c("top") + 9.5).otherwise(c("top") + 14.0)
    return noted.where("k > 0").select(
        "doc", "page", F.lit(1).alias("rule"), F.lit(72.0).alias("x"), y.alias("y"), F.when(c("doc_id") % 29 == 0, 300.0).otherwise(144.0).alias("width"), F.lit(0.5).alias("height")
    )


#: The same row sets for DuckDB: np (paragraphs), nm (marks), nr (rules); a line stands for each paragraph.
NOTED_SQL = PAGES_SQL + """, b0 AS (SELECT doc || '-' || ((page - 1) // 8)::VARCHAR AS doc, (page - 1) % 8 + 1 AS page, doc_id, len(list_filter(string_split(text, chr(10)), lambda t: t <> '')) AS n FROM pg),
b1 AS (SELECT *, CASE WHEN n - doc_id % 3 >= 2 THEN doc_id % 3 ELSE 0 END AS k FROM b0),
b2 AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS start,
         CASE WHEN doc_id % 7 = 0 AND k > 0 THEN 1 ELSE 0 END AS more, 700.0::DOUBLE - 16.0::DOUBLE * (n - k - 1) AS last FROM b1),
bn AS (SELECT *, last - CASE WHEN doc_id % 41 = 0 THEN 14.0::DOUBLE ELSE 30.0::DOUBLE END AS top FROM b2),
np AS (SELECT doc, page, doc_id, i + 1 AS paragraph, CASE WHEN i < n - k THEN 700.0::DOUBLE - 16.0::DOUBLE * i ELSE top - 16.0::DOUBLE * (i - (n - k)) END AS first,
         CASE WHEN i < n - k THEN 12.0 ELSE 9.0 END AS size, doc_id % 43 = 0 AND i >= n - k AS hidden, CASE WHEN doc_id % 37 = 0 AND i = 0 THEN 2 ELSE 1 END AS col
       FROM bn, unnest(range(0, n + more)) AS r(i)),
bj AS (SELECT *, start + j + CASE WHEN doc_id % 23 = 0 AND j > 0 THEN 1 ELSE 0 END AS number FROM bn, unnest(range(0, k)) AS r(j)),
nm AS (SELECT doc, page, n - k + j + 1 AS paragraph, 1 AS run, number FROM bj UNION ALL SELECT doc, page, j % (n - k) + 1, 2, number FROM bj WHERE NOT (doc_id % 19 = 0 AND j = 0)
       UNION ALL SELECT doc, page, 1, 9, number FROM bj WHERE doc_id % 17 = 0 AND j = 0),
nr AS (SELECT doc, page, CASE WHEN doc_id % 31 = 0 THEN last - 2 WHEN doc_id % 41 = 0 THEN top + 9.5 ELSE top + 14 END AS y, CASE WHEN doc_id % 29 = 0 THEN 300.0 ELSE 144.0 END AS width FROM bn WHERE k > 0)"""
