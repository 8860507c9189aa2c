"""Queries that compare two versions of every document's pages.

The source sets 43 lines a page with their numbers in the margin; its export has lost, changed or moved some words and numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fidelity as V
from ..session import ship
from ..sources.tables import LINES_SQL, by_page, lines
from .registry import query

KEY = ["doc_id", "page"]
D = "::DOUBLE"


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, word, text, x, y, right, page_width, and the line k on the page."""
    c = F.col
    line = lines(spark, sf_dir).select("doc_id", F.floor((c("line") - 1) / 43).alias("page"), ((c("line") - 1) % 43).alias("k"), "text")
    number = F.array((c("k") % 28 + 1).cast("string"))
    words = by_page(line, *KEY).select("doc_id", "page", "k", F.posexplode(F.concat(number, F.split("text", " "))).alias("p", "text"))
    words = words.where("text <> ''").withColumn("word", c("k") * 100_000 + c("p")).withColumn("x", F.when(c("p") == 0, 40.0).otherwise(50.0 + 30.0 * c("p")))
    words = words.withColumn("y", 720.0 - 16.0 * c("k")).withColumn("right", c("x") + 6.0 * F.length("text")).withColumn("page_width", F.lit(612.0))
    return words.drop("p")


def _exported(source: DataFrame) -> DataFrame:
    c = F.col
    h = (c("doc_id") * 31 + c("page") * 17 + c("word") * 7) % 97
    number = c("word") % 100_000 == 0
    kept = source.where(~((h < 3) | (number & (h > 94))))
    moved = c("y") + (c("doc_id") % 5) * 0.25 + F.when(h > 90, 2.0).otherwise(0.0)
    return kept.withColumn("text", F.when(~number & (h == 50), F.concat("text", F.lit("~"))).otherwise(c("text"))).withColumn("y", moved)


_WORDS_SQL = f"""{LINES_SQL}, fl AS (SELECT doc_id, (line - 1) // 43 AS page, (line - 1) % 43 AS k, string_split(text, ' ') AS ws FROM ln),
s AS (SELECT doc_id, page, k * 100000 + p + 1 AS word, ws[p + 1] AS text, 80.0{D} + 30.0{D} * p AS x, 720.0{D} - 16.0{D} * k AS y FROM fl, unnest(range(0, len(ws))) AS r(p) WHERE ws[p + 1] <> ''
      UNION ALL SELECT doc_id, page, k * 100000, (k % 28 + 1)::VARCHAR, 40.0{D}, 720.0{D} - 16.0{D} * k FROM fl),
eh AS (SELECT *, (doc_id * 31 + page * 17 + word * 7) % 97 AS h FROM s),
e AS (SELECT doc_id, page, word, CASE WHEN word % 100000 <> 0 AND h = 50 THEN text || '~' ELSE text END AS text, x, y + (doc_id % 5) * 0.25{D} + CASE WHEN h > 90 THEN 2.0{D} ELSE 0.0{D} END AS y
      FROM eh WHERE NOT (h < 3 OR (word % 100000 = 0 AND h > 94))),
sm AS (SELECT *, regexp_matches(trim(text), '^[0-9]{{1,2}}$') AND x + 6.0{D} * length(text) < 612.0{D} * 0.18{D} AS num FROM s),
em AS (SELECT *, regexp_matches(trim(text), '^[0-9]{{1,2}}$') AND x + 6.0{D} * length(text) < 612.0{D} * 0.18{D} AS num FROM e)"""


@query(f"""WITH {_WORDS_SQL}, mv AS (SELECT a.doc_id, a.page, a.word, b.y - a.y AS dy FROM sm a LEFT JOIN em b ON b.num AND a.doc_id = b.doc_id AND a.page = b.page AND a.text = b.text WHERE a.num
QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.page, a.word ORDER BY abs(b.y - a.y) NULLS LAST, b.word) = 1) SELECT doc_id, page, word, dy FROM mv""")
def agg27_number_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each margin number is from where it was, or that it is gone."""
    source = _source(spark, sf_dir)
    return V.number_moves(source, _exported(source), KEY)


@query(f"""WITH {_WORDS_SQL}, a AS (SELECT doc_id, page, regexp_replace(translate(text, '‘’“”', '''''""'), '\\s+', '', 'g') AS w, count(*) AS n FROM sm WHERE NOT num GROUP BY 1, 2, 3),
b AS (SELECT doc_id, page, regexp_replace(translate(text, '‘’“”', '''''""'), '\\s+', '', 'g') AS w, count(*) AS n FROM em WHERE NOT num GROUP BY 1, 2, 3)
SELECT doc_id, page, sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0))::BIGINT AS missing, sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0))::BIGINT AS extra FROM a FULL JOIN b USING (doc_id, page, w) GROUP BY 1, 2""")
def agg27_word_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words missing from and added to each page."""
    source = _source(spark, sf_dir)
    exported = _exported(source)
    return V.word_differences(source.where(~V.is_margin_number(source)), exported.where(~V.is_margin_number(exported)), KEY)


@query()
def agg27_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fidelity report of every page: words aligned in order, how far they moved, numbers off their lines and the paper."""
    ship(spark)
    source = _source(spark, sf_dir)
    return V.compared(source, _exported(source), KEY)
