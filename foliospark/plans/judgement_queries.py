"""Queries that choose the best reading or report the first problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clearest import clearest_feet
from ..operators.requests import request_problems
from ..session import load
from ..sources.tables import PAGES_SQL, pages
from .registry import query


# DuckDB's upper() leaves the sharp s one letter, where full case mapping makes two of it
@query(f"""WITH {PAGES_SQL}, ft AS (SELECT doc || '-' || ((page - 1) // 8)::VARCHAR AS doc, page, list_extract(string_split(text, chr(10)), -1) AS text, ((page - 1) // 8) % 5 <> 4 AS hidden, doc_id % 3 <> 0 AS numbered FROM pg),
cl AS (SELECT *, string_split(upper(replace(regexp_replace(text, '\\s+', '', 'g'), 'ß', 'ss')), '') AS c FROM ft WHERE length(text) > 0 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY page) <= 12),
pr AS (SELECT doc, page, hidden, numbered, CASE WHEN len(c) < 2 THEN [] ELSE list_distinct(list_transform(list_zip(c[:-2], c[2:]), lambda z: z[1] || z[2])) END AS g FROM cl),
dc AS (SELECT doc, count(*) AS n, bool_and(hidden) AS hid, bool_or(numbered) AS anyn FROM pr GROUP BY doc),
sc AS (SELECT a.doc, a.page, round(sum(CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) END), 9) AS score
       FROM pr a JOIN pr b ON a.doc = b.doc JOIN dc ON dc.doc = a.doc WHERE a.numbered = anyn GROUP BY 1, 2),
be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, page) = 1)
SELECT f.doc, coalesce(n, 0) AS feet, CASE WHEN n >= 3 AND hid THEN be.page ELSE first_page END AS best_page, CASE WHEN n >= 3 AND hid THEN round(score, 6) END AS score
FROM (SELECT doc, min(page) AS first_page FROM ft GROUP BY doc) f LEFT JOIN dc USING (doc) LEFT JOIN be USING (doc)""")
def agg25_clearest_foot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each volume whose last line the other pages' last lines bear out most."""
    c = F.col
    v = F.floor((c("page") - 1) / 8)
    feet = pages(spark, sf_dir).select(
        F.concat_ws("-", "doc", v.cast("string")).alias("doc"), "page", F.element_at(F.split("text", "\n"), -1).alias("text"), (v % 5 != 4).alias("hidden"), (c("doc_id") % 3 != 0).alias("numbered")
    )
    return clearest_feet(feet).withColumn("score", F.round("score", 6))


@query("""WITH dr AS (SELECT c_custkey AS request, CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE c_mktsegment END AS title, CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE c_name END AS requester,
  CASE WHEN c_custkey % 19 = 0 THEN 'no address' ELSE 'c' || c_custkey::VARCHAR || '@a.org' END AS email FROM customer),
sg AS (SELECT o_custkey AS request, o_orderkey AS signer, CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE 'Signer ' || o_orderkey::VARCHAR END AS name, CASE WHEN o_orderkey % 59 = 0 THEN 'at@nowhere' ELSE 's@a.org ' END AS email FROM orders),
fi AS (SELECT o_custkey AS request, l_orderkey AS signer FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 37 <> 0 AND o_custkey % 23 <> 0),
bad AS (SELECT request, signer, CASE WHEN trim(name) = '' THEN 'signer-name' WHEN NOT regexp_matches(trim(email), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'signer-email' END AS problem FROM sg),
fb AS (SELECT request, min(signer) AS signer, arg_min(problem, signer) AS problem FROM bad WHERE problem IS NOT NULL GROUP BY 1),
idle AS (SELECT request, min(signer) AS signer FROM sg WHERE NOT EXISTS (SELECT 1 FROM fi WHERE fi.request = sg.request AND fi.signer = sg.signer) GROUP BY 1),
al AS (SELECT dr.request, CASE WHEN trim(title) = '' THEN 'title' WHEN trim(coalesce(requester, '')) = '' THEN 'requester' WHEN NOT regexp_matches(trim(email), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'requester-email'
  WHEN dr.request NOT IN (SELECT request FROM sg) THEN 'no-signer' WHEN fb.request IS NOT NULL THEN fb.problem WHEN dr.request NOT IN (SELECT request FROM fi) THEN 'no-field' WHEN idle.request IS NOT NULL THEN 'nothing-to-sign' END AS problem,
  fb.signer AS fs, idle.signer AS ids FROM dr LEFT JOIN fb USING (request) LEFT JOIN idle USING (request))
SELECT request, problem, CASE WHEN problem LIKE 'signer-%' THEN fs WHEN problem = 'nothing-to-sign' THEN ids END AS signer FROM al""")
def jon26_request_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first problem of every draft: customers send requests, their orders sign them, and items are the fields."""
    c = F.col
    key, order = c("c_custkey"), c("o_orderkey")
    drafts = load(spark, sf_dir, "customer").select(
        key.alias("request"), F.when(key % 17 == 0, " ").otherwise(c("c_mktsegment")).alias("title"), F.when(key % 41 != 0, c("c_name")).alias("requester"),
        F.when(key % 19 == 0, "no address").otherwise(F.concat(F.lit("c"), key.cast("string"), F.lit("@a.org"))).alias("email"),
    )
    orders = load(spark, sf_dir, "orders")
    signers = orders.select(
        c("o_custkey").alias("request"), order.alias("signer"), F.when(order % 53 == 0, "").otherwise(F.concat(F.lit("Signer "), order.cast("string"))).alias("name"),
        F.when(order % 59 == 0, "at@nowhere").otherwise("s@a.org ").alias("email"),
    )
    items = load(spark, sf_dir, "lineitem").where("l_orderkey % 37 <> 0").select(c("l_orderkey").alias("o_orderkey"))
    fields = items.join(orders.where("o_custkey % 23 <> 0").select("o_orderkey", "o_custkey"), "o_orderkey").select(c("o_custkey").alias("request"), order.alias("signer"))
    return request_problems(drafts, signers, fields)
