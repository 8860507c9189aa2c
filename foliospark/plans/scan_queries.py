"""Queries of recognised text and tagged bodies over pages derived from `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import times_units, times_units_sql
from ..operators import recognised as R
from ..operators.tagged_body import reclaimed
from ..session import load
from ..sources.scans import SCANS_SQL, TAGGED_SQL, scanned_runs, tagged_runs
from .registry import query

_FACTS_SQL = f"""{SCANS_SQL},
hb AS (SELECT * FROM sr WHERE hidden AND role = 'body'),
ts AS (SELECT doc, count(*) AS n, median(size) AS md, median(width / (units / 1000.0::DOUBLE)) AS typed, list_sort(list(size)) AS s FROM hb WHERE length(trim(text)) >= 5 GROUP BY doc),
ty AS (SELECT doc, n, md, CASE WHEN n >= 20 AND (s[least(n - 1, floor(n * 0.9::DOUBLE)::BIGINT) + 1] > 1.12::DOUBLE * s[least(n - 1, floor(n * 0.1::DOUBLE)::BIGINT) + 1] OR md < 0.93::DOUBLE * typed)
         THEN floor(typed * 2 + 0.5) / 2 END AS body FROM ts),
nb AS (SELECT doc, lead(y) OVER w - y AS rise, low = 0.22::DOUBLE AS lo, low = 0 AS pl, lead(low = 0.22::DOUBLE) OVER w AS nlo, lead(low = 0) OVER w AS npl FROM hb WHERE length(trim(text)) > 0 WINDOW w AS (PARTITION BY doc, page ORDER BY run)),
dr AS (SELECT doc, CASE WHEN lo AND npl THEN rise WHEN nlo AND pl THEN 0.0::DOUBLE - rise END AS dp, coalesce(body, md) AS sz FROM nb JOIN ty USING (doc) WHERE abs(rise) <= 0.5 * coalesce(body, md)),
ik AS (SELECT doc, count(dp) AS pairs, median(dp) AS drop_, count(dp) >= 12 AND median(dp) >= 0.1::DOUBLE * any_value(sz) AS ink FROM dr GROUP BY doc HAVING count(dp) > 0)"""


@query(f"SELECT doc_id, {times_units_sql('text')}::DOUBLE / 1000 * 11.0::DOUBLE AS width FROM documents")
def scl14_times_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of every text in Times at 11 points, by the face's published metrics."""
    return load(spark, sf_dir, "documents").select("doc_id", (times_units(F.col("text")) / 1000 * 11.0).alias("width"))


@query(f"WITH {_FACTS_SQL} SELECT doc, pairs, round(drop_, 6) AS drop, ink FROM ik")
def agg26_ink_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far words with descenders lie under their neighbours in each volume, and whether baselines are bottoms of ink."""
    runs = scanned_runs(spark, sf_dir)
    return R.ink_baselines(runs, R.type_sizes(runs)).withColumn("drop", F.round("drop", 6))


@query(f"WITH {_FACTS_SQL} SELECT doc, n, md AS read, body AS body_size FROM ty")
def cmp6_type_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size each volume's recognised words were typed in, by their widths, where the layer's sizes are heights of ink."""
    return R.type_sizes(scanned_runs(spark, sf_dir))


@query(f"""WITH {_FACTS_SQL},
pa AS (SELECT doc, page, median(x) AS mid, list(x) AS xs FROM hb WHERE regexp_matches(trim(text), '^[)\\]}}]$') GROUP BY 1, 2),
pc AS (SELECT doc, page, mid FROM pa WHERE len(list_filter(xs, lambda v: abs(v - mid) <= 3)) >= 6),
ed AS (SELECT doc, page, max(x + width) AS rgt FROM sr WHERE role = 'line-number' GROUP BY 1, 2),
jn AS (SELECT sr.*, md, body, coalesce(ink, false) AS ink, rgt, coalesce(hidden AND role = 'body' AND regexp_matches(trim(text), '^[)\\]}}]$') AND abs(x - mid) <= 3, false) AS own_cell,
         coalesce(role = 'body' AND CASE WHEN hidden THEN x < rgt ELSE regexp_matches(trim(text), '^[0-9]{{1,2}}$') AND x + width <= rgt + 2 END, false) AS stray,
         width / (units / 1000.0::DOUBLE) AS own, length(trim(text)) AS len
       FROM sr LEFT JOIN ty USING (doc) LEFT JOIN ik USING (doc) LEFT JOIN pc USING (doc, page) LEFT JOIN ed USING (doc, page)),
sz AS (SELECT *, CASE WHEN NOT hidden OR body IS NULL THEN size WHEN role = 'line-number' THEN body
         WHEN role IN ('footer', 'page-number') THEN CASE WHEN len >= CASE role WHEN 'page-number' THEN 8 ELSE 5 END THEN floor(own * 2 + 0.5) / 2 ELSE least(body, floor(size * greatest(1.0, body / md) * 2 + 0.5) / 2) END
         WHEN role = 'body' THEN CASE WHEN len >= 5 AND own > 1.2::DOUBLE * body THEN floor(own * 2 + 0.5) / 2 ELSE body END ELSE size END AS size_ FROM jn)
SELECT doc, page, run, round(size_, 6) AS size, round(y + CASE WHEN hidden AND role = 'body' AND ink THEN low * size_ ELSE 0 END, 6) AS y, own_cell, stray FROM sz""")
def cmp6_recognised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of every volume with its size and baseline as typed, brackets of columns, and strays of number columns."""
    found = R.recognised_text(scanned_runs(spark, sf_dir))
    return found.select("doc", "page", "run", F.round("size", 6).alias("size"), F.round("y", 6).alias("y"), "own_cell", "stray")


# The fold over a page's tagged heads and feet as a recursion: heights and blocks of the text so far, from candidate to candidate.
@query(f"""WITH RECURSIVE {TAGGED_SQL},
bb AS (SELECT doc, page, list(y) AS ys, list(block) AS blocks FROM tr WHERE role = 'body' AND block IS NOT NULL GROUP BY 1, 2),
op AS (SELECT doc, page, bool_or(block IS NULL) AS outside FROM tr WHERE role IN ('header', 'footer') AND trim(text) <> '' GROUP BY 1, 2),
ca AS (SELECT tr.*, outside, greatest(size, 10.0::DOUBLE) * 1.6::DOUBLE AS reach, row_number() OVER (PARTITION BY doc, page ORDER BY y DESC, run) AS k FROM tr JOIN op USING (doc, page)
       WHERE role IN ('header', 'footer') AND trim(text) <> '' AND block IS NOT NULL),
fo(doc, page, k, run, ok, ys, blocks) AS (SELECT doc, page, 0::BIGINT, NULL::BIGINT, false, coalesce(ys, []::DOUBLE[]), coalesce(blocks, []::BIGINT[]) FROM (SELECT DISTINCT doc, page FROM ca) LEFT JOIN bb USING (doc, page)
 UNION ALL SELECT doc, page, k, run, ok, CASE WHEN ok THEN list_append(ys, y) ELSE ys END, CASE WHEN ok THEN list_append(blocks, block) ELSE blocks END FROM
   (SELECT ca.doc, ca.page, ca.k, ca.run, ca.y, ca.block, fo.ys, fo.blocks, outside OR list_contains(fo.blocks, ca.block) OR len(list_filter(fo.ys, lambda v: v > ca.y AND v - ca.y <= ca.reach)) > 0 AS ok
    FROM fo JOIN ca ON ca.doc = fo.doc AND ca.page = fo.page AND ca.k = fo.k + 1))
SELECT tr.doc, tr.page, tr.run, tr.role AS was, CASE WHEN fo.run IS NOT NULL THEN 'body' ELSE tr.role END AS role FROM tr LEFT JOIN fo ON fo.doc = tr.doc AND fo.page = tr.page AND fo.run = tr.run AND fo.ok""")
def cmp5_reclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run with its role before and after tagged heads and feet that belong to the text went back to the body."""
    runs = tagged_runs(spark, sf_dir).withColumn("was", F.col("role"))
    return reclaimed(runs).select("doc", "page", "run", "was", "role")
