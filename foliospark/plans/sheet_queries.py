"""Queries of the page classifier over positioned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import page_roles as R
from ..operators.running_heads import page_bands, running_heads
from ..sources.sheets import SHEETS_SQL, sheet_items
from .registry import query

_STACKS_SQL = f"""{SHEETS_SQL},
nc AS (SELECT *, trim(text)::INT AS value FROM (SELECT * FROM it WHERE regexp_matches(trim(text), '^[0-9]{{1,2}}$')) WHERE trim(text)::INT BETWEEN 1 AND 28),
nb AS (SELECT *, CASE WHEN rgt - lag(rgt) OVER (PARTITION BY doc, page ORDER BY rgt) <= 8 THEN 0 ELSE 1 END AS fresh FROM nc),
nx AS (SELECT *, sum(fresh) OVER (PARTITION BY doc, page ORDER BY rgt RANGE UNBOUNDED PRECEDING) AS band FROM nb),
nf AS (SELECT *, CASE WHEN value > lag(value) OVER (PARTITION BY doc, page, band ORDER BY cy DESC, item) THEN 0 ELSE 1 END AS restart FROM nx),
nr AS (SELECT *, sum(restart) OVER (PARTITION BY doc, page, band ORDER BY cy DESC, item ROWS UNBOUNDED PRECEDING) AS run FROM nf),
nk AS (SELECT *, min(item) OVER (PARTITION BY doc, page, band, run) AS stack FROM nr QUALIFY count(*) OVER (PARTITION BY doc, page, band, run) >= 5),
ng AS (SELECT *, lag(cy) OVER (PARTITION BY doc, page, stack ORDER BY cy DESC, item) - cy AS gap FROM nk),
n3 AS (SELECT doc, page, count(DISTINCT stack) AS stacks FROM nk GROUP BY 1, 2),
co AS (SELECT doc, page, stack, CASE WHEN any_value(stacks) >= 3 THEN CASE WHEN median(cx) > 306 THEN 2 ELSE 0 END + CASE WHEN median(cy) > 396 THEN 0 ELSE 1 END END AS quadrant,
         min(x) AS lft, max(rgt) AS rgt, max(cy) AS top, arg_min(height, value) AS height, list(value) AS numbers,
         min(cy) - CASE WHEN median(gap) > 0 THEN median(gap) ELSE 12 END / 4 AS c0 FROM ng JOIN n3 USING (doc, page) GROUP BY 1, 2, 3)"""
_FACTS_SQL = f"""{_STACKS_SQL},
pn AS (SELECT *, nullif(found, '')::INT AS number, CASE WHEN cx > 306 THEN 2 ELSE 0 END + CASE WHEN cy > 396 THEN 0 ELSE 1 END AS quad FROM it WHERE nullif(found, '')::INT > 0),
lead1 AS (SELECT * FROM co WHERE quadrant IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, page, quadrant ORDER BY lft, stack) = 1),
qb AS (SELECT l.doc, l.page, l.quadrant, pn.number, pn.item FROM lead1 l JOIN pn ON pn.doc = l.doc AND pn.page = l.page AND pn.quad = l.quadrant
         AND pn.cy > l.top AND pn.cy < l.top + l.height * 4 AND pn.x >= l.lft QUALIFY row_number() OVER (PARTITION BY l.doc, l.page, l.quadrant ORDER BY pn.rgt DESC, pn.item) = 1),
qn AS (SELECT l.doc, l.page, l.quadrant, qb.number, qb.item FROM lead1 l LEFT JOIN qb USING (doc, page, quadrant)),
qs AS (SELECT doc, page, count(*) > 1 AS multi, CASE WHEN bool_and(number IS NOT NULL) THEN min(number) ELSE any_value(number) FILTER (WHERE quadrant = lowest) END AS mini FROM
         (SELECT *, min(quadrant) OVER (PARTITION BY doc, page) AS lowest FROM qn) GROUP BY 1, 2),
cf AS (SELECT pn.doc, pn.page, pn.item, number, abs(number - pn.page) + CASE WHEN abs(cx - 306) > 612 * 0.15 THEN 4 ELSE 0 END + CASE WHEN number <= 28 AND abs(number - pn.page) > 10 THEN 8 ELSE 0 END
         + CASE WHEN y < 792 * 0.06::DOUBLE THEN 0 ELSE 2 END AS score FROM pn WHERE y <= 792 * 0.12::DOUBLE AND NOT EXISTS (SELECT 1 FROM co WHERE co.doc = pn.doc AND co.page = pn.page
         AND ((pn.x >= co.lft - 4 AND pn.rgt <= co.rgt + 4) OR (abs(pn.cx - (co.lft + co.rgt) / 2) < 20 AND list_contains(co.numbers, pn.number))))),
cr AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY score, item) AS k, lead(score) OVER (PARTITION BY doc, page ORDER BY score, item) AS second FROM cf),
pgs AS (SELECT DISTINCT doc, page FROM it),
ce AS (SELECT doc, page, min(c0) FILTER (WHERE quadrant IS NULL AND c0 < 792 * 0.2::DOUBLE) AS ceiling FROM co GROUP BY 1, 2),
fa AS (SELECT pgs.doc, pgs.page, coalesce(multi, false) AS multi_up, CASE WHEN NOT coalesce(multi, false) THEN ceiling END AS ceiling,
         CASE WHEN multi AND mini IS NOT NULL THEN mini ELSE cr.number END AS printed,
         CASE WHEN multi AND mini IS NOT NULL THEN 'high' WHEN cr.number IS NOT NULL AND abs(cr.number - pgs.page) <= 20 AND (second IS NULL OR second - score >= 3) THEN 'high' ELSE 'low' END AS confidence,
         CASE WHEN multi AND mini IS NOT NULL THEN NULL ELSE cr.item END AS own
       FROM pgs LEFT JOIN qs USING (doc, page) LEFT JOIN ce USING (doc, page) LEFT JOIN cr ON cr.doc = pgs.doc AND cr.page = pgs.page AND k = 1)"""


@query(f"""WITH {_FACTS_SQL} SELECT fa.doc, fa.page, fa.multi_up, fa.printed, fa.confidence, fa.ceiling, qn.quadrant, CASE WHEN fa.multi_up THEN qn.number END AS number
FROM fa LEFT JOIN qn ON qn.doc = fa.doc AND qn.page = fa.page""")
def cmp2_region_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed number and confidence of each sheet, its footer ceiling, and the quadrants of condensed ones with their numbers."""
    items = sheet_items(spark, sf_dir)
    cols = R.columns(R.number_stacks(items))
    plan = R.quadrant_numbers(items, cols)
    facts = R.printed_numbers(items, cols, plan)
    number = F.when(F.col("multi_up"), F.col("number")).alias("number")
    return facts.join(plan.drop("item"), R.PAGE, "left").select("doc", "page", "multi_up", "printed", "confidence", "ceiling", "quadrant", number)


_ROLES_SQL = f"""{_FACTS_SQL},
bk AS (SELECT *, regexp_replace(regexp_replace(lower(trim(text)), '[0-9]', '#', 'g'), '\\s+', ' ', 'g') AS band FROM it),
np AS (SELECT doc, count(DISTINCT page) AS n FROM it GROUP BY 1),
rt AS (SELECT doc, band FROM (SELECT DISTINCT doc, page, band FROM bk WHERE (cy > 792 * (1 - 0.08::DOUBLE) OR cy < 792 * 0.12::DOUBLE) AND band <> '') JOIN np USING (doc)
       GROUP BY doc, band, n HAVING count(*) >= greatest(3, ceil(n * 0.6::DOUBLE))),
ro AS (SELECT bk.*, fa.multi_up, fa.ceiling, fa.printed, fa.own, nk.item IS NOT NULL AS numbered, rt.band IS NOT NULL AS again, qn.item IS NOT NULL AND fa.multi_up AS mini
       FROM bk JOIN fa USING (doc, page) LEFT JOIN nk ON nk.doc = bk.doc AND nk.page = bk.page AND nk.item = bk.item
       LEFT JOIN rt ON rt.doc = bk.doc AND rt.band = bk.band LEFT JOIN qn ON qn.doc = bk.doc AND qn.page = bk.page AND qn.item = bk.item),
rb AS (SELECT *, CASE WHEN multi_up THEN NULL WHEN ceiling IS NOT NULL AND cy < ceiling THEN 'footer' WHEN ceiling IS NOT NULL AND cy < 792 * 0.12::DOUBLE THEN NULL
       WHEN cy > 792 * (1 - 0.08::DOUBLE) THEN CASE WHEN again OR cy > 792 * (1 - 0.06::DOUBLE) OR cy < 792 * 0.06::DOUBLE THEN 'header' END
       WHEN cy < 792 * 0.08::DOUBLE THEN CASE WHEN again OR cy < 792 * 0.06::DOUBLE THEN 'footer' END
       WHEN again AND cy < 792 * 0.12::DOUBLE THEN 'footer' END AS place FROM ro),
rl AS (SELECT doc, page, item, text, x, y, printed, CASE WHEN numbered THEN 'line-number' WHEN mini OR item = own THEN 'page-number'
  WHEN place IS NOT NULL AND regexp_matches(trim(text), '^[A-Za-z][A-Za-z0-9]{{0,19}}[ _.-]?[0-9]{{3,10}}$') THEN 'stamp' ELSE coalesce(place, 'body') END AS role FROM rb)"""


@query(f"WITH {_ROLES_SQL} SELECT doc, page, item, role FROM rl")
def cmp1_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of every item of every page, by evidence of the page and of its document."""
    return R.classified(sheet_items(spark, sf_dir)).select("doc", "page", "item", "role")


@query(f"""WITH {_ROLES_SQL},
pb AS (SELECT doc, (page - 1) // 3 AS section, page, coalesce(string_agg(text, ' | ' ORDER BY y DESC, x, item) FILTER (WHERE role = 'header'), '') AS header,
  regexp_replace(coalesce(string_agg(text, '' ORDER BY y DESC, x, item) FILTER (WHERE role = 'footer'), ''), '\\s+', '', 'g') AS foot, arg_min(text, item) FILTER (WHERE role = 'page-number') AS number,
  any_value(printed) AS printed FROM rl GROUP BY 1, 2, 3),
pp AS (SELECT *, regexp_replace(regexp_replace(trim(number), '^([^0-9]*)[0-9]+', '\\1{{n}}'), '(of\\s*)[0-9]+', '\\1{{total}}', 'g') AS pat, row_number() OVER (PARTITION BY doc, section ORDER BY page) AS k,
  row_number() OVER (PARTITION BY doc, section ORDER BY number IS NULL, page) AS nk, row_number() OVER (PARTITION BY doc, section ORDER BY header = '', page) AS hk FROM pb),
ag AS (SELECT doc, section, count(*) AS pages, min(page) AS fp, any_value(page) FILTER (WHERE hk = 1 AND header <> '') AS header_page, any_value(header) FILTER (WHERE hk = 1 AND header <> '') AS header,
  any_value(page) FILTER (WHERE nk = 1 AND number IS NOT NULL) AS numbered_page, any_value(pat) FILTER (WHERE nk = 1) AS pattern, any_value(printed - page) FILTER (WHERE nk = 1 AND number IS NOT NULL) AS ahead,
  count(DISTINCT pat) = 1 AND count(DISTINCT printed - page) FILTER (WHERE number IS NOT NULL) = 1 AS steady, count(*) FILTER (WHERE k > 1 AND number IS NOT NULL AND printed = page) AS later,
  bool_or(k = 1 AND number IS NOT NULL) AS first_has, any_value(foot) FILTER (WHERE k = 1) AS f1, any_value(foot) FILTER (WHERE nk = 1 AND number IS NOT NULL) AS fn FROM pp GROUP BY 1, 2)
SELECT doc, section, pages, header_page, header, numbered_page, pattern, ahead + fp AS start, steady, NOT first_has AND pages > 1 AND later = pages - 1 AS first_differs,
  CASE WHEN NOT first_has AND f1 <> '' AND f1 = fn THEN numbered_page END AS twin_page FROM ag""")
def cmp9_section_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running heads and page-number fields of sections of three pages, from all lines of both bands."""
    roles = R.classified(sheet_items(spark, sf_dir)).withColumn("section", F.floor((F.col("page") - 1) / 3))
    return running_heads(page_bands(roles, ["doc", "section"]), ["doc", "section"])
