"""Queries of footnotes over pages derived from `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import footnotes as N
from ..sources.noted_pages import NOTED_SQL, noted_lines, noted_marks, noted_pages, noted_paragraphs, noted_rules
from .registry import query

# The fold over a volume's pages as a recursion: (next number, stopped) from page to page.
_PAGES_SQL = f"""WITH RECURSIVE {NOTED_SQL},
ss AS (SELECT nr.doc, nr.page, y FROM nr WHERE width BETWEEN 100 AND 200
       AND (SELECT arg_min(y - first <= 2.5 * size AND EXISTS (SELECT 1 FROM nm WHERE nm.doc = np.doc AND nm.page = np.page AND nm.paragraph = np.paragraph AND run = 1), paragraph)
            FROM np WHERE np.doc = nr.doc AND np.page = nr.page AND first < y)
       AND NOT EXISTS (SELECT 1 FROM np WHERE np.doc = nr.doc AND np.page = nr.page AND first >= y AND first - y <= 4)),
un AS (SELECT np.*, y, nm.number FROM np JOIN ss USING (doc, page) LEFT JOIN nm ON nm.doc = np.doc AND nm.page = np.page AND nm.paragraph = np.paragraph AND run = 1 WHERE first < y),
bd AS (SELECT np.* FROM np JOIN ss USING (doc, page) WHERE first >= y),
nu AS (SELECT doc, page, list(number ORDER BY paragraph) FILTER (WHERE number IS NOT NULL) AS numbers, arg_min_null(number, paragraph) AS f, bool_or(hidden) AS hid, max(first) AS top FROM un GROUP BY 1, 2),
tm AS (SELECT nm.doc, nm.page, nm.number, count(*) AS times FROM nm JOIN bd ON bd.doc = nm.doc AND bd.page = nm.page AND bd.paragraph = nm.paragraph GROUP BY 1, 2, 3),
pr AS (SELECT un.doc, un.page, bool_and(coalesce(times, 0) = 1) AS paired FROM un LEFT JOIN tm ON tm.doc = un.doc AND tm.page = un.page AND tm.number = un.number WHERE un.number IS NOT NULL GROUP BY 1, 2),
ab AS (SELECT doc, page, min(first) - 2.25 AS bottom FROM bd GROUP BY 1, 2),
cl AS (SELECT doc, page, max(col) AS cols FROM np GROUP BY 1, 2),
ok AS (SELECT doc, page, numbers[1] AS f, len(numbers) AS n, coalesce(f IS NOT NULL AND NOT hid AND numbers = range(f, f + len(numbers)) AND paired AND cols = 1 AND bottom - (top + 0.8 * 11.25) >= 3.5, false) AS sound
       FROM nu JOIN cl USING (doc, page) LEFT JOIN pr USING (doc, page) LEFT JOIN ab USING (doc, page)),
st AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) AS k FROM ok),
fo(doc, k, nxt, stopped) AS (SELECT DISTINCT doc, 0::BIGINT, 1::BIGINT, false FROM st UNION ALL
   SELECT st.doc, st.k, CASE WHEN NOT stopped AND sound AND f = nxt THEN nxt + n ELSE nxt END, stopped OR NOT (sound AND f = nxt) FROM fo JOIN st ON st.doc = fo.doc AND st.k = fo.k + 1)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = noted_pages(spark, sf_dir)
    noted = N.noted_pages(noted_rules(base), noted_paragraphs(base), noted_marks(base), noted_lines(base))
    return N.lifted(N.pairings(noted))


@query(f"{_PAGES_SQL} SELECT st.doc, st.page, f AS first_number, n AS n_notes, sound, CASE WHEN stopped THEN 'kept' ELSE 'lifted' END AS kind FROM st JOIN fo USING (doc, k)")
def cmp8_lifted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with footnotes: lifted while each is sound and numbers run on, kept from a volume's first failure on."""
    return _pages(spark, sf_dir).select("doc", "page", "first_number", "n_notes", "sound", "kind")


@query(f"""{_PAGES_SQL}, lf AS (SELECT st.doc, st.page FROM st JOIN fo USING (doc, k) WHERE NOT stopped),
nn AS (SELECT un.doc, un.page, un.paragraph, count(number) OVER (PARTITION BY un.doc, un.page ORDER BY paragraph ROWS UNBOUNDED PRECEDING) AS note, number FROM un JOIN lf USING (doc, page)),
ng AS (SELECT doc, page, note, max(number) AS number, array_to_string(list(paragraph ORDER BY paragraph), ',') AS paragraphs FROM nn GROUP BY 1, 2, 3)
SELECT ng.doc, ng.page, ng.number, ng.paragraphs, nm.paragraph AS mark_paragraph, nm.run AS mark_run FROM ng JOIN nm ON nm.doc = ng.doc AND nm.page = ng.page AND nm.number = ng.number
JOIN bd ON bd.doc = nm.doc AND bd.page = nm.page AND bd.paragraph = nm.paragraph""")
def jon17_footnote_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of lifted pages with the one mark that each has in the text above."""
    found = N.footnotes(_pages(spark, sf_dir))
    return found.withColumn("paragraphs", F.array_join(F.col("paragraphs").cast("array<string>"), ","))
