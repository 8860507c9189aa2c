"""Queries of ruled tables: grids, borders, placed lines and whole tables of order forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ruled_tables as T
from ..session import ship
from ..sources.forms import FORMS_SQL, form_frames, form_rules, form_text
from .registry import query

# Drawings as the least rule that can be reached, edges by the first rule within two points, spans as islands, then grids.
_GRIDS_SQL = f"""WITH RECURSIVE {FORMS_SQL},
tp AS (SELECT a.page, a.rule AS a, b.rule AS b FROM fr a JOIN fr b ON a.page = b.page AND a.x - 2 <= b.x + b.width AND b.x - 2 <= a.x + a.width
         AND a.y - 2 <= b.y + b.height AND b.y - 2 <= a.y + a.height),
reach(page, rule, low) AS (SELECT page, rule, rule FROM fr UNION SELECT reach.page, tp.b, reach.low FROM reach JOIN tp ON tp.page = reach.page AND tp.a = reach.rule
         WHERE reach.low < tp.b),
dr AS (SELECT page, rule, min(low) AS drawing FROM reach GROUP BY 1, 2),
mk AS (SELECT page, drawing, height <= 3 AND width >= 8 AS level, CASE WHEN height <= 3 AND width >= 8 THEN y + height / 2 ELSE x + width / 2 END AS mark,
         CASE WHEN height <= 3 AND width >= 8 THEN x ELSE y END AS lo, CASE WHEN height <= 3 AND width >= 8 THEN x + width ELSE y + height END AS hi
       FROM fr JOIN dr USING (page, rule) WHERE (height <= 3 AND width >= 8) OR (width <= 3 AND height >= 8)),
st AS (SELECT page, drawing, level, list_reduce(list_transform(list_sort(list(mark)), lambda m: [m]),
         lambda kept, m: CASE WHEN m[1] > kept[-1] + 2 THEN list_concat(kept, m) ELSE kept END) AS stops FROM mk GROUP BY 1, 2, 3),
pl AS (SELECT page, drawing, level, list_max(list_filter(stops, lambda s: s <= mark)) AS ep, lo, hi FROM mk JOIN st USING (page, drawing, level)),
fl AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY page, drawing, level, ep ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS fresh FROM pl),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY page, drawing, level, ep ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM fl),
sp AS (SELECT page, drawing, level, ep, island, min(lo) AS lo, max(hi) AS hi FROM isl GROUP BY 1, 2, 3, 4, 5),
ed AS (SELECT page, drawing, level, ep, min(lo) AS lo, max(hi) AS hi FROM sp GROUP BY 1, 2, 3, 4),
seed AS (SELECT page, drawing, lo AS l, hi AS r FROM ed WHERE level QUALIFY row_number() OVER (PARTITION BY page, drawing ORDER BY hi - lo DESC, ep) = 1),
rw AS (SELECT page, drawing, l, r, sp.ep FROM sp JOIN seed USING (page, drawing) WHERE level GROUP BY 1, 2, 3, 4, 5
       HAVING sum(greatest(0, least(sp.hi, r) - greatest(sp.lo, l))) >= 0.8 * (r - l)),
bx AS (SELECT page, drawing, l, r, max(ep) AS t, min(ep) AS b, list_sort(list(ep), 'DESC') AS rows FROM rw GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3),
up AS (SELECT page, drawing, sp.ep FROM sp JOIN bx USING (page, drawing) WHERE NOT level AND r - sp.ep >= 12 GROUP BY 1, 2, 3, t, b
       HAVING sum(greatest(0, least(sp.hi, t) - greatest(sp.lo, b))) >= 0.8 * (t - b)),
ul AS (SELECT page, drawing, list_sort(list(ep)) AS ups FROM up GROUP BY 1, 2),
gr AS (SELECT page, drawing, rows, list_append(list_reduce(list_transform(list_prepend(l, coalesce(ups, [])), lambda m: [m]),
         lambda kept, m: CASE WHEN m[1] - kept[-1] >= 12 THEN list_concat(kept, m) ELSE kept END), r) AS columns
       FROM bx LEFT JOIN ul USING (page, drawing)),
gd AS (SELECT * FROM gr WHERE len(columns) >= 3)"""
_CELLS_SQL = """gc AS (SELECT page, drawing, i AS r, j AS c, rows[i + 1] AS t, rows[i + 2] AS b, columns[j + 1] AS l, columns[j + 2] AS e FROM gd,
         unnest(range(0, len(rows) - 1)) AS p(i), unnest(range(0, len(columns) - 1)) AS q(j)),
sd AS (SELECT page, drawing, r, c, side, level, pos, a, z FROM gc, (VALUES ('above'), ('below'), ('before'), ('behind')) AS v(side),
         LATERAL (SELECT side IN ('above', 'below') AS level, CASE side WHEN 'above' THEN t WHEN 'below' THEN b WHEN 'before' THEN l ELSE e END AS pos,
                  CASE WHEN side IN ('above', 'below') THEN l ELSE b END AS a, CASE WHEN side IN ('above', 'below') THEN e ELSE t END AS z)),
ne AS (SELECT sd.*, ed.ep FROM sd JOIN ed ON ed.page = sd.page AND ed.drawing = sd.drawing AND ed.level = sd.level AND abs(ed.ep - pos) <= 2
       QUALIFY row_number() OVER (PARTITION BY sd.page, sd.drawing, r, c, side ORDER BY ed.ep) = 1),
dn AS (SELECT ne.page, ne.drawing, r, c, side FROM ne JOIN sp ON sp.page = ne.page AND sp.drawing = ne.drawing AND sp.level = ne.level AND sp.ep = ne.ep
       GROUP BY 1, 2, 3, 4, 5, a, z HAVING sum(greatest(0, least(sp.hi, z) - greatest(sp.lo, a))) >= 0.8 * (z - a)),
bs AS (SELECT page, drawing, r, c, bool_or(side = 'above') AS above, bool_or(side = 'below') AS below, bool_or(side = 'before') AS before, bool_or(side = 'behind') AS behind
       FROM dn GROUP BY 1, 2, 3, 4)"""
_PLACED_SQL = """te AS (SELECT page, line, cell, x, baseline, coalesce(greatest(x, least(ft.right, lead(x) OVER (PARTITION BY page, line ORDER BY cell))), ft.right) AS ends FROM ft),
pc AS (SELECT page, drawing, line, cell, least(len(list_filter(rows[2:], lambda e: e >= baseline)), len(rows) - 2) AS r,
         CASE WHEN ends <= columns[1] + 2 OR x >= columns[-1] - 2 THEN -1
              ELSE coalesce(list_filter(range(0, len(columns) - 1), lambda k: x >= columns[k + 1] - 2 AND ends <= columns[k + 2] + 2)[1], -2) END AS place
       FROM te JOIN gd USING (page) WHERE baseline <= rows[1] + 2 AND baseline > rows[-1] - 2)"""


@query(f"{_GRIDS_SQL}, {_CELLS_SQL} SELECT page, drawing, gc.r, gc.c, coalesce(above, false) AS above, coalesce(below, false) AS below, coalesce(before, false) AS before, coalesce(behind, false) AS behind FROM gc LEFT JOIN bs USING (page, drawing, r, c)")
def jon21_grid_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the grids that drawn rules make, and which of their sides are drawn."""
    ship(spark)
    return T.grid_cells(form_rules(spark, sf_dir), ["page"])


@query(f"{_GRIDS_SQL}, {_PLACED_SQL} SELECT page, drawing, line, cell, r, place FROM pc")
def jon12_placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row and column of each text cell in the grid of its page; -1 beside it, -2 across a column edge."""
    ship(spark)
    return T.placements(form_rules(spark, sf_dir), form_text(spark, sf_dir), ["page"])


@query(f"""{_GRIDS_SQL}, {_CELLS_SQL}, {_PLACED_SQL},
bl AS (SELECT page, drawing, line, bool_or(place = -2) OR (bool_or(place = -1) AND bool_or(place >= 0)) AS broken, bool_or(place >= 0) AS inside FROM pc GROUP BY 1, 2, 3),
ok AS (SELECT page, drawing FROM bl JOIN gd USING (page, drawing) JOIN ff USING (page) WHERE columns[1] >= ff.left - 18 AND columns[-1] <= ff.right + 18
       GROUP BY 1, 2 HAVING bool_or(inside) AND NOT bool_or(broken)),
cl AS (SELECT page, drawing, r, place AS c, list_sort(list_distinct(list(line))) AS lines FROM pc WHERE place >= 0 GROUP BY 1, 2, 3, 4)
SELECT page, drawing, gc.r, gc.c, coalesce(above, false) AS above, coalesce(below, false) AS below, coalesce(before, false) AS before, coalesce(behind, false) AS behind,
       coalesce(array_to_string(lines, ','), '') AS lines FROM gc JOIN ok USING (page, drawing) LEFT JOIN bs USING (page, drawing, r, c) LEFT JOIN cl USING (page, drawing, r, c)""")
def cmp7_ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of all order forms: their cells, drawn sides, and the lines in each cell."""
    ship(spark)
    found = T.ruled_tables(form_rules(spark, sf_dir), form_text(spark, sf_dir), form_frames(spark, sf_dir), ["page"])
    return found.withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))
