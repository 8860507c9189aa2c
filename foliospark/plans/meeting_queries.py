"""Queries of things that meet on pages: matches and runs, points and boxes, rules and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import meeting as M
from ..sources.tables import RUNS_SQL, by_page, lines, runs
from .registry import query

_TERM = "licens"
_ID = 100_000  # words of a line


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).withColumn("run", F.col("line") * _ID + F.col("word"))


@query(f"""WITH {RUNS_SQL}, pt AS (SELECT doc_id, line, i, parts[i] AS part, len(parts) AS n FROM (SELECT doc_id, line, string_split(lower(text), '{_TERM}') AS parts FROM ln), unnest(range(1, len(parts) + 1)) AS r(i)),
mt AS (SELECT doc_id, line, i AS match, n, sum(length(part) + 6) OVER (PARTITION BY doc_id, line ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT - 6 AS a FROM pt),
sp AS (SELECT doc_id, line, word, off::BIGINT AS s, (off + length(text))::BIGINT AS e, 72.0::DOUBLE + 6.6::DOUBLE * off::DOUBLE AS x FROM wo WHERE text <> '')
SELECT doc_id, line, match, word, greatest(s, a) - s AS "from", least(e, a + 6) - s AS "to", round(x + 6.6::DOUBLE * (greatest(s, a) - s), 6) AS quad_x, round(6.6::DOUBLE * (least(e, a + 6) - greatest(s, a)), 6) AS quad_width
FROM sp JOIN mt USING (doc_id, line) WHERE match < n AND s < a + 6 AND e > a""")
def jon13_match_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of every hit of a term on the runs that it lies on, by places in the line's text."""
    c = F.col
    # lines with a hit are dealt out by page as their words are, so that they meet without an exchange
    parts = by_page(lines(spark, sf_dir).where(F.contains(F.lower("text"), F.lit(_TERM))), "doc_id")
    parts = parts.withColumn("parts", F.split(F.lower("text"), _TERM)).select("doc_id", "line", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "part"))
    so_far = Window.partitionBy("doc_id", "line").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = len(_TERM)
    hits = parts.withColumn("match_start", F.sum(F.length("part") + size).over(so_far) - size).where("i < n - 1")
    hits = hits.select("doc_id", "line", (c("i") + 1).cast("long").alias("match"), "match_start", (c("match_start") + size).alias("match_end"))
    start = F.round((c("x") - 72.0) / 6.6).cast("long")
    spans = runs(spark, sf_dir).select("doc_id", "line", c("word").alias("run"), start.alias("start"), (start + F.length("text")).alias("end"), "x", "width")
    found = M.quads(spans, hits, ["doc_id", "line"])
    return found.select("doc_id", "line", "match", c("run").alias("word"), "from", "to", F.round("quad_x", 6).alias("quad_x"), F.round("quad_width", 6).alias("quad_width"))


@query(f"""WITH {RUNS_SQL}, po AS (SELECT doc_id, line AS point, 40.0::DOUBLE + (doc_id * 37 + line * 53) % 560 AS px, 720.0::DOUBLE - 14.85::DOUBLE * (line - 1) + (line * 7) % 60 - 30 AS py FROM ln),
ga AS (SELECT doc_id, point, rn.line * {_ID} + word AS box, size, sqrt(power(greatest(0.0::DOUBLE, x - px, px - (x + width)), 2) + power(greatest(0.0::DOUBLE, y - py, py - (y + size)), 2)) AS d FROM po JOIN rn USING (doc_id)),
be AS (SELECT * FROM ga QUALIFY row_number() OVER (PARTITION BY doc_id, point ORDER BY d, box) = 1)
SELECT doc_id, point, CASE WHEN d <= 1.5::DOUBLE * size THEN box END AS box, CASE WHEN d <= 1.5::DOUBLE * size THEN round(d, 6) END AS distance FROM po LEFT JOIN be USING (doc_id, point)""")
def jon8_nearest_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for every line of every page, about the text: the run nearest to it, if within reach."""
    c = F.col
    px, py = 40.0 + (c("doc_id") * 37 + c("line") * 53) % 560, 720.0 - 14.85 * (c("line") - 1) + (c("line") * 7) % 60 - 30
    points = by_page(lines(spark, sf_dir).select("doc_id", "line"), "doc_id").select("doc_id", c("line").alias("point"), px.alias("px"), py.alias("py"))
    boxes = _boxes(spark, sf_dir).select("doc_id", c("run").alias("box"), "x", "y", "width", c("size").alias("height"), "size")
    found = M.nearest_boxes(points, boxes, ["doc_id"], largest=14.0)
    return found.select("doc_id", "point", "box", F.round("distance", 6).alias("distance"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules under every third run, some too thick, too short or too low; upright ones at every seventh line's first run."""
    c = F.col
    r = _boxes(spark, sf_dir)
    low = F.when(c("line") % 4 == 0, 3.0).otherwise(1.0)
    short = F.when(c("line") % 11 == 0, 4.0).otherwise(0.0)
    level = r.where("word % 3 = 0").select("doc_id", c("run").alias("rule"), (c("x") - 0.5).alias("x"), (c("y") - low).alias("y"), (c("width") + 1.0 - short).alias("width"), F.when(c("word") % 15 == 0, 4.0).otherwise(0.5).alias("height"))
    upright = r.where("word = 1 AND line % 7 = 0").select("doc_id", (-c("run")).alias("rule"), (c("x") + 90.0).alias("x"), (c("y") - 5.0).alias("y"), F.lit(1.0).alias("width"), F.lit(12.0).alias("height"))
    return level.unionByName(upright)


_RULES_SQL = f"""{RUNS_SQL}, ru AS (SELECT doc_id, line * {_ID} + word AS rule, x - 0.5::DOUBLE AS x, y - CASE WHEN line % 4 = 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS y, width + 1.0::DOUBLE - CASE WHEN line % 11 = 0 THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS width,
  CASE WHEN word % 15 = 0 THEN 4.0::DOUBLE ELSE 0.5::DOUBLE END AS height FROM rn WHERE word % 3 = 0
 UNION ALL SELECT doc_id, -(line * {_ID} + word), x + 90.0::DOUBLE, y - 5.0::DOUBLE, 1.0, 12.0 FROM rn WHERE word = 1 AND line % 7 = 0),
ur AS (SELECT * FROM ru WHERE width <= 3 AND height >= 8),
ul AS (SELECT * FROM ru WHERE NOT (width <= 3 AND height >= 8) AND NOT EXISTS (SELECT 1 FROM ur WHERE ur.doc_id = ru.doc_id AND ru.x - 2 <= ur.x + ur.width AND ur.x - 2 <= ru.x + ru.width AND ru.y - 2 <= ur.y + ur.height AND ur.y - 2 <= ru.y + ru.height))"""


@query(f"""WITH {_RULES_SQL} SELECT doc_id, line, word FROM rn WHERE EXISTS (SELECT 1 FROM ul WHERE ul.doc_id = rn.doc_id AND ul.height <= greatest(1.0::DOUBLE, 0.2::DOUBLE * rn.size) AND ul.y <= rn.y
AND ul.y >= rn.y - greatest(1.0::DOUBLE, 0.2::DOUBLE * rn.size) AND ul.x <= rn.x + 1 AND ul.x + ul.width >= rn.x + rn.width - 1)""")
def jon22_underlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that a level rule underlines; rules that an upright one meets belong to a table and underline nothing."""
    rules = M.underline_rules(_rules(spark, sf_dir), ["doc_id"])
    boxes = _boxes(spark, sf_dir).drop("text")
    return M.underlined(boxes, rules, ["doc_id"]).select("doc_id", "line", "word")


@query(f"""WITH {_RULES_SQL}, sc AS (SELECT doc_id, width >= height AS lv, CASE WHEN width >= height THEN y + height / 2 ELSE x + width / 2 END AS at_, CASE WHEN width >= height THEN x ELSE y END AS a, CASE WHEN width >= height THEN x + width ELSE y + height END AS b FROM
 (SELECT doc_id, x + width * ((abs(rule) % {_ID}) % 4) / 4 AS x, y + (abs(rule) // {_ID}) % 5 - 2.5::DOUBLE AS y, width, height FROM ru WHERE abs(rule) % 2 = 0)),
dr AS (SELECT doc_id, rule, width >= height AS lv, CASE WHEN width >= height THEN y + height / 2 ELSE x + width / 2 END AS at_, CASE WHEN width >= height THEN x ELSE y END AS a, CASE WHEN width >= height THEN x + width ELSE y + height END AS b FROM ru)
SELECT doc_id, rule FROM dr WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.doc_id = dr.doc_id AND sc.lv = dr.lv AND abs(dr.at_ - sc.at_) <= 2 AND least(dr.b, sc.b) - greatest(dr.a, sc.a) >= 0.5::DOUBLE * (dr.b - dr.a))""")
def jon23_without_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn rules that no rule seen in a scan traces; the scan holds every second one, moved along and across."""
    c = F.col
    drawn = _rules(spark, sf_dir)
    of, line = F.abs("rule") % _ID, F.floor(F.abs("rule") / _ID)
    scanned = drawn.where(F.abs("rule") % 2 == 0).select("doc_id", "rule", (c("x") + c("width") * (of % 4) / 4).alias("x"), (c("y") + line % 5 - 2.5).alias("y"), "width", "height")
    return M.without_echoes(drawn, scanned, ["doc_id"]).select("doc_id", "rule")
