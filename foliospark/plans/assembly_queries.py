"""Queries of annotations, footnotes, recognised text, fidelity reports and tool dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators.dispatch import COMMANDS, dispatch
from ..operators.marked_content import marks_in_force
from ..session import load, ship
from ..sources.tables import LINES_SQL, RUNS_SQL, lines, runs
from ..sources.text_pages import wrap
from .layout_queries import _line_boxes
from .registry import query

D = "::DOUBLE"


@query("""SELECT d.doc_id, count(l.doc_id) AS painted FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0 GROUP BY d.doc_id""")
def prj15_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible annotations (labels that are not toxic) are painted, all go; what each document got."""
    visible = load(spark, sf_dir, "labels").where("toxic = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return load(spark, sf_dir, "documents").join(visible, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("painted"))


@query(f"""WITH {RUNS_SQL}, t AS (SELECT doc_id, sum(length(text)) FILTER (WHERE size = 11) AS typed, sum(length(text)) FILTER (WHERE size = 14) AS hidden FROM rn GROUP BY doc_id)
SELECT doc_id, line, count(*) AS n FROM rn JOIN t USING (doc_id) WHERE size = 14 AND coalesce(typed, 0) >= 5 * hidden GROUP BY 1, 2""")
def prj25_hidden_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the other kind (headings stand for hidden ones), only where typed letters outnumber them five to one."""
    r = runs(spark, sf_dir)
    chars = lambda s: F.sum(F.when(F.col("size") == s, F.length("text")))
    t = r.groupBy("doc_id").agg(F.coalesce(chars(11.0), F.lit(0)).alias("typed"), chars(14.0).alias("hidden"))
    found = r.where("size = 14.0").join(t.where("typed >= 5 * hidden"), "doc_id", "left_semi")
    return found.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RUNS_SQL}, h AS (SELECT doc_id, line, min(x) AS a, max(x + width) AS b, min(y) AS y FROM rn GROUP BY 1, 2)
SELECT doc_id, line FROM h WHERE NOT EXISTS (SELECT 1 FROM h s WHERE s.doc_id = h.doc_id AND s.line = h.line + 1 AND abs(s.y - h.y) <= 15 AND least(h.b, s.b) - greatest(h.a, s.a) >= 0.5{D} * (h.b - h.a))""")
def jon23_not_echoed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules without an echo: a neighbour near by that shares half of their length (each looks at the next line only)."""
    h = _line_boxes(spark, sf_dir)
    s = h.select("doc_id", (F.col("line") - 1).alias("line"), F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("right").alias("sr"))
    near = (F.abs(F.col("sy") - F.col("y")) <= 15) & (F.least("right", "sr") - F.greatest("x", "sx") >= 0.5 * (F.col("right") - F.col("x")))
    echoed = h.join(s, ["doc_id", "line"]).where(near).select("doc_id", "line")
    return h.join(echoed, ["doc_id", "line"], "left_anti").select("doc_id", "line")


# What structure types hold, and tags without content.
_ROLES = {"p": "paragraph", "h1": "heading", "h2": "heading", "h3": "heading", "title": "heading", "li": "list-item", "td": "cell", "th": "cell", "caption": "caption", "blockquote": "quote", "code": "paragraph"}
_VOID = ("br", "meta", "img", "hr", "input", "link")


def _marked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, pos, kind, id: tags of `pages` as marks, those of structure types with an id."""
    pieces = load(spark, sf_dir, "pages").select("page_id", F.posexplode(F.expr("regexp_extract_all(html, '<[^>]*>|[^<]+', 0)")).alias("pos", "piece"))
    tag = F.lower(F.regexp_extract("piece", "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    kind = F.when(~F.col("piece").startswith("<"), "text").when(F.col("piece").startswith("</"), "end").otherwise("begin")
    tagged = pieces.withColumn("tag", tag).withColumn("kind", kind).where("kind = 'text' OR tag <> ''")
    tagged = tagged.where(~((F.col("kind") != "text") & F.col("tag").isin(*_VOID)))
    named = (F.col("kind") == "begin") & F.col("tag").isin(*_ROLES)
    return tagged.select("page_id", F.col("pos").cast("long").alias("pos"), "kind", F.when(named, F.concat_ws(":", "tag", "pos")).alias("id"))


_VOID_SQL = ", ".join(f"'{t}'" for t in _VOID)
_ROLES_SQL = ", ".join(f"'{t}'" for t in _ROLES)


@query(f"""WITH RECURSIVE pc AS (SELECT page_id, i - 1 AS pos, t[i] AS piece FROM (SELECT page_id, regexp_extract_all(html, '<[^>]*>|[^<]+') AS t FROM pages), unnest(range(1, len(t) + 1)) AS r(i)),
tg AS (SELECT *, lower(regexp_extract(piece, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pc),
it AS (SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k, CASE WHEN NOT starts_with(piece, '<') THEN 'text' WHEN starts_with(piece, '</') THEN 'end' ELSE 'begin' END AS kind,
  CASE WHEN starts_with(piece, '<') AND NOT starts_with(piece, '</') AND tag IN ({_ROLES_SQL}) THEN tag || ':' || pos::VARCHAR ELSE '' END AS id FROM tg
  WHERE NOT starts_with(piece, '<') OR (tag <> '' AND tag NOT IN ({_VOID_SQL}))),
st(page_id, k, kind, pos, stack) AS (SELECT DISTINCT page_id, 0::BIGINT, '', 0::BIGINT, []::VARCHAR[] FROM it UNION ALL
  SELECT it.page_id, it.k, it.kind, it.pos, CASE it.kind WHEN 'begin' THEN list_append(stack, it.id) WHEN 'end' THEN stack[1:len(stack) - 1] ELSE stack END FROM st JOIN it ON it.page_id = st.page_id AND it.k = st.k + 1)
SELECT page_id, pos, list_filter(stack, lambda x: x <> '')[-1] AS mark FROM st WHERE kind = 'text'""")
def jon20_mark_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure mark in force for every text of every page, tags being closed by whatever end comes next."""
    return marks_in_force(_marked_items(spark, sf_dir), ["page_id"], "pos")


@query(f"""WITH {RUNS_SQL}, l AS (SELECT doc_id, line, min(y) AS y, max(x + width) - min(x) AS w FROM rn GROUP BY 1, 2) SELECT doc_id, min(y) AS rule FROM l WHERE w >= 0.3{D} * 612.0{D} AND y > 80 AND y <= 110 GROUP BY doc_id""")
def agg32_footer_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest level rule of 30 % of the width in the band above the foot."""
    wide = F.col("right") - F.col("x") >= 0.3 * 612.0
    return _line_boxes(spark, sf_dir).where(wide & (F.col("y") > 80) & (F.col("y") <= 110)).groupBy("doc_id").agg(F.min("y").alias("rule"))


@query()
def scl13_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each document's lines take at 40 columns, and the longest of them."""
    ship(spark)

    @F.pandas_udf("struct<rows:long,longest:long>")
    def wrapped(text):  # noqa: ANN001, ANN202
        import pandas as pd

        parts = [wrap(t or "", 40) for t in text]
        return pd.DataFrame({"rows": [len(p) for p in parts], "longest": [max(map(len, p)) for p in parts]})

    every = lines(spark, sf_dir).select("doc_id", wrapped("text").alias("w"))
    return every.groupBy("doc_id").agg(F.sum("w.rows").alias("rows"), F.max("w.longest").alias("longest"))


@query(f"""WITH {LINES_SQL}, f AS (SELECT doc_id, line, length(text) > 2000 AS bad FROM ln), s AS (SELECT doc_id, line, bool_or(bad) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS stopped FROM f)
SELECT doc_id, count(*) FILTER (WHERE NOT stopped) AS lifted FROM s GROUP BY doc_id""")
def cmp8_stop_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines lifted before the first one that can't be; nothing behind it is."""
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    stopped = F.bool_or(F.length("text") > 2000).over(w)
    return lines(spark, sf_dir).withColumn("stopped", stopped).groupBy("doc_id").agg(F.count_if(~F.col("stopped")).alias("lifted"))


@query(f"""WITH {RUNS_SQL}, m AS (SELECT doc_id, median(width / length(text)) AS per FROM rn WHERE length(text) >= 5 GROUP BY doc_id HAVING count(*) >= 20)
SELECT doc_id, line, word, round(width / length(text) / per, 6) AS relative FROM rn JOIN m USING (doc_id) WHERE size = 14""")
def cmp6_relative_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from widths: a document's median width per letter, joined back to its headings."""
    r = runs(spark, sf_dir)
    per = F.col("width") / F.length("text")
    m = r.where(F.length("text") >= 5).groupBy("doc_id").agg(F.median(per).alias("per"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    return r.where("size = 14.0").join(m, "doc_id").select("doc_id", "line", "word", F.round(per / F.col("per"), 6).alias("relative"))


@query("""SELECT page_id, (length(html) - length(replace(html, '<a ', ''))) // 3 + (length(html) - length(replace(html, '<img', ''))) // 4 AS attachments FROM pages""")
def src17_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and images of a page: two child tables, counted together."""
    html = load(spark, sf_dir, "pages")
    child = lambda token: html.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(f"({token})"), 1)).alias("t"))
    n = child("<a ").unionByName(child("<img")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return html.select("page_id").join(n, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("attachments"))


@query("""SELECT user_id, count(DISTINCT event_type) AS fields, count(*) AS widgets FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def src18_form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widgets and distinct field names; unknown kinds are dropped."""
    known = load(spark, sf_dir, "events").where("event_type <> 'error'")
    return known.groupBy("user_id").agg(F.countDistinct("event_type").alias("fields"), F.count(F.lit(1)).alias("widgets"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def src19_json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON list read permissively: what can't be read is left out."""
    k = F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"]
    return load(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k IS NOT NULL")


@query("""SELECT p.event_id AS id, count(a.event_id) > 0 AS answered FROM events p LEFT JOIN events a ON a.user_id = p.user_id AND a.event_type = 'purchase' AND a.ts > p.ts AND a.ts <= p.ts + INTERVAL 60 MINUTES WHERE p.event_type = 'click' GROUP BY p.event_id""")
def str5_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (clicks) that a response (purchase) of the same user followed within the time limit: only the nearest
    one has to be looked at, so no pairs are made."""
    e = load(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(1, 60 * 60 * 1_000_000)
    found = e.withColumn("n", F.count(F.when(F.col("event_type") == "purchase", 1)).over(w))
    return found.where("event_type = 'click'").select(F.col("event_id").alias("id"), (F.col("n") > 0).alias("answered"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'rotated 90' WHEN 1 THEN 'extracted' WHEN 2 THEN 'deleted' ELSE 'unknown command' END AS outcome FROM documents""")
def udf3_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of commands, each row answered by the transform that its name is registered for."""
    names = F.array(*[F.lit(n) for n in (*sorted(COMMANDS), "nonsense")])
    order = {n: k for k, n in enumerate(sorted(COMMANDS))}
    pick = F.when(F.col("doc_id") % 4 == 0, order["rotate"]).when(F.col("doc_id") % 4 == 1, order["extract"]).when(F.col("doc_id") % 4 == 2, order["delete"]).otherwise(len(order))
    commands = load(spark, sf_dir, "documents").select("doc_id", F.element_at(names, (pick + 1).cast("int")).alias("command"), F.lit(90).alias("argument"))
    return dispatch(commands).select("doc_id", "outcome")


@query(f"""WITH {RUNS_SQL}, l AS (SELECT doc_id, line, max(x + width) AS r FROM rn GROUP BY 1, 2), m AS (SELECT doc_id, max(r) AS w FROM l GROUP BY doc_id)
SELECT doc_id, line, r < 0.75{D} * w AS short FROM l JOIN m USING (doc_id)""")
def win27_short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end a quarter or more before the widest one: behind them a paragraph's text isn't run on."""
    boxes = _line_boxes(spark, sf_dir)
    widest = boxes.groupBy("doc_id").agg(F.max("right").alias("w"))
    return boxes.join(widest, "doc_id").select("doc_id", "line", (F.col("right") < 0.75 * F.col("w")).alias("short"))


@query(f"""WITH {RUNS_SQL}, b AS (SELECT doc_id, line, word, CASE WHEN y > 728.0{D} OR y < 63.0{D} THEN 1 ELSE 0 END AS edge FROM rn) SELECT doc_id, count(*) FILTER (WHERE edge = 1) AS edge_runs, count(*) AS runs FROM b GROUP BY doc_id""")
def cmp5_edge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in the header and footer bands, which a tagged body would reclaim."""
    edge = (F.col("y") > 728.0) | (F.col("y") < 63.0)
    return runs(spark, sf_dir).groupBy("doc_id").agg(F.count_if(edge).alias("edge_runs"), F.count(F.lit(1)).alias("runs"))


@query(f"""WITH {RUNS_SQL} SELECT doc_id, line, word, greatest(0.01{D}, least(10.0{D}, width / (5.5{D} * length(text)))) AS stretch FROM rn""")
def cmp15_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal stretch that lays a word's nominal width on its recognised box, clamped to 0.01 to 10."""
    stretch = F.greatest(F.lit(0.01), F.least(F.lit(10.0), F.col("width") / (5.5 * F.length("text"))))
    return runs(spark, sf_dir).select("doc_id", "line", "word", stretch.alias("stretch"))


@query()
def cmp20_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection of a whole document's runs as lines, grouped by baseline: lines and characters."""
    ship(spark)
    first = runs(spark, sf_dir).select("doc_id", (F.col("line") * 100_000 + F.col("word")).alias("item"), "x", "y", "size", "text")
    found = L.lines_by_baseline(first, ["doc_id"])
    return found.groupBy("doc_id").agg(F.max("line").alias("lines"), F.sum(F.length("text")).alias("chars"))
