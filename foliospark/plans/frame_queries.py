"""More queries over text runs: coverage, grids, stacks, frames and running heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators.name_tree import destinations
from ..session import load
from ..sources.tables import LINES_SQL, PAGES_SQL, RUNS_SQL, lines, pages, runs
from .layout_queries import _MARKS_SQL, _line_boxes, _marks
from .registry import query

D = "::DOUBLE"


@query(f"""WITH {_MARKS_SQL} SELECT doc_id, line, count(*) AS covered FROM rn JOIN mk USING (doc_id, line)
WHERE (greatest(0.0{D}, least(x + width, mx + mw) - greatest(x, mx)) * greatest(0.0{D}, least(y + 11.0{D}, my + mh) - greatest(y, my))) / (width * 11.0{D}) >= 0.6 GROUP BY 1, 2""")
def jon10_covered_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    share = G.overlap_share(c("x"), c("y"), c("width"), F.lit(11.0), c("mx"), c("my"), c("mw"), c("mh"))
    joined = runs(spark, sf_dir).join(_marks(spark, sf_dir), ["doc_id", "line"]).where(share >= 0.6)
    return joined.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("covered"))


@query(f"""WITH {RUNS_SQL}, e AS (SELECT k, 72.0{D} + 66.0{D} * k AS a, 72.0{D} + 66.0{D} * (k + 1) AS b FROM (SELECT unnest(range(0, 7)) AS k)),
c AS (SELECT doc_id, line, k, sum(greatest(0.0{D}, least(x + width, b) - greatest(x, a))) AS cover FROM rn, e WHERE x + width > a AND x < b GROUP BY 1, 2, 3)
SELECT doc_id, line, count(*) AS filled FROM c WHERE cover >= 0.8{D} * 66.0{D} GROUP BY 1, 2""")
def jon21_covered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid segments of a line that its runs cover to 80 % or more: each run only meets the segments it reaches."""
    first = F.greatest(F.lit(0), F.floor((F.col("x") - 72.0) / 66.0)).cast("int")
    last = F.least(F.lit(6), F.floor((F.col("x") + F.col("width") - 72.0) / 66.0)).cast("int")
    met = runs(spark, sf_dir).where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    a = 72.0 + 66.0 * F.col("k")
    cover = F.sum(G.overlap_length(F.col("x"), F.col("x") + F.col("width"), a, 72.0 + 66.0 * (F.col("k") + 1))).alias("cover")
    found = met.groupBy("doc_id", "line", "k").agg(cover).where(F.col("cover") >= 0.8 * 66.0)
    return found.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("filled"))


@query(f"""WITH {RUNS_SQL}, a AS (SELECT doc_id, line, word, text, lag(text) OVER w AS p, lead(text) OVER w AS n FROM rn WINDOW w AS (PARTITION BY doc_id, line ORDER BY word))
SELECT doc_id, line, word FROM a WHERE regexp_matches(text, '^[0-9]+$') AND (coalesce(p, '') IN ('-', '–', '—', '|') OR coalesce(n, '') IN ('-', '–', '—', '|'))""")
def jon25_attended_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with a dash or bar beside them on the line."""
    w = Window.partitionBy("doc_id", "line").orderBy("word")
    dashes = ["-", "–", "—", "|"]
    beside = F.coalesce(F.lag("text").over(w), F.lit("")).isin(dashes) | F.coalesce(F.lead("text").over(w), F.lit("")).isin(dashes)
    return runs(spark, sf_dir).withColumn("beside", beside).where(F.col("text").rlike("^[0-9]+$") & F.col("beside")).select("doc_id", "line", "word")


@query(f"""WITH {RUNS_SQL}, p AS (SELECT doc_id, regexp_matches(text, '[gjpqyç,;]') AS low, lead(regexp_matches(text, '[gjpqyç,;]')) OVER w AS next_low, length(text) AS n, lead(length(text)) OVER w AS m FROM rn WINDOW w AS (PARTITION BY doc_id, line ORDER BY word))
SELECT doc_id, median(n - m){D} AS shift FROM p WHERE low AND NOT next_low GROUP BY doc_id HAVING count(*) >= 12""")
def agg26_paired_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median difference between a run with descenders and the plain run behind it, for documents with 12 pairs or more."""
    w = Window.partitionBy("doc_id", "line").orderBy("word")
    low = F.col("text").rlike("[gjpqyç,;]")
    p = runs(spark, sf_dir).select("doc_id", low.alias("low"), F.lead(low).over(w).alias("next_low"), (F.length("text") - F.lead(F.length("text")).over(w)).alias("d"))
    found = p.where("low AND NOT next_low").groupBy("doc_id").agg(F.median("d").alias("shift"), F.count(F.lit(1)).alias("n"))
    return found.where("n >= 12").select("doc_id", "shift")


@query(f"""WITH {RUNS_SQL}, r AS (SELECT doc_id, width / (6.0{D} * length(text)) AS ratio, row_number() OVER (PARTITION BY doc_id ORDER BY width / (6.0{D} * length(text))) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM rn WHERE length(text) >= 12)
SELECT doc_id, ratio FROM r WHERE i = n // 2 AND n >= 5""")
def agg29_width_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middle ratio of drawn to nominal width over runs of 12 characters or more, from five runs on."""
    from ..operators.aggregates import floor_quantiles

    some = runs(spark, sf_dir).where(F.length("text") >= 12).select("doc_id", (F.col("width") / (6.0 * F.length("text"))).alias("ratio"))
    enough = some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("doc_id")
    return floor_quantiles(some, "doc_id", "ratio", {"mid": 0.5}).join(enough, "doc_id").select("doc_id", F.col("mid").alias("ratio"))


@query(f"""WITH {LINES_SQL}, f AS (SELECT doc_id, line, text, CASE WHEN text = '' OR line = 1 THEN 1 ELSE 0 END AS b FROM ln), p AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS par FROM f),
h AS (SELECT DISTINCT doc_id, par FROM p WHERE contains(lower(text), 'licens')) SELECT doc_id, line FROM p JOIN h USING (doc_id, par)""")
def win19_paragraph_of_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the paragraphs that hold a hit; paragraphs end at empty lines."""
    from ..operators.layout import islands

    p = islands(lines(spark, sf_dir), ["doc_id"], ["line"], (F.col("text") == "") | (F.col("line") == 1), "par")
    hits = p.where(F.contains(F.lower("text"), F.lit("licens"))).select("doc_id", "par").distinct()
    return p.join(hits, ["doc_id", "par"], "left_semi").select("doc_id", "line")


@query(f"""WITH {RUNS_SQL}, l AS (SELECT doc_id, line, min(y) AS y FROM rn GROUP BY 1, 2), n AS (SELECT doc_id, count(*) AS n, sum(14.85{D}) AS h FROM l GROUP BY doc_id)
SELECT doc_id, CASE WHEN h > 648.0{D} + 0.05{D} AND (h - 648.0{D}) <= 0.1{D} * h THEN 648.0{D} / h ELSE 1.0{D} END AS scale FROM n""")
def win29_fit_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale of the leadings that fits a page's lines in its column, where they overrun by a tenth at most."""
    h = _line_boxes(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.lit(14.85)).alias("h"))
    over = (F.col("h") > 648.0 + 0.05) & (F.col("h") - 648.0 <= 0.1 * F.col("h"))
    return h.select("doc_id", F.when(over, 648.0 / F.col("h")).otherwise(1.0).alias("scale"))


@query(f"""SELECT doc_id, (500 * length(text) - 222 * (length(text) - length(replace(text, 'i', ''))) - 222 * (length(text) - length(replace(text, 'l', ''))) + 278 * (length(text) - length(replace(text, 'm', '')))){D} / 1000.0{D} * 11.0{D} AS width FROM documents""")
def scl14_text_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of a text from a table of glyph widths with a default (here three glyphs that differ from it)."""
    # Widths in thousandths of the size.
    widths, default = {"i": 278, "l": 278, "m": 778}, 500
    n = lambda s: F.length("text") - F.length(F.replace("text", F.lit(s), F.lit("")))
    units = F.length("text") * default
    for glyph, w in widths.items():
        units = units + (w - default) * n(glyph)
    return load(spark, sf_dir, "documents").select("doc_id", (units / 1000.0 * 11.0).alias("width"))


@query(f"WITH {RUNS_SQL} SELECT doc_id, line, word, round(x * cos(0.5{D}) + y * sin(0.5{D}), 6) AS along, round(y * cos(0.5{D}) - x * sin(0.5{D}), 6) AS across FROM rn")
def scl39_turned_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.cos(F.lit(0.5)), F.sin(F.lit(0.5))
    along, across = F.col("x") * c + F.col("y") * s, F.col("y") * c - F.col("x") * s
    return runs(spark, sf_dir).select("doc_id", "line", "word", F.round(along, 6).alias("along"), F.round(across, 6).alias("across"))


@query(f"WITH {RUNS_SQL} SELECT doc_id, line, word, floor((x - 9.0{D}) * 200.0{D} / 72.0{D} + 0.5)::BIGINT AS px, floor((792.0{D} - (y - 9.0{D})) * 200.0{D} / 72.0{D} + 0.5)::BIGINT AS py FROM rn")
def scl40_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs shifted by the page's origin and scaled to 200 dpi, rows counted from the top."""
    from ..functions.text import half_up

    px, py = half_up((F.col("x") - 9.0) * 200.0 / 72.0), half_up((792.0 - (F.col("y") - 9.0)) * 200.0 / 72.0)
    return runs(spark, sf_dir).select("doc_id", "line", "word", px.alias("px"), py.alias("py"))


@query(f"""SELECT doc_id, round(306.0{D} - 0.5{D} * w * cos(0.785398163397448{D}), 6) AS x, round(396.0{D} - 0.5{D} * w * sin(0.785398163397448{D}), 6) AS y FROM (SELECT doc_id, length(source){D} * 36.0{D} AS w FROM documents)""")
def scl41_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a diagonal watermark has to start to lie in the middle of a letter page."""
    w, turn = F.length("source") * 36.0, 0.785398163397448
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.round(306.0 - 0.5 * w * F.cos(F.lit(turn)), 6).alias("x"), F.round(396.0 - 0.5 * w * F.sin(F.lit(turn)), 6).alias("y")
    )


@query(f"""WITH {LINES_SQL} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(text, '(?i)electronically\\s*filed|e-?filed|clerk\\s+of\\s+the\\s+court|licensed under')) > 0 AND count(*) >= 3 AS stamped FROM ln GROUP BY doc_id""")
def cmp4_stamp_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three lines or more with words of a filing stamp."""
    word = F.col("text").rlike(r"(?i)electronically\s*filed|e-?filed|clerk\s+of\s+the\s+court|licensed under")
    return lines(spark, sf_dir).groupBy("doc_id").agg(((F.count_if(word) > 0) & (F.count(F.lit(1)) >= 3)).alias("stamped"))


@query(f"""WITH {PAGES_SQL}, f AS (SELECT doc, page, string_split(text, chr(10))[1] AS head FROM pg), c AS (SELECT doc, min(head) AS any_head, count(DISTINCT head) AS heads, max(CASE WHEN page = 1 THEN head END) AS first_head FROM f GROUP BY doc)
SELECT doc, heads = 1 AS same_on_all, first_head <> any_head AS first_differs FROM c""")
def cmp9_running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.split("text", "\n"), 1)
    f = pages(spark, sf_dir).withColumn("head", head).groupBy("doc").agg(
        F.min("head").alias("any_head"), F.countDistinct("head").alias("heads"), F.max(F.when(F.col("page") == 1, F.col("head"))).alias("first_head")
    )
    return f.select("doc", (F.col("heads") == 1).alias("same_on_all"), (F.col("first_head") != F.col("any_head")).alias("first_differs"))


@query(f"WITH {PAGES_SQL} SELECT doc, page, page % 3 = 0 AS blank FROM pg")
def cmp11_numbered_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers without a line become numbered blanks: every third page is missing and comes back as one."""
    every = pages(spark, sf_dir).select("doc", "page")
    present = every.where("page % 3 <> 0").withColumn("there", F.lit(True))
    grid = every.groupBy("doc").agg(F.max("page").alias("m")).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("page"))
    return grid.join(present, ["doc", "page"], "left").select("doc", "page", F.col("there").isNull().alias("blank"))


@query("""SELECT o_orderkey AS dest, coalesce(l_linenumber, 1) AS page FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def cmp18_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named destinations resolved to a page, page 1 where the name leads nowhere."""
    target = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("dest")).agg(F.min("l_linenumber").alias("p"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dest")).join(target, "dest", "left").select("dest", F.coalesce("p", F.lit(1)).alias("page"))


# A name tree: regions, nations, customers and each customer's orders one below the other; some customers hang in a cycle.
_TREE_SQL = """k AS (SELECT 'root' AS node, r_regionkey AS ordinal, 'r' || r_regionkey AS kid FROM region UNION ALL SELECT 'r' || n_regionkey, n_nationkey, 'n' || n_nationkey FROM nation
  UNION ALL SELECT CASE WHEN c_custkey % 50 = 7 THEN 'c' || c_custkey ELSE 'n' || c_nationkey END, c_custkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT CASE WHEN i = 1 THEN 'c' || c ELSE 'o' || p END, o, 'o' || o FROM od),
nm AS (SELECT 'o' || o AS node, 0 AS place, 'order ' || (o % 9000) AS name, o AS target FROM od)"""


@query(f"""WITH RECURSIVE od AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER w AS i, lag(o_orderkey) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), {_TREE_SQL},
t(node, depth, path) AS (SELECT 'root', 0, []::BIGINT[] UNION ALL SELECT kid, depth + 1, list_append(path, ordinal) FROM t JOIN k USING (node) WHERE depth < 32),
f AS (SELECT name, target FROM nm JOIN t USING (node) QUALIFY row_number() OVER (PARTITION BY name ORDER BY path, place, target) = 1),
pg AS (SELECT l_orderkey AS target, min(l_linenumber) AS page FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS item, 'order ' || o_orderkey AS name, coalesce(page, 1) AS page FROM orders LEFT JOIN f ON f.name = 'order ' || o_orderkey LEFT JOIN pg USING (target)""")
def cmp18_name_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each order's name: looked up in a tree that is as deep as a customer has orders, with cycles and repeated names."""
    c = F.col
    label = lambda sign, col: F.concat(F.lit(sign), c(col).cast("string"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("before"))
    kid = lambda df, node, ordinal, kid: df.select(F.lit(0).alias("doc"), node.alias("node"), c(ordinal).cast("long").alias("ordinal"), kid.alias("kid"))
    kids = kid(load(spark, sf_dir, "region"), F.lit("root"), "r_regionkey", label("r", "r_regionkey"))
    kids = kids.unionByName(kid(load(spark, sf_dir, "nation"), label("r", "n_regionkey"), "n_nationkey", label("n", "n_nationkey")))
    own = F.when(c("c_custkey") % 50 == 7, label("c", "c_custkey")).otherwise(label("n", "c_nationkey"))
    kids = kids.unionByName(kid(load(spark, sf_dir, "customer"), own, "c_custkey", label("c", "c_custkey")))
    kids = kids.unionByName(kid(orders, F.when(c("before").isNull(), label("c", "o_custkey")).otherwise(label("o", "before")), "o_orderkey", label("o", "o_orderkey")))
    named = orders.select(
        F.lit(0).alias("doc"), label("o", "o_orderkey").alias("node"), F.lit(0).alias("ordinal"),
        F.concat(F.lit("order "), (c("o_orderkey") % 9000).cast("string")).alias("name"), c("o_orderkey").alias("target"),
    )
    pages = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.lit(0).alias("doc"), c("l_orderkey").alias("target")).agg(F.min("l_linenumber").alias("page"))
    roots = spark.range(1).select(F.lit(0).alias("doc"), F.lit("root").alias("node"))
    items = load(spark, sf_dir, "orders").select(F.lit(0).alias("doc"), c("o_orderkey").alias("item"), label("order ", "o_orderkey").alias("name"))
    return destinations(items, named, kids, roots, pages, ["doc"]).select("item", "name", "page")
