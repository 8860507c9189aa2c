"""Queries of spatial joins, ordered folds and layout aggregates over text runs derived from `documents`.

`events`, `orders` and `lineitem` carry operators that only need numbers in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import geometry as G
from ..operators import layout as L
from ..operators.bigrams import shared_bigrams
from ..session import load, ship
from ..sources.tables import LINES_SQL, PAGES_SQL, RUNS_SQL, lines, pages, runs
from .registry import query

D = "::DOUBLE"

# A mark: the box from the third to the fifth word of a line, padded by 2 points.
_MARKS_SQL = (
    f"{RUNS_SQL}, mk AS (SELECT doc_id, line, min(x) - 2.0{D} AS mx, max(x + width) - min(x) + 4.0{D} AS mw, min(y) - 2.0{D} AS my, 15.0{D} AS mh "
    "FROM rn WHERE word BETWEEN 3 AND 5 GROUP BY doc_id, line)"
)


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = runs(spark, sf_dir).where("word BETWEEN 3 AND 5")
    return some.groupBy("doc_id", "line").agg(
        (F.min("x") - 2.0).alias("mx"), (F.max(F.col("x") + F.col("width")) - F.min("x") + 4.0).alias("mw"), (F.min("y") - 2.0).alias("my"), F.lit(15.0).alias("mh")
    )


@query(f"""WITH {_MARKS_SQL} SELECT doc_id, line, count(*) AS covered FROM rn JOIN mk USING (doc_id, line)
WHERE (greatest(0.0{D}, least(x + width, mx + mw) - greatest(x, mx)) * greatest(0.0{D}, least(y + 11.0{D}, my + mh) - greatest(y, my))) / (width * 11.0{D}) >= 0.5 GROUP BY 1, 2""")
def jon9_marked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of which half or more lies under a mark: an equi-join by line with the overlap as residual condition."""
    c = F.col
    share = G.overlap_share(c("x"), c("y"), c("width"), F.lit(11.0), c("mx"), c("my"), c("mw"), c("mh"))
    joined = runs(spark, sf_dir).join(_marks(spark, sf_dir), ["doc_id", "line"]).where(share >= 0.5)
    return joined.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("covered"))


@query(f"""WITH {_MARKS_SQL} SELECT doc_id, line, word FROM rn JOIN mk USING (doc_id, line)
WHERE (x + width / 2) >= mx AND (x + width / 2) <= mx + mw AND (y + 5.5{D}) >= my AND (y + 5.5{D}) <= my + mh""")
def jon11_centres_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    inside = G.contains(c("x") + c("width") / 2, c("y") + 5.5, c("mx"), c("my"), c("mw"), c("mh"))
    return runs(spark, sf_dir).join(_marks(spark, sf_dir), ["doc_id", "line"]).where(inside).select("doc_id", "line", "word")


@query("""WITH s AS (SELECT user_id, event_id, ts, event_type, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM events)
SELECT event_id, (SELECT max_by(e.event_id, (e.ts, e.event_id)) FROM events e WHERE e.user_id = s.user_id AND e.event_type = 'signup' AND (e.ts, e.event_id) <= (s.ts, s.event_id)) AS last_start FROM s""")
def jon6_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row takes the last starting row at or before it: both sides in one window, last non-null value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return load(spark, sf_dir, "events").select("event_id", F.last(start, ignorenulls=True).over(w).alias("last_start"))


@query(f"""WITH {RUNS_SQL}, l AS (SELECT doc_id, line, word AS c, x + width / 2 AS cx FROM rn WHERE word % 5 = 0),
k AS (SELECT a.doc_id, a.line, a.word, b.c, abs(a.x - b.cx) AS d, row_number() OVER (PARTITION BY a.doc_id, a.line, a.word ORDER BY abs(a.x - b.cx), b.c) AS r
FROM rn a JOIN l b ON a.doc_id = b.doc_id AND a.line = b.line AND abs(a.word - b.c) <= 5) SELECT doc_id, line, word, c AS nearest, d AS distance FROM k WHERE r = 1 AND d <= 60.0{D}""")
def jon7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest column mark (every fifth run) on the line, none beyond 60 points; the earlier of equal ones.

    Only marks up to five runs away count: each run looks at the one before it, its own and the one behind it in a window of its
    line, and no run is exchanged.
    """
    c = F.col
    in_line = Window.partitionBy("doc_id", "line").orderBy("word")
    mark = F.when(c("word") % 5 == 0, F.struct(c("word").alias("c"), (c("x") + c("width") / 2).alias("cx")))
    within = lambda low, high: F.max(c("m")).over(in_line.rangeBetween(low, high))  # noqa: E731  (five runs in a row hold one mark)
    looked = runs(spark, sf_dir).select("doc_id", "line", "word", "x", mark.alias("m")).withColumn("before", within(-5, -1)).withColumn("behind", within(1, 5))
    marks = F.filter(F.array("before", "m", "behind"), lambda m: m.isNotNull())
    best = looked.withColumn("b", F.array_min(F.transform(marks, lambda m: F.struct(F.abs(c("x") - m["cx"]).alias("d"), m["c"].alias("c"))))).where("b.d <= 60.0")
    return best.select("doc_id", "line", "word", F.col("b.c").alias("nearest"), F.col("b.d").alias("distance"))


@query(f"""WITH {RUNS_SQL}, m AS (SELECT doc_id, line, 10 AS a, 30 AS b FROM ln), s AS (SELECT doc_id, line, word, off, off + length(text) AS e FROM wo WHERE text <> '')
SELECT doc_id, line, count(*) AS spans, min(greatest(off, a))::BIGINT AS first, max(least(e, b))::BIGINT AS last FROM s JOIN m USING (doc_id, line) WHERE e > a AND off < b GROUP BY 1, 2""")
def jon13_span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run spans that meet the match at characters 10..30 of each line."""
    off = F.round((F.col("x") - 72.0) / 6.6).cast("long")
    s = runs(spark, sf_dir).select("doc_id", "line", off.alias("o"), (off + F.length("text")).alias("e")).where("e > 10 AND o < 30")
    return s.groupBy("doc_id", "line").agg(
        F.count(F.lit(1)).alias("spans"), F.min(F.greatest("o", F.lit(10).cast("long"))).alias("first"), F.max(F.least("e", F.lit(30).cast("long"))).alias("last")
    )


@query(f"""WITH {PAGES_SQL}, p AS (SELECT doc, page, doc_id, CASE WHEN doc_id % 3 <> 1 THEN doc_id END AS printed FROM pg)
SELECT doc, page, coalesce(printed - lag(printed) OVER w = 20 OR lead(printed) OVER w - printed = 20, false) AS continues FROM p WINDOW w AS (PARTITION BY doc ORDER BY page)""")
def jon14_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's number goes on from a page beside it (steps of 20, the distance of ids within a source)."""
    p = pages(spark, sf_dir).withColumn("printed", F.when(F.col("doc_id") % 3 != 1, F.col("doc_id")))
    w = Window.partitionBy("doc").orderBy("page")
    go_on = (F.col("printed") - F.lag("printed").over(w) == 20) | (F.lead("printed").over(w) - F.col("printed") == 20)
    return p.select("doc", "page", F.coalesce(go_on, F.lit(False)).alias("continues"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber AS i, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p FROM lineitem)
SELECT a.l_orderkey, median((b.p - a.p) / (b.q - a.q)) AS slope FROM a JOIN a b ON a.l_orderkey = b.l_orderkey AND a.i < b.i AND a.q <> b.q GROUP BY 1""")
def jon15_theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the slopes of all pairs of points of an order (at most 7 points, so 21 pairs)."""
    a = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    points = a.groupBy("l_orderkey").agg(F.collect_list(F.struct("i", "q", "p")).alias("s"))
    b = points.select("l_orderkey", F.explode("s").alias("a"), "s").select("l_orderkey", "a", F.explode("s").alias("b")).where("a.i < b.i AND a.q <> b.q")
    return b.groupBy("l_orderkey").agg(F.median((F.col("b.p") - F.col("a.p")) / (F.col("b.q") - F.col("a.q"))).alias("slope"))


@query(f"""WITH {RUNS_SQL}, h AS (SELECT DISTINCT doc_id, line, 40.0{D} + y AS ry FROM rn WHERE word = 1 AND line % 3 = 0)
SELECT doc_id, line, count(*) AS n FROM rn WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = rn.doc_id AND h.line = rn.line) GROUP BY 1, 2""")
def jon22_not_ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs on lines without a rule (anti join by line)."""
    r = runs(spark, sf_dir)
    ruled = r.where("word = 1 AND line % 3 = 0").select("doc_id", "line").distinct()
    return r.join(ruled, ["doc_id", "line"], "left_anti").groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_MARKS_SQL}, k AS (SELECT doc_id, line, word, sqrt(power(greatest(0.0{D}, mx - (x + width), x - (mx + mw)), 2) + power(greatest(0.0{D}, my - (y + 11.0{D}), y - (my + mh)), 2)) AS d,
row_number() OVER (PARTITION BY doc_id, line ORDER BY greatest(0.0{D}, mx - (x + width), x - (mx + mw)) DESC, word) AS r FROM rn JOIN mk USING (doc_id, line)) SELECT doc_id, line, word AS farthest, d FROM k WHERE r = 1""")
def jon24_rect_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangle-to-rectangle distance: the run of a line that is farthest from its mark."""
    c = F.col
    d = G.gap(c("x"), c("y"), c("width"), F.lit(11.0), c("mx"), c("my"), c("mw"), c("mh"))
    joined = runs(spark, sf_dir).join(_marks(spark, sf_dir), ["doc_id", "line"]).withColumn("d", d)
    best = joined.groupBy("doc_id", "line").agg(F.max_by(F.struct("word", "d"), F.struct("d", (-c("word")).alias("w"))).alias("b"))
    return best.select("doc_id", "line", F.col("b.word").alias("farthest"), F.col("b.d").alias("d"))


@query(f"""WITH {RUNS_SQL}, s AS (SELECT doc_id, y, sum(length(text)) AS w FROM rn GROUP BY 1, 2),
c AS (SELECT doc_id, y, sum(w) OVER (PARTITION BY doc_id ORDER BY y) AS u, sum(w) OVER (PARTITION BY doc_id) AS t FROM s) SELECT doc_id, min(y) AS y FROM c WHERE 2 * u >= t GROUP BY doc_id""")
def agg5_weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.weighted_median(runs(spark, sf_dir).withColumn("chars", F.length("text")), "doc_id", "y", "chars")


@query("""WITH n AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2)
SELECT source, lang AS majority FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS k FROM n) WHERE k = 1""")
def agg7_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), (-F.min("doc_id")).alias("f"))
    return n.groupBy("source").agg(F.max_by("lang", F.struct("n", "f")).alias("majority"))


@query(f"""WITH {RUNS_SQL}, s AS (SELECT doc_id, size, sum(length(text)) AS w FROM rn GROUP BY 1, 2), t AS (SELECT *, sum(w) OVER (PARTITION BY doc_id) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, size) AS k FROM s)
SELECT doc_id, size, w{D} / a{D} AS share FROM t WHERE k = 1""")
def agg8_dominant_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.weighted_mode(runs(spark, sf_dir).withColumn("chars", F.length("text")), "doc_id", "size", "chars")


@query(f"WITH {RUNS_SQL} SELECT doc_id, min(x) AS x0, max(x + width) AS x1, min(y) AS y0, max(y) + 11.0{D} AS y1 FROM rn GROUP BY doc_id")
def agg12_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("doc_id").agg(
        F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 11.0).alias("y1")
    )


@query(f"""WITH {RUNS_SQL}, e AS (SELECT doc_id, line, max(x + width) AS r FROM rn GROUP BY 1, 2), k AS (SELECT doc_id, r, row_number() OVER (PARTITION BY doc_id ORDER BY r DESC) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM e)
SELECT doc_id, max(r) AS right_edge FROM k WHERE i = floor(0.03 * n) GROUP BY doc_id""")
def agg13_trimmed_right_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right edge after dropping the outermost 3 % of the lines."""
    edges = runs(spark, sf_dir).groupBy("doc_id", "line").agg((-F.max(F.col("x") + F.col("width"))).alias("r"))
    return A.floor_quantiles(edges, "doc_id", "r", {"q": 0.03}).select("doc_id", (-F.col("q")).alias("right_edge"))


@query(f"WITH {RUNS_SQL} SELECT doc_id, count(DISTINCT round(y)) AS baselines, count(DISTINCT text) AS words FROM rn GROUP BY doc_id")
def agg16_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("doc_id").agg(F.countDistinct(F.round("y")).alias("baselines"), F.countDistinct("text").alias("words"))


@query(f"WITH {_MARKS_SQL} SELECT doc_id, count(*) AS marks, min(mx) AS left_most, sum(mw) AS covered FROM mk GROUP BY doc_id")
def agg19_marks_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("marks"), F.min("mx").alias("left_most"), F.sum("mw").alias("covered"))


@query("""WITH h AS (SELECT l_returnflag AS g, (floor(l_extendedprice::DOUBLE) % 256)::BIGINT AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT g, b, sum(n) OVER w AS w0, sum(b * n) OVER w AS s0, sum(n) OVER (PARTITION BY g) AS n, sum(b * n) OVER (PARTITION BY g) AS s FROM h WINDOW w AS (PARTITION BY g ORDER BY b)),
v AS (SELECT g, b, w0::DOUBLE * (n - w0)::DOUBLE * (s0::DOUBLE / w0::DOUBLE - (s - s0)::DOUBLE / (n - w0)::DOUBLE) * (s0::DOUBLE / w0::DOUBLE - (s - s0)::DOUBLE / (n - w0)::DOUBLE) AS v FROM c WHERE w0 < n)
SELECT g, b AS threshold FROM (SELECT g, b, row_number() OVER (PARTITION BY g ORDER BY v DESC, b) AS k FROM v) WHERE k = 1""")
def agg21_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Otsu's threshold of a 256-bucket histogram; the prices' low bytes stand for grey values."""
    bucket = F.pmod(F.floor(F.col("l_extendedprice").cast("double")), F.lit(256)).cast("long")
    h = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return A.otsu(h, "g", "b", "n")


@query("""WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark), v AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark)
SELECT item_id, w, 'missing' AS side FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM v) UNION ALL SELECT item_id, w, 'extra' FROM (SELECT * FROM v EXCEPT ALL SELECT * FROM w)""")
def agg24_multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the texts and of their lower-cased copies, both ways."""
    b = load(spark, sf_dir, "benchmark")
    w = b.select("item_id", F.explode(F.split("text", " ")).alias("w"))
    v = b.select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("w"))
    return w.exceptAll(v).withColumn("side", F.lit("missing")).unionByName(v.exceptAll(w).withColumn("side", F.lit("extra")))


@query("""WITH f AS (SELECT doc_id, source AS doc, string_split(lower(text), '') AS c FROM documents WHERE length(text) > 1),
b AS (SELECT doc, doc_id, unnest(list_distinct(list_transform(list_zip(c[:-2], c[2:]), lambda x: x[1] || x[2]))) AS g FROM f),
n AS (SELECT doc, g, count(*) AS n FROM b GROUP BY 1, 2) SELECT doc_id, sum(n - 1)::BIGINT AS shared FROM b JOIN n USING (doc, g) GROUP BY doc_id""")
def agg25_bigram_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bigrams a page's text shares with the other pages of its document, summed over them: through the
    bigrams' counts, without pairing the pages."""
    ship(spark)
    docs = load(spark, sf_dir, "documents").where(F.length("text") > 1)
    found = shared_bigrams(docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.lower("text").alias("text")))
    return found.withColumnRenamed("page", "doc_id")


@query(f"""WITH {PAGES_SQL}, p AS (SELECT doc, page, CASE WHEN length(text) > 300 THEN doc_id END AS k FROM pg), d AS (SELECT doc, k - lag(k) OVER (PARTITION BY doc ORDER BY page) AS step FROM p WHERE k IS NOT NULL)
SELECT doc, coalesce(bool_and(step > 0), true) AS counts_up, count(DISTINCT step) AS steps FROM d GROUP BY doc""")
def agg31_counts_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the known page numbers of a document rise, and by how many different steps."""
    known = pages(spark, sf_dir).where("length(text) > 300")
    step = F.col("doc_id") - F.lag("doc_id").over(Window.partitionBy("doc").orderBy("page"))
    return known.withColumn("step", step).groupBy("doc").agg(F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)).alias("counts_up"), F.countDistinct("step").alias("steps"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS v, CASE WHEN l_extendedprice::DOUBLE - lag(l_extendedprice::DOUBLE) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) > 5000 THEN 1 ELSE 0 END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, (sum(b) OVER (PARTITION BY l_orderkey ORDER BY v) + 1)::BIGINT AS cluster FROM f""")
def win8_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("v"))
    return L.clusters(items, ["l_orderkey"], "v", 5000.0).select("l_orderkey", "l_linenumber", "cluster")


@query("""WITH f AS (SELECT user_id, event_id, value, coalesce(value <= lag(value) OVER (PARTITION BY user_id ORDER BY event_id), true) AS b FROM events),
s AS (SELECT *, sum(b::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stack FROM f) SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM s GROUP BY user_id, stack HAVING count(*) >= 4""")
def win9_ascending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.ascending_runs(load(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 4)
    return found.groupBy("user_id", "stack").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n")).drop("stack")


@query("""WITH i AS (SELECT l_orderkey AS k, l_quantity::DOUBLE AS a, l_quantity::DOUBLE + l_linenumber::DOUBLE AS b FROM lineitem),
f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 1 ELSE 0 END AS n FROM i),
g AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY a, b, n DESC ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT k, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY k, s""")
def win10_merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    i = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), q.alias("a"), (q + F.col("l_linenumber").cast("double")).alias("b"))
    return L.merged_intervals(i, ["k"], "a", "b", 2.0)


@query()
def win11_kept_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab stops of an order: quantities, each more than 4 above the last kept one."""
    stops = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("s"))
    return stops.select("l_orderkey", F.array_join(F.transform(L.kept_stops(F.col("s")), lambda x: x.cast("int").cast("string")), ",").alias("stops"))


@query(f"""WITH {RUNS_SQL}, l AS (SELECT doc_id, line, min(y) AS y, max(size) AS size FROM rn GROUP BY 1, 2), g AS (SELECT *, lag(y) OVER (PARTITION BY doc_id ORDER BY y DESC) - y AS gap FROM l)
SELECT doc_id, coalesce(median(CASE WHEN gap > 0 AND gap <= 3 * size THEN gap END), 1.2{D} * median(size)) AS leading FROM g GROUP BY doc_id""")
def win15_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.leading(_line_boxes(spark, sf_dir), ["doc_id"])


def _line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("doc_id", "line").agg(
        F.min("y").alias("y"), F.max("size").alias("size"), F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right")
    )


@query(f"""WITH {RUNS_SQL}, l AS (SELECT doc_id, line, min(y) AS y, max(size) AS size FROM rn GROUP BY 1, 2), o AS (SELECT l.*, regexp_matches(ln.text, '^(Q[.:]|A[.:]|[0-9]{{1,3}}[.)] |[-–—] )') AS opens FROM l JOIN ln USING (doc_id, line)),
f AS (SELECT *, CASE WHEN coalesce(lag(y) OVER w - y > 1.6{D} * 14.85{D} OR abs(lag(size) OVER w - size) > 1 OR opens, lag(y) OVER w IS NULL) THEN 1 ELSE 0 END AS b FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY y DESC))
SELECT doc_id, line, (sum(b) OVER (PARTITION BY doc_id ORDER BY y DESC) + CASE WHEN first_value(b) OVER (PARTITION BY doc_id ORDER BY y DESC) = 1 THEN 0 ELSE 1 END)::BIGINT AS paragraph FROM f""")
def win14_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    opens = lines(spark, sf_dir).select("doc_id", "line", F.col("text").rlike("^(Q[.:]|A[.:]|[0-9]{1,3}[.)] |[-–—] )").alias("opens"))
    boxes = _line_boxes(spark, sf_dir).join(opens, ["doc_id", "line"]).withColumn("leading", F.lit(14.85))
    return L.paragraphs(boxes, ["doc_id"]).select("doc_id", "line", "paragraph")


@query(f"""WITH {RUNS_SQL}, g AS (SELECT doc_id, line, word, x, size, max(x + width) OVER (PARTITION BY doc_id, line ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rn),
f AS (SELECT *, CASE WHEN reach IS NULL OR x - reach > 0.7{D} * size THEN 1 ELSE 0 END AS b FROM g) SELECT doc_id, line, sum(b)::BIGINT AS cells FROM f GROUP BY 1, 2""")
def win18_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each line, with a threshold low enough for double blanks."""
    return L.cells(runs(spark, sf_dir), ["doc_id", "line"], 0.7).groupBy("doc_id", "line").agg(F.max("cell").alias("cells"))


@query(f"""WITH {RUNS_SQL}, l AS (SELECT doc_id, line, max(x + width) AS r FROM rn GROUP BY 1, 2), f AS (SELECT doc_id, line, 6.6{D} * length(text){D} AS w FROM rn WHERE word = 1)
SELECT doc_id, min(p + 3.3{D} + 0.94{D} * w) AS ceiling FROM (SELECT l.doc_id, lag(r) OVER (PARTITION BY l.doc_id ORDER BY l.line) AS p, w FROM l LEFT JOIN f USING (doc_id, line)) GROUP BY doc_id HAVING min(p + 3.3{D} + 0.94{D} * w) IS NOT NULL""")
def win28_wrap_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No line can be wider than the one before it with the first word of the next one."""
    r = runs(spark, sf_dir)
    first = r.where("word = 1").select("doc_id", "line", F.col("width").alias("w"))
    p = F.lag("right").over(Window.partitionBy("doc_id").orderBy("line"))
    joined = _line_boxes(spark, sf_dir).join(first, ["doc_id", "line"], "left").withColumn("p", p)
    return joined.groupBy("doc_id").agg(F.min(F.col("p") + 3.3 + 0.94 * F.col("w")).alias("ceiling")).where("ceiling IS NOT NULL")


@query(f"""WITH {RUNS_SQL} SELECT doc_id, line, word, row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, x, line, word) AS place FROM rn""")
def srt1_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc("y"), "x", "line", "word")
    return runs(spark, sf_dir).select("doc_id", "line", "word", F.row_number().over(w).cast("long").alias("place"))


@query(f"""WITH {RUNS_SQL}, g AS (SELECT doc_id, share, 72.0{D} + 468.0{D} * share AS gx FROM (SELECT DISTINCT doc_id FROM rn), (VALUES (1, 0.5{D}), (2, 0.45{D}), (3, 0.55{D}), (4, 0.4{D}), (5, 0.6{D})) AS v(prio, share)),
c AS (SELECT g.doc_id, share, count(*) FILTER (WHERE x < gx AND x + width > gx) AS crossing, count(*) AS n FROM rn JOIN g USING (doc_id) GROUP BY 1, 2),
k AS (SELECT doc_id, share, row_number() OVER (PARTITION BY doc_id ORDER BY CASE share WHEN 0.5{D} THEN 1 WHEN 0.45{D} THEN 2 WHEN 0.55{D} THEN 3 WHEN 0.4{D} THEN 4 ELSE 5 END) AS r FROM c WHERE crossing * 20 <= n) SELECT doc_id, share AS gutter FROM k WHERE r = 1""")
def srt2_gutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gutter that at most 5 % of a document's runs cross: five conditional counts in one pass."""
    shares = [0.5, 0.45, 0.55, 0.4, 0.6]
    r = runs(spark, sf_dir)
    crossing = [F.count_if((F.col("x") < 72.0 + 468.0 * s) & (F.col("x") + F.col("width") > 72.0 + 468.0 * s)).alias(f"c{k}") for k, s in enumerate(shares)]
    counts = r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *crossing)
    first = F.coalesce(*[F.when(F.col(f"c{k}") * 20 <= F.col("n"), F.lit(s)) for k, s in enumerate(shares)])
    return counts.select("doc_id", first.alias("gutter")).where("gutter IS NOT NULL")


@query(f"""WITH {RUNS_SQL}, s AS (SELECT doc_id, word, line, abs(length(text) - 4) + abs(x - 300.0{D}) / 100.0{D} AS score FROM rn), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, line, word) AS r FROM s)
SELECT a.doc_id, a.line, a.word, coalesce(b.score - a.score, 1e9{D}) AS margin FROM k a LEFT JOIN k b ON a.doc_id = b.doc_id AND b.r = 2 WHERE a.r = 1""")
def srt5_best_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scored run of each page and how far the runner-up is behind."""
    score = F.abs(F.length("text") - 4) + F.abs(F.col("x") - 300.0) / 100.0
    w = Window.partitionBy("doc_id").orderBy("score", "line", "word")
    s = runs(spark, sf_dir).withColumn("score", score).withColumn("r", F.row_number().over(w)).where("r <= 2")
    best = lambda c: F.max(F.when(F.col("r") == 1, F.col(c))).alias(c)
    margin = F.max(F.when(F.col("r") == 2, F.col("score"))) - F.max(F.when(F.col("r") == 1, F.col("score")))
    return s.groupBy("doc_id").agg(best("line"), best("word"), F.coalesce(margin, F.lit(1e9)).alias("margin"))


@query(f"""WITH {RUNS_SQL} SELECT doc_id, line, word, CASE doc_id % 4 WHEN 1 THEN y WHEN 2 THEN 612.0{D} - x WHEN 3 THEN 792.0{D} - y ELSE x END AS dx, CASE doc_id % 4 WHEN 1 THEN 612.0{D} - x WHEN 2 THEN 792.0{D} - y WHEN 3 THEN x ELSE y END AS dy FROM rn""")
def scl25_display_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.to_display(F.col("x"), F.col("y"), F.lit(612.0), F.lit(792.0), F.col("doc_id") % 4 * 90)
    return runs(spark, sf_dir).withColumn("p", p).select("doc_id", "line", "word", F.col("p.x").alias("dx"), F.col("p.y").alias("dy"))


@query(f"WITH {RUNS_SQL} SELECT doc_id, line, word, 0.5{D} * x + 0.0{D} * y + 10.0{D} AS tx, 0.0{D} * x + 2.0{D} * y + 5.0{D} AS ty FROM rn")
def scl26_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = [F.lit(v) for v in (0.5, 0.0, 0.0, 2.0, 0.0, 0.0)]
    move = [F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 10.0, 5.0)]
    p = G.apply_matrix(G.multiply(move, scale), F.col("x"), F.col("y"))
    return runs(spark, sf_dir).withColumn("p", p).select("doc_id", "line", "word", F.col("p.x").alias("tx"), F.col("p.y").alias("ty"))


@query(f"WITH {_MARKS_SQL} SELECT doc_id, line, greatest(0.0{D}, least(mx, 612.0{D} - mw)) AS x, greatest(0.0{D}, least(my, 792.0{D} - mh)) AS y FROM mk")
def scl27_shift_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _marks(spark, sf_dir).select("doc_id", "line", G.shift_inside(c("mx"), c("mw"), F.lit(612.0)).alias("x"), G.shift_inside(c("my"), c("mh"), F.lit(792.0)).alias("y"))


@query(f"WITH {RUNS_SQL} SELECT doc_id, line, word, x + width / length(text) * 1 AS rx, width / length(text) * (least(3, length(text)) - 1) AS rw FROM rn")
def scl38_range_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = G.range_box(F.col("x"), F.col("width"), F.length("text"), F.lit(1), F.least(F.lit(3), F.length("text")))
    return runs(spark, sf_dir).withColumn("b", box).select("doc_id", "line", "word", F.col("b.x").alias("rx"), F.col("b.width").alias("rw"))


@query(f"""WITH {RUNS_SQL}, l AS (SELECT doc_id, line, min(x) AS x, max(x + width) AS r FROM rn GROUP BY 1, 2) SELECT doc_id,
CASE WHEN max(x) - min(x) <= 0.5 AND max(r) - min(r) <= 0.5 THEN 'justify' WHEN max(x) - min(x) <= 0.5 THEN 'left' WHEN max(r) - min(r) <= 0.5 THEN 'right' WHEN max(x + r) - min(x + r) <= 1 THEN 'center' ELSE 'left' END AS align FROM l GROUP BY doc_id""")
def scl16_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = lambda c: F.max(c) - F.min(c)
    x, r = F.col("x"), F.col("right")
    align = F.when((spread(x) <= 0.5) & (spread(r) <= 0.5), "justify").when(spread(x) <= 0.5, "left").when(spread(r) <= 0.5, "right")
    return _line_boxes(spark, sf_dir).groupBy("doc_id").agg(align.when(spread(x + r) <= 1, "center").otherwise("left").alias("align"))


@query(f"""WITH {RUNS_SQL}, e AS (SELECT doc_id, min(x) AS l, max(x + width) AS r, min(y) AS b, max(y) AS t FROM rn GROUP BY doc_id)
SELECT doc_id, greatest(36.0{D}, l) AS margin_left, greatest(18.0{D}, 612.0{D} - r - 2.0{D}) AS margin_right, greatest(8.0{D}, 792.0{D} - t - 0.8{D} * 11.0{D}) AS margin_top, least(70.0{D}, greatest(8.0{D}, b - 0.25{D} * 11.0{D})) AS margin_bottom FROM e""")
def cmp10_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = runs(spark, sf_dir).groupBy("doc_id").agg(F.min("x").alias("l"), F.max(F.col("x") + F.col("width")).alias("r"), F.min("y").alias("b"), F.max("y").alias("t"))
    return e.select(
        "doc_id",
        F.greatest(F.lit(36.0), "l").alias("margin_left"),
        F.greatest(F.lit(18.0), 612.0 - F.col("r") - 2.0).alias("margin_right"),
        F.greatest(F.lit(8.0), 792.0 - F.col("t") - 0.8 * 11.0).alias("margin_top"),
        F.least(F.lit(70.0), F.greatest(F.lit(8.0), F.col("b") - 0.25 * 11.0)).alias("margin_bottom"),
    )


@query(f"WITH {RUNS_SQL} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9]{{2,}}')) AS words, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9]{{2,}}')) < 12 AS picture_page FROM rn GROUP BY doc_id")
def prj20_picture_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.count_if(F.col("text").rlike("[A-Za-z0-9]{2,}"))
    return runs(spark, sf_dir).groupBy("doc_id").agg(words.alias("words"), (words < 12).alias("picture_page"))


@query(f"WITH {RUNS_SQL} SELECT doc_id, sum(CASE WHEN size = 11 THEN length(text) ELSE 0 END) > sum(CASE WHEN size <> 11 THEN length(text) ELSE 0 END) AS transcript FROM rn GROUP BY doc_id")
def prj22_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = lambda c: F.sum(F.when(c, F.length("text")).otherwise(0))
    return runs(spark, sf_dir).groupBy("doc_id").agg((chars(F.col("size") == 11) > chars(F.col("size") != 11)).alias("transcript"))


@query()
def win6_lines_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-fit lines of boxes that overlap vertically; every box is shifted by its word number modulo 3."""
    boxes = runs(spark, sf_dir).select("doc_id", (F.col("line") * 100_000 + F.col("word")).alias("item"), "x", (F.col("y") + F.col("word") % 3).alias("y"), "width", F.lit(11.0).alias("height"))
    return L.lines_by_overlap(boxes, ["doc_id"]).groupBy("doc_id").agg(F.max("line").alias("lines"), F.count(F.lit(1)).alias("boxes"))


@query()
def win7_lines_by_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = runs(spark, sf_dir).select("doc_id", (F.col("line") * 100_000 + F.col("word")).alias("item"), "x", (F.col("y") + F.col("word") % 3).alias("y"), "size")
    return L.lines_by_baseline(boxes, ["doc_id"]).groupBy("doc_id").agg(F.max("line").alias("lines"), F.count(F.lit(1)).alias("boxes"))


@query()
def win20_vertical_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines set one under the other at 16 points each, where the source had 14.85."""
    blocks = _line_boxes(spark, sf_dir).select("doc_id", F.col("line").alias("item"), (720.0 - F.col("y")).alias("top"), F.lit(16.0).alias("height"))
    return L.vertical_settle(blocks, ["doc_id"]).groupBy("doc_id").agg(F.max("bottom").alias("bottom"), F.sum("space_before").alias("space"))


@query()
def jon16_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected groups of marks that touch within 2 points."""
    rules = _marks(spark, sf_dir).select("doc_id", F.col("line").alias("item"), F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mw").alias("width"), (F.col("mh") - 3).alias("height"))
    found = L.touching_components(rules, ["doc_id"])
    return found.groupBy("doc_id").agg(F.countDistinct("component").alias("groups"), F.count(F.lit(1)).alias("rules"))
