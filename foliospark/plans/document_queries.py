"""Queries of form, outline, table, numbering and export operators over the given tables.

TPC-H-like tables carry operators that only need keys and numbers: regions, nations and customers are an outline, orders
and line items are tables with rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import layout as L
from ..operators import pages as P
from ..operators.outline import flatten_tree, promote_children
from ..session import load, ship
from ..sources.tables import LINES_SQL, PAGES_SQL, RUNS_SQL, lines, pages, runs
from .registry import query

D = "::DOUBLE"


@query(f"""WITH {PAGES_SQL} SELECT doc, CASE WHEN page >= 2 THEN page + 1 ELSE page END AS page, doc_id FROM pg UNION ALL
SELECT d.doc, 2, f.doc_id FROM (SELECT DISTINCT doc FROM pg) d, (SELECT doc_id FROM pg WHERE doc = 'src0' AND page = 1) f""")
def prj9_insert_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of one document inserted into all as page 2 (one row, so the join is a broadcast of one row)."""
    every = pages(spark, sf_dir).select("doc", "page", "doc_id")
    slot = P.insert_blanks(every, 2, 1, ["doc"])
    first = F.broadcast(every.where("doc = 'src0' AND page = 1").select(F.lit(True).alias("blank"), F.col("doc_id").alias("from_id")))
    return slot.join(first, "blank", "left").select("doc", "page", F.coalesce("doc_id", "from_id").alias("doc_id"))


@query(f"WITH {RUNS_SQL} SELECT doc_id, line, word FROM rn WHERE y BETWEEN 792.0{D} * 0.08{D} AND 792.0{D} * (1.0{D} - 0.08{D}) AND regexp_replace(text, '[\\s\\x{{A0}}]', '', 'g') <> ''")
def prj12_body_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("y").between(792.0 * 0.08, 792.0 * (1.0 - 0.08))
    return runs(spark, sf_dir).where(body & (T.strip(F.col("text")) != "")).select("doc_id", "line", "word")


@query("""SELECT event_id, CASE WHEN (json_extract_string(props, '$.k'))::BIGINT >= 50 THEN 'k' ELSE '' END AS removed FROM events""")
def prj13_scrub_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata entries with a value of 50 or more go; the names of those that went."""
    m = F.from_json("props", "map<string,long>")
    gone = F.map_filter(m, lambda k, v: v >= 50)
    return load(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(gone)), ",").alias("removed"))


@query("""SELECT page_id, CASE WHEN contains(lower(url), 'utm') OR contains(lower(url), '/es/') THEN '[Redacted]' ELSE url END AS title FROM pages""")
def prj14_redact_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(F.lit("UTM"), F.lit("/es/"))
    quotes = F.exists(terms, lambda t: F.contains(F.lower("url"), F.lower(t)))
    return load(spark, sf_dir, "pages").select("page_id", F.when(quotes, "[Redacted]").otherwise(F.col("url")).alias("title"))


@query("""SELECT count(*) AS fields, count(p_partkey) AS filled, count(*) = count(p_partkey) AS complete, l_returnflag FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag""")
def prj16_fill_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-or-nothing: whether each field found its value."""
    joined = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    n, filled = F.count(F.lit(1)), F.count("p_partkey")
    return joined.groupBy("l_returnflag").agg(n.alias("fields"), filled.alias("filled"), (n == filled).alias("complete"))


@query("""SELECT doc_id, array_to_string(list_sort(CASE WHEN list_contains(s, p) THEN list_filter(s, lambda x: x <> p) ELSE list_append(s, p) END), ',') AS selection
FROM (SELECT doc_id, list_distinct([doc_id % 4, doc_id % 6, doc_id % 9]) AS s, doc_id % 5 AS p FROM documents)""")
def prj18_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.array_distinct(F.array(*[F.col("doc_id") % k for k in (4, 6, 9)])), F.col("doc_id") % 5
    toggled = F.when(F.array_contains(s, p), F.array_remove(s, p)).otherwise(F.array_append(s, p))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(toggled), ",").alias("selection"))


@query(f"WITH {LINES_SQL} SELECT doc_id, min(line) AS first_line FROM ln WHERE length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) < 3 AND text <> '' GROUP BY doc_id")
def prj23_noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line with fewer than three alphanumerics, which band recognition would drop."""
    noise = F.length(F.regexp_replace("text", "[^A-Za-z0-9]", "")) < 3
    return lines(spark, sf_dir).where(noise & (F.col("text") != "")).groupBy("doc_id").agg(F.min("line").alias("first_line"))


@query("SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def jon1_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "quality", "toxic")


@query("SELECT l_orderkey, l_linenumber, p_name AS part FROM lineitem JOIN part ON l_partkey = p_partkey")
def jon2_mandatory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without a match stops the job instead of vanishing."""
    joined = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    name = F.when(F.col("p_partkey").isNull(), F.raise_error(F.lit("a line item without its part")).cast("string")).otherwise(F.col("p_name"))
    return joined.select("l_orderkey", "l_linenumber", name.alias("part"))


@query("""WITH c AS (SELECT lower(trim(c_mktsegment)) AS k, count(*) AS customers FROM customer GROUP BY 1), p AS (SELECT lower(trim(o_orderpriority)) AS k, count(*) AS orders FROM orders GROUP BY 1)
SELECT coalesce(c.k, p.k) AS k, coalesce(customers, 0) AS customers, coalesce(orders, 0) AS orders FROM c FULL OUTER JOIN p ON c.k = p.k""")
def jon3_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rosters on a trimmed, lower-cased key; rows missing on either side are added."""
    c = load(spark, sf_dir, "customer").groupBy(F.lower(F.trim("c_mktsegment")).alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    p = load(spark, sf_dir, "orders").groupBy(F.lower(F.trim("o_orderpriority")).alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    return c.join(p, "k", "full_outer").select("k", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query(f"""WITH {RUNS_SQL}, h AS (SELECT doc_id, line, word, row_number() OVER (PARTITION BY doc_id ORDER BY line, word) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM rn WHERE lower(text) = 'the')
SELECT d.doc_id, line, word, CASE WHEN word IS NOT NULL THEN 'hit' ELSE 'not that often' END AS outcome FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id AND h.k = d.doc_id % 3 + 1""")
def jon5_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nth occurrence of a word in each document, with the reason of each miss."""
    w = Window.partitionBy("doc_id").orderBy("line", "word")
    hits = runs(spark, sf_dir).where(F.lower("text") == "the").withColumn("k", F.row_number().over(w)).select("doc_id", "line", "word", "k")
    wanted = load(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 + 1).cast("int").alias("k"))
    joined = wanted.join(hits, ["doc_id", "k"], "left")
    return joined.select("doc_id", "line", "word", F.when(F.col("word").isNotNull(), "hit").otherwise("not that often").alias("outcome"))


@query(f"""WITH {RUNS_SQL}, k AS (SELECT doc_id, line, word, sqrt(power(x + width / 2 - 300.0{D}, 2) + power(y - 400.0{D}, 2)) AS d, row_number() OVER (PARTITION BY doc_id ORDER BY round(sqrt(power(x + width / 2 - 300.0{D}, 2) + power(y - 400.0{D}, 2)), 6), line, word) AS r FROM rn)
SELECT doc_id, line, word FROM k WHERE r = 1""")
def jon8_nearest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run nearest to a point of each page."""
    d = F.sqrt(F.pow(F.col("x") + F.col("width") / 2 - 300.0, 2) + F.pow(F.col("y") - 400.0, 2))
    best = F.min(F.struct(F.round(d, 6).alias("d"), "line", "word"))
    return runs(spark, sf_dir).groupBy("doc_id").agg(best.alias("b")).select("doc_id", F.col("b.line").alias("line"), F.col("b.word").alias("word"))


@query("""WITH e(lo, hi, band) AS (VALUES (0, 10, 1), (10, 25, 2), (25, 40, 3), (40, 60, 4)) SELECT l_orderkey, l_linenumber, band FROM lineitem JOIN e ON l_quantity >= lo AND l_quantity < hi""")
def jon12_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to bands between fixed edges: the edges are a parameter, so the band is an expression, not a range join."""
    edges = [0, 10, 25, 40, 60]
    band = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("l_quantity")))
    rows = load(spark, sf_dir, "lineitem").where((F.col("l_quantity") >= edges[0]) & (F.col("l_quantity") < edges[-1]))
    return rows.select("l_orderkey", "l_linenumber", band.alias("band"))


@query("""WITH m AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, 1 AS n FROM customer)
SELECT c.k, CASE WHEN m.n = 1 THEN 'paired' WHEN m.n IS NULL THEN 'no mark' ELSE 'ambiguous' END AS outcome FROM c LEFT JOIN m USING (k)""")
def jon17_unique_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their orders pair only one to one."""
    m = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    joined = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(m, "k", "left")
    return joined.select("k", F.when(F.col("n") == 1, "paired").when(F.col("n").isNull(), "no mark").otherwise("ambiguous").alias("outcome"))


@query(f"""WITH {RUNS_SQL}, rl AS (SELECT doc_id, line, word, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS n FROM rn),
it AS (SELECT doc_id, line, word, n, sum(n) OVER (PARTITION BY doc_id ORDER BY line, word) - n AS s FROM rl WHERE n > 0),
pt AS (SELECT doc_id, string_split_regex(text, '[.,;]') AS t FROM documents), pl AS (SELECT doc_id, i AS piece, length(regexp_replace(t[i], '[^A-Za-z0-9]', '', 'g')) AS n FROM pt, unnest(range(1, len(t) + 1)) AS r(i)),
op AS (SELECT doc_id, piece, n, sum(n) OVER (PARTITION BY doc_id ORDER BY piece) - n AS s FROM pl WHERE n > 0)
SELECT it.doc_id, line, word, piece, it.s + it.n > op.s + op.n AS straddles FROM it JOIN op ON it.doc_id = op.doc_id AND it.s >= op.s AND it.s < op.s + op.n""")
def jon18_aligned_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text runs and the clauses of the same text (cut at stops, commas and semicolons): the clause each run starts in."""
    clauses = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "[.,;]")).alias("p", "text"))
    clauses = clauses.select("doc_id", (F.col("p") + 1).cast("long").alias("at"), "text")
    return L.aligned(runs(spark, sf_dir).select("doc_id", "line", "word", "text"), clauses, ["doc_id"], ["line", "word"], "at")


@query()
def jon19_word_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common word subsequence of each conversation turn with the next one of the same role."""
    ship(spark)

    @F.pandas_udf("long")
    def common(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([len(L.word_alignment((x or "").lower().split(), (y or "").lower().split())) for x, y in zip(a, b, strict=True)], dtype="int64")

    following = F.lead("text").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    turns = load(spark, sf_dir, "conversations").withColumn("following", following)
    return turns.where("following IS NOT NULL").select("conv_id", "turn", common("text", "following").alias("common"))


# A column of printed numbers for each part: quantities are the numbers, discounts jitter their baselines, and numbers of
# late items are misread by five lines. One point for each number, the lowest.
_COLUMN_SQL = f"""p AS (SELECT l_partkey AS k, l_quantity{D} AS x, min(720.0{D} - 14.85{D} * (l_quantity{D} - 1.0{D}) + 10.0{D} * l_discount{D} + CASE WHEN l_linenumber >= 6 THEN 74.25{D} ELSE 0.0{D} END) AS y FROM lineitem GROUP BY 1, 2),
s AS (SELECT a.k, median((a.y - b.y) / (b.x - a.x)) AS m FROM p a JOIN p b ON a.k = b.k AND a.x < b.x GROUP BY a.k),
r AS (SELECT p.k, m, median(y + (x - 1) * m) AS c FROM p JOIN s USING (k) GROUP BY p.k, m),
i AS (SELECT p.k, x, y FROM p JOIN r USING (k) WHERE round(abs(c - (x - 1) * m - y) - 0.5{D} * abs(m), 6) <= 0),
g AS (SELECT k, -regr_slope(y, x) AS a, regr_intercept(y, x) + regr_slope(y, x) AS b, count(*) AS n FROM i GROUP BY k),
f AS (SELECT r.k, coalesce(n, 0) AS kept, coalesce(n >= 10 AND m > 0, false) AS refitted, CASE WHEN n >= 10 AND m > 0 THEN a ELSE m END AS pitch, CASE WHEN n >= 10 AND m > 0 THEN b ELSE c END AS first FROM r LEFT JOIN g ON g.k = r.k)"""


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    x = F.col("l_quantity").cast("double")
    y = 720.0 - 14.85 * (x - 1.0) + 10.0 * F.col("l_discount").cast("double") + F.when(F.col("l_linenumber") >= 6, 74.25).otherwise(0.0)
    points = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k"), x.alias("x")).agg(F.min(y).alias("y"))
    return A.robust_fit(points, ["k"], "x", "y")


@query(f"WITH {_COLUMN_SQL} SELECT k, round(pitch, 3) AS pitch, round(first, 2) AS first, kept, refitted FROM f")
def agg10_robust_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch and first baseline of each column of numbers, without the misread ones."""
    return _columns(spark, sf_dir).select("k", F.round("pitch", 3).alias("pitch"), F.round("first", 2).alias("first"), "kept", "refitted")


@query(f"WITH {_COLUMN_SQL} SELECT p_brand AS section, round(median(pitch), 3) AS pitch, max(kept) AS most, count(*) FILTER (WHERE refitted) * 2 > count(*) AS majority FROM f JOIN part ON p_partkey = f.k GROUP BY 1")
def agg11_section_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a section (a brand's parts) vote: median pitch, most numbers, whether most were fitted."""
    fits = _columns(spark, sf_dir).join(load(spark, sf_dir, "part"), F.col("k") == F.col("p_partkey"))
    majority = F.count_if("refitted") * 2 > F.count(F.lit(1))
    return fits.groupBy(F.col("p_brand").alias("section")).agg(F.round(F.median("pitch"), 3).alias("pitch"), F.max("kept").alias("most"), majority.alias("majority"))


@query(f"""WITH {RUNS_SQL} SELECT doc_id, count(DISTINCT (line, lower(text))) FILTER (WHERE word % 2 = 0) + count(*) FILTER (WHERE word % 2 = 1) AS instances FROM rn GROUP BY doc_id""")
def agg18_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks from one search hit count once, drawn ones each: even words stand for hits, odd ones for drawn marks."""
    hit = F.when(F.col("word") % 2 == 0, F.struct("line", F.lower("text").alias("t")))
    return runs(spark, sf_dir).groupBy("doc_id").agg((F.count_distinct(hit) + F.count_if(F.col("word") % 2 == 1)).alias("instances"))


@query("""SELECT r_regionkey AS root, count(*) AS leaves FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def agg28_leaf_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves (customers) under each root of the outline."""
    found = flatten_tree(_outline(spark, sf_dir), 4)
    return found.where("kind = 'customer'").groupBy(F.regexp_extract("root", "([0-9]+)", 1).cast("long").alias("root")).agg(F.count(F.lit(1)).alias("leaves"))


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("region").alias("kind"))
    n = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit("nation"))
    c = load(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.lit("customer"))
    return r.union(n).union(c)


@query("""SELECT 'c' || c_custkey AS node, CASE WHEN n_nationkey % 2 = 0 THEN 'r' || n_regionkey ELSE 'n' || n_nationkey END AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT 'r' || r_regionkey, NULL FROM region""")
def win23_outline_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other nation is dropped from the outline; its customers move up to the region."""
    tree = _outline(spark, sf_dir)
    gone = (F.col("kind") == "nation") & (F.regexp_extract("node", "([0-9]+)", 1).cast("int") % 2 == 0)
    return promote_children(tree, gone, 4).select("node", "parent")


@query("""SELECT 'c' || c_custkey AS node, 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey AS path, 3 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey || '/n' || n_nationkey, 2 FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey, 1 FROM region""")
def cmp17_bookmark_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_tree(_outline(spark, sf_dir), 4).select("node", "path", "depth")


@query(f"""WITH {LINES_SQL} SELECT doc_id, string_agg(CASE WHEN line = 1 THEN text WHEN regexp_matches(p, '[A-Za-z]-$') AND regexp_matches(text, '^[a-z]') THEN text ELSE ' ' || text END, '' ORDER BY line) AS joined
FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line) AS p FROM ln) GROUP BY doc_id""")
def win16_joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document as one text: a blank between them, unless a hyphen breaks a word."""
    p = F.lag("text").over(Window.partitionBy("doc_id").orderBy("line"))
    piece = F.when(F.col("line") == 1, F.col("text")).when(T.joins_hyphen(p, F.col("text")), F.col("text")).otherwise(F.concat(F.lit(" "), "text"))
    parts = lines(spark, sf_dir).withColumn("piece", piece).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "piece"))).alias("s"))
    return parts.select("doc_id", F.array_join(F.transform("s", lambda x: x["piece"]), "").alias("joined"))


@query(f"""WITH {RUNS_SQL}, g AS (SELECT doc_id, line, word, x, width, size, lag(x + width) OVER (PARTITION BY doc_id, line ORDER BY word) AS e FROM rn),
s AS (SELECT *, sum(CASE WHEN e IS NULL OR x - e > 0.55{D} * size THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY word ROWS UNBOUNDED PRECEDING) AS seg FROM g) SELECT doc_id, line, max(seg)::BIGINT AS segments FROM s GROUP BY 1, 2""")
def win17_gutter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "line").orderBy("word")
    e = F.lag(F.col("x") + F.col("width")).over(w)
    found = L.islands(runs(spark, sf_dir), ["doc_id", "line"], ["word"], F.col("x") - e > 0.55 * F.col("size"), "segment")
    return found.groupBy("doc_id", "line").agg(F.max("segment").alias("segments"))


@query("""SELECT event_id, 'Exhibit ' || CASE WHEN z < 26 THEN chr((65 + z)::INT) ELSE chr((65 + ((z - 26) // 26) % 26)::INT) || chr((65 + (z - 26) % 26)::INT) END AS label FROM (SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 702 AS z FROM events)""")
def win24_exhibit_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exhibits of each user in order: A..Z, AA..ZZ, then from A again."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Exhibit "), T.letters_of((n % 702 + 1).cast("long"))).alias("label"))


@query("""WITH i AS (SELECT user_id, (event_id % 50) * 10 AS a, (event_id % 50) * 10 + 12 AS b, count(*) AS c FROM events GROUP BY 1, 2, 3), f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM i),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, min(a) AS a, max(b) AS b, sum(c)::BIGINT AS n FROM g GROUP BY user_id, s""")
def win26_merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected character ranges merged when one starts no later than the reach of those before."""
    a = F.col("event_id") % 50 * 10
    return L.merged_intervals(load(spark, sf_dir, "events").select("user_id", a.alias("a"), (a + 12).alias("b")), ["user_id"], "a", "b", 0)


@query()
def win13_settled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed numbers with single gaps filled; every fifth page has lost its number."""
    ship(spark)
    p = pages(spark, sf_dir).select("doc", "page", F.when(F.col("page") % 5 != 0, F.col("page")).alias("printed"))
    return L.settled_numbers(p, ["doc"])


@query("""SELECT user_id, count(*) > 500 AS too_many, least(count(*), 500) AS allowed FROM events GROUP BY user_id""")
def srt6_limit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return load(spark, sf_dir, "events").groupBy("user_id").agg((n > 500).alias("too_many"), F.least(n, F.lit(500)).alias("allowed"))


@query(f"""WITH {PAGES_SQL} SELECT doc, doc_id, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN page = 3 THEN 0.5{D} ELSE page{D} END) AS place FROM pg""")
def srt7_move_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page moved before the first: place arithmetic, no sort of the document."""
    place = F.when(F.col("page") == 3, 1).when(F.col("page") < 3, F.when(F.col("last") >= 3, F.col("page") + 1).otherwise(F.col("page"))).otherwise(F.col("page"))
    every = pages(spark, sf_dir)
    n = every.groupBy("doc").agg(F.max("page").alias("last"))
    return every.join(n, "doc").select("doc", "doc_id", place.cast("long").alias("place"))


@query("""SELECT lower(w) AS token FROM (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) INTERSECT SELECT DISTINCT unnest(string_split(lower(text), ' ')) FROM conversations""")
def set5_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = lambda t: load(spark, sf_dir, t).select(F.explode(F.split(F.lower("text"), " ")).alias("token"))
    return token("benchmark").intersect(token("conversations"))


@query("""SELECT c_custkey, c_name AS before, (c_custkey % 90 + 1)::VARCHAR AS after FROM customer""")
def scl11_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table-of-contents lines taken apart at their dot leaders."""
    line = F.concat("c_name", F.lit(" ........ "), (F.col("c_custkey") % 90 + 1).cast("string"))
    return load(spark, sf_dir, "customer").select("c_custkey", T.leader_parts(line)["before"].alias("before"), T.leader_parts(line)["after"].alias("after"))


@query(f"WITH {RUNS_SQL} SELECT doc_id, count(*) AS markers FROM rn WHERE word = 1 AND regexp_matches(text, '^(\\(?([0-9]{{1,3}}|[a-z]|[ivxlcdm]{{2,6}})[.)]|[•·▪◦])$') GROUP BY doc_id")
def scl12_list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What stands before a list item.
    marker = F.col("text").rlike(r"^(\(?([0-9]{1,3}|[a-z]|[ivxlcdm]{2,6})[.)]|[•·▪◦])$")
    return runs(spark, sf_dir).where((F.col("word") == 1) & marker).groupBy("doc_id").agg(F.count(F.lit(1)).alias("markers"))


@query(f"WITH {RUNS_SQL} SELECT doc_id, line, word, greatest(6.0{D}, floor(least(size, size * 40.0{D} / width) * 2.0{D}) / 2.0{D}) AS fitted FROM rn")
def scl15_fit_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type size that fits 40 points: shrunk, floored to half a point, at least 6."""
    fit = F.least(F.col("size"), F.col("size") * 40.0 / F.col("width"))
    return runs(spark, sf_dir).select("doc_id", "line", "word", F.greatest(F.lit(6.0), F.floor(fit * 2.0) / 2.0).alias("fitted"))


@query("""SELECT p_partkey, regexp_replace(f, '^[A-Z]{6}\\+', '') AS family, regexp_matches(lower(f), 'bold|black|heavy') AS bold, regexp_matches(lower(f), 'italic|oblique') AS italic FROM (SELECT p_partkey, 'ABCDEF+' || replace(p_type, ' ', '-') AS f FROM part)""")
def scl23_font_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.concat(F.lit("ABCDEF+"), F.replace("p_type", F.lit(" "), F.lit("-")))
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.regexp_replace(f, r"^[A-Z]{6}\+", "").alias("family"), f.rlike("(?i)bold|black|heavy").alias("bold"), f.rlike("(?i)italic|oblique").alias("italic")
    )


@query(f"WITH {RUNS_SQL} SELECT doc_id, line, word, CASE WHEN x < 306 AND y >= 396 THEN 0 WHEN y >= 396 THEN 1 WHEN x < 306 THEN 2 ELSE 3 END AS quadrant FROM rn")
def cmp2_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, top = F.col("x") < 306, F.col("y") >= 396
    q = F.when(left & top, 0).when(top, 1).when(left, 2).otherwise(3)
    return runs(spark, sf_dir).select("doc_id", "line", "word", q.alias("quadrant"))


@query(f"""WITH {RUNS_SQL}, l AS (SELECT doc_id, y, lag(y) OVER (PARTITION BY doc_id ORDER BY y DESC) - y AS gap FROM (SELECT DISTINCT doc_id, y FROM rn)) SELECT doc_id, min(y) - median(gap) / 4 AS ceiling FROM l GROUP BY doc_id HAVING median(gap) IS NOT NULL""")
def cmp3_footer_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = runs(spark, sf_dir).select("doc_id", "y").distinct()
    gap = F.lag("y").over(Window.partitionBy("doc_id").orderBy(F.desc("y"))) - F.col("y")
    found = y.withColumn("gap", gap).groupBy("doc_id").agg(F.min("y").alias("low"), F.median("gap").alias("gap"))
    return found.where("gap IS NOT NULL").select("doc_id", (F.col("low") - F.col("gap") / 4).alias("ceiling"))


@query(f"""WITH {PAGES_SQL} SELECT doc, count(*) AS pages, count(*) FILTER (WHERE len(string_split(text, ' ')) < 12) AS picture_pages, min(CASE WHEN len(string_split(text, ' ')) >= 12 THEN page END) AS first_typed FROM pg GROUP BY doc""")
def cmp12_export_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.split("text", " "))
    return pages(spark, sf_dir).groupBy("doc").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(n < 12).alias("picture_pages"), F.min(F.when(n >= 12, F.col("page"))).alias("first_typed")
    )


@query(f"""WITH {PAGES_SQL} SELECT doc, page, 'stamp-' || page AS text, 612.0{D} - 100.0{D} - 24.0{D} AS x, 24.0{D} AS y, ((doc_id % 4) * 90) AS rotation FROM pg""")
def cmp16_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamp at the lower right of every page as rows of an ink table."""
    from ..operators.geometry import corner

    at = corner("bottom-right", F.lit(100.0), F.lit(12.0), F.lit(612.0), F.lit(792.0), 24.0)
    return pages(spark, sf_dir).select(
        "doc", "page", F.concat(F.lit("stamp-"), F.col("page").cast("string")).alias("text"), at["x"].alias("x"), at["y"].alias("y"), (F.col("doc_id") % 4 * 90).alias("rotation")
    )


@query("""SELECT user_id, count(*) AS in_order FROM (SELECT user_id, ts >= coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), ts) AS ok FROM events) WHERE ok GROUP BY user_id""")
def str8_results_in_input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work done in any order is put back by key; counts the rows that came no earlier than the one before."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    ok = F.col("ts") >= F.coalesce(F.lag("ts").over(w), F.col("ts"))
    return load(spark, sf_dir, "events").withColumn("ok", ok).where("ok").groupBy("user_id").agg(F.count(F.lit(1)).alias("in_order"))


@query("""SELECT host, count(*) AS files, sum(n)::BIGINT AS bytes, bool_and(n > 0) AS complete FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host, octet_length(encode(html)) AS n FROM pages) GROUP BY host""")
def snk8_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and whether none is empty, per output set."""
    n = F.octet_length("html")
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1))
    return load(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(n).alias("bytes"), F.bool_and(n > 0).alias("complete")
    )
