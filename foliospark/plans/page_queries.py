"""Queries of the page algebra. `documents.source` is the document, its rows by doc_id are the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from ..operators.ordinals import running
from ..session import load
from ..sources.tables import PAGES_SQL, pages
from .registry import query


@query("SELECT source AS doc, count(*) AS page_count FROM documents GROUP BY source")
def src4_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(F.col("source").alias("doc")).agg(F.count(F.lit(1)).alias("page_count"))


@query(f"""WITH {PAGES_SQL}, n AS (SELECT doc, count(*) AS n FROM pg GROUP BY doc)
SELECT doc, least(x, y)::BIGINT AS page FROM n, LATERAL (SELECT unnest(range(1, least(3, n) + 1)) AS x), LATERAL (SELECT x AS y)
UNION SELECT doc, n::BIGINT FROM n""")
def prj1_parse_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = pages(spark, sf_dir).groupBy("doc").agg(F.max("page").alias("n"))
    spec = F.concat(F.lit("1-"), F.least(F.lit(3), F.col("n")).cast("string"), F.lit(", "), F.col("n").cast("string"))
    found = counts.select("doc", P.parse_page_ranges(spec, F.col("n")).alias("r"))
    return found.select("doc", F.explode("r.pages").alias("page")).withColumn("page", F.col("page").cast("long"))


@query(f"""WITH {PAGES_SQL}, n AS (SELECT doc, count(*) AS n FROM pg GROUP BY doc)
SELECT doc, 'outside the document: 1-' || (n + 1) AS error FROM n""")
def prj2_page_range_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = pages(spark, sf_dir).groupBy("doc").agg(F.max("page").alias("n"))
    spec = F.concat(F.lit("1-"), (F.col("n") + 1).cast("string"))
    return counts.select("doc", P.parse_page_ranges(spec, F.col("n"))["error"].alias("error"))


_LONG = "length(text) >= 1000"


@query(f"""WITH {PAGES_SQL}, k AS (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS i FROM pg WHERE {_LONG}),
r AS (SELECT doc, min(page) AS a, max(page) AS b FROM k GROUP BY doc, i)
SELECT doc, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY doc""")
def prj3_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ranges_text(P.page_ranges(pages(spark, sf_dir).where(_LONG), ["doc"]), ["doc"])


@query(f"""WITH {PAGES_SQL} SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS new_page, doc_id FROM pg WHERE {_LONG}""")
def prj5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = pages(spark, sf_dir)
    return P.extract(every, every.where(_LONG).select("doc", "page"), ["doc"]).select("doc", "page", "new_page", "doc_id")


@query(f"""WITH {PAGES_SQL} SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS new_page, doc_id FROM pg WHERE NOT ({_LONG}) OR page = 1""")
def prj6_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All long pages go but a document's first one, as deleting all its pages would be an error."""
    every = pages(spark, sf_dir)
    return P.delete(every, every.where(_LONG).where("page > 1").select("doc", "page"), ["doc"]).select("doc", "page", "new_page", "doc_id")


@query(f"""WITH {PAGES_SQL}, n AS (SELECT doc, count(*) AS n FROM pg GROUP BY doc)
SELECT pg.doc, part, page, doc_id FROM pg JOIN n USING (doc), (VALUES (1), (2)) AS v(part)
WHERE (part = 1 AND page <= greatest(1, n * 2 // 3)) OR (part = 2 AND page >= greatest(1, n // 3))""")
def prj7_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = pages(spark, sf_dir)
    n = every.groupBy("doc").agg(F.max("page").alias("n"))
    one = F.lit(1).cast("long")
    first = n.select("doc", F.lit(1).alias("part"), one.alias("first"), F.greatest(one, F.floor(F.col("n") * 2 / 3)).alias("last"))
    second = n.select("doc", F.lit(2).alias("part"), F.greatest(one, F.floor(F.col("n") / 3)).alias("first"), F.col("n").alias("last"))
    return P.split_parts(every, first.unionByName(second), ["doc"]).select("doc", "part", "page", "doc_id")


@query(f"""WITH {PAGES_SQL}, z AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 792.0::DOUBLE ELSE 612.0::DOUBLE END AS width, CASE WHEN doc_id % 3 = 0 THEN 612.0::DOUBLE ELSE 792.0::DOUBLE END AS height FROM pg)
SELECT doc, CASE WHEN page >= 3 THEN page + 2 ELSE page END AS page, false AS blank, doc_id, width, height FROM z
UNION ALL SELECT doc, p, true, NULL, width, height FROM z, (VALUES (3), (4)) AS v(p) WHERE page = 2""")
def prj8_insert_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blank pages behind the second one, as wide and high as that: every third page lies on its side."""
    wide = F.col("doc_id") % 3 == 0
    sized = pages(spark, sf_dir).select("doc", "page", "doc_id", F.when(wide, 792.0).otherwise(612.0).alias("width"), F.when(wide, 612.0).otherwise(792.0).alias("height"))
    return P.insert_blanks(sized, 3, 2, ["doc"], ("width", "height"))


@query(f"""WITH {PAGES_SQL}, o AS (SELECT doc, page, doc_id FROM pg)
SELECT doc, CASE WHEN page >= 2 THEN page + 1 ELSE page END AS page, doc_id, false AS slip, NULL AS label FROM o
UNION ALL SELECT doc, 2, NULL, true, 'EXHIBIT ' || doc FROM o GROUP BY doc""")
def prj10_slip_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.insert_blanks(pages(spark, sf_dir).select("doc", "page", "doc_id"), 2, 1, ["doc"])
    label = F.when(F.col("blank"), F.concat(F.lit("EXHIBIT "), F.col("doc")))
    return found.select("doc", "page", "doc_id", F.col("blank").alias("slip"), label.alias("label"))


@query("SELECT doc_id, ((doc_id % 4) * 90 + 270) % 360 AS rotation FROM documents")
def prj11_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = P.rotate((F.col("doc_id") % 4) * 90, F.lit(-90))
    return load(spark, sf_dir, "documents").select("doc_id", turned.alias("rotation"))


@query("""SELECT doc_id, d.quality IS NOT NULL AS labelled, NOT (coalesce(d.quality, 0) = 1) AS changed FROM documents
LEFT JOIN labels d USING (doc_id)""")
def prj17_changed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label is an edit over the original value 1; only rows whose value differs survive as changed."""
    joined = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    value = F.coalesce("quality", F.lit(0))
    return joined.select("doc_id", F.col("quality").isNotNull().alias("labelled"), (~value.eqNullSafe(F.lit(1))).alias("changed"))


@query(f"""WITH {PAGES_SQL} SELECT doc, page, (length(text) - length(replace(text, ' ', '')) + 1 < 60) AS needs_look FROM pg""")
def prj21_short_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same partition predicate as for pages that need OCR, on words."""
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    return pages(spark, sf_dir).select("doc", "page", (words < 60).alias("needs_look"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct([doc_id % 7 + 1, doc_id % 5 + 1, doc_id % 3 + 1])), ',') AS pages FROM documents""")
def prj4_normalise_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.array(*[F.col("doc_id") % k + 1 for k in (7, 5, 3)])
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(some)), ",").alias("pages"))


@query("""SELECT doc_id, least(doc_id % 9, doc_id % 4) + 1 AS first_page, greatest(doc_id % 9, doc_id % 4) + 1 AS last_page,
greatest(doc_id % 9, doc_id % 4) - least(doc_id % 9, doc_id % 4) + 1 AS n FROM documents""")
def prj19_clamped_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("doc_id") % 9 + 1, F.col("doc_id") % 4 + 1
    span = F.sequence(F.least(a, b), F.greatest(a, b))
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.array_min(span).alias("first_page"), F.array_max(span).alias("last_page"), F.size(span).cast("long").alias("n")
    )


@query("""SELECT doc_id, 'ABC' || CASE WHEN length(n::VARCHAR) < 6 THEN repeat('0', 6 - length(n::VARCHAR)) ELSE '' END || n AS label
FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) + 100 AS n FROM documents)""")
def win1_bates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bates(load(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", "ABC", 101).select("doc_id", "label")


@query(f"""WITH {PAGES_SQL} SELECT doc, page, 'Page ' || page || ' of ' || count(*) OVER (PARTITION BY doc) AS stamp FROM pg""")
def win2_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = pages(spark, sf_dir)
    total = every.groupBy("doc").agg(F.count(F.lit(1)).alias("total"))
    stamp = P.page_stamp(F.col("page"), F.col("total"), "Page {n} of {total}")
    return every.join(total, "doc").select("doc", "page", stamp.alias("stamp"))


@query("""SELECT o_orderkey, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS first_page
FROM (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)""")
def win3_merge_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carrier rows: orders are files, their line items pages, each customer's files are merged."""
    n = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    files = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(n, "o_orderkey")
    found = running(files, ["o_custkey"], "o_orderkey", F.col("n"), "upto")
    return found.select("o_orderkey", (F.col("upto") - F.col("n") + 1).cast("long").alias("first_page"))


@query("""SELECT source AS doc, true AS complete FROM documents GROUP BY source""")
def win4_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document turned end to front is a complete permutation."""
    every = pages(spark, sf_dir)
    n = every.groupBy("doc").agg(F.max("page").alias("n"))
    return P.is_permutation(every.join(n, "doc").withColumn("target", F.col("n") - F.col("page") + 1), ["doc"], "target")


@query(f"""WITH {PAGES_SQL}, f AS (SELECT *, length(text) >= 1500 AS big, lag(length(text) >= 1500) OVER (PARTITION BY doc ORDER BY page) AS was FROM pg),
g AS (SELECT *, sum(CASE WHEN was IS NULL OR big <> was THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page) AS part FROM f)
SELECT doc, part::BIGINT AS part, any_value(big) AS big, min(page) AS first, max(page) AS last FROM g GROUP BY doc, part""")
def win12_consecutive_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc").orderBy("page")
    f = pages(spark, sf_dir).withColumn("big", F.length("text") >= 1500)
    f = f.withColumn("new", (~F.col("big").eqNullSafe(F.lag("big").over(w))).cast("long")).withColumn("part", F.sum("new").over(w))
    return f.groupBy("doc", "part").agg(F.first("big").alias("big"), F.min("page").alias("first"), F.max("page").alias("last"))


@query("""SELECT source AS doc, 'delete' AS op, count(*) AS pages_in, count(*) FILTER (WHERE length(text) < 1000) AS pages_out FROM documents GROUP BY source""")
def snk1_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = load(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "text")
    return P.receipt(every, every.where("length(text) < 1000"), ["doc"], "delete")


@query(f"""WITH {PAGES_SQL} SELECT doc, page, regexp_replace(doc, '[^a-z]', '', 'g') || '-' ||
CASE WHEN length(page::VARCHAR) < w THEN repeat('0', w - length(page::VARCHAR)) ELSE '' END || page || '.png' AS file
FROM (SELECT doc, page, greatest(3, length(count(*) OVER (PARTITION BY doc)::VARCHAR)) AS w FROM pg)""")
def snk7_page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = pages(spark, sf_dir).select("doc", "page")
    n = every.groupBy("doc").agg(F.max("page").alias("n"))
    width = F.greatest(F.lit(3), F.length(F.col("n").cast("string")))
    number = F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(F.col("page").cast("string")), F.lit(0))), F.col("page").cast("string"))
    name = F.concat(F.regexp_replace("doc", "[^a-z]", ""), F.lit("-"), number, F.lit(".png"))
    return every.join(n, "doc").select("doc", "page", name.alias("file"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def jon4_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set3_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id").exceptAll(load(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages")
def set1_concatenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"))
    return a.unionByName(load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind")))


@query("SELECT DISTINCT lower(w) AS token FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark UNION ALL SELECT unnest(string_split(text, ' ')) FROM conversations)")
def set2_union_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = lambda t: load(spark, sf_dir, t).select(F.explode(F.split("text", " ")).alias("w")).select(F.lower("w").alias("token"))
    return token("benchmark").union(token("conversations")).distinct()


@query("""SELECT item_id AS id, text FROM (SELECT item_id, text, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY item_id) AS k FROM benchmark) WHERE k = 1
AND lower(trim(text)) NOT IN (SELECT lower(trim(text)) FROM conversations WHERE text IS NOT NULL)""")
def set4_append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lower(F.trim("text"))
    first = Window.partitionBy("k").orderBy("item_id")
    new = load(spark, sf_dir, "benchmark").withColumn("k", key).withColumn("n", F.row_number().over(first)).where("n = 1")
    seen = load(spark, sf_dir, "conversations").select(key.alias("k"))
    return new.join(seen, "k", "left_anti").select(F.col("item_id").alias("id"), "text")


@query("""SELECT doc_id, regexp_extract(source, '([a-z]+)', 1) AS stem, lower(source) || '.' || lang AS file, '.' || lang AS extension FROM documents""")
def scl37_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lower("source"), F.lit("."), F.col("lang"))
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_extract(T.file_stem(name), "([a-z]+)", 1).alias("stem"), name.alias("file"), T.file_extension(name).alias("extension")
    )
