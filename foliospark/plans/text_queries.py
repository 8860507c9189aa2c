"""Queries of search, redaction, bands and string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import residue
from ..operators import search as S
from ..session import load
from ..sources.tables import LINES_SQL, PAGES_SQL, lines, pages
from .registry import query

#: Terms of the searches: a parameter of the queries.
TERMS = ["the", "tion", "und", "Licens", "a.b", "de la"]
_VALUES = ", ".join(f"('{t.lower()}')" for t in TERMS)
_COUNT = "(length(lower(text)) - length(replace(lower(text), term, ''))) // length(term)"

_PHRASES_SQL = """ph AS (SELECT item_id, needle FROM (SELECT item_id, array_to_string(string_split(lower(text), ' ')[1:4], ' ') AS needle,
row_number() OVER (PARTITION BY array_to_string(string_split(lower(text), ' ')[1:4], ' ') ORDER BY item_id) AS k FROM benchmark) WHERE k = 1),
gr AS (SELECT doc_id, line, i - 1 AS word, array_to_string(w[i:i+3], ' ') AS needle FROM (SELECT doc_id, line, string_split(lower(text), ' ') AS w FROM ln),
unnest(range(1, len(w) - 2)) AS r(i))"""


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    return S.first_spelling(load(spark, sf_dir, "benchmark").select("item_id", first.alias("t")), "t", "item_id").select("item_id", "needle")


@query(f"WITH {LINES_SQL}, {_PHRASES_SQL} SELECT item_id, needle AS term, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM gr JOIN ph USING (needle) GROUP BY 1, 2")
def flagship_term_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four words of every benchmark text, searched in every line of every document; a census per phrase."""
    hits = S.phrase_hits(lines(spark, sf_dir).select("doc_id", "line", "text"), _phrases(spark, sf_dir), 4)
    return hits.groupBy("item_id", F.col("needle").alias("term")).agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("hits"))


@query(f"""WITH {LINES_SQL}, {_PHRASES_SQL} SELECT doc_id, line, word, item_id,
row_number() OVER (PARTITION BY doc_id ORDER BY line, word, item_id) - 1 AS index FROM gr JOIN ph USING (needle)""")
def win5_match_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.phrase_hits(lines(spark, sf_dir).select("doc_id", "line", "text"), _phrases(spark, sf_dir), 4)
    return S.match_ordinals(hits, "doc_id", ["line", "word", "item_id"]).select("doc_id", "line", F.col("word").cast("long").alias("word"), "item_id", "index")


@query(f"WITH {LINES_SQL} SELECT doc_id, line, term, {_COUNT} AS hits FROM ln, (VALUES {_VALUES}) AS v(term) WHERE {_COUNT} > 0")
def scl1_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.find_terms(lines(spark, sf_dir).select("doc_id", "line", "text"), TERMS).select("doc_id", "line", "term", "hits")


@query(f"""WITH t AS (SELECT doc_id, text, regexp_replace(text, '(?i)(the|tion)', '#', 'g') AS masked FROM documents),
c AS (SELECT term, sum({_COUNT})::BIGINT AS before, sum({_COUNT.replace('text', 'masked')})::BIGINT AS remaining,
sum(CASE WHEN term IN ('the', 'tion') THEN {_COUNT} ELSE 0 END)::BIGINT AS marked FROM t, (VALUES {_VALUES}) AS v(term) GROUP BY term HAVING sum({_COUNT}) > 0)
SELECT term, before, remaining, marked, greatest(0, before - remaining) AS destroyed,
CASE WHEN marked = 0 THEN remaining = 0 ELSE greatest(0, before - remaining) >= least(marked, before) END AS proved FROM c""")
def agg17_term_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the terms are redacted everywhere; the census proves what is gone and what remains."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    masked = docs.withColumn("text", T.mask_terms(F.col("text"), "(?i)(the|tion)", "#"))
    before, after = S.find_terms(docs, TERMS), S.find_terms(masked, TERMS)
    return S.census(before, after, before.where(F.col("term").isin("the", "tion")), ["term"])


@query("""SELECT doc_id, regexp_replace(text, '(?i)(licens[a-z]*|the)', '█', 'g') = text AS untouched,
length(text) - length(regexp_replace(text, '(?i)(licens[a-z]*|the)', '█', 'g')) AS removed FROM documents""")
def cmp13_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = T.mask_terms(F.col("text"), "(?i)(licens[a-z]*|the)")
    return load(spark, sf_dir, "documents").select(
        "doc_id", (masked == F.col("text")).alias("untouched"), (F.length("text") - F.length(masked)).cast("long").alias("removed")
    )


_UNITS = "flatten(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)] ELSE [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] END))"


# Files of redacted documents: the text, and a title (its first six words) stored as hex, masked in every fifth document only.
RESIDUE_TERMS = ["the", "tion", "und", "é"]
_HEX = {k: f"CASE WHEN {{t}} = '' THEN '' ELSE array_to_string(list_transform({_UNITS.replace('(text', '({t}')}, lambda u: {v}), '') END" for k, v in (("l", "printf('%02x', u % 256)"), ("u", "printf('%04x', u)"))}
_FORMS_SQL = ", ".join(f"('{n}', '{residue.stored_forms(n)[0]}', '{residue.stored_forms(n)[1]}', '{residue.stored_forms(n)[2]}')" for n in RESIDUE_TERMS)
_TIMES = " + ".join(f"(length({{h}}) - length(replace({{h}}, {f}, ''))) // length({f})" for f in ("f0", "f1", "f2"))


def _stored(title: str) -> str:
    return f"' <' || CASE doc_id % 3 WHEN 0 THEN {_HEX['l'].replace('{t}', title)} WHEN 1 THEN {_HEX['u'].replace('{t}', title)} ELSE '' END || '>'"


@query(f"""WITH m AS (SELECT doc_id, text, array_to_string(string_split(text, ' ')[1:6], ' ') AS title, regexp_replace(text, '(?i)(the|tion|und|é)', '█', 'g') AS masked FROM documents),
k AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN regexp_replace(title, '(?i)(the|tion|und|é)', '█', 'g') ELSE title END AS kept FROM m),
f AS (SELECT doc_id, lower(text) AS plain, lower(text || {_stored('title')}) AS old, lower(masked || {_stored('kept')}) AS new FROM k),
v(term, f0, f1, f2) AS (VALUES {_FORMS_SQL}),
c AS (SELECT doc_id, term, {_TIMES.format(h='old')} AS before, {_TIMES.format(h='new')} AS remaining, (length(plain) - length(replace(plain, f0, ''))) // length(f0) AS marked FROM f, v)
SELECT doc_id, term, before, remaining, marked, greatest(0, before - remaining) AS destroyed,
CASE WHEN marked = 0 THEN remaining = 0 ELSE greatest(0, before - remaining) >= least(marked, before) END AS proved FROM c WHERE before + remaining + marked > 0""")
def cmp13_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census of each term in each redacted file, in all forms: titles stored as hex keep what the text has lost."""
    pattern = "(?iu)(the|tion|und|é)"
    title = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", title.alias("title"))
    docs = docs.withColumn("kept", F.when(F.col("doc_id") % 5 == 0, T.mask_terms(F.col("title"), pattern)).otherwise(F.col("title")))

    def stored(c: str) -> F.Column:
        form = F.when(F.col("doc_id") % 3 == 0, residue.latin1_hex(F.col(c))).when(F.col("doc_id") % 3 == 1, residue.utf16_hex(F.col(c))).otherwise("")
        return F.concat(F.lit(" <"), form, F.lit(">"))

    before = docs.select("doc_id", F.concat("text", stored("title")).alias("text"))
    after = docs.select("doc_id", F.concat(T.mask_terms(F.col("text"), pattern), stored("kept")).alias("text"))
    low = docs.select("doc_id", F.lower("text").alias("low"))
    marks = [F.struct(F.lit(n).alias("term"), residue.times(F.col("low"), n).alias("hits")) for n in RESIDUE_TERMS]
    marked = low.select("doc_id", F.inline(F.filter(F.array(*marks), lambda x: x["hits"] > 0)))
    return residue.proofs(before, after, marked, ["doc_id"], RESIDUE_TERMS)


@query("""SELECT min_by(text, item_id) AS spelling, lower(trim(text)) AS needle, min(item_id) AS item_id FROM benchmark GROUP BY lower(trim(text))""")
def agg20_distinct_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_spelling(load(spark, sf_dir, "benchmark"), "text", "item_id").select(F.col("text").alias("spelling"), "needle", "item_id")


_BAND = r"regexp_replace(regexp_replace(lower(trim(text, chr(32) || chr(9) || chr(13) || chr(160))), '[0-9]', '#', 'g'), '[\s\x{A0}\x85]+', ' ', 'g')"


@query(f"""WITH {LINES_SQL} SELECT doc, {_BAND} AS band, count(DISTINCT doc_id) AS on_pages FROM ln WHERE {_BAND} <> '' GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3""")
def agg14_repeated_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.repeated_bands(lines(spark, sf_dir), "doc", "doc_id", T.band_text(F.col("text")), share=None)


@query(f"""WITH {LINES_SQL} SELECT lower(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '\\s+', '', 'g')) AS band, count(*) AS n FROM ln GROUP BY 1""")
def scl2_export_band_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy(T.export_band_text(F.col("text")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lang, count(*) AS docs, sum(length(text))::BIGINT AS chars, sum(len(string_split(text, ' ')))::BIGINT AS words,
count(*) FILTER (WHERE length(text) < 500) AS short FROM documents GROUP BY lang""")
def agg1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.length("text")).alias("chars"),
        F.sum(F.size(F.split("text", " "))).alias("words"),
        F.count_if(F.length("text") < 500).alias("short"),
    )


@query("""SELECT d.doc_id, coalesce(avg(l.quality), 0)::DOUBLE AS mean_quality FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id""")
def agg2_mean_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("doc_id").agg(F.coalesce(F.avg("quality"), F.lit(0.0)).alias("mean_quality"))


@query("SELECT user_id, coalesce(median(value), 0)::DOUBLE AS mid FROM events GROUP BY user_id")
def agg3_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(F.median("value"), F.lit(0.0)).alias("mid"))


@query("""SELECT event_type, s[least(floor(0.95 * len(s))::INT, len(s) - 1) + 1] AS p95, s[least(floor(0.5 * len(s))::INT, len(s) - 1) + 1] AS mid
FROM (SELECT event_type, list_sort(list(value)) AS s FROM events GROUP BY event_type)""")
def agg4_floor_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element at floor(q * n) of the sorted values, without gathering a group: by counts of smaller values."""
    from ..operators.aggregates import floor_quantiles

    return floor_quantiles(load(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value", {"p95": 0.95, "mid": 0.5})


@query("""SELECT custkey, seg FROM (SELECT o_custkey AS custkey, o_orderpriority AS seg, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(o_orderkey)) AS k
FROM orders GROUP BY 1, 2) WHERE k = 1""")
def agg6_mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent value; of equally frequent ones the first seen, which mode() doesn't promise."""
    n = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("seg"))
    n = n.agg(F.count(F.lit(1)).alias("n"), (-F.min("o_orderkey")).alias("first"))
    return n.groupBy("custkey").agg(F.max_by("seg", F.struct("n", "first")).alias("seg"))


@query("""SELECT l_suppkey AS k, regr_slope(l_extendedprice::DOUBLE, l_quantity::DOUBLE) AS slope, regr_intercept(l_extendedprice::DOUBLE, l_quantity::DOUBLE) AS icept
FROM lineitem GROUP BY l_suppkey""")
def agg9_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icept"))


@query(f"""WITH {PAGES_SQL}, n AS (SELECT doc, count(*) AS n FROM pg GROUP BY doc), s AS (SELECT pg.doc, page, doc_id FROM pg JOIN n USING (doc) WHERE (page - 1) % greatest(1, n // 8) = 0)
SELECT doc, page, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) AS k FROM s) WHERE k <= 8""")
def agg15_systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every floor(n / 8)-th page from the first, at most eight: the sample is the feature."""
    every = pages(spark, sf_dir)
    n = every.groupBy("doc").agg(F.max("page").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 8))
    picked = every.join(n, "doc").where(((F.col("page") - 1) % step == 0) & ((F.col("page") - 1) / step < 8))
    return picked.select("doc", "page", "doc_id")


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) < 16 OR text IS NULL")
def src16_text_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where(F.col("text").isNull() | (F.length("text") < 16)).select("doc_id", F.length("text").cast("long").alias("chars"))


@query(f"""WITH {PAGES_SQL} SELECT doc, page, '----- Page ' || page || ' -----' || chr(10) || chr(10) || rtrim(text, ' ' || chr(10) || chr(9) || chr(13)) || chr(10) AS block FROM pg""")
def snk3_text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block a page, as the text sink writes them (joined by form feeds within a document)."""
    from ..sources.sinks import page_block

    return pages(spark, sf_dir).select("doc", "page", page_block(F.col("page"), F.col("text")).alias("block"))


@query("""SELECT doc_id, regexp_matches(trim(source || ' ' || (doc_id + 100)), '^[A-Za-z][A-Za-z0-9]{0,19}[ _.-]?[0-9]{3,10}$') AS bates FROM documents""")
def scl3_bates(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("source", F.lit(" "), (F.col("doc_id") + 100).cast("string"))
    return load(spark, sf_dir, "documents").select("doc_id", T.looks_like_bates(label).alias("bates"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 OR doc_id = 0 THEN NULL WHEN doc_id > 9999 THEN NULL ELSE doc_id END AS page FROM documents")
def scl4_printed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    label = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Page "), n, F.lit(" of 37"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("- "), n, F.lit(" -")))
    label = label.when(F.col("doc_id") % 4 == 2, F.concat(F.lit("["), n, F.lit("]"))).otherwise(F.concat(F.lit("see "), n))
    return load(spark, sf_dir, "documents").select("doc_id", T.printed_page(label).cast("long").alias("page"))


@query("SELECT doc_id, CASE WHEN doc_id BETWEEN 1 AND 28 THEN doc_id END AS line_number FROM documents")
def scl5_line_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.line_number(F.col("doc_id").cast("string")).cast("long").alias("line_number"))


@query("SELECT doc_id, doc_id % 89 + 1 AS value FROM documents")
def scl6_roman_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") % 89 + 1).cast("int")
    return load(spark, sf_dir, "documents").select("doc_id", T.roman_value(T.roman_numeral(n)).cast("long").alias("value"))


@query("""SELECT doc_id, CASE WHEN z < 26 THEN chr((65 + z)::INT) ELSE chr((65 + ((z - 26) // 26) % 26)::INT) || chr((65 + (z - 26) % 26)::INT) END AS letters,
doc_id % 702 + 1 AS value FROM (SELECT doc_id, doc_id % 702 AS z FROM documents)""")
def scl7_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = T.letters_of((F.col("doc_id") % 702 + 1).cast("long"))
    return load(spark, sf_dir, "documents").select("doc_id", letters.alias("letters"), T.value_of_letters(letters).cast("long").alias("value"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%d/%m/%Y') AS eu, strftime(o_orderdate, '%Y-%m-%d') AS iso,
strftime(o_orderdate, '%B %-d, %Y') AS long FROM orders""")
def scl8_date_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", T.date_stamp(day, "MM/DD/YYYY").alias("us"), T.date_stamp(day, "DD/MM/YYYY").alias("eu"),
        T.date_stamp(day, "YYYY-MM-DD").alias("iso"), T.date_stamp(day, "MMMM D, YYYY").alias("long"),
    )


@query(f"""WITH {LINES_SQL} SELECT doc_id, line, regexp_matches(text, '^[A-Za-z]') AND regexp_matches(coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY line), ''), '[A-Za-z]-$')
AND regexp_matches(text, '^[a-z]') AS joins FROM ln""")
def scl9_dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("line")
    joins = T.joins_hyphen(F.coalesce(F.lag("text").over(w), F.lit("")), F.col("text"))
    return lines(spark, sf_dir).select("doc_id", "line", joins.alias("joins"))


@query(rf"""WITH {LINES_SQL} SELECT count(*) AS n, doc_id FROM ln WHERE regexp_matches(text, '^(Q[.:]|A[.:]|THE (COURT|WITNESS|REPORTER|CLERK)\b|(MR|MS|MRS|DR)\.\s|BY (MR|MS|MRS|DR)\.|\(\w{{1,3}}\)\s|\d{{1,3}}[.)]\s|[•▪‣◦●]\s|[-–—]\s)') GROUP BY doc_id""")
def scl10_block_openers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where(T.opens_block(F.col("text"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, lower(text) AS literal, CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform({_UNITS}, lambda u: printf('%02x', u % 256)), '') END AS latin1_hex,
CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform({_UNITS}, lambda u: printf('%04x', u)), '') END AS utf16_hex FROM documents""")
def scl17_needle_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in the forms in which a needle may be stored."""
    c = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.lower(c).alias("literal"), residue.latin1_hex(c).alias("latin1_hex"), residue.utf16_hex(c).alias("utf16_hex"))


@query()
def scl18_fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.fnv1a(F.col("source")).alias("source_hash"), T.fnv1a(F.col("text")).alias("text_hash"))


@query("""SELECT doc_id, '(' || a || ':' || x || CASE WHEN a = b AND x = y THEN '' WHEN a = b THEN '-' || y ELSE '-' || b || ':' || y END || ')' AS cite FROM (
SELECT doc_id, CASE WHEN (p, l) <= (q, m) THEN p ELSE q END AS a, CASE WHEN (p, l) <= (q, m) THEN l ELSE m END AS x,
CASE WHEN (p, l) <= (q, m) THEN q ELSE p END AS b, CASE WHEN (p, l) <= (q, m) THEN m ELSE l END AS y FROM (
SELECT doc_id, doc_id % 5 AS p, doc_id % 7 AS l, doc_id % 4 AS q, doc_id % 3 AS m FROM documents))""")
def scl19_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cite = T.citation(F.col("doc_id") % 5, F.col("doc_id") % 7, F.col("doc_id") % 4, F.col("doc_id") % 3)
    return load(spark, sf_dir, "documents").select("doc_id", cite.alias("cite"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')),
'&amp;', chr(57344)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&nbsp;', ' '), chr(57344), '&') AS text FROM (SELECT page_id, replace(html, '&#39;', '&apos;') AS html FROM pages)""")
def scl21_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.decode_entities(T.strip_tags(F.col("html"))).alias("text"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped FROM pages""")
def scl22_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey * 7919) % 256 ELSE ((c_custkey * 7919) % 16) * 17 END AS r FROM customer""")
def scl24_hex_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") * 7919
    six = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(k % 256)), 2, "0"), F.lit("00ff"))
    three = F.concat(F.lower(F.hex(k % 16)), F.lit("0f"))
    return load(spark, sf_dir, "customer").select("c_custkey", T.hex_colour(F.when(F.col("c_custkey") % 2 == 0, six).otherwise(three))["r"].cast("long").alias("r"))


@query("""SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) AS prompt, least(128000, greatest(8192, sum(length(text)) * 4))::BIGINT AS token_limit
FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def scl31_ask_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in order, system turns apart, with the token ceiling clamped to its range."""
    block = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text"))
    turns = load(spark, sf_dir, "conversations").where("role <> 'system'").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("t"), F.sum(F.length("text")).alias("n")
    )
    limit = F.least(F.lit(128_000), F.greatest(F.lit(8192), F.col("n") * 4))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["b"]), "\n").alias("prompt"), limit.alias("token_limit"))


@query("""SELECT conv_id, first_role = 'user' AS allowed FROM (SELECT conv_id, min_by(role, turn) AS first_role FROM conversations GROUP BY conv_id)""")
def scl31_first_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first"))
    return first.select("conv_id", (F.col("first") == "user").alias("allowed"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND value > 100 THEN 'retry' WHEN event_type = 'error' THEN 'refused' ELSE 'ok' END AS outcome FROM events""")
def scl32_error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    outcome = F.when(failed & (F.col("value") > 100), "retry").when(failed, "refused").otherwise("ok")
    return load(spark, sf_dir, "events").select("event_id", outcome.alias("outcome"))


@query("""SELECT event_id, CASE WHEN k BETWEEN 0 AND 49 THEN k ELSE 10 END AS setting FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def scl34_setting_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A persisted number with a range check and a fallback."""
    k = F.from_json("props", "k long")["k"]
    return load(spark, sf_dir, "events").select("event_id", F.when(k.between(0, 49), k).otherwise(10).alias("setting"))


@query("""SELECT event_id, CASE WHEN props IS NULL THEN 'missing' WHEN json_extract_string(props, '$.k') IS NULL THEN 'k is required' WHEN (json_extract_string(props, '$.k'))::BIGINT >= 90 THEN 'k is too large' END AS problem FROM events""")
def scl33_validate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"]
    problem = F.when(F.col("props").isNull(), "missing").when(k.isNull(), "k is required").when(k >= 90, "k is too large")
    return load(spark, sf_dir, "events").select("event_id", problem.alias("problem"))


@query("""SELECT lang, count(*) || CASE WHEN count(*) = 1 THEN ' page' ELSE ' pages' END || ' searched' AS summary FROM documents GROUP BY lang""")
def scl36_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return n.select("lang", F.concat(T.plural(F.col("n"), "page", "pages"), F.lit(" searched")).alias("summary"))


@query("""SELECT p_partkey, floor(p_retailprice::DOUBLE * 20.0 + 0.5)::BIGINT AS twips, floor(p_retailprice::DOUBLE * 2.0 + 0.5)::BIGINT AS half_points, floor(p_retailprice::DOUBLE * 96.0 / 72.0 + 0.5)::BIGINT AS pixels FROM part""")
def scl43_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = F.col("p_retailprice").cast("double")
    return load(spark, sf_dir, "part").select(
        "p_partkey", T.half_up(pt * 20.0).alias("twips"), T.half_up(pt * 2.0).alias("half_points"), T.half_up(pt * 96.0 / 72.0).alias("pixels")
    )


@query("SELECT doc_id, (doc_id + 1) % 7 AS next_match, (doc_id % 7 + 6) % 7 AS previous_match FROM documents")
def scl44_cyclic_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.pmod(F.col("doc_id") + 1, F.lit(7)).alias("next_match"), F.pmod(F.col("doc_id") % 7 - 1, F.lit(7)).alias("previous_match")
    )


@query("""SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host, page_id FROM (SELECT url, page_id, row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) ORDER BY page_id DESC) AS k FROM pages) WHERE k <= 12""")
def srt4_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve latest pages of each host: the limit is the feature."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1))
    w = Window.partitionBy("host").orderBy(F.desc("page_id"))
    latest = load(spark, sf_dir, "pages").withColumn("host", host).withColumn("k", F.row_number().over(w)).where("k <= 12")
    return latest.select("url", "host", "page_id")


@query("""SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY regexp_extract(source, '^([a-z]+)', 1), regexp_extract(source, '([0-9]+)$', 1)::INT, doc_id) AS place FROM documents""")
def srt3_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(T.natural_key(F.col("source")), "doc_id")
    return load(spark, sf_dir, "documents").select("doc_id", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT c_custkey, regexp_matches(lower(replace(c_name, '#', '@')) || '.org', '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS ok FROM customer""")
def jon26_email_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("@"))), F.lit(".org"))
    return load(spark, sf_dir, "customer").select("c_custkey", T.is_email(mail).alias("ok"))
