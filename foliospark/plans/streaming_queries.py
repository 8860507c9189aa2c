"""Queries of sources, codecs and time-dependent behaviours over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..session import load, ship
from ..sources.files import choose_engine, input_kind
from ..sources.hocr import hocr_words
from ..sources.text_pages import text_pages
from ..streaming import state as S
from .registry import query


@query("""WITH e AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT * FROM e ORDER BY user_id, ts))
SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM g GROUP BY user_id, s""")
def str1_quiet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of a user with no pause over 30 minutes form one batch."""
    found = S.quiet_batches(load(spark, sf_dir, "events"), "user_id", "event_type", window="30 minutes")
    return found.select("user_id", F.unix_micros("started").alias("started"), "n", F.array_join("paths", ",").alias("kinds"))


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), kind.alias("action"), F.col("event_id").cast("string").alias("tag"))


@query()
def str3_undo_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded undo stack per user: errors undo, sign-ups redo, all else edits."""
    ship(spark)
    return S.history(_actions(spark, sf_dir))


@query("""SELECT p.event_id AS id, CASE WHEN count(a.event_id) = 0 THEN 'refused' ELSE min_by(a.event_type, (a.ts, a.event_id)) END AS decision
FROM events p LEFT JOIN events a ON a.user_id = p.user_id AND a.event_type <> 'signup' AND a.ts >= p.ts AND a.ts <= p.ts + INTERVAL 5 MINUTES WHERE p.event_type = 'signup' GROUP BY p.event_id""")
def str4_confirm_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sign-up waits five minutes for the user's next event; the first one in time decides."""
    e = S.event_time(load(spark, sf_dir, "events"))
    # the next other event of the user by a window over both sides, so that no pairs are made
    answer = F.when(F.col("event_type") != "signup", F.struct("ts", "event_id", "event_type"))
    after = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "signup", 0).otherwise(1), "event_id").rowsBetween(1, Window.unboundedFollowing)
    p = e.withColumn("a", F.first(answer, ignorenulls=True).over(after)).where("event_type = 'signup'")
    proposals = p.select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    answers = p.where("a IS NOT NULL").select(F.col("event_id").alias("id"), F.col("a.ts").alias("answered"), F.col("a.event_type").alias("answer"))
    return S.decisions(proposals, answers).select("id", "decision")


@query("""SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS deltas FROM conversations GROUP BY conv_id""")
def str6_assembled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.assembled(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""SELECT user_id, max_by(value, (ts, event_id)) AS value, max_by(event_type, (ts, event_id)) AS event_type, max(event_id) AS last_id FROM events GROUP BY user_id""")
def str7_latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by("value", order).alias("value"), F.max_by("event_type", order).alias("event_type"), F.max("event_id").alias("last_id")
    )


@query("""SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'skipped' WHEN l.toxic = 1 THEN 'failed' ELSE 'done' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def str9_bulk_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt for every input, whatever became of it."""
    joined = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "skipped").when(F.col("toxic") == 1, "failed").otherwise("done")
    return joined.select("doc_id", status.alias("status"))


@query()
def src5_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document wrapped to 70 columns and 43 lines: pages, lines and replaced signs of each."""
    ship(spark)
    rows = text_pages(load(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.max("page").alias("pages"), F.count(F.lit(1)).alias("lines"), F.sum("replaced").alias("replaced"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'printer' WHEN page_id % 3 = 1 THEN 'reader' END AS engine FROM pages""")
def src11_choose_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first available engine for each page's extension; the third extension has none available."""
    extension = F.element_at(F.array(F.lit(".html"), F.lit(".txt"), F.lit(".rtf")), (F.col("page_id") % 3 + 1).cast("int"))
    files = load(spark, sf_dir, "pages").select("page_id", extension.alias("extension"))
    engines = spark.createDataFrame(
        [("office", ".html", 1, False), ("printer", ".html", 2, True), ("reader", ".txt", 1, True), ("printer", ".txt", 2, True), ("office", ".rtf", 1, False)],
        "engine string, extension string, priority int, available boolean",
    )
    return choose_engine(files, engines).select("page_id", "engine")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'text' ELSE 'image' END AS kind FROM pages")
def scl37_input_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".HTML").otherwise(".png"))
    return load(spark, sf_dir, "pages").select("page_id", input_kind(name).alias("kind"))


@query("SELECT page_id, contains(html, '/Encrypt') AS encrypted FROM pages")
def src2_encryption_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import is_encrypted

    return load(spark, sf_dir, "pages").select("page_id", is_encrypted(F.col("html").cast("binary")).alias("encrypted"))


@query(r"""WITH l AS (SELECT doc_id, i - 1 AS i, list_filter(string_split_regex(t[i], '\s+'), lambda w: w <> '') AS ws FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents), unnest(range(1, len(t) + 1)) AS r(i)),
w AS (SELECT doc_id, i, j, ws[j + 1] AS w FROM l, unnest(range(0, len(ws))) AS r(j))
SELECT doc_id, i * 20 AS y0, count(*) AS words, sum(length(w))::BIGINT AS letters, sum(j * 10)::BIGINT AS x0, sum(j * 10 + 8)::BIGINT AS x1, sum((60 + (i + j) % 40)::DOUBLE) AS conf,
sum(CASE WHEN i % 5 <> 4 THEN (i * 20 + 18) + 0.125::DOUBLE * (j * 10 + 4) - 2 END) AS baseline, sum(CASE WHEN i % 5 <> 4 THEN CASE WHEN i % 3 = 2 THEN 18.0::DOUBLE ELSE 12.5::DOUBLE END END) AS size,
5000 AS page_width FROM w GROUP BY doc_id, i""")
def src12_hocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as hOCR and parsed back: boxes, confidences, baselines and sizes of the words, summed up by line."""
    ship(spark)
    c = F.col
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # the file may be one row group; its texts are dealt out before they are written as hOCR, a thousand a task, since a task's
    # hOCR comes to Python in batches of up to ten thousand rows
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.repartition(max(n, docs.count() // 1_000), "doc_id")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    text = lambda x: x.cast("string")

    def line(t: F.Column, i: F.Column) -> F.Column:
        metrics = F.concat(F.when(i % 5 == 4, "").otherwise("; baseline 0.125 -2"), F.when(i % 3 == 2, "").otherwise("; x_size 12.5"))
        words = F.transform(
            F.filter(F.split(t, r"\s+"), lambda w: w != ""),
            lambda w, j: F.concat(
                F.lit("<span class='ocrx_word' title='bbox "), text(j * 10), F.lit(" "), text(i * 20), F.lit(" "), text(j * 10 + 8), F.lit(" "), text(i * 20 + 9),
                F.lit("; x_wconf "), text((i + j) % 40 + 60), F.lit("'>"), w, F.lit("</span>"),
            ),
        )
        head = F.concat(F.lit("<span class='ocr_line' title='bbox 0 "), text(i * 20), F.lit(" 5000 "), text(i * 20 + 18), metrics, F.lit("'>"))
        return F.concat(head, F.array_join(words, " "), F.lit("</span>"))

    hocr = F.concat(F.lit("<div class='ocr_page' title='bbox 0 0 5000 9999'>"), F.array_join(F.transform(F.split(escaped, "\n"), line), " "), F.lit("</div>"))
    found = hocr_words(docs.select("doc_id", hocr.alias("hocr")), "doc_id", "hocr")
    total = lambda col: F.sum(col).alias(col)
    return found.groupBy(c("id").alias("doc_id"), "y0").agg(
        F.count(F.lit(1)).alias("words"), F.sum(F.length("text")).alias("letters"), *[total(k) for k in ("x0", "x1", "conf", "baseline", "size")], F.first("page_width").alias("page_width")
    )


@query("SELECT doc_id, true AS same, octet_length(encode(text)) AS n_bytes FROM documents")
def scl29_packbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's bytes run-length coded and decoded again."""
    ship(spark)
    raw = F.col("text").cast("binary")
    back = C.unpackbits_udf(C.packbits_udf(raw))
    return load(spark, sf_dir, "documents").select("doc_id", (back == raw).alias("same"), F.octet_length("text").cast("long").alias("n_bytes"))


@query()
def scl20_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page text with named, decimal and hex entities decoded in one pass."""
    ship(spark)
    from ..functions.text import strip_tags

    return load(spark, sf_dir, "pages").select("page_id", C.decode_entities_udf(strip_tags(F.col("html"))).alias("text"))


@query()
def scl30_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and digits after NFKC."""
    ship(spark)
    return load(spark, sf_dir, "documents").select("doc_id", C.letter_count_udf(F.col("text")).alias("letters"))
