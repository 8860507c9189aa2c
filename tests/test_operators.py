import pytest
from pyspark.sql import functions as F

from foliospark.operators import aggregates as A
from foliospark.operators import layout as L
from foliospark.operators import pages as P
from foliospark.operators import search as S
from foliospark.operators.ordinals import numbered, running
from foliospark.session import ship
from foliospark.sources import hocr
from foliospark.sources.sinks import write_text_export, write_verified
from foliospark.sources.text_pages import TextPage, text_pages, wrap
from foliospark.streaming import state as T


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def test_page_ranges_and_back(spark):
    spec = spark.createDataFrame([("1-3, 5, 4",), ("2-1",), ("0",), ("3-9",), ("x",)], "s string")
    got = [tuple(r["r"]) for r in spec.select(P.parse_page_ranges(F.col("s"), F.lit(6)).alias("r")).collect()]
    assert got == [([1, 2, 3, 4, 5], None), (None, "backwards: 2-1"), (None, "outside the document: 0"), (None, "outside the document: 3-9"), (None, "not a page: x")]
    pages = spark.createDataFrame([("d", p) for p in (1, 2, 3, 6, 8, 9)], "doc string, page int")
    assert P.ranges_text(P.page_ranges(pages, ["doc"]), ["doc"]).first()["pages"] == "1–3, 6, 8–9"


def test_numbering_over_ranges(spark):
    rows = [("ab"[k % 2], k * 7 % 101) for k in range(101)]
    got = numbered(spark.createDataFrame(rows, "g string, o long"), ["g"], "o").collect()
    for g in "ab":
        own = sorted((r["o"], r["ordinal"]) for r in got if r["g"] == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    nulls = spark.createDataFrame([(None, 1, 5), (None, 2, 6)], "g string, o long, w long")
    assert sorted(r["s"] for r in running(nulls, ["g"], "o", F.col("w"), "s").collect()) == [5, 11]


def test_delete_and_insert(spark):
    pages = spark.createDataFrame([("d", p) for p in range(1, 6)], "doc string, page long")
    gone = pages.where("page IN (2, 3)")
    assert sorted((r["page"], r["new_page"]) for r in P.delete(pages, gone, ["doc"]).collect()) == [(1, 1), (4, 2), (5, 3)]
    others = spark.createDataFrame([(None, 1), ("e", 1)], "doc string, page long")
    assert P.delete(pages.union(others), gone, ["doc"]).count() == 5
    with pytest.raises(Exception, match="keep a page: d"):
        P.delete(pages, pages, ["doc"]).collect()
    sized = pages.withColumn("width", 600 + F.col("page"))
    assert [[r["width"] for r in P.insert_blanks(sized, at, 2, ["doc"], ("width",)).where("blank").collect()] for at in (1, 4)] == [[601] * 2, [603] * 2]
    more = P.insert_blanks(pages, 6, 2, ["doc"]).collect()
    assert sorted((r["page"], r["blank"]) for r in more)[-2:] == [(6, True), (7, True)]
    with pytest.raises(ValueError, match="500"):
        P.insert_blanks(pages, 1, 501, ["doc"])


def test_find_and_census(spark):
    lines = spark.createDataFrame([(1, "aaaa a.b AxB"), (2, "none")], "id long, text string")
    got = {(r["id"], r["term"]): r["hits"] for r in S.find_terms(lines, ["aa", "a.b", " "]).collect()}
    assert got == {(1, "aa"): 2, (1, "a.b"): 1}
    hits = lambda *rows: spark.createDataFrame(rows, "term string, hits long")
    found = {r["term"]: r for r in S.census(hits(("a", 5), ("b", 2)), hits(("a", 1), ("b", 2)), hits(("a", 4)), ["term"]).collect()}
    assert (found["a"]["destroyed"], found["a"]["proved"], found["b"]["proved"]) == (4, True, False)


def test_bands_need_a_share_of_the_pages(spark):
    rows = [("d", p, t) for p in range(1, 6) for t in ("Header 1", "body %d" % p if p % 2 else "x%d y" % p)]
    lines = spark.createDataFrame(rows, "doc string, page long, text string")
    assert [r["band"] for r in S.repeated_bands(lines, "doc", "page", F.col("text")).collect()] == ["Header 1"]


def test_aggregates(spark):
    v = spark.createDataFrame([("a", float(x), 1) for x in (1, 2, 3, 10)] + [("b", 5.0, 1)], "g string, v double, w long")
    got = {r["g"]: r["q"] for r in A.floor_quantiles(v, "g", "v", {"q": 0.95}).collect()}
    assert got == {"a": 10.0, "b": 5.0}
    assert {r["g"]: r["v"] for r in A.weighted_median(v, "g", "v", "w").collect()} == {"a": 2.0, "b": 5.0}
    h = spark.createDataFrame([("a", b, n) for b, n in ((0, 10), (1, 8), (200, 9), (201, 12))], "g string, b long, n long")
    assert A.otsu(h, "g", "b", "n").first()["threshold"] == 1


def test_shared_bigrams(spark, monkeypatch):
    """Against plain sets, on repeated and null ids and characters of four bytes, with all, some and none of the counts in the head;
    pages go to the join as one row each where the head knows all of their bigrams."""
    from collections import Counter

    from foliospark.operators import bigrams as B

    ship(spark)
    texts = ["abab c", "ab", "\U0001f600a\U0001f600a", "a\U0001f600b", "éa éa", "xx", "zq" * 20, "ab\nab"]
    rows = [(None if k == 5 else f"d{k % 3}", None if k == 7 else k % 19, texts[k % 8]) for k in range(40)]
    sets = [(d, p, {t[i : i + 2] for i in range(len(t) - 1)}) for d, p, t in rows if d is not None]
    n, want = Counter((d, g) for d, _, s in sets for g in s), Counter()
    for d, p, s in sets:
        want[p] += sum(n[d, g] - 1 for g in s)
    docs = spark.createDataFrame(rows, "doc string, page long, text string").repartition(3)
    monkeypatch.setattr(B, "CHUNK_CHARS", 50)
    for share in (0, 0.02, 1):
        monkeypatch.setattr(B, "HEAD_SHARE", share)
        assert {r["page"]: r["shared"] for r in B.shared_bigrams(docs).collect()} == want, share
    assert B.shared_bigrams(docs.limit(0)).collect() == []


def test_kept_stops_depend_on_the_last_kept(spark):
    s = spark.createDataFrame([([10.0, 12.0, 14.5, 15.0, 30.0],)], "s array<double>")
    assert s.select(L.kept_stops(F.col("s"))).first()[0] == [10.0, 14.5, 30.0]


def test_first_fit_lines(spark):
    rows = [("p", 1, 0.0, 100.0, 5.0, 10.0), ("p", 2, 9.0, 97.0, 5.0, 10.0), ("p", 3, 0.0, 80.0, 5.0, 10.0), ("p", 4, 20.0, 93.0, 5.0, 10.0)]
    boxes = spark.createDataFrame(rows, "doc string, item long, x double, y double, width double, height double")
    got = {r["item"]: r["line"] for r in L.lines_by_overlap(boxes, ["doc"]).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 3: 2}


def plain_lines(boxes):
    """First fit as it is told: every line's every member is looked at."""
    lines, out = [], {}
    for item, _, y, _, h in sorted(boxes, key=lambda b: (-b[2], b[1], b[0])):
        fits = [k for k, line in enumerate(lines) if any(min(y + h, b) - max(y, a) >= 0.5 * min(h, b - a) for a, b in line)]
        if not fits:
            lines.append([])
        k = fits[0] if fits else len(lines) - 1
        lines[k].append((y, y + h))
        out[item] = k + 1
    return out


def test_folds_of_many_boxes(spark):
    """Lines, baselines and touching rules against their plain forms, also for long pages, on which those take the square."""
    import random
    import time

    rng = random.Random(3)
    kind = "doc string, item long, x double, y double, width double, height double"
    boxes = [(k, float(rng.randrange(60)), float(rng.randrange(150)) / 2, float(rng.randrange(9)), rng.choice([-3.0, 0.0, 4.0, 9.0, 30.0])) for k in range(300)]
    df = spark.createDataFrame([("p", *b) for b in boxes], kind)
    assert {r["item"]: r["line"] for r in L.lines_by_overlap(df, ["doc"]).collect()} == plain_lines(boxes)

    order, seed, n, want = sorted(boxes, key=lambda b: (-b[2], b[1], b[0])), None, 0, {}
    for item, _, y, _, size in order:
        if seed is None or abs(seed[0] - y) > max(1.5, 0.35 * seed[1]):
            seed, n = (y, size), n + 1
        want[item] = n
    assert {r["item"]: r["line"] for r in L.lines_by_baseline(df.withColumnRenamed("height", "size"), ["doc"]).collect()} == want

    rules = [(k, rng.uniform(0, 400), rng.uniform(0, 400), rng.uniform(0, 30), rng.uniform(0, 30)) for k in range(200)]
    touch = lambda a, b: min(a[1] + a[3], b[1] + b[3]) >= max(a[1], b[1]) - 2 and min(a[2] + a[4], b[2] + b[4]) >= max(a[2], b[2]) - 2
    least = {r[0]: r[0] for r in rules}
    for _ in rules:
        least = {a[0]: min(least[b[0]] for b in rules if touch(a, b)) for a in rules}
    got = {r["item"]: r["component"] for r in L.touching_components(spark.createDataFrame([("p", *r) for r in rules], kind), ["doc"]).collect()}
    assert got == least and len(set(least.values())) > 1

    long = spark.range(40_000).selectExpr("'p' doc", "id item", "0.0D x", "-15.0D * id y", "9.0D width", "11.0D height")
    began = time.time()
    assert L.lines_by_overlap(long, ["doc"]).agg({"line": "max"}).first()[0] == 40_000
    assert L.touching_components(long, ["doc"]).selectExpr("count(distinct component)").first()[0] == 40_000
    assert time.time() - began < 30


def test_missing_numbers_settle_in_order(spark):
    rows = [("d", p, n) for p, n in ((1, 4), (2, None), (3, 6), (4, None), (5, None), (6, 9))]
    pages = spark.createDataFrame(rows, "doc string, page long, printed long")
    got = [r["settled"] for r in L.settled_numbers(pages, ["doc"]).orderBy("page").collect()]
    assert got == [4, 5, 6, None, None, 9]


def test_touching_rules(spark):
    rows = [("p", 1, 0.0, 0.0, 10.0, 1.0), ("p", 2, 11.0, 0.0, 10.0, 1.0), ("p", 3, 20.0, 1.0, 1.0, 30.0), ("p", 4, 60.0, 0.0, 1.0, 1.0)]
    rules = spark.createDataFrame(rows, "doc string, item long, x double, y double, width double, height double")
    assert {r["item"]: r["component"] for r in L.touching_components(rules, ["doc"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_alignment():
    assert L.word_alignment("a b c d".split(), "b x d".split()) == [(1, 0), (3, 2)]


def test_wrap_and_pages(spark):
    assert (TextPage().columns, TextPage().rows) == (70, 43)
    assert wrap("aa bb cc", 5) == ["aa bb", "cc"]
    assert wrap("abcdefgh ij", 3) == ["abc", "def", "gh", "ij"]
    docs = spark.createDataFrame([(1, "a\r\nb\n\f\nc\t€"), (2, None), (3, "\n".join("x" * 44))], "doc_id long, text string")
    got = [(r["doc_id"], r["page"], r["row"], r["text"], r["replaced"]) for r in text_pages(docs).where("doc_id < 3").orderBy("doc_id", "page", "row").collect()]
    assert got == [(1, 1, 1, "a", 0), (1, 1, 2, "b", 0), (1, 2, 1, "c    ?", 1), (2, 1, 1, "", 0)]
    assert text_pages(docs).where("doc_id = 3").agg(F.max("page")).first()[0] == 2


def test_hocr():
    page = """<div class='ocr_page' title='bbox 0 0 100 100'><span class='ocr_line' title="bbox 0 0 90 20; baseline 0.1 -2">
    <span class='ocrx_word' title='bbox 10 2 30 18; x_wconf 91'><em>a</em>&amp;b</span></span></div>"""
    assert hocr.words(page) == [("a&b", 10, 2, 30, 18, 91.0, 20 + 0.1 * 20 - 2, 20.0)]
    assert hocr.page_box(page) == (0, 0, 100, 100)
    sized = page.replace("0.1 -2", "0.1 -2; x_size 13.5").replace("<em>a</em>&amp;b", " two \n words ")
    assert hocr.words(sized)[0][0] == "two words" and hocr.words(sized)[0][-1] == 13.5
    assert hocr.words(page.replace("; baseline 0.1 -2", ""))[0][-2:] == (None, None)
    assert hocr.words("<span class='ocrx_word' title='x_wconf 3'> </span>") == []
    with pytest.raises(ValueError, match="no page"):
        hocr.page_box("<div class='ocr_page'></div>")
    with pytest.raises(ValueError, match="empty box"):
        hocr.words("<span class='ocrx_word' title='bbox 3 2 3 18'>x</span>")
    with pytest.raises(ValueError, match="has no box"):
        hocr.words("<span class='ocrx_word' title='x_wconf 3'>x</span>")
    with pytest.raises(ValueError, match="without an end"):
        hocr.words("<span class='ocrx_word' title='bbox 3 2 5 18'>x")
    assert hocr.fields("bbox 0 0 9 9; image \"a b.png\"; x_size 12.5") == {"bbox": [0, 0, 9, 9], "x_size": [12.5]}


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "one  "), ("d", 2, ""), ("e", 1, "x")], "doc string, page long, text string")
    receipt = {r["doc"]: (r["pages"], r["empty_pages"]) for r in write_text_export(pages, f"file://{tmp_path}/txt").collect()}
    assert receipt == {"d": (2, 1), "e": (1, 0)}
    texts = {r[0] for r in spark.read.text(f"file://{tmp_path}/txt", wholetext=True).select("value").collect()}
    assert "----- Page 1 -----\n\none\n\f----- Page 2 -----\n\n\n\n" in texts
    assert write_verified(pages, f"file://{tmp_path}/pq") == 3


def test_history_in_batch_and_stream(spark, tmp_path):
    rows = [(1, k, a, str(k)) for k, a in enumerate(["edit", "edit", "undo", "redo", "undo", "edit", "redo"])] + [(2, k, "edit", str(k)) for k in range(14)]
    table = spark.createDataFrame(rows, "key long, seq long, action string, tag string")
    table.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    want = sorted(tuple(r) for r in T.history(table).collect())
    assert [w[2:] for w in want if w[0] == 1][-1] == (2, 0, "5")
    assert max(w[2] for w in want) == 10
    stream = spark.readStream.schema(table.schema).parquet(f"file://{tmp_path}/in")
    q = T.history_stream(stream).writeStream.format("memory").queryName("history_out").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("history_out").collect()) == want


def test_quiet_window_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "b"), (1, "2024-01-01 00:00:01", "a"), (1, "2024-01-01 00:00:10", "c"), (1, "2024-01-01 01:00:00", "z")]
    t = spark.createDataFrame(rows, "k long, ts string, p string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["paths"] for r in T.quiet_batches(t, "k", "p").collect()) == [["a", "b"], ["c"], ["z"]]
    t.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    s = spark.readStream.schema(t.schema).parquet(f"file://{tmp_path}/in")
    q = T.quiet_batches(s, "k", "p", delay="10 seconds").writeStream.format("memory").queryName("quiet_out").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["paths"] for r in spark.table("quiet_out").collect()) == [["a", "b"], ["c"]]


def test_decisions(spark):
    p = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00")], "id long, at string").withColumn("at", F.col("at").cast("timestamp"))
    a = spark.createDataFrame([(1, "2024-01-01 00:04:00", "yes"), (2, "2024-01-01 00:06:00", "yes")], "id long, answered string, answer string").withColumn("answered", F.col("answered").cast("timestamp"))
    assert {r["id"]: r["decision"] for r in T.decisions(p, a).collect()} == {1: "yes", 2: "refused"}


def test_hocr_words_are_handed_on_in_parts(spark):
    """All words of a batch of pages were gathered before the first was handed on."""
    from foliospark.sources.hocr import WORDS, hocr_words

    ship(spark)
    word = "<span class='ocrx_word' title='bbox 1 2 3 4'>x</span>"
    page = "<div class='ocr_page' title='bbox 0 0 9 9'>" + word * 500 + "</div>"
    pages = spark.createDataFrame([(k, page if k % 50 else None) for k in range(200)], "id long, hocr string").coalesce(1)
    found = hocr_words(pages, "id", "hocr")
    assert found.groupBy("id").count().where("count = 500").count() == 196

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    assert max(r["n"] for r in found.mapInArrow(sizes, "n long").collect()) < WORDS + 500


def test_robust_fit(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    columns = {"fitted": 25, "few": 8, "two": 2, "one": 1}
    rows = [(k, float(x), 700 - 14.0 * x + float(rng.normal(0, 0.3)) + (70.0 if x % 7 == 3 else 0.0)) for k, n in columns.items() for x in range(1, n + 1)]
    rows += [("rising", float(x), 10.0 * x) for x in range(1, 15)]
    got = {r["k"]: r for r in A.robust_fit(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert set(got) == {"fitted", "few", "two", "rising"}
    for k, r in got.items():
        xs, ys = np.array([(x, y) for g, x, y in rows if g == k]).T
        pitch = np.median([(ys[i] - ys[j]) / (xs[j] - xs[i]) for i, j in itertools.combinations(range(len(xs)), 2)])
        first = np.median(ys + (xs - 1) * pitch)
        near = np.abs(first - (xs - 1) * pitch - ys) <= 0.5 * abs(pitch)
        again = near.sum() >= 10 and pitch > 0
        if again:
            slope, at = np.polyfit(xs[near], ys[near], 1)
            pitch, first = -slope, at + slope
        assert (r["kept"], r["refitted"]) == (near.sum(), again)
        assert (r["pitch"], r["first"]) == pytest.approx((pitch, first))
    assert got["fitted"]["refitted"] and abs(got["fitted"]["pitch"] - 14) < 0.1 and got["fitted"]["kept"] == 21


def test_robust_fit_leaves_out_points_without_a_place(spark):
    """A missing y made the middle of the slopes wrong; points at one x have no slope, and a group of them no line."""
    rows = [("a", float(x), None if x == 3 else 100.0 - 10.0 * x) for x in range(1, 6)] + [("a", None, 7.0), ("b", 1.0, 5.0), ("b", 1.0, 6.0), ("c", 1.0, None), ("c", 2.0, None)]
    got = A.robust_fit(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()
    assert [tuple(r) for r in got] == [("a", 10.0, 90.0, 4, False)]


def test_robust_fit_sorts_no_slopes_in_the_plan(spark):
    """Slopes were sorted by an interpreted comparison, several times for each median."""
    frame = spark.createDataFrame([("a", 1.0, 2.0)], "k string, x double, y double")
    plan = A.robust_fit(frame, ["k"], "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and plan.count("ArrowEvalPython") == 1


def test_aligned(spark):
    items = spark.createDataFrame([("d", 1, "Ab c"), ("d", 2, "--"), ("d", 3, "de"), ("d", 4, "fg"), ("d", 5, "h"), ("e", 1, "x"), (None, 1, "q")], "doc string, n long, text string")
    pieces = spark.createDataFrame([("d", 1, "abc "), ("d", 2, ", "), ("d", 3, "d e f"), ("d", 4, "g"), (None, 1, "q")], "doc string, at long, text string")
    got = {(r["doc"], r["n"]): (r["piece"], r["straddles"]) for r in L.aligned(items, pieces, ["doc"], ["n"], "at").collect()}
    assert got == {("d", 1): (1, False), ("d", 3): (3, False), ("d", 4): (3, True), ("d", 5): (None, None), ("e", 1): (None, None), (None, 1): (1, False)}
    assert L.aligned(items, pieces.limit(0), ["doc"], ["n"], "at").where("piece IS NOT NULL").count() == 0
