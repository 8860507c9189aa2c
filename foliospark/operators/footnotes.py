"""Footnotes at the foot of pages: found under their separator, paired with their references, lifted while numbers run on.

paragraphs: doc, page, paragraph (in reading order), kind ('text' or another), first (first baseline), bottom, size, leading,
hidden, column (from 1). marks: doc, page, paragraph, run, number: raised runs that print a number alone; run 1 opens its
paragraph. lines: doc, page, baseline, x, right. rules: doc, page, rule, x, y, width, height. y grows upwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordinals import ranges, running

# Fixed values of the format.
LEAST_WIDTH, MOST_WIDTH, MOST_HEIGHT = 100.0, 200.0, 1.5
REACH, UNDERLINE, ROOM, BASELINE = 2.5, 4.0, 3.5, 0.8

PAGE = ["doc", "page"]


def _page_rows(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    return rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def noted_pages(rules: DataFrame, paragraphs: DataFrame, marks: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, page, body, under, numbers, marks, columns): pages with footnotes, their paragraphs above and under the separator, and
    the number that opens each one under it (null if none does).

    The separator is the only short thin rule over a paragraph that a note's number opens, near enough, and not under a line as
    its underline. Each row set is brought together by page once, as arrays; nothing else is shuffled.
    """
    c = F.col
    page = _page_rows(paragraphs, ["paragraph", "kind", "first", "bottom", "size", "leading", "hidden", "column"], "all")
    short = rules.where((c("height") <= MOST_HEIGHT) & c("width").between(LEAST_WIDTH, MOST_WIDTH))
    page = page.join(_page_rows(short, ["rule", "x", "y", "width"], "rules"), PAGE).join(_page_rows(marks, ["paragraph", "run", "number"], "marks"), PAGE)
    page = page.join(_page_rows(lines, ["baseline", "x", "right"], "lines"), PAGE, "left")

    def opening(paragraph: F.Column) -> F.Column:
        return F.get(F.filter("marks", lambda m: (m["paragraph"] == paragraph) & (m["run"] == 1)), 0)["number"]

    def separates(r: F.Column) -> F.Column:
        below = F.get(F.filter("all", lambda p: p["first"] < r["y"]), 0)
        near = (below["kind"] == "text") & (r["y"] - below["first"] <= REACH * below["size"]) & opening(below["paragraph"]).isNotNull()
        underlined = F.exists(
            "lines", lambda k: (k["baseline"] >= r["y"]) & (k["baseline"] - r["y"] <= UNDERLINE) & (k["x"] < r["x"] + r["width"]) & (k["right"] > r["x"])
        )
        return near & ~F.coalesce(underlined, F.lit(False))

    page = page.withColumn("found", F.filter("rules", separates)).where(F.size("found") == 1).withColumn("y", c("found")[0]["y"])
    page = page.withColumn("under", F.filter("all", lambda p: p["first"] < c("y"))).withColumn("body", F.filter("all", lambda p: p["first"] >= c("y")))
    return page.select(
        *PAGE, "body", "under", F.transform("under", lambda p: opening(p["paragraph"])).alias("numbers"), "marks",
        F.array_max(F.transform("all", lambda p: p["column"])).alias("columns"),
    )


def _above(marks: str, number: F.Column) -> F.Column:
    """The marks in the text above the separator that print a number."""
    return F.filter(marks, lambda m: (m["number"] == number) & F.exists("body", lambda p: p["paragraph"] == m["paragraph"]))


def pairings(noted: DataFrame) -> DataFrame:
    """noted_pages() with first_number, n_notes and sound: whether all that stands under the rule is visible text, its numbers
    follow one another from the first paragraph on, each has exactly one mark in the text above, the page has one column, and
    between text and notes there is ROOM. Paragraphs without a number go on with the note before."""
    c = F.col
    printed = noted.withColumn("printed", F.filter("numbers", lambda n: n.isNotNull())).withColumn("first_number", c("numbers")[0])
    visible = F.forall("under", lambda p: (p["kind"] == "text") & ~p["hidden"])
    runs_on = F.forall(F.transform("printed", lambda n, k: n == c("first_number") + k), lambda x: x)
    paired = F.forall("printed", lambda n: F.size(_above("marks", n)) == 1)
    room = F.array_min(F.transform("body", lambda p: p["bottom"])) - (c("under")[0]["first"] + BASELINE * c("under")[0]["leading"])
    sound = visible & c("first_number").isNotNull() & runs_on & paired & (c("columns") == 1) & (room >= ROOM)
    return printed.select("*", F.size("printed").cast("long").alias("n_notes"), F.coalesce(sound, F.lit(False)).alias("sound"))


def lifted(offered: DataFrame) -> DataFrame:
    """Adds `kind`: 'lifted' while a document's pages are sound and their numbers run on from page to page, 'kept' from the first
    failure on. Sums up to a page are taken over ranges of pages, so a document of any length spreads over tasks."""
    c = F.col
    cut = ranges(offered, "page")
    counted = running(offered, ["doc"], "page", c("n_notes"), "upto", cut)
    good = c("sound") & (c("first_number") == 1 + c("upto") - c("n_notes"))
    failed = running(counted, ["doc"], "page", (~good).cast("long"), "failures", cut)
    return failed.select(*offered.columns, F.when(c("failures") == 0, "lifted").otherwise("kept").alias("kind"))


def footnotes(pages: DataFrame) -> DataFrame:
    """(doc, page, number, paragraphs, mark_paragraph, mark_run): the notes of the lifted pages, with the one mark of each."""
    # how many notes are open at each paragraph under the separator
    opened = F.transform("numbers", lambda n, k: F.size(F.filter(F.slice("numbers", 1, k + 1), lambda m: m.isNotNull())))
    some = pages.where("kind = 'lifted'").withColumn("opened", opened).select("*", F.posexplode("printed").alias("k", "number"))
    own = F.transform(F.filter(F.arrays_zip("under", "opened"), lambda z: z["opened"] == F.col("k") + 1), lambda z: z["under"]["paragraph"])
    mark = _above("marks", F.col("number"))[0]
    return some.select(*PAGE, "number", own.alias("paragraphs"), mark["paragraph"].alias("mark_paragraph"), mark["run"].alias("mark_run"))
