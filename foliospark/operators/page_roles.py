"""Page classifier: what each item on a page is for, by evidence of the page and of its document.

items: doc, page (from 1), item, text, x, y, width, height, page_width, page_height; y grows upwards, and item numbers are in
reading order. A page's items are one window group; texts of a document's bands are counted in a plain aggregation, so a document
of any length spreads over tasks.

1. Line-number stacks: bare numbers whose right edges are near one another and whose values rise down the page.
2. From three stacks on, a sheet holds several small pages; each stack says in which quadrant it stands.
3. The printed page number: the best candidate at the foot by a score, or the number above a quadrant.
4. Bands: texts that repeat at the head or foot of most pages of the document.
5. Roles, in this precedence: line-number, page-number, stamp, header or footer, body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import looks_like_bates, printed_page
from .layout import clusters, islands

# Fixed values of the format.
LAST_LINE, LEAST_STACK, SAME_EDGE, LEAST_STACKS = 28, 5, 8.0, 3
BAND, EDGE, WIDE, FOOT, DEEP = 0.08, 0.06, 0.12, 0.12, 0.06
REPEAT_SHARE, LEAST_PAGES = 0.6, 3
TRUSTED_OFFSET, DECISIVE, CEILING = 20, 3, 0.2

PAGE = ["doc", "page"]


def _centred(items: DataFrame) -> DataFrame:
    c = F.col
    return items.withColumn("cx", c("x") + c("width") / 2).withColumn("cy", c("y") + c("height") / 2).withColumn("right", c("x") + c("width"))


def quadrant(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """0 top left, 1 bottom left, 2 top right, 3 bottom right: the reading order of a sheet of four pages."""
    return F.when(cx > width / 2, 2).otherwise(0) + F.when(cy > height / 2, 0).otherwise(1)


def number_stacks(items: DataFrame) -> DataFrame:
    """Line-number items with their value, stack and quadrant (null on an ordinary page)."""
    digits = F.trim("text")
    bare = F.when(digits.rlike("^[0-9]{1,2}$"), digits.cast("int"))
    some = _centred(items).withColumn("value", bare).where(F.col("value").between(1, LAST_LINE))
    banded = clusters(some, PAGE, "right", SAME_EDGE)
    down = [F.desc("cy"), "item"]
    last = F.lag("value").over(Window.partitionBy(*PAGE, "cluster").orderBy(*down))
    stacked = islands(banded, [*PAGE, "cluster"], down, F.col("value") <= last, "run")
    own, page = Window.partitionBy(*PAGE, "cluster", "run"), Window.partitionBy(*PAGE)
    kept = stacked.withColumn("n", F.count(F.lit(1)).over(own)).where(F.col("n") >= LEAST_STACK)
    kept = kept.withColumn("stack", F.min("item").over(own))
    kept = kept.withColumn("stacks", F.size(F.collect_set("stack").over(page)))
    where = quadrant(F.percentile("cx", 0.5).over(own), F.percentile("cy", 0.5).over(own), F.col("page_width"), F.col("page_height"))
    kept = kept.withColumn("quadrant", F.when(F.col("stacks") >= LEAST_STACKS, where))
    return kept.select(*PAGE, "item", "value", "stack", "quadrant", "x", "right", "cy", "height", "page_height")


def columns(stacks: DataFrame) -> DataFrame:
    """(doc, page, stack, quadrant, left, right, top, height, numbers, ceiling): the stacks as line-number columns. ceiling is
    a quarter of a line below the last number, null if that is too high up to be the last line of the page."""
    own = Window.partitionBy(*PAGE, "stack").orderBy(F.desc("cy"), "item")
    gaps = stacks.withColumn("gap", F.lag("cy").over(own) - F.col("cy"))
    found = gaps.groupBy(*PAGE, "stack").agg(
        F.first("quadrant").alias("quadrant"), F.min("x").alias("left"), F.max("right").alias("right"), F.max("cy").alias("top"),
        F.min_by("height", "value").alias("height"), F.collect_set("value").alias("numbers"), F.first("page_height").alias("page_height"),
        F.min("cy").alias("bottom"), F.percentile("gap", 0.5).alias("gap"),
    )
    ceiling = F.col("bottom") - F.when(F.col("gap") > 0, F.col("gap")).otherwise(12.0) / 4
    low = F.col("quadrant").isNull() & (ceiling < F.col("page_height") * CEILING)
    return found.withColumn("ceiling", F.when(low, ceiling)).drop("bottom", "gap", "page_height")


def quadrant_numbers(items: DataFrame, cols: DataFrame) -> DataFrame:
    """(doc, page, quadrant, number, item): the printed number above the first column of each quadrant, the rightmost one;
    null where there is none."""
    first = Window.partitionBy(*PAGE, "quadrant").orderBy("left", "stack")
    lead = cols.where(F.col("quadrant").isNotNull()).withColumn("k", F.row_number().over(first)).where("k = 1")
    lead = lead.select(*PAGE, "quadrant", F.col("left").alias("column_left"), "top", F.col("height").alias("band"))
    own = _centred(items).withColumn("number", printed_page(F.col("text"))).where("number IS NOT NULL")
    own = own.withColumn("quadrant", quadrant(F.col("cx"), F.col("cy"), F.col("page_width"), F.col("page_height")))
    above = own.join(lead, [*PAGE, "quadrant"]).where("cy > top AND cy < top + band * 4 AND x >= column_left")
    best = above.groupBy(*PAGE, "quadrant").agg(F.max(F.struct("right", (-F.col("item")).alias("order"), "number", "item")).alias("best"))
    return lead.select(*PAGE, "quadrant").join(best.select(*PAGE, "quadrant", "best.number", "best.item"), [*PAGE, "quadrant"], "left")


def printed_numbers(items: DataFrame, cols: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc, page, multi_up, ceiling, printed, confidence, number_items): a row for each page."""
    c = F.col
    foot = _centred(items).where(c("y") <= c("page_height") * FOOT).withColumn("number", printed_page(c("text"))).where("number IS NOT NULL")
    by_page = cols.groupBy(*PAGE).agg(
        F.collect_list(F.struct("left", "right", "numbers")).alias("columns"), F.min("ceiling").alias("ceiling")
    )
    foot = foot.join(by_page.select(*PAGE, "columns"), PAGE, "left")
    inside = lambda k: (c("x") >= k["left"] - 4) & (c("right") <= k["right"] + 4)
    goes_on = lambda k: (F.abs(c("cx") - (k["left"] + k["right"]) / 2) < 20) & F.array_contains(k["numbers"], c("number"))
    free = foot.where(~F.coalesce(F.exists("columns", lambda k: inside(k) | goes_on(k)), F.lit(False)))
    off = F.abs(c("number") - c("page"))
    score = (
        off + F.when(F.abs(c("cx") - c("page_width") / 2) > c("page_width") * 0.15, 4).otherwise(0)
        + F.when((c("number") <= LAST_LINE) & (off > 10), 8).otherwise(0) + F.when(c("y") < c("page_height") * DEEP, 0).otherwise(2)
    )
    ranked = free.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(score.alias("score"), "item", "number"))).alias("all"))
    best, second = F.get("all", 0), F.get("all", 1)
    sure = (F.abs(best["number"] - c("page")) <= TRUSTED_OFFSET) & F.coalesce(second["score"] - best["score"] >= DECISIVE, F.lit(True))
    alone = ranked.select(*PAGE, best["number"].alias("best"), best["item"].alias("best_item"), F.when(sure, "high").otherwise("low").alias("best_confidence"))
    # the first small page in reading order: by printed numbers if each quadrant has one, else by place
    sheets = plan.groupBy(*PAGE).agg(
        (F.count(F.lit(1)) > 1).alias("multi_up"), F.bool_and(c("number").isNotNull()).alias("told"), F.min_by("number", "number").alias("least"),
        F.min_by(F.struct("number"), "quadrant")["number"].alias("first"), F.collect_set("item").alias("minis"),
    )
    pages = items.select(*PAGE).distinct().join(by_page.select(*PAGE, "ceiling"), PAGE, "left").join(sheets, PAGE, "left").join(alone, PAGE, "left")
    multi = F.coalesce("multi_up", F.lit(False))
    mini = F.when(multi, F.when(c("told"), c("least")).otherwise(c("first")))
    return pages.select(
        *PAGE, multi.alias("multi_up"), F.when(~multi, c("ceiling")).alias("ceiling"), F.coalesce(mini, c("best")).alias("printed"),
        F.when(mini.isNotNull(), "high").otherwise(F.coalesce("best_confidence", F.lit("low"))).alias("confidence"),
        F.concat(F.when(multi, c("minis")).otherwise(F.array()), F.when(mini.isNull() & c("best_item").isNotNull(), F.array("best_item")).otherwise(F.array())).alias("number_items"),
    )


def band_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[0-9]", "#"), r"\s+", " ")


def repeated_texts(items: DataFrame) -> DataFrame:
    """(doc, band): texts without their digits that stand at the head or foot of LEAST_PAGES and REPEAT_SHARE of the pages."""
    c = F.col
    centred = _centred(items)
    n_pages = items.groupBy("doc").agg(F.count_distinct("page").alias("n"))
    there = centred.where((c("cy") > c("page_height") * (1 - BAND)) | (c("cy") < c("page_height") * WIDE))
    there = there.withColumn("band", band_key(c("text"))).where("band <> ''")
    counts = there.select(*PAGE, "band").distinct().groupBy("doc", "band").agg(F.count(F.lit(1)).alias("times"))
    least = F.greatest(F.lit(LEAST_PAGES), F.ceil(c("n") * F.lit(REPEAT_SHARE)))
    return counts.join(n_pages, "doc").where(c("times") >= least).select("doc", "band")


def classified(items: DataFrame) -> DataFrame:
    """items with role, and the facts of their page: printed, confidence, multi_up."""
    c = F.col
    stacks = number_stacks(items)
    cols = columns(stacks)
    facts = printed_numbers(items, cols, quadrant_numbers(items, cols))
    numbers = stacks.select(*PAGE, "item", F.lit(True).alias("numbered"))
    repeats = repeated_texts(items).withColumn("repeats", F.lit(True))
    all_items = _centred(items).withColumn("band", band_key(c("text"))).join(facts, PAGE).join(numbers, [*PAGE, "item"], "left")
    all_items = all_items.join(repeats, ["doc", "band"], "left")
    h, cy, again = c("page_height"), c("cy"), F.coalesce("repeats", F.lit(False))
    at_edge = (cy > h * (1 - EDGE)) | (cy < h * EDGE)
    strict = (
        F.when(cy > h * (1 - BAND), F.when(again | at_edge, "header"))
        .when(cy < h * BAND, F.when(again | at_edge, "footer"))
        .when(again & (cy < h * WIDE), "footer")
    )
    band = F.when(~c("multi_up"), F.when(cy < c("ceiling"), "footer").when(c("ceiling").isNotNull() & (cy < h * WIDE), F.lit(None)).otherwise(strict))
    role = (
        F.when(c("numbered"), "line-number")
        .when(F.array_contains("number_items", c("item")), "page-number")
        .when(band.isNotNull() & looks_like_bates(c("text")), "stamp")
        .otherwise(F.coalesce(band, F.lit("body")))
    )
    return all_items.select(*items.columns, role.alias("role"), "printed", "confidence", "multi_up")
