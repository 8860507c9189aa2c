"""Running heads and page-number fields of a section, induced from the bands of its pages.

Pages are summed up one by one, sections by aggregates over their pages, so that neither needs a section in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_pattern(text: Column) -> Column:
    """A printed number as a field: its first number is {n}, one behind `of` is {total}; the rest is constant."""
    counted = F.regexp_replace(F.trim(text), r"^([^0-9]*)[0-9]+", "$1{n}")
    return F.regexp_replace(counted, r"(of\s*)[0-9]+", "$1{total}")


def page_bands(items: DataFrame, key: list[str]) -> DataFrame:
    """(key, page, header, foot, number, printed): a row for each page. items: key, page, item, text, x, y, role, printed.

    header: the lines of the head, from the top, joined by ` | `; foot: the words of the foot without white space; number: the
    first item that prints a page number; printed: the page's number.
    """

    def band(role: str, sign: str) -> Column:
        own = F.collect_list(F.when(F.col("role") == role, F.struct((-F.col("y")).alias("down"), "x", "item", "text")))
        return F.array_join(F.transform(F.sort_array(own), lambda i: i["text"]), sign)

    number = F.min(F.when(F.col("role") == "page-number", F.struct("item", "text")))["text"]
    return items.groupBy(*key, "page").agg(
        band("header", " | ").alias("header"), F.regexp_replace(band("footer", ""), r"\s+", "").alias("foot"), number.alias("number"), F.first("printed").alias("printed")
    )


def running_heads(bands: DataFrame, key: list[str]) -> DataFrame:
    """One row for each section: pages; header_page and header, read off the first page that has one; numbered_page, pattern and
    start: the number that the section's first page must have for the field to print what the first numbered page does; steady:
    all numbered pages have this pattern and count up with the pages; first_differs: only the first page has no number, and every
    other prints its own place; twin_page: the first numbered page, if the first page has none but the same foot."""
    c = F.col
    numbered, headed = c("number").isNotNull(), c("header") != ""
    at = lambda value, ok: F.min(F.when(ok, F.struct("page", value.alias("v"))))["v"]
    ahead = c("printed") - c("page")
    pattern = number_pattern(c("number"))
    found = bands.groupBy(*key).agg(
        F.count(F.lit(1)).alias("pages"), F.min("page").alias("first_page"), F.min(F.when(headed, c("page"))).alias("header_page"), at(c("header"), headed).alias("header"),
        F.min(F.when(numbered, c("page"))).alias("numbered_page"), at(pattern, numbered).alias("pattern"), at(ahead, numbered).alias("ahead"),
        (F.min(F.when(numbered, pattern)) == F.max(F.when(numbered, pattern))).alias("one_pattern"),
        (F.min(F.when(numbered, ahead)) == F.max(F.when(numbered, ahead))).alias("counts"),
        F.count_if(numbered & (ahead == 0)).alias("in_place"), at(c("foot"), F.lit(True)).alias("first_foot"), at(c("foot"), numbered).alias("numbered_foot"),
    )
    late = F.coalesce(c("numbered_page") != c("first_page"), F.lit(True))
    twin = late & (c("first_foot") != "") & (c("first_foot") == c("numbered_foot"))
    return found.select(
        *key, "pages", "header_page", "header", "numbered_page", "pattern", (c("ahead") + c("first_page")).alias("start"),
        F.coalesce(c("one_pattern") & c("counts"), F.lit(False)).alias("steady"), (late & (c("pages") > 1) & (c("in_place") == c("pages") - 1)).alias("first_differs"),
        F.when(twin, c("numbered_page")).alias("twin_page"),
    )
