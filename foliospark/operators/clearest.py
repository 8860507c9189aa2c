"""The clearest of several readings of the same foot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the format: readings that are compared, and how many it takes.
SAMPLE, LEAST = 12, 3


def letter_pairs(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, without white space and in upper case."""
    chars = F.split(F.upper(F.regexp_replace(text, r"\s+", "")), "")
    n = F.size(chars)
    both = F.zip_with(F.slice(chars, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(both, lambda g: F.length(g) == 2))


def likeness(a: Column, b: Column) -> Column:
    """Dice's share of two sets: 1 for equal ones, 0 where one is empty."""
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def clearest_feet(feet: DataFrame) -> DataFrame:
    """(doc, feet, best_page, score): the page whose foot the others bear out most, by the sum of likenesses to all of them.

    feet: doc, page, text, hidden, numbered; a null or empty text is no foot. The first twelve feet of a document are compared, as
    more say nothing new about a foot that repeats; the window's limit leaves the rest behind before the exchange. Where one has a
    page number, only those that have one can be best. With fewer than three feet, or printed ones among them, it is the
    first of the document's pages, without a score. Scores are compared to nine decimals, equal ones by page.
    """
    c = F.col
    first = feet.groupBy("doc").agg(F.min("page").alias("first_page"))
    w = Window.partitionBy("doc").orderBy("page")
    some = feet.where(F.length("text") > 0).withColumn("_k", F.row_number().over(w)).where(c("_k") <= SAMPLE)
    row = F.struct("page", F.coalesce("hidden", F.lit(False)).alias("hidden"), F.coalesce("numbered", F.lit(False)).alias("numbered"), letter_pairs(c("text")).alias("pairs"))
    lists = some.groupBy("doc").agg(F.sort_array(F.collect_list(row)).alias("f")).withColumn("any", F.exists("f", lambda x: x["numbered"]))

    def scored(x: Column) -> Column:
        total = F.aggregate("f", F.lit(0.0), lambda s, o: s + likeness(x["pairs"], o["pairs"]))
        return F.struct((-F.round(total, 9)).alias("minus"), x["page"].alias("page"))

    ranked = F.array_min(F.transform(F.filter("f", lambda x: x["numbered"] == c("any")), scored))
    judged = (F.size("f") >= LEAST) & F.forall("f", lambda x: x["hidden"])
    best = lists.select("doc", F.size("f").alias("feet"), F.when(judged, ranked).alias("b"))
    found = first.join(best, "doc", "left")
    return found.select("doc", F.coalesce("feet", F.lit(0)).alias("feet"), F.coalesce("b.page", "first_page").alias("best_page"), (-c("b.minus")).alias("score"))
