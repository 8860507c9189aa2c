"""Find, census and redaction over lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quoted(term: Column) -> Column:
    """A term as a regular expression that matches it literally."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def first_spelling(terms: DataFrame, term: str, order: str) -> DataFrame:
    """Distinct terms, case ignored; the first spelling stays. Adds `needle`, the folded term."""
    folded = terms.withColumn("needle", F.lower(F.trim(F.col(term)))).where("needle <> ''")
    w = Window.partitionBy("needle").orderBy(order)
    return folded.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def find_terms(lines: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """Case-insensitive, non-overlapping hits: a row for each line and term with hits. terms: a short parameter list.

    Lines are matched against all terms in one pass, without a join; only (line, term) with a hit make a row.
    """
    needles = F.array(*[F.lit(t.strip().lower()) for t in terms if t.strip()])
    hits = F.filter(
        F.transform(needles, lambda n: F.struct(n.alias("term"), F.regexp_count(F.lower(F.col(text)), quoted(n)).cast("long").alias("hits"))),
        lambda h: h["hits"] > 0,
    )
    return lines.withColumn("_hit", F.explode(hits)).select(*lines.columns, "_hit.term", "_hit.hits")


def phrase_hits(lines: DataFrame, phrases: DataFrame, words: int, text: str = "text") -> DataFrame:
    """Hits of phrases of exactly `words` words (column `needle`), for phrase tables of any size.

    Every run of `words` words of a line meets the phrases in an equi-join; phrases with no hit drop out.
    """
    kept = [c for c in lines.columns if c != text]

    def grams(own: Column) -> Column:
        # the lambda's variable holds the words, so that a line is split once and not again for every run
        runs = F.transform(F.sequence(F.lit(1), F.size(own) - (words - 1)), lambda i: F.array_join(F.slice(own, i, F.lit(words)), " "))
        return F.when(F.size(own) >= words, runs)

    # lines are dealt out first: a table of few row groups would be cut up in few tasks
    dealt = lines.repartition(*[F.col(c) for c in kept]) if kept else lines
    runs = F.element_at(F.transform(F.array(F.split(F.lower(F.col(text)), " ")), grams), 1)
    exploded = dealt.select(*kept, F.posexplode(runs).alias("word", "needle"))
    return exploded.join(phrases, "needle")


def census(before: DataFrame, after: DataFrame, marked: DataFrame, key: list[str]) -> DataFrame:
    """Per term: occurrences before and after, marked ones, how many are gone, and whether that is proved.

    Proved: at least min(marked, before) are gone, or, where none was marked, none remains.
    """
    b = before.groupBy(*key).agg(F.sum("hits").alias("before"))
    a = after.groupBy(*key).agg(F.sum("hits").alias("remaining"))
    m = marked.groupBy(*key).agg(F.sum("hits").alias("marked"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    all_ = b.join(a, key, "full_outer").join(m, key, "full_outer").select(*key, zero("before"), zero("remaining"), zero("marked"))
    gone = F.greatest(F.lit(0), F.col("before") - F.col("remaining"))
    proved = F.when(F.col("marked") == 0, F.col("remaining") == 0).otherwise(gone >= F.least("marked", "before"))
    return all_.withColumn("destroyed", gone).withColumn("proved", proved)


def repeated_bands(lines: DataFrame, doc: str, page: str, text: Column, least: int = 3, share: float | None = 0.6) -> DataFrame:
    """Normalised lines that recur on max(least, ceil(share * pages)) pages of a document, counted once a page."""
    norm = lines.withColumn("band", text).where("band <> ''")
    found = norm.groupBy(doc, "band").agg(F.countDistinct(page).alias("on_pages"))
    if share is None:
        return found.where(F.col("on_pages") >= least)
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("pages")).where(F.col("pages") >= least)
    return found.join(pages, doc).where(F.col("on_pages") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share))).drop("pages")


def match_ordinals(hits: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """Adds `index`: the ordinal of a hit in its document, from 0."""
    w = Window.partitionBy(doc).orderBy(*order)
    return hits.withColumn("index", (F.row_number().over(w) - 1).cast("long"))
