"""Page algebra: selections, ranges, and edits of a document's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pad_number
from .ordinals import numbered, running


def parse_page_ranges(spec: Column, page_count: Column) -> Column:
    """struct(pages, error): sorted distinct pages of `1-30, 45`, or what is wrong with the first bad part."""
    parts = F.transform(F.split(spec, ","), lambda p: F.regexp_replace(p, r"(?U)\s+", ""))
    first = lambda p: F.regexp_extract(p, "^([0-9]{1,9})", 1).try_cast("int")
    last = lambda p: F.coalesce(F.regexp_extract(p, "-([0-9]{1,9})$", 1).try_cast("int"), first(p))
    problem = F.transform(
        parts,
        lambda p: F.when(~p.rlike("^[0-9]{1,9}(-[0-9]{1,9})?$"), F.concat(F.lit("not a page: "), p))
        .when(last(p) < first(p), F.concat(F.lit("backwards: "), p))
        .when((first(p) < 1) | (last(p) > page_count), F.concat(F.lit("outside the document: "), p)),
    )
    bad = F.element_at(F.filter(problem, lambda e: e.isNotNull()), 1)
    every = F.when(F.size(F.filter(problem, lambda e: e.isNotNull())) == 0, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(first(p), last(p)))))))
    return F.struct(every.alias("pages"), F.when(every.isNull(), bad).alias("error"))


def page_ranges(df: DataFrame, group: list[str], page: str = "page") -> DataFrame:
    """One row per run of consecutive pages: group, first, last. Gaps and islands."""
    w = Window.partitionBy(*group).orderBy(page)
    island = df.withColumn("_island", F.col(page) - F.row_number().over(w))
    return island.groupBy(*group, "_island").agg(F.min(page).alias("first"), F.max(page).alias("last")).drop("_island")


def ranges_text(ranges: DataFrame, group: list[str]) -> DataFrame:
    """Folds page_ranges() to text such as `6, 8, 10–91`."""
    piece = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(
        F.concat(F.col("first").cast("string"), F.lit("–"), F.col("last").cast("string"))
    )
    sorted_pieces = F.array_sort(F.collect_list(F.struct("first", piece.alias("s"))))
    return ranges.groupBy(*group).agg(F.array_join(F.transform(sorted_pieces, lambda x: x["s"]), ", ").alias("pages"))


def extract(pages: DataFrame, chosen: DataFrame, group: list[str]) -> DataFrame:
    """The chosen pages, renumbered from 1; chosen has the group and page columns."""
    kept = pages.join(chosen, [*group, "page"], "left_semi")
    return numbered(kept, group, "page", "new_page")


def delete(pages: DataFrame, gone: DataFrame, group: list[str]) -> DataFrame:
    """The other pages, renumbered from 1. Deleting all pages of a document is an error, when the job runs."""
    marked = pages.join(gone.select(*group, "page").distinct().withColumn("_gone", F.lit(True)), [*group, "page"], "left")
    keys = [f"_k{k}" for k in range(len(group))]
    kept = marked.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]).agg(F.count_if(F.col("_gone").isNull()).alias("_kept"))
    judged = marked.join(kept, [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys, strict=True)])
    message = F.concat(F.lit("a document has to keep a page: "), F.concat_ws(", ", *[F.col(g).cast("string") for g in group]))
    stays = F.when(F.col("_kept") == 0, F.raise_error(message).cast("boolean")).otherwise(F.col("_gone").isNull())
    return numbered(judged.where(stays).drop("_gone", "_kept", *keys), group, "page", "new_page")


def split_parts(pages: DataFrame, parts: DataFrame, group: list[str]) -> DataFrame:
    """A page for each part that holds it. parts: group, part, first, last; parts may overlap."""
    exploded = parts.select(*group, "part", F.explode(F.sequence("first", "last")).alias("page"))
    return pages.join(exploded, [*group, "page"])


def insert_blanks(pages: DataFrame, at: int, n: int, group: list[str], size: tuple[str, ...] = ()) -> DataFrame:
    """n blank pages in front of page `at` of every document (1 to count + 1); the columns named in `size` are those of the
    page before them, of the first page if there is none. Other columns are null.

    Documents with fewer than at - 1 pages stay as they are.
    """
    if not 1 <= n <= 500:
        raise ValueError("1 to 500 blank pages")
    moved = pages.withColumn("page", F.when(F.col("page") >= at, F.col("page") + n).otherwise(F.col("page"))).withColumn("blank", F.lit(False))
    beside = [F.max(F.when(F.col("page") == max(1, at - 1), F.col(c))).alias(c) for c in size]
    counts = pages.groupBy(*group).agg(F.max("page").alias("_n"), *beside).where(F.col("_n") >= at - 1)
    numbers = F.array(*[F.lit(k).cast("long") for k in range(at, at + n)])
    blanks = counts.select(*group, *size, F.explode(numbers).alias("page"), F.lit(True).alias("blank"))
    return moved.unionByName(blanks, allowMissingColumns=True)


def rotate(angle: Column, degrees: Column) -> Column:
    """Clockwise quarter turns added, normalised to 0..270."""
    return F.pmod(angle + degrees, F.lit(360))


def bates(df: DataFrame, group: list[str], order: str, prefix: str, start: int = 1, width: int = 6) -> DataFrame:
    """Adds `label`: prefix and a zero-padded number that runs through the group in order."""
    if not 1 <= width <= 12 or len(prefix) > 32:
        raise ValueError("width 1 to 12, prefix up to 32 characters")
    n = numbered(df, group, order, "_n")
    return n.withColumn("label", F.concat(F.lit(prefix), pad_number(F.col("_n") - 1 + start, width))).drop("_n")


def page_stamp(page: Column, total: Column, template: str, start: int = 1) -> Column:
    """Template with {n} and {total}."""
    return F.replace(
        F.replace(F.lit(template), F.lit("{n}"), (page - 1 + start).cast("string")), F.lit("{total}"), (total - 1 + start).cast("string")
    )


def merge_offsets(documents: DataFrame, order: str) -> DataFrame:
    """documents: one row a document with page_count. Adds first_page, the page at which it starts in the merged file."""
    upto = running(documents, [], order, F.col("page_count"), "_upto")
    return upto.withColumn("first_page", F.col("_upto") - F.col("page_count") + 1).drop("_upto")


def is_permutation(df: DataFrame, group: list[str], target: str) -> DataFrame:
    """Per group: whether `target` names every position 1..n once."""
    return df.groupBy(*group).agg(
        ((F.countDistinct(target) == F.count(F.lit(1))) & (F.min(target) == 1) & (F.max(target) == F.count(F.lit(1)))).alias("complete")
    )


def receipt(before: DataFrame, after: DataFrame, group: list[str], op: str) -> DataFrame:
    """Per group: op, pages_in, pages_out. What every operation proves about itself."""
    a = before.groupBy(*group).agg(F.count(F.lit(1)).alias("pages_in"))
    b = after.groupBy(*group).agg(F.count(F.lit(1)).alias("pages_out"))
    return a.join(b, group, "full_outer").select(
        *group, F.lit(op).alias("op"), F.coalesce("pages_in", F.lit(0)).alias("pages_in"), F.coalesce("pages_out", F.lit(0)).alias("pages_out")
    )
