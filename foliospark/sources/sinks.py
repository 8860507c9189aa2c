"""Sinks and what they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_block(page: Column, text: Column) -> Column:
    """Header, blank line, text without white space at its end, line feed."""
    return F.concat(F.lit("----- Page "), page.cast("string"), F.lit(" -----\n\n"), F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", ""), F.lit("\n"))


def write_text_export(pages: DataFrame, path: str, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """One text file part per document under path/doc=..., pages joined by form feeds; returns doc, pages and empty pages.

    A document whose pages are all empty is an error. The files are read again and counted before the receipt returns.
    """
    blocks = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), page_block(F.col(page), F.col(text)).alias("b"))))
    empty = F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) == "")
    out = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), empty.alias("empty_pages"), F.array_join(F.transform(blocks, lambda x: x["b"]), "\f").alias("value"))
    out = out.withColumn("value", F.when(F.col("pages") == F.col("empty_pages"), F.raise_error(F.concat(F.lit("no text in "), F.col(doc).cast("string"))).cast("string")).otherwise(F.col("value")))
    out.select(doc, "value").write.partitionBy(doc).text(path)
    again = pages.sparkSession.read.text(path, wholetext=True).agg(F.count(F.lit(1))).first()[0]
    receipt = out.select(doc, "pages", "empty_pages")
    wanted = receipt.count()
    if again != wanted:
        raise ValueError(f"{wanted} documents, but {again} files")
    return receipt


def write_verified(df: DataFrame, path: str) -> int:
    """Writes Parquet, reads it again and compares the row counts; returns the count."""
    df.write.parquet(path)
    wanted, found = df.count(), df.sparkSession.read.schema(df.schema).parquet(path).count()
    if wanted != found:
        raise ValueError(f"{wanted} rows, but {found} were written")
    return found


#: Writers by format name.
EXPORTERS = {"txt": write_text_export, "parquet": write_verified}
