"""Files as rows: probes, converter choice, recent lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_extension

# Kinds of input by extension.
KINDS = {
    "word": (".docx", ".doc", ".rtf"),
    "spreadsheet": (".xlsx", ".xls"),
    "presentation": (".pptx", ".ppt"),
    "text": (".txt", ".html", ".htm"),
    "image": (".png", ".jpg", ".jpeg", ".tif", ".tiff"),
    "pdf": (".pdf",),
}


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def is_encrypted(content: Column) -> Column:
    """Whether the token /Encrypt occurs anywhere in the bytes."""
    return F.instr(F.decode(content, "ISO-8859-1"), "/Encrypt") > 0


def input_kind(path: Column) -> Column:
    e = file_extension(path)
    kind = F.lit(None).cast("string")
    for name, extensions in KINDS.items():
        kind = F.when(e.isin(*extensions), name).otherwise(kind)
    return kind


def choose_engine(files: DataFrame, engines: DataFrame, extension: str = "extension") -> DataFrame:
    """The first available engine by priority for each file; files without one keep a null engine.

    engines: engine, extension, priority, available. They are reduced to one row an extension before the join.
    """
    w = Window.partitionBy("extension").orderBy("priority")
    best = engines.where("available").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("extension").alias(extension), "engine")
    return files.join(best, extension, "left")


def recent_files(spark: SparkSession, path: str, schema: str = "path string, opened timestamp", keep: int = 12) -> DataFrame:
    """The latest `keep` distinct paths of a JSON list; broken lines count as nothing."""
    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED").where("path IS NOT NULL")
    return rows.groupBy("path").agg(F.max("opened").alias("opened")).orderBy(F.desc("opened"), "path").limit(keep)
