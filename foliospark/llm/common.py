"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given table; also makes sure that Python workers can import this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Where none is set, a local session gets a folder of
    its machine; on a cluster that is an error, as each executor would write to its own disk."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='foliospark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table of written(), or the one that a frame of running_totals() reads, when no later step reads it."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table._written_to)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def running_totals(df: DataFrame, group: list[str], order: list[str], weight: str, name: str) -> DataFrame:
    """Adds `before` (sum of weight over earlier rows of the group) and `total` (of the group).

    No task holds a whole group: rows are range-partitioned by group and order, each range is summed, and the few
    range sums are added up. The ranged rows are written once, so that both reads see the same ranges. Group columns
    must not be null; rows that tie in `order` follow one another in any order.
    """
    n = shuffle_partitions(df.sparkSession)
    keys = [*group, *order]
    ranged = written(df.repartitionByRange(n, *keys).withColumn("range_id", F.spark_partition_id()), name)
    sums = ranged.groupBy(*group, "range_id").agg(F.sum(weight).alias("range_sum"))
    to_here = Window.partitionBy(*group).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        *group,
        "range_id",
        F.coalesce(F.sum("range_sum").over(to_here), F.lit(0)).alias("range_base"),
        F.sum("range_sum").over(Window.partitionBy(*group)).alias("total"),
    )
    inside = Window.partitionBy(*group, "range_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    result = (
        ranged.withColumn("run", F.sum(weight).over(inside))
        .join(bases, [*group, "range_id"])
        .withColumn("before", (F.col("range_base") + F.col("run") - F.col(weight)).cast("long"))
        .drop("run", "range_id", "range_base")
    )
    result._written_to = ranged._written_to
    return result


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A number for each row, never negative, that no two different rows share: the id where all ids are distinct whole numbers
    (they pack well), else a hash of id and text. That no two different rows agree in it is checked, so a collision only
    means another seed. Rows equal in id and text then share it, and what holds for one holds for the other. Unlike a
    row's place it is the same whatever executors come and go."""
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        by_id = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        if by_id.where("id is null or id < 0 or n > 1").isEmpty():
            return F.col(id_col).cast("long")
    for seed in range(100):
        key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).bitwiseAND((1 << 63) - 1)
        content = F.md5(F.concat_ws(":", F.col(id_col).isNull().cast("string"), F.col(id_col).cast("string"), F.col(text_col)).cast("binary"))
        by_key = docs.select(key.alias("key"), content.alias("c")).groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"))
        if by_key.where("a <> b").isEmpty():
            return key
    raise RuntimeError("no seed tells the rows apart")


def hash_words(words: list[bytes], key: str = "0123456789123456") -> np.ndarray:
    """64-bit SipHash of each word, under a key of 16 characters."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), hash_key=key, categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number: the fixed split into folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
