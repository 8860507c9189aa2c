"""Operator 5, sharding: k-d tree over metadata, split at distributed weighted medians. Native."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, running_totals, written


def kd_shards(
    docs: DataFrame,
    target_bytes: int | None = None,
    n_shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    labels: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 1. Every node of the tree is split along the metadata dimension (size, id, and
    a hash of each label column) that is widest within it relative to the whole table; the cut is the weighted
    median by bytes, ties broken by id, so that a label value that holds a third of all rows is split too. Leaves:
    n_shards, or total bytes over target_bytes, rounded up. slot counts the rows of a shard from 0, by id.

    The medians come from range-partitioned running sums; no task sees a whole node. Null texts weigh 1 byte; null
    labels and ids sort first (a null id stays null); equal rows may lie in any order; an empty table gives no rows.
    """
    if (target_bytes is None) == (n_shards is None):
        raise ValueError("give target_bytes or n_shards")
    present = [c for c in labels if c in docs.columns]
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    meta = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        *[F.pmod(F.xxhash64(F.col(c)), F.lit(1 << 20)).alias(f"label{k}") for k, c in enumerate(present)],
    )
    meta = written(meta.withColumn("order_id", F.coalesce("doc_id", F.lit(-(1 << 63)))), "kd-meta")
    dims = ["size", "order_id", *[f"label{k}" for k in range(len(present))]]
    if n_shards is None:
        total = meta.agg(F.sum("size")).first()[0] or 1
        n_shards = max(1, math.ceil(total / target_bytes))
    whole = meta.agg(*[(F.max(c).cast("double") - F.min(c)).alias(c) for c in dims]).first()
    spans = {c: max(1.0, float(whole[c] or 0)) for c in dims}
    n_leaves = n_shards
    last = meta
    rows = meta.withColumn("shard", F.lit(0)).withColumn("leaves", F.lit(n_shards))
    while n_shards > 1:
        # a node holds the leaves shard .. shard + leaves - 1
        widths = [(F.max(c).cast("double") - F.min(c)) / F.lit(spans[c]) for c in dims]
        nodes = rows.groupBy("shard").agg(*[w.alias(f"w{k}") for k, w in enumerate(widths)])
        all_widths = F.array(*[f"w{k}" for k in range(len(dims))])
        nodes = nodes.select("shard", F.array_position(all_widths, F.array_max(all_widths)).cast("int").alias("dim"))
        if n_leaves <= 100_000:  # one row per node, so at most this many
            nodes = F.broadcast(nodes)
        along = rows.join(nodes, "shard").withColumn("along", F.element_at(F.array(*[F.col(c) for c in dims]), F.col("dim")))
        cut = running_totals(along.drop("dim"), ["shard", "leaves"], ["along", "order_id"], "size", "kd-level")
        left = F.floor(F.col("leaves") / 2).cast("int")
        goes_left = (F.col("before") + F.col("size") / 2) * F.col("leaves") <= F.col("total") * left
        rows = cut.select(
            "doc_id", "size", "text_crc32", *[c for c in dims if c != "size"],
            F.when((F.col("leaves") == 1) | goes_left, F.col("shard")).otherwise(F.col("shard") + left).alias("shard"),
            F.when(F.col("leaves") == 1, 1).when(goes_left, left).otherwise(F.col("leaves") - left).alias("leaves"),
        )
        before, rows = last, written(rows, "kd-level")
        last = rows
        discard(cut)
        discard(before)
        n_shards = math.ceil(n_shards / 2)
    ranked = running_totals(rows.withColumn("one", F.lit(1)), ["shard"], ["order_id"], "one", "kd-slots")
    return ranked.select("doc_id", "size", "text_crc32", "shard", F.col("before").alias("slot"))
