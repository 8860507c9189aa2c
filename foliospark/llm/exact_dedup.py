"""Operator 10, exact dedup: group by a 128-bit content hash, keep one row, compare bytes inside groups. Native."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

_TOP = 9223372036854775807
_STEP = "100000000000000000000"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the columns of `carry` as c0, c1, ...

    Texts are equal when identical without `[\\x20\\x09-\\x0D]`; the longest original (in code points), then the
    smallest id, stays. The group key is the MD5 of the normalised text together with that text, so rows only share
    a group when their bytes agree. Groups go back to the rows by (MD5, SHA-256); should two different texts agree in
    both, the job stops with an error instead of merging them.

    Copies are counted before the shuffle; the join back has no aggregate on top, so that adaptive execution can
    split a hot group. Null texts count as empty. Of rows that tie in length a null id comes last, and keep_id is null where
    such a row stays. Rows of a group that agree in id and length, such as repeated rows, are all kept or all dropped.
    Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)],
    )
    carried = rows.columns[2:]
    rows = rows.select(
        "doc_id", *carried, F.length("text").alias("n_chars"), F.regexp_replace("text", SPACE_CLASS, "").alias("norm")
    ).withColumn("content_hash", F.unhex(F.md5("norm")))
    # Longest first, then smallest id, as one number: a fixed-width buffer that hash aggregation can update in place.
    rank = F.col("n_chars").cast("decimal(12,0)") * F.lit(_STEP).cast("decimal(21,0)") + (
        F.lit(_TOP).cast("decimal(20,0)") - F.coalesce("doc_id", F.lit(_TOP)).cast("decimal(20,0)")
    )
    groups = (
        rows.groupBy("content_hash", "norm")
        .agg(F.count(F.lit(1)).alias("size"), F.max(rank).alias("best"))
        .select("content_hash", F.sha2("norm", 256).alias("text_sha256"), "size", "best")
        .groupBy("content_hash", "text_sha256")
        .agg(F.sum("size").alias("size"), F.max("best").alias("best"), F.count(F.lit(1)).alias("texts"))
        .select(
            "content_hash",
            "text_sha256",
            F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long"))
            .otherwise(F.col("size"))
            .alias("group_size"),
            "best",
            F.nullif((F.lit(_TOP).cast("decimal(20,0)") - F.col("best") % F.lit(_STEP).cast("decimal(21,0)")).cast("long"), F.lit(_TOP)).alias(
                "keep_id"
            ),
        )
    )
    keyed = rows.select("doc_id", *carried, "content_hash", F.sha2("norm", 256).alias("text_sha256"), rank.alias("rank"))
    return keyed.join(groups, ["content_hash", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("rank") == F.col("best")).alias("kept"),
        "text_sha256",
        *carried,
    )
