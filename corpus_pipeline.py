"""From raw documents to packed training sequences: five stages, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import discard, written
from foliospark.llm.exact_dedup import exact_dedup
from foliospark.llm.language_id import identify, train
from foliospark.llm.ngram_join import ngram_join
from foliospark.llm.packing import pack
from foliospark.llm.queries import tokenizer
from foliospark.llm.substring_dedup import substring_dedup
from foliospark.session import ship

#: A document whose best language has a smaller share of its letters is rejected.
LEAST_LANGUAGE_SHARE = 0.4
#: Ids beyond all others, for documents without one.
NO_ID = 1 << 62


def _row(docs: DataFrame) -> Column:
    """A number of its own for each row of a Parquet table, the same in every read of it."""
    return F.monotonically_increasing_id()


def _free(name: str, docs: DataFrame) -> str:
    """The name, or one like it that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in which no language reaches LEAST_LANGUAGE_SHARE of the letters.

    Learns from all documents that have a lang; if none has, nothing can be told and every document stays. Row by row:
    null ids and repeated rows are no matter, null and empty texts have no letter and go; columns of any name stay.
    """
    model = train(docs)
    if not model.languages:
        return docs
    found = identify(docs, model, carry=tuple(docs.columns))
    good = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SHARE))
    return good.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the longest, then the one with the smallest id.

    Of repeated rows one stays; a row without an id stays if its text is the only or longest one; null texts are empty and
    equal to one another; columns of any name stay.
    """
    row = _free("row_number", docs)
    rows = docs.withColumn(row, _row(docs))
    one = exact_dedup(rows, carry=(row,)).where("kept").groupBy("text_sha256").agg(F.min("c0").alias(row))
    return rows.join(one, row, "left_semi").select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (5 words, similarity 0.8).

    Rows are told apart by their number, so repeated rows are near duplicates of one another and null ids are no matter
    (they come last in their group); texts without a word are in no group and stay; columns of any name stay.
    """
    row = _free("row_number", docs)
    rows = docs.withColumn(row, _row(docs))
    grouped = ngram_join(rows, id_col=row).where("n_links > 0").select(F.col("doc_id").alias(row), "component_id")
    ids = rows.select(row, F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"))
    grouped = grouped.join(ids, row)
    first = grouped.groupBy("component_id").agg(F.min(F.struct("id", row))[row].alias("first"))
    gone = grouped.join(first, "component_id").where(F.col(row) != F.col("first")).select(row)
    return rows.join(gone, row, "left_anti").select(docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of 20 words or more out of all but their first document; empty rests go.

    Documents come by id, those without one last, each by itself; repeated rows are one document and stay or are cut
    alike; null texts and texts without a word stay. n_chars follows the text where that is cut; columns of any name stay.
    """
    key = _free("cut_key", docs)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + _row(docs)))
    rest = [c for c in docs.columns if c != "text"]
    found = substring_dedup(keyed, id_col=key, carry=tuple(rest)).where("n_removed = 0 or n_removed < n_words")
    columns = {c: F.col(f"c{k}") for k, c in enumerate(rest)} | {"text": F.col("kept_text")}
    if "n_chars" in rest:
        length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(columns["n_chars"])
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 4,096 tokens; the last stage, so it returns pieces.

    Every row is packed, also repeated ones and those without an id; null texts are an end alone.
    """
    return pack(docs, tokenizer("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _shipped(language_stage)),
    ("exact_dedup", _shipped(exact_stage)),
    ("ngram_join", _shipped(near_stage)),
    ("substring_dedup", _shipped(substring_stage)),
    ("packing", _shipped(packing_stage)),
]

#: Several stages (Viterbi, tokens) can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
