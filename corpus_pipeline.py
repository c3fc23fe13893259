"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next one. All but the last return the columns of documents.

In every stage columns besides those of documents are not read and go; nulls in doc_id, lang, source and n_chars are kept
as they are; very long texts are read whole; an empty table gives no rows. A row is known by its place, not by its
doc_id, so rows without an id, or with one that another row has as well, are judged each.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import checkpointed, shared_folder
from tidegrid.llm.exact_dedup import exact_dedup
from tidegrid.llm.language_id import NONE, fit_languages, identify
from tidegrid.llm.near_dedup import near_duplicates
from tidegrid.llm.packing import pack_documents
from tidegrid.llm.pii import find_pii, fit_tagger

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_rows(docs: DataFrame) -> DataFrame:
    """docs with row, a number of its own for every row: its file and its place in it, the same each time it is read.

    docs is read from Parquet; anything else is written first.
    """
    try:
        placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        placed = checkpointed(docs.select(*COLUMNS)).select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    files = sorted(r.file for r in placed.select("file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "number long, file string")
    return placed.join(F.broadcast(numbers), "file").select(*COLUMNS, (F.shiftleft("number", 40) + F.col("place")).alias("row"))


def _only_kept(docs: DataFrame, judged: DataFrame, group: str, *order: Column) -> DataFrame:
    """Of each group of judged (doc_id, which is the row of docs, and group) the first row in the given order."""
    named = docs.select("row", F.struct(*order, F.col("doc_id").isNull(), "doc_id", "row").alias("rank"))
    groups = judged.select(F.col("doc_id").alias("row"), F.col(group).alias("group"))
    kept = groups.join(named, "row").groupBy("group").agg(F.min_by("row", "rank").alias("row"))
    return docs.join(kept, "row", "left_semi").select(*COLUMNS)


def _by_row(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("row").alias("doc_id"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, empty or blank texts and those without a letter. Fills in a missing lang.

    Repeated rows stay each. Where no row has a lang, no language is known and lang stays null.
    """
    docs = docs.select(*COLUMNS)
    model = fit_languages(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, model).where(F.col("language.lang_pred") != NONE)
    return found.withColumn("lang", F.coalesce("lang", "language.lang_pred")).select(*COLUMNS)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays: the longest, then that of the smallest doc_id (null last), then the first row. Null, empty and blank texts are equal."""
    docs = _with_rows(docs)
    return _only_kept(docs, exact_dedup(_by_row(docs)), "keep_id", -F.coalesce(F.length("text"), F.lit(0)))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) one document stays: that of the smallest doc_id (null last), then the first row. Null, empty and blank texts stay each."""
    docs = _with_rows(docs)
    return _only_kept(docs, near_duplicates(_by_row(docs)), "component_id")


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind; n_chars follows the text. Null texts stay null, with null n_chars; all rows stay."""
    docs = docs.select(*COLUMNS)
    masked = find_pii(docs, fit_tagger(docs)).withColumn("text", F.col("pii.masked"))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; null and empty texts are an end alone, repeated rows are packed each."""
    # Workers of earlier stages are still there, so a worker keeps fewer words here.
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), kept=60_000)


STAGES = [("language_id", language_id), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("pii", mask_pii), ("packing", pack)]

#: SQL can't express the model's or the tokenizer's work; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = shared_folder(spark, f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
