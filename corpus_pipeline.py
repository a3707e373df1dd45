"""A training corpus from `documents`: quality, exact copies, near copies, repeated passages, packing.

Every stage works on all rows its predecessor kept and returns the columns of documents, but for the last one, which
returns packed pieces. Decisions are about rows, told by id and text, so that rows without id or with one id twice are
judged each. A null text counts as empty, an empty table gives an empty table, and other columns are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm.common import documents, row_key, small, staged
from siftspark.llm.exact_dedup import exact_groups, normalised
from siftspark.llm.jaccard import jaccard_components
from siftspark.llm.packing import pack_documents
from siftspark.llm.resampling import resample
from siftspark.llm.substrings import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows (doc_id, row) of gone; texts are shuffled only if gone is too large to be broadcast."""
    rows = docs.select(*COLUMNS, row_key("doc_id", "text").alias("row"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).distinct()
    gone = small(gone, gone.count(), 32)
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["row"] == gone["gone_row"]), "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws. Rows with one id and text are drawn or rejected together, as their keys are equal."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without(docs, resample(docs, labels, (F.col("quality") == 1) & (F.col("toxic") == 0)).filter("not kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts that are equal but for white space; rows without id come last, and a repeated row stays once."""
    ids = exact_groups(docs).groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("any"), F.count(F.lit(1)).alias("n"))
    ids = staged(ids.filter("not any or n > 1"), "copies", 1 + docs.count() // (1 << 20))
    rows = docs.select(*COLUMNS, F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    gone = ids.filter("not any").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"))
    gone = small(gone, gone.count(), 128)
    left = rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["text_sha256"] == gone["gone_sha"]), "left_anti")
    if not ids.filter("any").isEmpty():
        left = left.dropDuplicates(["doc_id", "text_sha256"])
    return left.select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The one with the smallest id stays; rows without id come last, and of rows with one id the one with the least key of its text.
    """
    found = staged(jaccard_components(docs, n=5, percent=80).filter("label is not null").select("label", "doc_id", "row"), "components", 1 + docs.count() // (1 << 20))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")
    first = found.groupBy("label").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return without(docs, found.join(first, "label").filter(place != F.col("first")))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 200 bytes that are found twice or more; a document all of which is cut stays, with an empty text."""
    left = without_repeats(docs, keep_text=True, carry=("lang", "source"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("suffix-array dedup", passages), ("packing", packed)]

#: Importance resampling and packing can't be told in SQL; tests/llm/test_stages.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
