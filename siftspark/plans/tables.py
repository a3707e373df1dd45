"""The engine's tables derived from the driver's: documents stand in for files and bodies, embeddings for chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = [".txt", ".md", ".pdf", ".docx", ".xlsx", ".bin"]
EPOCH, NOW = 1_704_067_200, 1_704_067_200 + 3_600 * 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("size"))
    rows = rows.withColumn("ext", F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 6 + 1).cast("int")))
    rows = rows.withColumns({"name": F.concat(F.lit("doc_"), "doc_id", "ext"), "dir": F.concat(F.lit("/"), "lang", F.lit("/"), "source")})
    return rows.select(
        F.col("doc_id").alias("id"), F.concat("dir", F.lit("/"), "name").alias("path"), "name", "ext", "dir", "size",
        (EPOCH + F.col("doc_id") * 3600).cast("double").alias("mtime"), F.when(F.col("doc_id") % 17 == 0, 1).otherwise(0).alias("is_deleted"), F.lit(float(EPOCH)).alias("last_seen_at"),
    )


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, text) of every document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of the labelled documents; toxic ones stand for failed, those of quality 1 for embedded ones, every fifth is stale."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    at = (EPOCH + F.col("doc_id") * 3600 + F.when(F.col("doc_id") % 5 == 0, -10).otherwise(10)).cast("double")
    return rows.select(
        F.col("doc_id").alias("file_id"), "text", F.length("text").cast("long").alias("char_count"), at.alias("extracted_at"), F.lit(1).alias("extractor_version"),
        F.when(F.col("toxic") == 1, "failed").alias("error"), F.when(F.col("quality") == 1, at + 1).alias("embedded_at"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 5).cast("long").alias("file_id"), (F.col("vec_id") % 5).cast("int").alias("chunk_index"),
        F.concat(F.lit("  vector "), "vec_id", F.lit("\nof class "), "label").alias("chunk_text"), "embedding", F.when(F.col("vec_id") % 11 != 0, F.col("label")).alias("cluster_id"),
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"])


FILES_SQL = f"""files AS (
  SELECT doc_id AS id, dir || '/' || name AS path, name, ext, dir, strlen(text)::BIGINT AS size, ({EPOCH} + doc_id * 3600)::DOUBLE AS mtime,
         CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS is_deleted, {EPOCH}::DOUBLE AS last_seen_at
  FROM (SELECT *, 'doc_' || doc_id || ext AS name, '/' || lang || '/' || source AS dir
        FROM (SELECT *, CASE doc_id % 6 {" ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS))} END AS ext FROM documents)))"""
CONTENT_SQL = f"""content AS (
  SELECT doc_id AS file_id, text, length(text)::BIGINT AS char_count, tm::DOUBLE AS extracted_at, CASE WHEN toxic = 1 THEN 'failed' END AS error,
         CASE WHEN quality = 1 THEN tm + 1.0 END::DOUBLE AS embedded_at
  FROM (SELECT *, {EPOCH} + doc_id * 3600 + CASE WHEN doc_id % 5 = 0 THEN -10 ELSE 10 END AS tm FROM documents JOIN labels USING (doc_id)))"""
CHUNKS_SQL = """chunks AS (
  SELECT vec_id AS id, (vec_id // 5)::BIGINT AS file_id, (vec_id % 5)::INTEGER AS chunk_index, '  vector ' || vec_id || chr(10) || 'of class ' || label AS chunk_text,
         embedding, CASE WHEN vec_id % 11 <> 0 THEN label END AS cluster_id FROM embeddings)"""
