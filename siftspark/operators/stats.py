"""Counts, size estimates and their calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import text

FACTOR, SAMPLES, REFRESH = 2.5, 5, 100
DAY = 86_400
FTS_FACTOR = 1.5


def counts(files: DataFrame, content: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: live files, error-free bodies, files with chunks, chunks."""
    a = files.agg(F.count_if(F.col("is_deleted") == 0).alias("file_count"))
    b = content.agg(F.count_if(F.col("error").isNull()).alias("content_count"))
    c = chunks.agg(F.countDistinct("file_id").alias("chunked_files"), F.count(F.lit(1)).alias("chunk_count"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))


def calibration(files: DataFrame, content: DataFrame) -> DataFrame:
    """(ext, n, src_bytes, text_bytes, ratio) of extensions with enough error-free samples."""
    rows = files.select(F.col("id").alias("file_id"), "ext", "size").join(content.filter("error is null").select("file_id", F.octet_length("text").alias("bytes")), "file_id")
    found = rows.groupBy("ext").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("src_bytes"), F.sum("bytes").alias("text_bytes"))
    return found.filter((F.col("n") >= SAMPLES) & (F.col("src_bytes") > 0)).withColumn("ratio", F.col("text_bytes") / F.col("src_bytes"))


def overhead_ratio(content: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: bytes of chunks and of the text index (a guess), over bytes of text."""
    body = content.filter("error is null").agg(F.sum(F.octet_length("text")).alias("text_bytes"))
    part = chunks.agg(F.sum(F.octet_length("chunk_text") + 4 * F.size("embedding")).alias("chunk_bytes"))
    return body.join(F.broadcast(part)).select(((F.coalesce("chunk_bytes", F.lit(0)) + FTS_FACTOR * F.col("text_bytes")) / F.nullif(F.col("text_bytes"), F.lit(0))).alias("overhead_ratio"))


def estimate(files: DataFrame, plain: list[str], ratios: DataFrame | None = None, overhead: float | None = None) -> DataFrame:
    """One row: the estimated bytes of a full index. Calibrated ratios replace the fixed ones by extension."""
    sizes = files.filter("is_deleted = 0").groupBy("ext").agg(F.sum("size").alias("bytes"))
    ratio = text.extraction_ratio(F.col("ext"), plain)
    if ratios is not None:
        sizes = sizes.join(ratios.select("ext", "ratio"), "ext", "left")
        ratio = F.coalesce(F.col("ratio"), ratio)
    factor = FACTOR if overhead is None else 1 + overhead
    return sizes.agg((F.coalesce(F.sum(F.col("bytes") * ratio), F.lit(0.0)) * factor).cast("long").alias("estimate_bytes"))


def due(processed: int, computed_at: float | None, now: float) -> bool:
    """Whether the calibration is to be computed anew."""
    return computed_at is None or processed >= REFRESH or (processed > 0 and now - computed_at > DAY)


def first_run(all_drives: bool, folders: list[str], last_full_scan: float | None) -> bool:
    return not all_drives and not folders and last_full_scan is None


def scan_due(last: float | None, interval_minutes: int, now: float, running: bool) -> bool:
    return not running and (last is None or now - last >= max(interval_minutes, 1) * 60)
