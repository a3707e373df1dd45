"""Which files to extract or embed, and their new bodies and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import text


def candidates(files: DataFrame, content: DataFrame, extensions: list[str], embedder: bool) -> DataFrame:
    """Live extractable files to work on, with action: extract (never done, failed, or changed since) or embed (only that is missing).

    A failed file is not tried again until it changes; embeddings are looked for only if there is an embedder.
    """
    state = content.select(F.col("file_id").alias("id"), F.lit(True).alias("known"), "extracted_at", "error", "embedded_at")
    rows = files.filter((F.col("is_deleted") == 0) & F.col("ext").isin(extensions)).join(state, "id", "left")
    stale = F.col("known").isNull() | (F.col("extracted_at") < F.col("mtime"))
    bare = F.col("error").isNull() & F.col("embedded_at").isNull()
    wanted = rows.filter(stale | bare) if embedder else rows.filter(stale)
    action = F.when(stale | F.col("error").isNotNull(), "extract").otherwise("embed")
    return wanted.select(*files.columns, "extracted_at", "error", "embedded_at", action.alias("action"))


def chunked(content: DataFrame) -> DataFrame:
    """(file_id, chunk_index, chunk_text) of all bodies."""
    return content.select("file_id", F.posexplode(text.chunks(F.coalesce("text", F.lit("")))).alias("chunk_index", "chunk_text"))


def embedded(chunks: DataFrame, embed: Callable) -> DataFrame:
    """chunks with embedding, by a pandas UDF over passages (providers.passages)."""
    return chunks.withColumn("embedding", embed(F.concat(F.lit("passage: "), F.col("chunk_text"))))


def freshness(content: DataFrame, disk: DataFrame) -> DataFrame:
    """(file_id, use_index): whether a preview may show the indexed text, by the files' times on disk (null: unreadable)."""
    rows = content.join(disk.select("file_id", "disk_mtime"), "file_id", "left")
    return rows.select("file_id", (F.col("error").isNull() & (F.col("disk_mtime").isNull() | (F.col("extracted_at") >= F.col("disk_mtime")))).alias("use_index"))
