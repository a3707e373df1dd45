"""Schemas of the persistent tables, and additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = "id long, path string, name string, ext string, dir string, size long, mtime double, is_deleted int, last_seen_at double"
CONTENT = "file_id long, text string, char_count long, extracted_at double, extractor_version int, error string, embedded_at double"
CHUNKS = "id long, file_id long, chunk_index int, chunk_text string, embedding array<float>, cluster_id int"
OBSERVATION = "path string, name string, ext string, dir string, size long, mtime double, scan_started_at double"
CENTROIDS = "cluster_id int, centroid array<float>"
INDEX_META = "dim int, built_at double, indexed_chunk_count long, probes int"
CALIBRATION = "ext string, n long, src_bytes long, text_bytes long, ratio double, computed_at double"
STATUS = "name string, value double"


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the schema's columns; missing ones are null, so tables may gain columns."""
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])
