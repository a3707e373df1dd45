"""Keyword results first, then semantic ones in the slots that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.operators import match, semantic


def hybrid_search(files: DataFrame, content: DataFrame, keywords: list[str], extensions: list[str] | None = None, recency_days: int | None = None, now: float = 0.0, limit: int = match.LIMIT, chunks: DataFrame | None = None, query: list[float] | None = None, min_score: float = semantic.MIN_SCORE, most: int = semantic.MOST, clusters: list[int] | None = None) -> DataFrame:
    """Search results with rank. Keyword filters relax if nothing passes; semantic ones never do, and apply after the top-k.

    Files that any keyword matches, shown or not, are no semantic results.
    """
    found = match.matches(files, content, keywords)
    shown = match.ranked(found, extensions, recency_days, now, limit).withColumns({"semantic_score": F.lit(None).cast("double"), "snippet": F.lit(None).cast("string"), "part": F.lit(0)})
    if chunks is None or query is None:
        return shown.drop("part")
    near = semantic.semantic_search(chunks, files, query, found, most, min_score, clusters)
    extra = files.join(F.broadcast(near), files["id"] == near["file_id"]).filter(match.passes(extensions, recency_days, now))
    extra = extra.select(*files.columns, F.expr("cast(array() as array<string>)").alias("matched_keywords"), F.lit(False).alias("matched_in_name"), F.lit(False).alias("matched_in_content"), F.lit(None).cast("int").alias("rank"), "semantic_score", "snippet", F.lit(1).alias("part"))
    # At most limit + most rows from here on.
    both = shown.unionByName(extra)
    order = Window.partitionBy(F.lit(1)).orderBy("part", "rank", F.desc("semantic_score"), "id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("part")
