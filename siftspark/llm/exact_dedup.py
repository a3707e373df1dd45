"""Exact deduplication with heavy hitters split off.

Digests that many rows share would send those rows to one task. A Misra-Gries summary (Spark's frequent-items
sketch, merged level by level) names the candidates, one exact count verifies them, and the verified winners are
broadcast: their rows are settled where they lie. The other digests take the ordinary shuffle: counts and first rows
are summed up by each task before they meet, and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import SPACE, gathered, staged

#: Counters of a Misra-Gries summary. Every digest with over 3.5 / TRACKED of the rows is among its candidates.
TRACKED = 1024
#: A winner has at least rows / SPLIT rows; at most SPLIT digests can be winners, which bounds the broadcast.
SPLIT = 256
#: Summaries merged into one on each level: those of this many neighbouring tasks.
FAN_IN = 64


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def frequent(digests: DataFrame, parts: int) -> DataFrame:
    """(key): at most SPLIT candidates for frequent digests, by merged Misra-Gries summaries; rows are of `parts` tasks."""
    width = FAN_IN.bit_length() - 1
    task = F.shiftright("rid", 33)
    merged = digests.groupBy(F.shiftright(task, width).alias("part")).agg(F.expr(f"approx_top_k_accumulate(xxhash64(text_sha256), {TRACKED})").alias("state"))
    # By a key, as a task without rows would hand on a summary without a type, which can't be merged.
    combine = F.expr(f"approx_top_k_combine(state, {TRACKED})").alias("state")
    while (parts := parts >> width) > FAN_IN:
        merged = merged.groupBy(F.shiftright("part", width).alias("part")).agg(combine)
    merged = merged.groupBy(F.lit(0).alias("one")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(state, {TRACKED}), {SPLIT})").alias("top"))
    return merged.select(F.explode("top.item").alias("key"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after replacing each run of white space by one space; null counts as
    empty. Of equal texts the row with the smallest id stays; null ids come last, and of repeated rows (same id and
    text) exactly one stays. Other columns are ignored, so their names can't clash. An empty table gives none.
    """
    digests = staged(
        gathered(docs).select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("text_sha256")),
        "digests",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid")))
    size, parts = digests.agg(F.count(F.lit(1)), F.coalesce(F.max(F.shiftright("rid", 33)), F.lit(0)) + 1).first()
    verified = (
        digests.withColumn("key", F.xxhash64("text_sha256"))
        .join(F.broadcast(frequent(digests, parts)), "key", "left_semi")
        .groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
        .filter(F.col("group_size") * SPLIT >= F.lit(size))
        .filter("group_size > 1")
    )
    winners = staged(verified, "winners", 1)
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    others = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    rest = others.join(others.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")), "text_sha256")
    columns = ["doc_id", F.col("first.keep_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.keep_rid")).alias("kept"), "text_sha256"]
    return heavy.select(*columns).unionByName(rest.select(*columns))
