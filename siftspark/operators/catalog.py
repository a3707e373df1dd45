"""The file catalogue: merges of observed snapshots, with soft deletes. Snapshots are published as numbered versions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark import schemas, shared


def latest(observed: DataFrame, key: str = "path", order: tuple[str, ...] = ("scan_started_at",)) -> DataFrame:
    """The last observation of each key."""
    rest = [c for c in observed.columns if c not in (key, *order)]
    best = observed.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("x"))
    return best.select(key, "x.*").select(*observed.columns)


def merged(files: DataFrame, observed: DataFrame, roots: list[str] | None = None, started: float | None = None) -> DataFrame:
    """files with the observations merged in.

    A known path gets the new size and mtime, is live again and keeps id, name, ext and dir; new paths get the next
    ids in the order of their paths. With roots and the start of a complete scan, rows whose path begins with a root
    and that were last seen before are marked deleted. Leave roots out after a cancelled scan.
    """
    seen = latest(observed).select("path", *[F.col(c).alias(f"o_{c}") for c in ("name", "ext", "dir", "size", "mtime", "scan_started_at")])
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    both = files.join(seen, "path", "full")
    new = F.col("id").isNull()
    hit = F.col("o_scan_started_at").isNotNull()
    rows = both.select(
        "id", "path", *[F.when(new, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in ("name", "ext", "dir")],
        F.when(hit, F.col("o_size")).otherwise(F.col("size")).alias("size"), F.when(hit, F.col("o_mtime")).otherwise(F.col("mtime")).alias("mtime"),
        F.when(hit, 0).otherwise(F.col("is_deleted")).alias("is_deleted"), F.when(hit, F.col("o_scan_started_at")).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )
    if roots is not None and started is not None:
        under = F.lit(False)
        for r in roots:
            under = under | F.startswith("path", F.lit(r))
        rows = rows.withColumn("is_deleted", F.when(under & (F.col("last_seen_at") < started), 1).otherwise(F.col("is_deleted")))
    old, fresh = rows.filter("id is not null"), numbered(rows.filter("id is null").drop("id"))
    fresh = fresh.join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("nth")).drop("top", "nth")
    return schemas.conformed(old.unionByName(fresh), schemas.FILES)


def numbered(rows: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """rows with nth, 1 to n in the order of `by`: ranks in ranges of it, after the counts of the ranges before.

    There are as many ranges as shuffle partitions. They are written first, as their bounds are drawn anew whenever they are computed.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = shared.written(rows.repartitionByRange(ranges, *by).withColumn("range", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("range").agg(F.count(F.lit(1)).alias("c"))  # one row a range
    before = counts.select("range", (F.sum("c").over(Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"))
    inner = Window.partitionBy("range").orderBy(*by)
    return parts.join(F.broadcast(before), "range").withColumn("nth", F.col("before") + F.row_number().over(inner)).drop("before", "range")


def replaced(table: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """table with all rows of new's keys replaced by new's: content upserts and chunk replacement."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*table.columns))


VERSION = re.compile(r"v-(\d{12})")


def versions(spark: SparkSession, base: str) -> tuple[list[str], int]:
    """Complete versions under base, oldest first, and the number of the next one."""
    top = shared.Folder(spark, base)
    found = sorted(x for x in top.names() if VERSION.fullmatch(x))
    return [x for x in found if top.has(f"{x}/_SUCCESS")], int(VERSION.fullmatch(found[-1])[1]) + 1 if found else 1


def publish(df: DataFrame, base: str, keep: int = 2) -> str:
    """Write df as the next version under base: it counts once Spark marks it complete, so readers see the old version or the new one.

    Of two writers at once one fails, as both write the same folder. Versions before the last `keep` are deleted.
    """
    done, number = versions(df.sparkSession, base)
    name = f"v-{number:012d}"
    df.write.parquet(f"{base}/{name}")
    top = shared.Folder(df.sparkSession, base)
    for old in [*done, name][: -max(1, keep)]:
        top.delete(old)
    return f"{base}/{name}"


def current(spark: SparkSession, base: str) -> DataFrame | None:
    """The last complete version; None before the first."""
    done, _ = versions(spark, base)
    return spark.read.parquet(f"{base}/{done[-1]}") if done else None
