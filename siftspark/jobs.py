"""Jobs that keep an index up: scans of folders, and the index of contents. Both can be run again after they broke off."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark import schemas, shared
from siftspark.operators import catalog, content, semantic, stats
from siftspark.providers import Embedder, passages
from siftspark.sources import extract, logs
from siftspark.sources.walk import SCHEMA as WALKED
from siftspark.sources.walk import Walk
from siftspark.store import Store

#: Files of a round of the content index: a cancelled or broken run loses no more than a round.
ROUND = 100_000
DEFAULT_FOLDERS = ["Windows", "Program Files", "Program Files (x86)", "ProgramData", "$Recycle.Bin", "System Volume Information", "AppData", "node_modules", ".git", "venv", "__pycache__"]
DEFAULT_EXTENSIONS = [".exe", ".dll", ".sys", ".tmp", ".msi", ".cab", ".dmp", ".lnk"]


@dataclass
class Report:
    """What a job has done."""

    finished: bool = False
    processed: int = 0
    errors: int = 0
    embedded: int = 0
    rebuilt: bool = False
    last_error: str | None = None
    counts: dict[str, int] = field(default_factory=dict)


def scan(store: Store, roots: list[str], now: float, exclude_folders: list[str] = DEFAULT_FOLDERS, exclude_extensions: list[str] = DEFAULT_EXTENSIONS, cancelled: Callable[[], bool] = lambda: False, then: Callable[[Report], None] | None = None) -> Report:
    """Walk the roots and merge what is there into the catalogue. Files under the roots that a finished scan didn't see are marked deleted.

    A scan that is cancelled merges what it has seen and marks nothing. At most one scan runs at a time (store.Busy).
    """
    spark, report = store.spark, Report()
    with store.claim("scan", now):
        spark.dataSource.register(Walk)
        seen, failed = None, spark.createDataFrame([], WALKED)
        for root in roots:
            if cancelled():
                break
            options = {"roots": json.dumps([root]), "exclude_folders": json.dumps(exclude_folders), "exclude_extensions": json.dumps(exclude_extensions), "started": str(now)}
            rows = shared.written(spark.read.format("walk").options(**options).load(), "walk")
            seen = rows if seen is None else seen.unionByName(rows)
        stopped = cancelled()
        if seen is not None:
            failed = seen.filter("error is not null")
            found = seen.filter("error is null").drop("error")
            store.publish("files", catalog.merged(store.read("files"), found, None if stopped else roots, None if stopped else now))
            report.processed = found.count()
        report.errors = failed.count()
        report.finished = not stopped
        if report.finished:
            store.tell(last_scan_at=now)
        report.counts = stats.counts(store.read("files"), store.read("content"), store.read("chunks")).first().asDict()
    if then:
        then(report)
    return report


def read_files(files: DataFrame, now: float, version: int = 1) -> DataFrame:
    """Content rows of (id, path, ext), each file read where the task runs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guard = extract.Guard()
        for part in parts:
            found = [extract.file_text(p, e, guard) for p, e in zip(part["path"], part["ext"])]
            yield pd.DataFrame({"file_id": part["id"], "text": [t for t, _ in found], "error": [e for _, e in found]})

    rows = files.select("id", "path", "ext").mapInPandas(run, "file_id long, text string, error string")
    return rows.select("file_id", "text", F.length("text").cast("long").alias("char_count"), F.lit(now).alias("extracted_at"), F.lit(version).alias("extractor_version"), "error")


def index_contents(store: Store, now: float, make: Callable[[], Embedder] | None = None, cancelled: Callable[[], bool] = lambda: False, size: int = ROUND) -> Report:
    """Extract new and changed files, cut and embed their texts, and keep clusters and calibration up.

    Without an embedder only texts are kept; a later run with one embeds them without reading the files again. A file
    that can't be read is logged and not tried again until it changes. At most one run at a time.
    """
    spark, report = store.spark, Report()
    with store.claim("content", now):
        todo = content.candidates(store.read("files"), store.read("content"), extract.extractable(), make is not None).select("id", "path", "ext", "action")
        todo = shared.written(todo, "todo")
        rounds = -(-todo.count() // size)
        for nth in range(rounds):
            if cancelled():
                break
            _round(store, todo.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == nth), now, make, report)
        if not cancelled():
            report.rebuilt = build_if_due(store, now, cancelled)
            at = store.read("calibration").agg(F.max("computed_at")).first()[0]
            if stats.due(report.processed, at, now):
                store.publish("calibration", stats.calibration(store.read("files"), store.read("content")).withColumn("computed_at", F.lit(now)))
            report.finished = not cancelled()
        if report.finished:
            store.tell(last_content_index_at=now)
    return report


def _round(store: Store, todo: DataFrame, now: float, make: Callable[[], Embedder] | None, report: Report) -> None:
    spark, held = store.spark, store.read("content")
    fresh = read_files(todo.filter("action = 'extract'"), now)
    old = held.join(todo.filter("action = 'embed'").select(F.col("id").alias("file_id")), "file_id", "left_semi").drop("embedded_at")
    done = F.when(F.col("error").isNull(), F.lit(now)) if make else F.lit(None).cast("double")
    rows = shared.written(schemas.conformed(fresh.unionByName(old).withColumn("embedded_at", done), schemas.CONTENT), "content")
    chunks = store.read("chunks")
    top = chunks.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = spark.createDataFrame([], schemas.CHUNKS)
    if make:
        cut = catalog.numbered(content.chunked(rows.filter("error is null")), by=("file_id", "chunk_index")).withColumn("id", F.col("nth") + top)
        new = semantic.assigned(content.embedded(cut, passages(make)), published_centroids(store))
        new = shared.written(schemas.conformed(new, schemas.CHUNKS), "chunks")
    left = chunks.join(rows.select("file_id"), "file_id", "left_anti")  # a text that may have changed loses its chunks
    store.publish("chunks", left.unionByName(new))
    store.publish("content", catalog.replaced(held, rows))
    failed = rows.filter("error is not null").join(todo.select(F.col("id").alias("file_id"), "path"), "file_id")
    failed = failed.select(F.lit(now).alias("timestamp"), F.lit("extract").alias("kind"), "path", "error")
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad"), F.count("embedded_at").alias("embedded")).first()
    if about["bad"]:
        store.log("content_errors", schemas.conformed(failed, logs.ERROR))
        last = failed.orderBy(F.desc("path")).first()
        report.last_error = f"{last['error']} ({last['path']})"
    report.processed, report.errors, report.embedded = report.processed + about["n"], report.errors + about["bad"], report.embedded + about["embedded"]


def published_centroids(store: Store) -> list[tuple[int, list[float]]] | None:
    """The clusters of the last finished build, if meta and centroids fit together."""
    meta = store.read("index_meta")
    about = meta.first()
    return semantic.load_centroids(store.read("centroids"), meta, about["dim"]) if about else None


def build_if_due(store: Store, now: float, cancelled: Callable[[], bool] = lambda: False) -> bool:
    """Build the clusters anew if chunks have grown, or too many have none. While it works there is no index, so searches look at all chunks; meta is published last."""
    spark, chunks = store.spark, store.read("chunks")
    meta = store.read("index_meta")
    if not semantic.rebuild_decision(chunks, meta).first()["rebuild"]:
        return False
    dim = semantic.dominant_dim(chunks)
    sample = semantic.sampled(chunks, dim)
    total = chunks.filter(F.size("embedding") == dim).count()
    centers = semantic.spherical_kmeans(sample, semantic.choose_k(total))
    probes = semantic.probes_for(sample, centers)
    if cancelled():
        return False
    store.publish("index_meta", meta.limit(0))
    centroids = [(i, [float(np.float32(x)) for x in c]) for i, c in enumerate(centers)]
    store.publish("chunks", semantic.assigned(chunks, centroids))
    if cancelled():
        return False
    store.publish("centroids", spark.createDataFrame(centroids, schemas.CENTROIDS).coalesce(1))
    store.publish("index_meta", spark.createDataFrame([(dim, now, total, probes)], schemas.INDEX_META).coalesce(1))
    return True


def after_scan(store: Store, now: float, auto: bool, make: Callable[[], Embedder] | None) -> Report | None:
    """The content index after a scan: only if it is wanted, has been made before, and none runs."""
    if not auto or "last_content_index_at" not in store.status() or store.running("content"):
        return None
    return index_contents(store, now, make)


def scan_if_due(store: Store, roots: list[str], now: float, interval_minutes: int = 10, **options) -> Report | None:
    """A scan, if the last one is older than the interval and none runs."""
    if not stats.scan_due(store.status().get("last_scan_at"), interval_minutes, now, store.running("scan")):
        return None
    return scan(store, roots, now, **options)
