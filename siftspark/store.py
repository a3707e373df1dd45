"""The published tables of an index, claims on its jobs, and its logs."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark import schemas, shared
from siftspark.operators import catalog

TABLES = {
    "files": schemas.FILES, "content": schemas.CONTENT, "chunks": schemas.CHUNKS, "centroids": schemas.CENTROIDS,
    "index_meta": schemas.INDEX_META, "calibration": schemas.CALIBRATION, "status": schemas.STATUS,
}


class Busy(Exception):
    """Another run of the job has the claim."""


class Store:
    """Tables under a folder, each published version by version: what reads one sees the old version or the new one."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def read(self, name: str) -> DataFrame:
        found = catalog.current(self.spark, f"{self.base}/{name}")
        return self.spark.createDataFrame([], TABLES[name]) if found is None else schemas.conformed(found, TABLES[name])

    def publish(self, name: str, df: DataFrame) -> None:
        catalog.publish(schemas.conformed(df, TABLES[name]), f"{self.base}/{name}")

    def status(self) -> dict[str, float]:
        return {r["name"]: r["value"] for r in self.read("status").collect()}

    def tell(self, **values: float) -> None:
        """Keep single numbers, such as times of the last runs."""
        self.publish("status", self.spark.createDataFrame(sorted((self.status() | values).items()), TABLES["status"]).coalesce(1))

    @contextmanager
    def claim(self, job: str, now: float | None = None, stale: float = 86_400.0) -> Iterator[None]:
        """At most one run of a job at a time, whichever driver starts it. A claim older than `stale` is that of a run that died."""
        top = shared.Folder(self.spark, self.base)
        name, now = f"running-{job}", time.time() if now is None else now
        if top.has(name) and now - float(top.text(name)) > stale:
            top.delete(name)
        try:
            top.create(name, str(now))
        except shared.Exists:
            raise Busy(job) from None
        try:
            yield
        finally:
            top.delete(name)

    def running(self, job: str) -> bool:
        return shared.Folder(self.spark, self.base).has(f"running-{job}")

    def log(self, name: str, rows: DataFrame) -> None:
        """Append rows to a log of JSON lines."""
        rows.write.mode("append").json(f"{self.base}/logs/{name}")

    def logged(self, name: str) -> DataFrame | None:
        return self.spark.read.json(f"{self.base}/logs/{name}") if shared.Folder(self.spark, f"{self.base}/logs").has(name) else None

    def without_deleted(self, files: DataFrame) -> None:
        """Drop bodies and chunks whose file is in the catalogue no more."""
        for name in ("content", "chunks"):
            self.publish(name, self.read(name).join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi"))


def settings_of(spark: SparkSession, path: str) -> dict:
    """A stored configuration; empty if there is none."""
    folder, name = path.rsplit("/", 1)
    top = shared.Folder(spark, folder)
    return json.loads(top.text(name)) if top.has(name) else {}


def save_settings(spark: SparkSession, path: str, raw: dict) -> None:
    """Written beside and renamed, so that a reader sees the old configuration or the new one."""
    folder, name = path.rsplit("/", 1)
    top = shared.Folder(spark, folder)
    draft = f"{name}-{uuid.uuid4().hex}"
    top.create(draft, json.dumps(raw, ensure_ascii=False, indent=2))
    top.replace(draft, name)
