"""Shared pieces: tables in the shared folder, size-checked broadcasts, the tables' readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes that a broadcast side may have; beyond it, joins shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of a task that writes an intermediate table, about.
TASK_BYTES = 8 << 20
#: Spark's setting that deletes a query's shuffle files when it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Settings for rows with long texts, which the operators set for the session: rows that a scan decodes at once, and
#: that Python gets at once. Spark's own, 4,096 and 10,000, are for short rows, and take some 100 MB a task here.
LONG_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "256", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: Bytes of a row group of an intermediate table: a writer holds one, and a reader a column of it.
ROW_GROUP = 4 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for intermediate tables; on a local master without one, a folder of our own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="siftspark-")
    return _own[app]


def tasks_for(spark: SparkSession, volume: int, a_core: float = 2.0) -> int:
    """Tasks, and so files, for a table of about `volume` bytes: TASK_BYTES each, but `a_core` of them a core at least."""
    return min(1 << 24, max(1, int(a_core * spark.sparkContext.defaultParallelism), volume // TASK_BYTES))


def volume(df: DataFrame) -> int:
    """Bytes of df by the planner's estimate: those of its files, if it is a table that is read."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def gathered(df: DataFrame) -> DataFrame:
    """df, texts that an operator reads, in no more tasks than its volume, by the planner's estimate, needs."""
    for k, v in LONG_ROWS.items():
        df.sparkSession.conf.set(k, v)
    return df.coalesce(tasks_for(df.sparkSession, volume(df)))


class Table:
    """df as a Parquet table in the shared folder, written by `tasks` tasks at most: cuts lineage, and survives lost executors. It can be dropped once nothing reads it any more."""

    def __init__(self, df: DataFrame, label: str, tasks: int | None = None) -> None:
        self.spark, self.path = df.sparkSession, f"{shared_dir(df.sparkSession)}/siftspark-{uuid.uuid4().hex}/{label}"
        before = self.spark.conf.get(CLEAN, None)
        self.spark.conf.set(CLEAN, "true")
        try:
            (df.coalesce(tasks) if tasks else df).write.option("parquet.block.size", ROW_GROUP).parquet(self.path)
        finally:
            self.spark.conf.unset(CLEAN) if before is None else self.spark.conf.set(CLEAN, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str, tasks: int | None = None) -> DataFrame:
    return Table(df, label, tasks).df


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its counted rows stay under BROADCAST_BYTES, else df as it is (joins then shuffle)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text: with the id, it tells rows apart whose id is null or repeated."""
    return F.xxhash64(id_col, text_col)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value, body):
    """body(value) with value computed once a row: a binding for Column expressions."""
    return F.transform(F.array(value), body)[0]
