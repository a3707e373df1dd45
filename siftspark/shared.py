"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master without it, a folder of our own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="siftspark-")
    return _own[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: whatever reads it sees the same rows in the same partitions' columns."""
    path = f"{folder(df.sparkSession)}/siftspark-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Exists(Exception):
    """The file is there already."""


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.make = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path
        self.files = self.make(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        top = self.make(self.path)
        return [x.getPath().getName() for x in self.files.listStatus(top)] if self.files.exists(top) else []

    def has(self, name: str) -> bool:
        return self.files.exists(self.make(f"{self.path}/{name}"))

    def delete(self, name: str) -> None:
        self.files.delete(self.make(f"{self.path}/{name}"), True)

    def text(self, name: str) -> str:
        """The text of a small file."""
        stream = self.files.open(self.make(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new small file; Exists if there is one of the name."""
        try:
            stream = self.files.create(self.make(f"{self.path}/{name}"), False)
        except Py4JJavaError as e:
            if "Exist" in e.java_exception.getClass().getName():
                raise Exists(name) from None
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, draft: str, name: str) -> None:
        """Rename draft to name, over what was there."""
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        source, target = (self.make(f"{self.path}/{x}") for x in (draft, name))
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, options)
