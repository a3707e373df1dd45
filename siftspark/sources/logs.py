"""Append-only logs: usage as CSV, model calls and content errors as JSON lines."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the usage log: its header and its words for an opened and an unopened file.
USAGE_HEADER = ["検索日時", "入力クエリ", "展開語数", "ヒット件数", "開いたファイルの有無"]
OPENED, UNOPENED = "あり", "なし"
BOM = "\ufeff"


def usage_rows(searches: DataFrame) -> DataFrame:
    """(time, query, keyword_count, hit_count, opened boolean) under the log's names."""
    rows = searches.select(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"), "query", "keyword_count", "hit_count", F.when(F.col("opened"), OPENED).otherwise(UNOPENED))
    return rows.toDF(*USAGE_HEADER)


def append_usage(searches: DataFrame, path: str) -> None:
    """Add rows to the log, kept as Parquet until it is asked for as one file."""
    usage_rows(searches).write.mode("append").parquet(path)


def usage_csv(spark: SparkSession, path: str) -> Iterator[str]:
    """The lines of the log as one CSV file: a byte-order mark and the header once, rows by time. Rows come to the driver part by part."""
    out = io.StringIO()
    lines = csv.writer(out)
    rows = spark.read.parquet(path).orderBy(USAGE_HEADER[0], *USAGE_HEADER[1:]).toLocalIterator()
    for row in chain([USAGE_HEADER], rows):
        lines.writerow(row)
        yield (BOM if row is USAGE_HEADER else "") + out.getvalue()
        out.seek(0)
        out.truncate()


#: Fields of a logged model call and of a logged content error.
CALL, ERROR = "timestamp double, query string, ok boolean, elapsed_sec double, error string", "timestamp double, kind string, path string, error string"


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
