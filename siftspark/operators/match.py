"""Keyword matches of names, paths and bodies, filters with relaxation, and ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark import shared
from siftspark.functions import text

LIMIT = 50


def tests(x: Column, words: list[str]) -> Column:
    """For each keyword, whether x contains any of its variants; x is folded once a row."""
    either = lambda v: [text.holds(v, w) for w in words]
    return F.transform(F.array(F.struct(text.fold(x).alias("long"), text.ascii_fold(x).alias("short"))), lambda v: F.array(*either(v)))[0]


def live(files: DataFrame) -> DataFrame:
    return files.filter("is_deleted = 0")


def matches(files: DataFrame, content: DataFrame | None, keywords: list[str]) -> DataFrame:
    """Live files that any keyword matches: their columns, matched_keywords (sorted), matched_in_name (or path), matched_in_content.

    All keywords are tested in one pass. Bodies are tested where they lie, and only the flags of those that match are joined;
    without content there is no shuffle.
    """
    words = list(dict.fromkeys(s for s in (k.strip(text.STRIPPED) for k in keywords) if s))
    rows = live(files)
    if not words:
        none = F.lit(False)
        return rows.filter(none).select(*files.columns, F.expr("cast(array() as array<string>)").alias("matched_keywords"), none.alias("matched_in_name"), none.alias("matched_in_content"))
    any_of = lambda flags: F.exists(flags, lambda x: x)
    # No name holds the character 0, so a keyword without it can't be found across the two; one with it is in neither.
    rows = rows.withColumn("in_name", F.zip_with(tests(F.concat_ws("\0", "name", "path"), words), F.array(*[F.lit("\0" not in w) for w in words]), lambda a, b: a & b))
    if content is None:
        rows = rows.filter(any_of("in_name")).withColumn("in_body", F.lit(None).cast("array<boolean>"))
    else:
        bodies = content.select(F.col("file_id").alias("body_id"), tests(F.col("text"), words).alias("in_body")).filter(any_of("in_body"))
        rows = rows.join(bodies, rows["id"] == bodies["body_id"], "left").drop("body_id").filter(any_of("in_name") | F.col("in_body").isNotNull())
    body = lambda i: F.coalesce(F.col("in_body")[i], F.lit(False))
    found = F.sort_array(F.array_compact(F.array(*[F.when(F.col("in_name")[i] | body(i), F.lit(w)) for i, w in enumerate(words)])))
    return rows.select(*files.columns, found.alias("matched_keywords"), any_of("in_name").alias("matched_in_name"), F.coalesce(any_of("in_body"), F.lit(False)).alias("matched_in_content"))


#: Bytes of keywords whose automaton a task holds at once; more are taken in turns, each over all bodies.
TURN_BYTES = 8 << 20


def match_many(files: DataFrame, content: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, matched_keywords) for a table of keywords (keyword), matched against bodies in one pass of an automaton for each TURN_BYTES of keywords."""
    spark = files.sparkSession
    words = keywords.select(text.stripped(F.col("keyword")).alias("keyword")).filter("keyword <> ''").distinct()
    words = words.select("keyword", F.when(F.length("keyword") >= text.LONG, text.fold(F.col("keyword"))).alias("long"), F.when(F.length("keyword") < text.LONG, text.ascii_fold(F.col("keyword"))).alias("short"))
    words = shared.written(words, "keywords")
    size = words.agg(F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0))).first()[0]
    turns = -(-size // TURN_BYTES)
    bodies = live(files).select("id").join(content, F.col("id") == content["file_id"]).select("id", text.fold(F.col("text")).alias("long"), text.ascii_fold(F.col("text")).alias("short"))
    out = spark.createDataFrame([], "id long, keyword string")
    for turn in range(turns):
        mine = [tuple(r) for r in words.filter(F.pmod(F.xxhash64("keyword"), F.lit(turns)) == turn).collect()]
        if mine:
            out = out.unionByName(bodies.mapInArrow(_automaton(spark.sparkContext.broadcast(mine)), "id long, keyword string"))
    return out.groupBy("id").agg(F.sort_array(F.collect_set("keyword")).alias("matched_keywords"))


def _automaton(words: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ahocorasick import Automaton

        known: list[dict[str, list[str]]] = [{}, {}]
        for keyword, *folded in words.value:
            for held, x in zip(known, folded):
                if x is not None:
                    held.setdefault(x, []).append(keyword)
        made = []
        for held in known:
            made.append(Automaton())
            for x, names in held.items():
                made[-1].add_word(x, names)
            made[-1].make_automaton()
        for batch in batches:
            ids, found = [], []
            for key, *bodies in zip(*(c.to_pylist() for c in batch.columns)):
                hits = {name for body, held in zip(bodies, made) if body is not None and len(held) for _, names in held.iter(body) for name in names}
                ids += [key] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["id", "keyword"])

    return run


def passes(extensions: list[str] | None, recency_days: int | None, now: float) -> Column:
    out = F.lit(True)
    if extensions:
        out = out & F.col("ext").isin([e.lower() for e in extensions])
    if recency_days is not None:
        out = out & (F.col("mtime") >= now - recency_days * 86_400)
    return out


def ranked(found: DataFrame, extensions: list[str] | None = None, recency_days: int | None = None, now: float = 0.0, limit: int = LIMIT) -> DataFrame:
    """The best `limit` matches with rank: by number of keywords, newest first, then id. If no match passes the filters, both are dropped.

    Rows that pass come first in one top-k, so that whether any does is seen in its result.
    """
    top = found.withColumn("pass", passes(extensions, recency_days, now)).orderBy(F.desc("pass"), F.size("matched_keywords").desc(), F.desc("mtime"), "id").limit(limit)
    top = top.withColumn("any", F.max("pass").over(Window.partitionBy(F.lit(1)))).filter("pass or not any").drop("pass", "any")
    order = Window.partitionBy(F.lit(1)).orderBy(F.size("matched_keywords").desc(), F.desc("mtime"), "id")
    return top.withColumn("rank", F.row_number().over(order))


def search_files(files: DataFrame, keywords: list[str], extensions: list[str] | None = None, recency_days: int | None = None, now: float = 0.0, limit: int = LIMIT) -> DataFrame:
    """Search by names and paths only."""
    return ranked(matches(files, None, keywords), extensions, recency_days, now, limit)
