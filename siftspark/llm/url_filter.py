"""URL filters by hash prefixes of host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import let, small

#: Hex digits of a digest that the equi-join compares (32 bits); the full digest confirms.
PREFIX = 8


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or url."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def folder(path: Column) -> Column:
    """The path through its last slash: what an expression of a rule or a url ends with."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Host suffixes of up to `labels` labels, each with the empty path and the path prefixes of up to `depth` slashes."""
    suffixes = let(F.split(host, r"\.", -1), lambda p: F.transform(F.sequence(F.lit(1), F.least(F.size(p), F.lit(labels))), lambda k: F.concat_ws(".", F.slice(p, -k, k))))
    ends = let(F.split(path, "/", -1), lambda p: F.transform(F.sequence(F.lit(0), F.least(F.size(p) - 1, F.lit(depth))), lambda k: F.when(k == 0, "").otherwise(F.concat(F.concat_ws("/", F.slice(p, 1, k)), F.lit("/")))))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(ends, lambda e: F.concat(s, F.lit("\x00"), e))))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    rules: (host, path, verdict), paths of any form. A rule fits its host and all subdomains if the url's path starts
    with the rule's path. The longest rule (host and path together) wins; of equally long ones the one with the longer
    host, then block before allow, then the larger text. A url that no rule fits gets rule null and `default`.
    A null url, or one without ://, has an empty host and path and no rule. Repeated rows are judged each; other columns are ignored.
    """
    size, labels, depth = rules.agg(
        F.count(F.lit(1)),
        F.coalesce(F.max(F.size(F.split("host", r"\.", -1))), F.lit(1)),
        F.coalesce(F.max(F.length(F.regexp_replace("path", "[^/]", ""))), F.lit(0)),
    ).first()
    known = rules.filter("host <> ''").select(
        F.sha2(F.concat(F.col("host"), F.lit("\x00"), folder(F.col("path"))), 256).alias("rule_digest"),
        F.col("path").alias("rule_path"),
        F.struct(F.length(F.concat("host", "path")).alias("a"), F.length("host").alias("b"), F.when(F.col("verdict") == "block", 1).otherwise(0).alias("c"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict")).alias("hit"),
    ).withColumn("short", F.substring("rule_digest", 1, PREFIX))
    url = F.col(url_col)
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    parts = rows.select("*", F.explode(expressions(F.col("host"), F.col("path"), labels, depth)).alias("expression")).withColumn("digest", F.sha2("expression", 256)).drop("expression").withColumn("short", F.substring("digest", 1, PREFIX))
    hits = parts.join(small(known, size, 400), "short", "left")
    sure = (F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path"))
    best = hits.groupBy("rid", "page_id", "host", "path").agg(F.max(F.when(sure, F.col("hit"))).alias("hit"))
    return best.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
