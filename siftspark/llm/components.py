"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import Table

#: Links of a task that writes them, about; and the share of all of them, inverted, from which a node's links are joined where they lie.
LINKS, HUB = 1 << 19, 1_000


def _star(edges: DataFrame, both: bool, links: int) -> DataFrame:
    """Links of every node to the least node it knows: of all its neighbours (large star), or of the smaller ones (small star).

    A hub's links are not brought together: at most 2 * HUB nodes have more than 1 / HUB of the links each, and their
    least nodes are broadcast.
    """
    near = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if both:
        near = near.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    far = near.filter("v > u") if both else near
    hubs = least.filter(F.col("n") * HUB > links).select("u", "m")
    marked = far.join(F.broadcast(hubs), "u", "left")
    out = marked.filter("m is not null").select("m", "v").unionByName(marked.filter("m is null").drop("m").join(least.select("u", "m"), "u").select("m", "v"))
    out = out.select(F.col("m").alias("a"), F.col("v").alias("b"))
    if not both:
        out = out.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of the links (a, b), a < b, the least node that it is connected with. No links give no rows."""
    now, seen = Table(edges.select("a", "b").distinct(), "links"), None
    while True:
        found = tuple(now.df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if found == seen:
            break
        seen = found
        tasks = max(1, found[0] // LINKS)
        large = Table(_star(now.df, True, found[0]), "large-stars", tasks)
        now.drop()
        now = Table(_star(large.df, False, found[0]), "small-stars", tasks)
        large.drop()
    return now.df.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.df.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
