"""Exact and clustered semantic search, and upkeep of the clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions import text, vectors

MIN_SCORE, MOST = 0.75, 10
#: Fixed values of the index: chunks from which it is built, growth and null share that rebuild it, sample, rounds, seed.
LEAST_CHUNKS, GROWTH, NULLS = 5_000, 1.5, 0.3
SAMPLE, ROUNDS, SEED = 50_000, 10, 12_345
DIGITS = 6
#: Share of the nearest chunks that probes_for() aims at: more than 0.9, as it sees a sample.
RECALL = 0.93
#: Pairs of a vector asked and a row whose distances a task holds at once (8 bytes each, and some more to pick from them).
CELLS = 1 << 20


def choose_k(total: int) -> int:
    return min(1024, max(8, math.isqrt(total)))


def nprobe_for(k: int) -> int:
    return max(4, k // 8)


def dominant_dim(chunks: DataFrame) -> int | None:
    """The dimension most chunks have; of equally frequent ones the largest."""
    row = chunks.filter("embedding is not null").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return row["dim"] if row else None


def scored(chunks: DataFrame, files: DataFrame, query: list[float], clusters: list[int] | None = None) -> DataFrame:
    """(id, file_id, score) of live files' chunks of the query's dimension; with clusters, theirs and those without one."""
    rows = chunks.filter(F.size("embedding") == len(query))
    if clusters is not None:
        rows = rows.filter(F.col("cluster_id").isin(clusters) | F.col("cluster_id").isNull())
    live = files.filter("is_deleted = 0").select(F.col("id").alias("file_id"))
    return rows.select("id", "file_id", vectors.dot(F.col("embedding"), vectors.literal(query)).alias("score")).join(live, "file_id")


def best_per_file(scores: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(file_id, chunk_id, semantic_score): the best chunk of each file that reaches min_score, the first of equal ones."""
    best = scores.filter(F.col("score") >= min_score).groupBy("file_id").agg(F.max(F.struct("score", (-F.col("id")).alias("back"))).alias("best"))
    return best.select("file_id", (-F.col("best.back")).alias("chunk_id"), F.col("best.score").alias("semantic_score"))


def semantic_search(chunks: DataFrame, files: DataFrame, query: list[float], exclude: DataFrame | None = None, limit: int = MOST, min_score: float = MIN_SCORE, clusters: list[int] | None = None) -> DataFrame:
    """(file_id, semantic_score, snippet): the best `limit` files but those in exclude (id); texts are fetched for these only."""
    best = best_per_file(scored(chunks, files, query, clusters), min_score)
    if exclude is not None:
        best = best.join(exclude.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    top = best.orderBy(F.desc("semantic_score"), "file_id").limit(limit)
    told = chunks.select(F.col("id").alias("chunk_id"), text.snippet(F.col("chunk_text")).alias("snippet"))
    return told.join(F.broadcast(top), "chunk_id").select("file_id", F.round("semantic_score", DIGITS).alias("semantic_score"), "snippet")


def top_k(rows: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to the query."""
    return rows.select(id_col, vectors.dot(F.col(vector_col), vectors.literal(query)).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def top_clusters(centroids: list[tuple[int, list[float]]], query: list[float], probes: int | None = None) -> list[int]:
    """Clusters to probe, nearest first, by the fixed rule or `probes` of them; the centroids are at most 1,024."""
    at = np.array([c for _, c in centroids], np.float64) @ np.array(query, np.float64)
    order = sorted(range(len(at)), key=lambda i: (-at[i], centroids[i][0]))
    return [centroids[i][0] for i in order[: probes or nprobe_for(len(centroids))]]


def load_centroids(centroids: DataFrame, meta: DataFrame, dim: int) -> list[tuple[int, list[float]]] | None:
    """The published centroids, if their dimension is dim and their ids have no gap."""
    about = meta.first()
    rows = sorted((r["cluster_id"], list(r["centroid"])) for r in centroids.collect())
    good = about is not None and about["dim"] == dim and rows and [i for i, _ in rows] == list(range(len(rows))) and all(len(c) == dim for _, c in rows)
    return rows if good else None


def assigned(chunks: DataFrame, centroids: list[tuple[int, list[float]]] | None) -> DataFrame:
    """chunks with cluster_id: the nearest centroid, the lowest of equal ones; null without an index or with another dimension."""
    if not centroids:
        return chunks.withColumn("cluster_id", F.lit(None).cast("int"))
    ids, matrix = np.array([i for i, _ in centroids]), np.array([c for _, c in centroids], np.float64)

    @F.pandas_udf("int")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            fits = part.map(lambda v: v is not None and len(v) == matrix.shape[1]).astype(bool)
            out = pd.Series([None] * len(part), index=part.index, dtype="Int32")
            if fits.any():
                out[fits] = ids[(np.stack(part[fits].to_list()).astype(np.float64) @ matrix.T).argmax(1)]
            yield out

    return chunks.withColumn("cluster_id", nearest("embedding"))


def needs_rebuild(total: int, nulls: int, indexed: int | None) -> bool:
    return total >= LEAST_CHUNKS and (indexed is None or nulls > NULLS * total or total > GROWTH * indexed)


def rebuild_decision(chunks: DataFrame, meta: DataFrame) -> Column | DataFrame:
    """One row: total, nulls, indexed, rebuild."""
    one = chunks.filter("embedding is not null").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("cluster_id").isNull()).alias("nulls"))
    row = one.join(F.broadcast(meta.agg(F.max("indexed_chunk_count").alias("indexed"))))
    return row.withColumn("rebuild", (F.col("total") >= LEAST_CHUNKS) & (F.col("indexed").isNull() | (F.col("nulls") > NULLS * F.col("total")) | (F.col("total") > GROWTH * F.col("indexed"))))


def sampled(chunks: DataFrame, dim: int, most: int = SAMPLE) -> np.ndarray:
    """At most `most` vectors, in the order of a hash of their id, so that any part of the corpus may be among them."""
    rows = chunks.filter(F.size("embedding") == dim).select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(most)
    found = rows.select("embedding").toArrow()["embedding"].combine_chunks()
    return found.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def probes_for(sample: np.ndarray, centers: np.ndarray, target: float = RECALL, k: int = MOST, queries: int = 512) -> int:
    """The least number of probes, by the fixed rule at least, that finds `target` of the k nearest of sampled vectors among the sample. Searching without clusters is the exact way."""
    label = (sample @ centers.T).argmax(1)
    asked = sample[:: max(1, len(sample) // queries)][:queries]
    order = np.argsort(np.argsort(-(asked @ centers.T), 1, kind="stable"), 1)
    near = np.argpartition(-(asked @ sample.T), min(k, len(sample)) - 1, 1)[:, :k]
    rank = np.take_along_axis(order, label[near], 1)
    found = np.cumsum(np.bincount(rank.ravel(), minlength=len(centers))) / rank.size
    return max(nprobe_for(len(centers)), int(np.searchsorted(found, target)) + 1)


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centroids; empty clusters start anew from the sample."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    centers = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        label = (sample @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, label, sample)
        empty = np.bincount(label, minlength=k) == 0
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centers


def nearest_in(batches: Iterator[pa.RecordBatch], asked: np.ndarray, seen_in: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, id, seen) of the k rows (id, embedding, cluster_id) nearest to each vector of asked, by d and then id; seen_in: whether probing sees each cluster of ids, and in its last column any other.

    Distances are held for CELLS pairs at once, whatever the batches' rows.
    """
    best = np.zeros((len(asked), 0)), np.zeros((len(asked), 0), np.int64), np.zeros((len(asked), 0), bool)
    step = max(k, CELLS // max(1, len(asked)))
    for batch in batches:
        for begin in range(0, batch.num_rows, step):
            part = batch.slice(begin, step)
            order = pc.array_sort_indices(part.column(0))
            key, cluster = part.column(0).take(order).to_numpy(), pc.fill_null(pc.index_in(part.column(2).take(order), value_set=pa.array(ids, part.column(2).type)), len(ids)).to_numpy()
            distance = asked @ -part.column(1).take(order).flatten().to_numpy().astype(np.float64).reshape(len(key), -1).T
            top = least(distance, k)
            row = np.arange(len(asked))[:, None]
            d, key, seen = (np.concatenate(x, 1) for x in zip(best, (distance[row, top], key[top], seen_in[row, cluster[top]])))
            first = np.lexsort((key, d))[:, :k]
            best = d[row, first], key[row, first], seen[row, first]
    return best


def least(x: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least values of each row, in any order; of equal ones the first."""
    if x.shape[1] <= k:
        return np.broadcast_to(np.arange(x.shape[1]), x.shape)
    top = np.argpartition(x, k - 1, 1)[:, :k]
    most = np.take_along_axis(x, top, 1).max(1, keepdims=True)
    tied = np.flatnonzero((x <= most).sum(1) > k)
    if len(tied):
        below, equal = x[tied] < most[tied], x[tied] == most[tied]
        equal &= np.cumsum(equal, 1) <= k - below.sum(1, keepdims=True)
        top[tied] = np.nonzero(below | equal)[1].reshape(-1, k)
    return top


def nearest_of(chunks: DataFrame, asked: DataFrame, centroids: list[tuple[int, list[float]]], probes: int, k: int = MOST, block: int = 4_096) -> DataFrame:
    """(qid, near: the k nearest chunks of each vector of asked (id, embedding), best first, as (d, id, seen); scanned): seen if probing sees it.

    Vectors are asked in blocks, which bounds what is broadcast; each task hands on its own k nearest only.
    """
    dim, ids = len(centroids[0][1]), np.array([i for i, _ in centroids])
    matrix = np.array([c for _, c in centroids], np.float64)
    rows = asked.filter(F.size("embedding") == dim).select("id", "embedding")
    chunks = chunks.filter(F.size("embedding") == dim).select("id", "embedding", "cluster_id")
    sizes = {r["cluster_id"]: r["count"] for r in chunks.groupBy("cluster_id").count().collect()}
    of, all_ = np.array([sizes.get(i, 0) for i in ids.tolist()]), sum(sizes.values())
    blocks = max(1, -(-rows.count() // block))
    out = None
    for number in range(blocks):
        mine = rows.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow()
        if not mine.num_rows and (out is not None or number < blocks - 1):
            continue
        names = mine["id"].to_numpy()
        vectors_ = mine["embedding"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
        seen_in = np.zeros((len(names), len(ids) + 1), bool)
        np.put_along_axis(seen_in, np.argsort(-(vectors_ @ matrix.T), 1, kind="stable")[:, :probes], True, 1)
        held = chunks.sparkSession.sparkContext.broadcast((names, vectors_, seen_in, seen_in[:, :-1] @ of / max(1, all_)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, asked, seen_in, scanned = held.value
            d, key, seen = nearest_in(batches, asked, seen_in, ids, k)
            q = np.repeat(np.arange(len(names)), d.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(d.ravel()), pa.array(key.ravel()), pa.array(seen.ravel()), pa.array(scanned[q])], ["qid", "d", "id", "seen", "scanned"])

        found = chunks.mapInArrow(run, "qid long, d double, id long, seen boolean, scanned double")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("qid").orderBy("d", "id")
    best = out.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    return best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("d", "id", "seen"))).alias("near"), F.first("scanned").alias("scanned"))


def build(chunks: DataFrame, k: int | None = None) -> tuple[list[tuple[int, list[float]]], DataFrame] | None:
    """(centroids, chunks with new clusters): fitted on a bounded sample, assigned to every row of the dominant dimension."""
    dim = dominant_dim(chunks)
    if dim is None:
        return None
    total = chunks.filter(F.size("embedding") == dim).count()
    centers = spherical_kmeans(sampled(chunks, dim), k or choose_k(total))
    centroids = [(i, [float(np.float32(x)) for x in c]) for i, c in enumerate(centers)]
    return centroids, assigned(chunks, centroids)
