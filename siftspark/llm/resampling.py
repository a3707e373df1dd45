"""Quality classifier by importance resampling.

Two generative models of hashed unigrams and bigrams: the target model from a bounded sample of rows labelled good, the
raw model from every row. A row's weight is the ratio of its probabilities under the two; rows are drawn without
replacement in proportion to it by Gumbel top-k: the k largest log weights plus Gumbel noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import textbytes
from siftspark.llm.common import gathered, row_key, staged

#: Buckets of the hashed n-grams, and the pseudo-count of each.
BUCKETS, PSEUDO = 1 << 14, 1.0
#: Most labelled rows that are used: half for the target model, half to set k. The bound of the broadcast, too.
SAMPLE = 20_000
#: Share of the labelled good rows held out that may lie under the cut, of weight per n-gram, which sets k.
MISS = 0.002
#: Bins of the search for the k-th key, and keys that the driver may see at its end.
BINS = 4096
PART = 1024

CLASSES = np.full(256, 2, np.uint8)
CLASSES[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
CLASSES[textbytes.SPACES] = 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and each one's text: runs of word bytes, and runs of other bytes, without white space."""
    kind = CLASSES[data]
    new = np.zeros(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offsets] = True
    edges = np.flatnonzero(new)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    return textbytes.slice_hashes(textbytes.prefix_hashes(data), starts, ends), np.searchsorted(offsets, starts, "right") - 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and each one's text; in lower case."""
    one, owner = textbytes.by_block(tokens, textbytes.LOWER[data], offsets)
    pair = owner[1:] == owner[:-1]
    two = textbytes.mix(one[:-1] * textbytes.MULTIPLIER + one[1:])[pair]
    buckets = (np.concatenate([one, two]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return buckets, np.concatenate([owner, owner[1:][pair]])


def labelled(labels: DataFrame, good, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, role): at most `sample` good rows, by the order of a hash of the id; role 0 fits the model, 1 sets the cut."""
    rows = labels.groupBy("doc_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("good")).filter("good and doc_id is not null")
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit("sample"))).orderBy("h", "doc_id").limit(sample)
    return rows.select("doc_id", F.pmod(F.shiftright("h", 7), F.lit(2)).cast("int").alias("role"))


def counted(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the buckets over the rows of role 0, and over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, every = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part, data, offsets in textbytes.chunks(batches, 1):
            if len(data):
                buckets, owner = features(data, offsets)
                fit = (np.asarray(part.column(2)) == 0)[owner]
                every += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[fit], minlength=BUCKETS)
        cut = range(0, BUCKETS, PART)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(cut), pa.int32()), "target": [target[i : i + PART].tobytes() for i in cut], "every": [every[i : i + PART].tobytes() for i in cut]})

    def add(table: pa.Table) -> pa.Table:
        total = {c: sum(np.frombuffer(x, np.int64) for x in table[c].to_pylist()).tobytes() for c in ("target", "every")}
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "target": [total["target"]], "every": [total["every"]]})

    schema = "part int, target binary, every binary"
    rows = sorted(marked.mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect())
    if not rows:
        return np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    return tuple(np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("target", "every"))


def weighed(marked: DataFrame, ratio: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in textbytes.chunks(batches, 1):
            n, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
            if len(data):
                buckets, owner = features(data, offsets)
                n = np.bincount(owner, minlength=part.num_rows)
                total = np.bincount(owner, ratio[buckets], minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(n, pa.int64()), pa.array(total, pa.float64())], ["doc_id", "role", "row", "n_features", "log_weight"])

    return marked.mapInArrow(run, "doc_id long, role int, row long, n_features long, log_weight double")


def kth_largest(keys: DataFrame, k: int, total: int) -> float | None:
    """The k-th largest `key`, by histograms of ever smaller ranges; the driver sees BINS counts, or BINS keys at the end."""
    if k <= 0 or total == 0:
        return None
    low, high, above = *keys.agg(F.min("key"), F.max("key")).first(), 0
    while low < high:
        width = (high - low) / BINS
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        bins = sorted(inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("low"), F.max("key").alias("high")).collect(), reverse=True)
        for _, count, a, b in bins:
            if above + count >= k:
                break
            above += count
        if (a, b) == (low, high) or width <= 0:
            break
        low, high = a, b
        if count <= BINS:
            found = sorted((r[0] for r in keys.filter((F.col("key") >= low) & (F.col("key") <= high)).select("key").collect()), reverse=True)
            return found[k - above - 1]
    return low


def resample(docs: DataFrame, labels: DataFrame, good, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, miss: float = MISS, share: float | None = None) -> DataFrame:
    """One row per input row: doc_id, n_features, log_weight, key, kept, row (common.row_key).

    good: condition on a label row. share: the share of the rows to draw; without it, k is the number of rows whose log
    weight per n-gram reaches the `miss` quantile of the labelled good rows held out, so that length doesn't set it. Without any such row, all rows are kept.
    Rows whose keys equal the k-th are all kept (repeated rows have equal keys). A null or empty text has weight 0;
    rows without id or label are weighed like others. Other columns are ignored.
    """
    rows = gathered(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))
    chosen = staged(labelled(labels, good), "labels", 1)
    marked = rows.join(F.broadcast(chosen), "doc_id", "left").select("doc_id", "text", F.coalesce("role", F.lit(2)).alias("role"), "row")
    target, every = counted(marked)
    fitted = target.sum() > 0
    ratio = np.log(target + PSEUDO) - np.log(target.sum() + PSEUDO * BUCKETS) - np.log(every + PSEUDO) + np.log(every.sum() + PSEUDO * BUCKETS)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "n_features", "log_weight"), 11).cast("double") + 0.5) * 2.0**-53
    scored = staged(weighed(marked, ratio if fitted else np.zeros(BUCKETS)).withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    total = scored.count()
    mean = F.col("log_weight") / F.greatest("n_features", F.lit(1))
    held = scored.filter("role = 1").agg(F.percentile(mean, F.lit(miss)).alias("cut"), F.count(F.lit(1)).alias("n")).first()
    if share is not None:
        k = round(share * total)
    elif held["n"] and fitted:
        k = scored.filter(mean >= held["cut"]).count()
    else:
        k = total
    least = kth_largest(scored, k, total)
    kept = F.lit(False) if least is None else F.col("key") >= least
    return scored.select("doc_id", "n_features", "log_weight", "key", kept.alias("kept"), "row")
