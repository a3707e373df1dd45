"""N-gram Jaccard join by signature trees.

The upper levels of the tree are a partition of the distinct shingle sets by size range and by rare shingles: in the
order of the number of sets that have them, two sets that link share one of the first |x| - ceil(t |x|) + 1 shingles of each.
Shingles that one set has alone can't be shared, so only the others are dealt out; sets that share one and whose sizes
admit a link, directly or by way of others, form a cluster, and links lie inside clusters only. In a cluster of any size from two
sets on, the nodes of a signature tree hold OR-combined token bitmaps and size ranges; a dual traversal prunes pairs of
nodes whose largest possible overlap is too small, or whose sets are connected already, and the remaining pairs of sets
are compared exactly.

Shingles are counted by an exchange: places (the texts of a task, some MB at a time) deal their shingles to buckets, ranges of their
hashes; a bucket answers every place with the counts of those that are shared. A shingle that many sets of a place have is
dealt once, with their number, so that a passage of all texts makes one record a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import textbytes
from siftspark.llm.common import gathered, row_key, shuffle_width, small, staged, tasks_for
from siftspark.llm.components import components
from siftspark.llm.difference_cover import packed, unpacked

#: Sets of a tree at most; larger clusters are cut into blocks of about as many.
BLOCK = 256
PIVOTS = 24
LEAF, FANOUT = 8, 4
#: Keys of one bucket, and bytes of sets of one task, about.
BUCKET_KEYS, TASK_BYTES = 1 << 19, 4 << 20
RECORD = np.dtype([("key", "<u8"), ("node", "<i8"), ("size", "<i4")])
#: Bytes of text shingled at once, of a place, and of those whose shingles one bucket counts, about.
CHUNK, PLACE_BYTES, BUCKET_BYTES = 1 << 19, 1 << 23, 1 << 23
#: Rows of names and numbers that a task writes, about.
ROWS = 1 << 20
#: Sets of a place from which a shingle is dealt once for all of them.
COMMON = 64
#: Bits of a shingle's hash that are counted and make its key: two shingles with the same ones only make a comparison more.
BITS = 48
DEALT = "place long, bucket long, records binary, sets binary, common binary"


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of n words; of fewer words, the whole sequence is one."""
    word, owner = textbytes.by_block(textbytes.word_hashes, textbytes.LOWER[data], offsets)
    first = np.searchsorted(owner, np.arange(len(offsets)))
    rolled = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for i in range(n):
        rolled = rolled * textbytes.MULTIPLIER + word[i : len(word) - n + 1 + i]
    rolled = textbytes.mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = whole * textbytes.MULTIPLIER + word[i : i + 1]
            out.append(textbytes.mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def names(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set: equal sets have equal names."""
    sums = np.array([textbytes.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    return textbytes.mix(sums + np.array([len(s) for s in sets], np.uint64) * textbytes.MULTIPLIER).view(np.int64)


def asked(place: int, sets: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows of DEALT of a place: its shingles (hash, set's number or -1, number of sets) for each bucket, and for itself its sets' names and sizes and the sets of common shingles."""
    node, size = names(sets), np.array([len(s) for s in sets], np.int64)
    keep = np.unique(node, return_index=True)[1]
    keep = keep[size[keep] > 0]
    node, size, sets = node[keep], size[keep], [sets[i] for i in keep]
    flat = (np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - BITS)).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)])
    times = np.diff(np.append(first, len(flat)))
    common = np.repeat(times >= COMMON, times)
    own = packed(np.stack([node, size], 1)), packed(np.stack([flat[common], owner[common]], 1))
    once, many = first[times >= COMMON], times[times >= COMMON]
    owner[once] = -1
    common[once] = False
    flat, owner, number = flat[~common], owner[~common], np.ones(len(flat) - int(common.sum()), np.int64)
    number[np.flatnonzero(owner < 0)] = many
    width = -(-(1 << BITS) // buckets)
    cut = np.searchsorted(flat, np.arange(buckets + 1) * width)
    used = np.flatnonzero(np.diff(cut))
    blobs = [packed(np.stack([np.diff(flat[a:b], prepend=0), owner[a:b], number[a:b]], 1)) for a, b in zip(cut[used], cut[used + 1])]
    # A place's own row goes by a bucket of its own.
    return pa.RecordBatch.from_arrays([pa.array([place] * (len(used) + 1), pa.int64()), pa.array([*used, -1 - place], pa.int64()), pa.array([*blobs, None], pa.binary()), pa.array([*[None] * len(used), own[0]], pa.binary()), pa.array([*[None] * len(used), own[1]], pa.binary())], DEALT_NAMES)


DEALT_NAMES = [x.split()[0] for x in DEALT.split(", ")]


def counted(table: pa.Table) -> pa.Table:
    """Of a bucket: for each place its records whose shingles two sets or more have, with the number of sets."""
    if table["bucket"][0].as_py() < 0:
        return table
    parts = [unpacked(x, 3) for x in table["records"].to_pylist()]
    for x in parts:
        x[:, 0] = np.cumsum(x[:, 0])
    rows = np.concatenate(parts)
    of = np.unique(rows[:, 0], return_inverse=True)[1]
    rows[:, 2] = np.bincount(of, rows[:, 2])[of]
    cut = np.cumsum([0, *map(len, parts)])
    blobs = [packed(x[x[:, 2] > 1]) for x in (rows[a:b] for a, b in zip(cut[:-1], cut[1:]))]
    none = pa.nulls(len(blobs), pa.binary())
    return pa.table([table["place"], table["bucket"], pa.array(blobs, pa.binary()), none, none], DEALT_NAMES)


def rare_keys(table: pa.Table, percent: int, buckets: int) -> pa.Table:
    """Of a place: the keys of its sets, those of their rarest shingles that others have too, dealt to buckets."""
    own = [r for r in table.to_pylist() if r["sets"] is not None][0]
    node, size = unpacked(own["sets"], 2).T
    rows = np.concatenate([np.zeros((0, 3), np.int64), *[unpacked(x, 3) for x in table["records"].to_pylist() if x is not None]])
    common, single = unpacked(own["common"], 2), rows[:, 1] >= 0
    once = rows[~single][np.argsort(rows[~single, 0])]
    if len(once):  # every common shingle has an answer, as some sets have it
        count = once[np.searchsorted(once[:, 0], common[:, 0]), 2]
        rows = np.concatenate([rows[single], np.concatenate([common, count[:, None]], 1)])
    key, owner, count = rows.T
    shared = np.bincount(owner, minlength=len(size))
    left = np.maximum(0, size - -(-percent * size // 100) + 1 - (size - shared))
    order = np.lexsort((key, count, owner))
    rank = np.arange(len(rows)) - np.repeat(np.cumsum(shared) - shared, shared)
    kept = order[rank < left[owner[order]]]
    found = np.zeros(len(kept), RECORD)
    found["key"], found["node"], found["size"] = key[kept], node[owner[kept]], size[owner[kept]]
    return pa.Table.from_batches([dealt(found, buckets)])


def dealt(found: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket, with its records as bytes."""
    to = (textbytes.mix(found["key"]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(buckets + 1))
    found = found[order]
    used = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([found[cut[p] : cut[p + 1]].tobytes() for p in used], pa.binary())], ["bucket", "records"])


def stars(table: pa.Table, percent: int) -> pa.Table:
    """Of a bucket: links (a, b) that connect the nodes that share a key and whose sizes admit a link."""
    found = np.concatenate([np.frombuffer(x.as_buffer(), RECORD) for x in table["records"]])
    found = found[np.lexsort((found["node"], found["size"], found["key"]))]
    size = found["size"].astype(np.int64)
    # Sizes in order: where one is too small for the next, no smaller one links with that or a larger one.
    head = np.concatenate([[True], (found["key"][1:] != found["key"][:-1]) | (100 * size[:-1] < percent * size[1:])])
    run = np.cumsum(head) - 1
    least = np.minimum.reduceat(found["node"], np.flatnonzero(head))[run]
    real = least != found["node"]
    pairs = np.unique(np.stack([least[real], found["node"][real]], 1), axis=0) if real.any() else np.zeros((0, 2), np.int64)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


class Joined:
    """Union-find over the sets of a task, with the links that joined them."""

    def __init__(self, labels: list[int]) -> None:
        self.parent = list(range(len(labels)))
        self.links: list[tuple[int, int]] = []
        seen: dict[int, int] = {}
        for i, x in enumerate(labels):
            self.parent[i] = seen.setdefault(x, i)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.links.append((i, j))
        self.parent[max(self.root(i), self.root(j))] = min(self.root(i), self.root(j))


class Tree:
    """Signature tree over sets in the order of their sizes: levels of bitmaps, size ranges and excess of tokens over bits."""

    def __init__(self, sets: list[np.ndarray], members: list[int], bits: int) -> None:
        self.members = sorted(members, key=lambda i: (len(sets[i]), i))
        self.sets = sets
        size = np.array([len(sets[i]) for i in self.members])
        maps = np.zeros((len(self.members), bits // 64), np.uint64)
        for row, i in enumerate(self.members):
            at = sets[i] & np.uint64(bits - 1)
            np.bitwise_or.at(maps[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        excess = size - np.bitwise_count(maps).sum(1)
        self.levels = [(maps, size, size, excess)]
        self.width = [LEAF]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, excess = self.levels[-1]
            cut = np.arange(0, len(maps), LEAF if len(self.levels) == 1 else FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(excess, cut)))
        self.top = len(self.levels) - 1

    def below(self, level: int, k: int) -> range:
        step = LEAF if level == 1 else FANOUT
        return range(k * step, min(len(self.levels[level - 1][0]), (k + 1) * step))


def possible(a: Tree, la: int, i: int, b: Tree, lb: int, j: int, percent: int) -> bool:
    """Whether a set below node i and one below node j can link, by sizes and the largest overlap their bitmaps allow."""
    (ma, lo_a, hi_a, ea), (mb, lo_b, hi_b, eb) = a.levels[la], b.levels[lb]
    if 100 * hi_a[i] < percent * lo_b[j] or 100 * hi_b[j] < percent * lo_a[i]:
        return False
    most = min(int(np.bitwise_count(ma[i] & mb[j]).sum()) + min(ea[i], eb[j]), hi_a[i], hi_b[j])
    return most * (100 + percent) >= percent * (lo_a[i] + lo_b[j])


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return 100 * both >= percent * (len(x) + len(y) - both)


def traverse(a: Tree, b: Tree, joined: Joined, percent: int) -> None:
    """Dual traversal: joins every two sets, one of each tree, that link, but for those connected already."""

    def roots(tree: Tree, level: int, k: int) -> set[int]:
        low = high = k
        for at in range(level, 0, -1):
            low, high = tree.below(at, low).start, tree.below(at, high).stop - 1
        return {joined.root(i) for i in tree.members[low : high + 1]}

    stack = [(a.top, 0, b.top, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if a is b and la == lb and i > j:
            continue
        if la == lb == 0:
            x, y = a.members[i], b.members[j]
            if joined.root(x) != joined.root(y) and possible(a, 0, i, b, 0, j, percent) and links(a.sets[x], b.sets[y], percent):
                joined.join(x, y)
            continue
        if not possible(a, la, i, b, lb, j, percent):
            continue
        ra = roots(a, la, i)
        if len(ra) == 1 and ra == roots(b, lb, j):
            continue
        if la >= lb:
            below = [(la - 1, k) for k in a.below(la, i)]
            if la == lb:
                stack += [(la - 1, p, lb - 1, q) for p in reversed(a.below(la, i)) for q in reversed(b.below(lb, j))]
            else:
                stack += [(*p, lb, j) for p in reversed(below)]
        else:
            stack += [(la, i, lb - 1, q) for q in reversed(b.below(lb, j))]


def bits_for(sets: list[np.ndarray]) -> int:
    typical = int(np.median([len(s) for s in sets]))
    return min(1 << 16, max(512, 1 << (8 * typical - 1).bit_length()))


def linked(table: pa.Table, percent: int) -> pa.Table:
    """Of a task's rows (job, side, node, label, tokens): links that join the sets of each job, side 0 with all, or with side 1 if there is one."""
    job, side, node, label = (table[c].to_numpy() for c in ("job", "side", "node", "label"))
    order = np.lexsort((node, side, job))
    found_a, found_b = [], []
    tokens = table["tokens"].combine_chunks() if isinstance(table["tokens"], pa.ChunkedArray) else table["tokens"]
    cut = np.flatnonzero(np.concatenate([[True], job[order][1:] != job[order][:-1], [True]]))
    for a, b in zip(cut[:-1], cut[1:]):
        rows = order[a:b]
        keep = np.concatenate([[True], (node[rows][1:] != node[rows][:-1]) | (side[rows][1:] != side[rows][:-1])])
        rows = rows[keep]
        if len(rows) < 2:
            continue
        sets = [np.frombuffer(tokens[int(r)].as_buffer(), np.uint64) for r in rows]
        joined = Joined(label[rows].tolist())
        bits = bits_for(sets)
        parts = [[k for k in range(len(rows)) if side[rows[k]] == s] for s in (0, 1)]
        left = Tree(sets, parts[0], bits) if parts[0] else None
        if left and parts[1]:
            traverse(left, Tree(sets, parts[1], bits), joined, percent)
        elif left:
            traverse(left, left, joined, percent)
        found_a += [node[rows[i]] for i, _ in joined.links]
        found_b += [node[rows[j]] for _, j in joined.links]
    a, b = np.array(found_a, np.int64), np.array(found_b, np.int64)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _tasks(jobs: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Links found in jobs (job, side, node, label, tokens), several jobs to a task."""
    jobs = jobs.withColumn("task", F.pmod(F.xxhash64("job"), F.lit(tasks)).cast("int"))
    return jobs.groupBy("task").applyInArrow(lambda t: linked(t, percent), "a long, b long")


def _labelled(sets: DataFrame, found: DataFrame) -> DataFrame:
    """sets with the label of each node's component by the links found so far."""
    labels = components(found).select("node", F.col("component").alias("label"))
    return sets.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def tree_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the sets (cluster, node, tokens) of each cluster as all links would."""
    spark = sets.sparkSession
    total = sets.agg(F.coalesce(F.sum(F.length("tokens")), F.lit(0))).first()[0]
    tasks, files = max(shuffle_width(spark), total // TASK_BYTES), tasks_for(spark, total, 1)
    sizes = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    sets = staged(sets.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("members") / BLOCK)).cast("int")), "sets", files)
    # Of a cluster of several blocks, about PIVOTS sets are in every block: they join most components across blocks.
    pivots = sets.filter((F.col("members") > BLOCK) & (F.pmod(F.xxhash64("node", F.lit(2)), F.ceil(F.col("members") / PIVOTS)) == 0))
    copies = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("members") / BLOCK).cast("int") - 1)))
    one = sets.unionByName(copies).select(F.xxhash64("cluster", "block").alias("job"), F.lit(0).alias("side"), "node", F.col("node").alias("label"), "tokens")
    found = staged(_tasks(one, percent, tasks), "links", files)
    large = sets.filter(F.col("members") > BLOCK)
    if large.isEmpty():
        return found
    # Then, where components remain, every set outside the largest one against all blocks: nothing is left unchecked.
    linked_large = found.join(large.select(F.col("node").alias("a")), "a", "left_semi")
    labels = staged(_labelled(large, linked_large), "labels", files)
    counts = labels.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), (F.sum("n") - F.max("n")).alias("outside")).filter("labels > 1")
    rest = labels.join(main, "cluster").withColumns({"chunks": F.ceil(F.col("outside") / BLOCK), "blocks": F.ceil(F.col("members") / BLOCK)})
    out = rest.filter("label <> main").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(9)), F.col("chunks")))
    left = out.select("*", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("to")).select(F.xxhash64("cluster", "chunk", "to").alias("job"), F.lit(0).alias("side"), "node", "label", "tokens")
    right = rest.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).select(F.xxhash64("cluster", "chunk", "block").alias("job"), F.lit(1).alias("side"), "node", "label", "tokens")
    pairs = staged(left.unionByName(right), "pairs")
    volume = pairs.agg(F.coalesce(F.sum(F.length("tokens")), F.lit(0))).first()[0]
    return found.unionByName(_tasks(pairs, percent, max(shuffle_width(spark), volume // TASK_BYTES)))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, and row (common.row_key) and label, which is equal in rows of one component, null without words.

    Words are runs of other characters than white space, with A-Z lower-cased; a text's set are its distinct shingles of
    n words, of fewer words the whole sequence as one. Two texts link when 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable by links. A text without words (or null) links with nothing and is
    its own component. Repeated rows are equal texts; null ids get the component of their text's other rows, if any.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in textbytes.chunks(batches, 1, CHUNK):
            sets = shingles(data, offsets, n)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(names(sets))], ["doc_id", "row", "n_shingles", "node"])

    named = staged(gathered(rows).mapInArrow(name, "doc_id long, row long, n_shingles long, node long"), "named")
    total, sets = named.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count(F.lit(1))).first()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges, buckets = max(4 * shuffle_width(spark), size // BUCKET_BYTES), max(4 * shuffle_width(spark), total * (100 - percent) // 100 // BUCKET_KEYS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, room = TaskContext.get().partitionId() << 32, [], 0
        for _, data, offsets in textbytes.chunks(batches, 1, CHUNK):
            held += shingles(data, offsets, n)
            room += len(data)
            if room >= PLACE_BYTES:
                yield asked(place, held, ranges)
                place, held, room = place + 1, [], 0
        if held:
            yield asked(place, held, ranges)

    counts = gathered(rows).select("doc_id", "text").mapInArrow(ask, DEALT).groupBy("bucket").applyInArrow(counted, DEALT)
    found = counts.groupBy("place").applyInArrow(lambda t: rare_keys(t, percent, buckets), "bucket int, records binary")
    clusters = components(found.groupBy("bucket").applyInArrow(lambda t: stars(t, percent), "a long, b long"))
    first = named.filter("n_shingles > 0").groupBy("node").agg(F.min("row").alias("row"), F.max("n_shingles").alias("n"))
    wanted = staged(clusters.join(first, "node").select("row", "node", F.col("component").alias("cluster"), "n"), "wanted", 1 + sets // ROWS)
    found, held = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = small(wanted.drop("n"), found, 48)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in textbytes.chunks(batches, 1, CHUNK):
            sets = shingles(data, offsets, n)
            out = pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array([s.tobytes() for s in sets], pa.binary())], ["cluster", "node", "tokens"])
            yield out.filter(pa.array(names(sets) == part.column(3).to_numpy()))  # not of another row whose hash is the same

    sets = rows.join(wanted, "row").select("doc_id", "text", "cluster", "node").mapInArrow(tokens, "cluster long, node long, tokens binary")
    joined = components(tree_links(staged(sets, "tokens", tasks_for(spark, 8 * held, 1)), percent))
    per_node = named.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(joined, "node", "left").withColumn("label", F.coalesce("component", "node"))
    of = per_node.join(per_node.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id", "label")
    full, none = named.filter("n_shingles > 0"), named.filter("n_shingles = 0")
    out = full.join(of, "node").select("doc_id", "n_shingles", "component_id", "row", "label")
    return out.unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row", F.lit(None).cast("long").alias("label")))
