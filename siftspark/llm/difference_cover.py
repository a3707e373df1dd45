"""Distributed difference-cover sort of suffixes of many texts, to a given depth, over content-defined symbols.

Of the GRAM-byte grams in every stretch of `span` positions the one with the least hash is an anchor. A text's string has
a symbol for each anchor: the rank of the `word` = span + GRAM bytes from there, among all such words in the order of
their bytes. As a word tells where the next anchor is, words at the anchors, one after another, order suffixes just as
their bytes do, and equal texts of `depth` bytes have equal anchors, whatever stands around them.

1. Words are ranked by a range sort of the distinct ones (ranked_words).
2. Difference cover: of every level's string the suffixes that begin at i mod 3 = 1 or 2 are sampled, their triples of
   symbols sorted and named; the names, those of i mod 3 = 1 before those of 2, are the string of the next level. The
   recursion ends once every name tells `depth` bytes. On the way back the remaining suffixes (i mod 3 = 0) are merged
   with the sampled ones, whose ranks are known, by their first one or two symbols and the rank of the sampled suffix that follows.
3. The suffixes that begin between anchors are those of an anchor with up to span - 1 bytes in front of it. In the order
   of step 2 adjacent anchors are compared byte by byte; so are the bytes in front of anchors, in the order of these
   read backwards. Two strings of `depth` bytes are equal if they lie in one run of either order that is long enough.

Suffixes that are equal in the first `depth` bytes may have any order among each other, but stand together. Nothing is
judged by a hash: words, names and neighbours are compared as they are.

Every step asks the same way: places (rows with some texts each) deal distinct records to buckets, which are ranges of
the order of about GROUP symbols; a bucket answers every place's records in the order they came in, and its numbers are
moved by the count of those in buckets before it. A word that GROUP anchors or more have gets a range of its own, which is
split by the word that follows. A passage that all texts share makes one record a place, not one a text. The driver
sees counts of ranges of the word sort only, and the least number of bytes that a level's names tell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.llm import textbytes
from siftspark.llm.common import Table, small

GRAM = 8
#: Symbols of a range of the order, about.
GROUP = 1 << 16
DEALT = "place long, bucket long, records binary, n long"


def span_of(depth: int) -> int:
    """Positions of which one is an anchor at least. Any anchor with the bytes behind it that a string of `depth` bytes holds tells its own word and the next anchor's."""
    return min(64, (depth - GRAM) // 3)


def packed(x: np.ndarray) -> bytes:
    """Numbers (n or n x columns), column by column and byte by byte, compressed."""
    x = np.ascontiguousarray(x.T, np.int64)
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(blob: bytes, columns: int = 1) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    x = np.ascontiguousarray(flat.reshape(8, -1).T).view(np.int64).reshape(columns, -1)
    return x[0] if columns == 1 else np.ascontiguousarray(x.T)


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows as they first come, the place of every row among them, and how often each is there. Grouped by hash, and by sorting if two rows share one."""
    if not len(rows):
        return rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
    name = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        name = textbytes.mix(name * textbytes.MULTIPLIER + rows[:, c].view(np.uint64))
    of = pd.factorize(name)[0]
    out = rows[np.flatnonzero(np.diff(np.maximum.accumulate(of), prepend=-1))]
    if not (out[of] == rows).all():
        out, of = np.unique(rows, axis=0, return_inverse=True)
        of = of.ravel()
    return out, of, np.bincount(of)


def keys(*tables: np.ndarray) -> list[np.ndarray]:
    """A number for each row of tables with the same columns, all in the order of the rows."""
    rows = np.concatenate(tables)
    out, room = np.zeros(len(rows), np.int64), 63
    for c in range(rows.shape[1] if len(rows) else 0):
        x = rows[:, c] - rows[:, c].min()
        if int(x.max()).bit_length() > room:
            out = np.unique(out, return_inverse=True)[1]
            room = 63 - int(out.max()).bit_length()
        if int(x.max()).bit_length() > room:
            x = np.unique(x, return_inverse=True)[1]
        bits = int(x.max()).bit_length()
        out, room = out << bits | x, room - bits
    return np.split(out, np.cumsum([len(t) for t in tables])[:-1])


class Strings:
    """Lengths, places and anchors of the strings of each level, from the number of each text's anchors alone. Each string has three zeros behind it."""

    def __init__(self, lens: np.ndarray) -> None:
        self.lens = lens
        self.place = self.spread(lens)
        self.position = np.full(int((lens + 3).sum()), int(lens.sum()))
        self.position[self.place] = np.arange(int(lens.sum()))

    @staticmethod
    def spread(lens: np.ndarray) -> np.ndarray:
        return np.arange(int(lens.sum())) + np.repeat(3 * np.arange(len(lens)), lens)

    def padded(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.position), np.int64)
        out[self.place] = values
        return out

    def sampled(self) -> np.ndarray:
        """Places of the sampled suffixes, in the order of the next level's symbols; one begins at or next to each string's end."""
        one, two = (self.lens + 2) // 3, (self.lens + 1) // 3
        many = one + two
        text = np.repeat(np.arange(len(many)), many)
        j = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        i = np.where(j < one[text], 1 + 3 * j, 2 + 3 * (j - one[text]))
        return (np.cumsum(self.lens + 3) - self.lens - 3)[text] + i

    def residue(self) -> np.ndarray:
        return (np.arange(int(self.lens.sum())) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)) % 3

    def next(self) -> Strings:
        out = object.__new__(Strings)
        out.lens = (self.lens + 2) // 3 + (self.lens + 1) // 3
        out.place = self.spread(out.lens)
        out.position = np.full(int((out.lens + 3).sum()), self.position[-1] if len(self.position) else 0)
        out.position[out.place] = self.position[self.sampled()]
        return out

    def level(self, k: int) -> Strings:
        return self if k == 0 else self.next().level(k - 1)


def least_in(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    done = 1
    while done * 2 <= width:
        x, done = np.minimum(x[:-done], x[done:]), done * 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def grams_of(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on, with zeros behind the data."""
    padded = np.zeros(len(data) + GRAM, np.uint8)
    padded[: len(data)] = data
    out = np.zeros(len(data), np.uint64)
    for b in range(GRAM):
        out = out << np.uint64(8) | padded[b : b + len(data)]
    return textbytes.mix(out)


def anchors_of(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """(position, first, last) of every anchor of texts of `depth` bytes or more: it is that of the strings of `depth` bytes that begin at first to last (none if last < first)."""
    span = span_of(depth)
    if len(data) < span:
        return np.zeros((0, 3), np.int64)
    marked = grams_of(data) >> np.uint64(32) << np.uint64(32) | np.arange(len(data), dtype=np.uint64)
    start = np.arange(len(data) - span + 1)
    end = ends[np.searchsorted(ends, start, "right")]
    inside = start + span + GRAM - 1 <= end
    start, end = start[inside], end[inside]
    at = (least_in(marked, span) & np.uint64(0xFFFFFFFF)).astype(np.int64)[inside]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return np.stack([at[first], start[first], np.minimum(start[last], end[last] - depth)], 1)


def slices(data: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Rows of `width` bytes from each position on, which may be before or behind the data: zeros there."""
    padded = np.zeros(len(data) + 2 * width, np.uint8)
    padded[width : width + len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, width)[np.clip(begin, -width, len(data)) + width]


def cut_off(rows: np.ndarray, room: np.ndarray) -> np.ndarray:
    """rows with zeros from each one's room on."""
    short = np.flatnonzero(room < rows.shape[1])
    rows[short] *= np.arange(rows.shape[1]) < room[short, None]
    return rows


def words_of(data: np.ndarray, ends: np.ndarray, at: np.ndarray, width: int, skip: int = 0) -> np.ndarray:
    """The `width` bytes from `skip` behind each position on, with zeros behind its text's end."""
    return cut_off(slices(data, at + skip, width), ends[np.searchsorted(ends, at, "right")] - at - skip)


def numbers(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit numbers."""
    out = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view(np.int64)


def binaries(rows: np.ndarray) -> pa.Array:
    offsets = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


Row = dict[str, object]
#: Records of a place, their buckets, and what else the place needs to read the answers.
Ask = Callable[[Row], tuple]


def dealt(state: DataFrame, ask: Ask) -> DataFrame:
    """The records of every place, a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                records, bucket = ask(row)[:2]
                order = np.argsort(bucket, kind="stable")
                used, cut = np.unique(bucket[order], return_index=True)
                blobs = [packed(records[order[a:b]]) for a, b in zip(cut, np.append(cut[1:], len(order)))]
                yield pa.RecordBatch.from_pydict({"place": pa.array([row["place"]] * len(used), pa.int64()), "bucket": pa.array(used, pa.int64()), "records": pa.array(blobs, pa.binary()), "n": pa.array([0] * len(used), pa.int64())})

    return state.mapInArrow(run, DEALT)


def offsets(answered: DataFrame) -> DataFrame:
    """(bucket, before): the sum of the answers' counts over all smaller buckets, in two levels of ranges."""
    counts = answered.groupBy("bucket").agg(F.max("n").alias("n")).withColumn("upper", F.shiftright("bucket", 39))
    below = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    upper = counts.groupBy("upper").agg(F.sum("n").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(below(F.lit(0)).orderBy("upper")), F.lit(0)))
    inner = counts.withColumn("inner", F.coalesce(F.sum("n").over(below("upper").orderBy("bucket")), F.lit(0)))
    return inner.join(upper.select("upper", "base"), "upper").select("bucket", (F.col("base") + F.col("inner")).alias("before"))


def exchange(state: DataFrame, ask: Ask, columns: int, answer: Callable[[np.ndarray], tuple[np.ndarray, int]], take: Callable[..., Row], schema: str, label: str, tasks: int, moved: bool = False) -> Table:
    """Ask buckets for numbers of the records of each place, and make the place's new row of its old one and the answers.

    answer(records) gives a number for each record of a bucket, and by how much the numbers of later buckets move, if they are moved.
    """

    def run(table: pa.Table) -> pa.Table:
        parts = [unpacked(x, columns) for x in table["records"].to_pylist()]
        reply, n = answer(np.concatenate(parts))
        cut = np.cumsum([0, *map(len, parts)])
        blobs = [packed(reply[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        return pa.table({"place": table["place"], "bucket": table["bucket"], "records": pa.array(blobs, pa.binary()), "n": pa.array([n] * len(blobs), pa.int64())})

    answered = Table(dealt(state, ask).groupBy("bucket").applyInArrow(run, DEALT), f"{label}-answers", tasks)
    if moved:
        before = offsets(answered.df)
        replies = answered.df.join(small(before, before.count(), 32), "bucket")
    else:
        replies = answered.df.withColumn("before", F.lit(0).cast("long"))
    replies = replies.select("place", "bucket", "records", "before")
    types = state.sparkSession.createDataFrame([], schema).schema

    def receive(mine: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in mine.to_pylist():
            records, bucket, *context = ask(row)
            order, reply = np.argsort(bucket, kind="stable"), np.zeros(len(records), np.int64)
            got = sorted(zip(*(replies[c].to_pylist() for c in ("bucket", "records", "before"))))
            reply[order] = np.concatenate([np.zeros(0, np.int64), *[unpacked(x) + n for _, x, n in got]])
            out.append(take(row, reply, *context))
        return pa.Table.from_pylist(out, arrow)

    arrow = pa.schema([(f.name, {"bigint": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}[f.dataType.simpleString()]) for f in types])
    done = Table(state.groupBy("place").cogroup(replies.groupBy("place")).applyInArrow(receive, schema), label, tasks)
    answered.drop()
    return done


TEXTS = "place long, starts binary, lens binary, data binary, anchors binary, many binary"
STATE = "place long, many binary, at binary, bucket binary, names array<binary>, ranks binary, told long"


def text_of(row: Row) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a place's texts, and where each ends."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8), np.cumsum(unpacked(row["lens"]))


def with_anchors(place: int, starts: np.ndarray, lens: np.ndarray, data: bytes, depth: int) -> Row:
    """A row of TEXTS: texts of `depth` bytes or more, and where each starts in the place's input."""
    ends = np.cumsum(lens)
    found = anchors_of(np.frombuffer(data, np.uint8), ends, depth)
    many = np.bincount(np.searchsorted(ends, found[:, 0], "right"), minlength=len(lens))
    return {"place": place, "starts": packed(starts), "lens": packed(lens), "data": zstandard.ZstdCompressor(1).compress(data), "anchors": packed(found), "many": packed(many)}


def ranked_words(texts: DataFrame, depth: int, tasks: int) -> Table:
    """STATE of each place: symbols of its anchors (the first of names) and their buckets.

    Distinct words are sorted by Spark's range partitioning; a word's symbol is its place in the order, and its range is
    told by the number of anchors whose words are smaller. bucket is the word's range, above 2 ** 31, and below it for
    words that GROUP anchors have one more than the range of the word that follows; so buckets are in the order, too.
    """
    spark, word = texts.sparkSession, span_of(depth) + GRAM

    def own(row: Row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, ends = text_of(row)
        words = words_of(data, ends, unpacked(row["anchors"], 3)[:, 0], word)
        _, of, many = distinct(numbers(words))
        return words[np.unique(of, return_index=True)[1]], of, many

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words, _, many = own(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), row["place"])), pa.array(np.arange(len(words))), binaries(words), pa.array(many)], ["place", "nth", "word", "many"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if batch.num_rows:
                many = batch.column(1).to_numpy()
                upto = before + np.cumsum(many)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(many), part)), batch.column(0), batch.column(1), pa.array(np.arange(nth, nth + len(many))), pa.array(upto - many)], ["part", "word", "many", "rank", "smaller"])
                nth, before = nth + len(many), int(upto[-1])

    rows = texts.mapInArrow(asked, "place long, nth long, word binary, many long")
    found = rows.groupBy("word").agg(F.sum("many").alias("many")).repartitionByRange(tasks, "word").sortWithinPartitions("word")
    known = Table(found.mapInArrow(numbered, "part long, word binary, many long, rank long, smaller long"), "words")  # a task for each range, as its number names the range
    sizes = sorted(tuple(r) for r in known.df.groupBy("part").agg(F.count(F.lit(1)), F.sum("many")).collect())  # a row for each range
    bases = np.cumsum([(0, 0), *[r[1:] for r in sizes]], 0)[:-1].tolist()
    base = spark.createDataFrame([(r[0], *b) for r, b in zip(sizes, bases)], "part long, words_before long, anchors_before long")
    smaller = F.col("smaller") + F.col("anchors_before")
    group = (F.floor(smaller / GROUP) + 1) * 2 + (F.col("many") >= GROUP).cast("long")
    symbols = known.df.join(F.broadcast(base), "part").select("word", (F.col("rank") + F.col("words_before") + 1).alias("symbol"), group.alias("grp"))
    answers = rows.join(symbols, "word").select("place", "nth", "symbol", "grp")

    def receive(mine: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        nth = replies["nth"].to_numpy()
        got = np.zeros((2, len(nth)), np.int64)
        got[0, nth], got[1, nth] = replies["symbol"].to_numpy(), replies["grp"].to_numpy()
        for row in mine.to_pylist():
            _, of, _ = own(row)
            symbol, (group, hot) = got[0, of], (got[1, of] >> 1, got[1, of] & 1)
            strings = Strings(unpacked(row["many"]))
            after = strings.padded(group)[strings.place + 1]
            bucket = group << 31 | np.where(hot > 0, after + 1, 0)
            at = unpacked(row["anchors"], 3)[:, 0]
            out.append({"place": row["place"], "many": row["many"], "at": packed(at), "bucket": packed(bucket), "names": [packed(symbol)], "ranks": None, "told": None})
        return pa.Table.from_pylist(out, arrow)

    arrow = pa.schema([("place", pa.int64()), ("many", pa.binary()), ("at", pa.binary()), ("bucket", pa.binary()), ("names", pa.list_(pa.binary())), ("ranks", pa.binary()), ("told", pa.int64())])
    done = Table(texts.groupBy("place").cogroup(answers.groupBy("place")).applyInArrow(receive, STATE), "symbols", tasks)
    known.drop()
    return done


def bucketed(row: Row, records: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct records of each bucket, the buckets, the place of every record among them, how often each is there."""
    bucket = np.append(unpacked(row["bucket"]), 0)[anchor]
    rows, of, many = distinct(np.concatenate([bucket[:, None], records], 1))
    return rows[:, 1:], rows[:, 0], of, many


def triples(row: Row, k: int) -> tuple[np.ndarray, np.ndarray]:
    level = Strings(unpacked(row["many"])).level(k)
    s, at = level.padded(unpacked(row["names"][k])), level.sampled()
    return np.stack([s[at], s[at + 1], s[at + 2]], 1), level.position[at]


def told_by(row: Row, k: int, word: int) -> int:
    """The least number of bytes that the triples of level k tell, but for those that reach their text's end; None without any."""
    strings = Strings(unpacked(row["many"]))
    anchor = strings.level(k).position[strings.level(k).sampled()]
    further = 3 ** (k + 1) - 1
    inside = np.repeat(np.cumsum(strings.lens), strings.lens)
    anchor = anchor[anchor < len(inside)]
    anchor = anchor[anchor + further < inside[anchor]]
    at = unpacked(row["at"])
    return int((at[anchor + further] - at[anchor]).min()) + word if len(anchor) else None


def named(records: np.ndarray) -> tuple[np.ndarray, int]:
    rows, of = np.unique(keys(records)[0], return_inverse=True)
    return of + 1, len(rows)


def order_of(records: np.ndarray) -> tuple[np.ndarray, int]:
    """Merge: records (residue, two symbols, own or next rank, rank after that) to their ranks, one more than the smaller records. See merging()."""
    zero, one, two = (np.flatnonzero(records[:, 0] == c) for c in range(3))
    pick = lambda which, *columns: records[np.ix_(which, columns)]
    below = lambda a, b: np.searchsorted(np.sort(b), a)
    rank = np.ones(len(records), np.int64)
    both = np.concatenate([one, two])
    own = records[both, 3]
    rank[both] += below(own, own)
    a, b = keys(pick(zero, 1, 3), pick(one, 1, 4))
    rank[zero] += below(a, a) + below(a, b)
    rank[one] += below(b, a)
    a, b = keys(pick(zero, 1, 2, 4), pick(two, 1, 2, 4))
    rank[zero] += below(a, b)
    rank[two] += below(b, a)
    return rank, len(records)


def merging(row: Row, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix of level k: residue 0 (0, s0, s1, rank of i + 1, of i + 2), 1 (1, s0, s1, own rank, of i + 1), 2 (2, s0, s1, own rank, of i + 2); and its anchor."""
    level = Strings(unpacked(row["many"])).level(k)
    s = level.padded(unpacked(row["names"][k]))
    rank = np.zeros(len(s), np.int64)
    rank[level.sampled()] = unpacked(row["ranks"])
    at, c = level.place, level.residue()
    x = np.where(c == 0, rank[at + 1], rank[at])
    y = np.where(c == 1, rank[at + 1], rank[at + 2])
    return np.stack([c, s[at], s[at + 1], x, y], 1), level.position[at]


def fronts(row: Row, depth: int) -> tuple:
    """For every anchor with strings: its record of merging() at level 0, the least and the most bytes in front of it, these and the bytes behind its word; and the anchors."""
    data, ends = text_of(row)
    found, span = unpacked(row["anchors"], 3), span_of(depth)
    records, anchor = merging(row, 0)
    used = np.flatnonzero(found[anchor, 2] >= found[anchor, 1])
    at, first, last = found[anchor[used]].T
    most = at - first
    left = cut_off(slices(data, at - span, span)[:, ::-1].copy(), most)
    right = words_of(data, ends, at, depth - span - GRAM, span + GRAM)
    return np.concatenate([records[used], (at - last)[:, None], most[:, None]], 1), np.concatenate([left, right], 1), anchor[used], found


def common(rows: np.ndarray) -> np.ndarray:
    """How many of the first bytes of each row and the one before it are equal."""
    differ = rows[1:] != rows[:-1]
    return np.where(differ.any(1), differ.argmax(1), rows.shape[1]) if len(rows) else np.zeros(0, np.int64)


def neighbours(records: np.ndarray, text: np.ndarray, depth: int) -> np.ndarray:
    """For each anchor a number whose bit d is set if its string of `depth` bytes with d bytes in front of the anchor is in the bucket twice or more."""
    span, n = span_of(depth), len(records)
    order = np.argsort(order_of(records[:, :5])[0], kind="stable")  # equal ranks tell equal bytes
    least, most = records[order, 5], records[order, 6]
    behind = common(text[order, span:]) + span + GRAM
    behind[records[order[1:], 1] != records[order[:-1], 1]] = 0
    back = np.lexsort(np.ascontiguousarray(text[:, :span]).T[::-1]) if n else order
    front = common(text[back, :span])
    place = np.empty(n, np.int64)
    place[back] = np.arange(n)
    place = place[order]
    nearest = np.maximum(np.append(behind, 0), np.insert(behind, 0, 0))
    before = np.maximum(np.append(front, 0), np.insert(front, 0, 0))[place]
    found = np.zeros(n, np.uint64)
    for d in range(span):
        mine = np.flatnonzero((least <= d) & (d <= most) & (nearest >= depth - d) & (before >= d))
        if len(mine) < 2:
            continue
        one = np.concatenate([[0], np.cumsum(behind < depth - d)])[mine]
        two = np.concatenate([[0], np.cumsum(front < d)])[place[mine]]
        key = one * n + two
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        twice = mine[by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        found[twice] |= np.uint64(1 << d)
    out = np.empty(n, np.uint64)
    out[order] = found
    return out


def compared(texts: DataFrame, state: DataFrame, depth: int, tasks: int) -> Table:
    """(place, spans): the ranges in each place's input where strings of `depth` bytes start that also start elsewhere, packed."""
    rows = Table(texts.join(state.select("place", "bucket", "names", "ranks"), "place"), "merge", tasks)
    width = depth - GRAM

    def sent(row: Row) -> tuple:
        """Of anchors with equal bytes throughout one is sent."""
        records, text, anchor, found = fronts(row, depth)
        bucket = unpacked(row["bucket"])[anchor]
        of, many = distinct(np.concatenate([records[:, [1, 5, 6]], numbers(text)], 1))[1:]
        first = np.unique(of, return_index=True)[1]
        return records[first], text[first], bucket[first], of, many, anchor, found

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                records, text, bucket = sent(row)[:3]
                order = np.argsort(bucket, kind="stable")
                used, cut = np.unique(bucket[order], return_index=True)
                parts = [order[a:b] for a, b in zip(cut, np.append(cut[1:], len(order)))]
                bodies = [zstandard.ZstdCompressor(1).compress(text[p].tobytes()) for p in parts]
                yield pa.RecordBatch.from_pydict({"place": pa.array([row["place"]] * len(used), pa.int64()), "bucket": pa.array(used, pa.int64()), "records": pa.array([packed(records[p]) for p in parts], pa.binary()), "text": pa.array(bodies, pa.binary())})

    def run(table: pa.Table) -> pa.Table:
        parts = [unpacked(x, 7) for x in table["records"].to_pylist()]
        text = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for x in table["text"].to_pylist()), np.uint8).reshape(-1, width)
        reply = neighbours(np.concatenate(parts), text, depth).view(np.int64)
        cut = np.cumsum([0, *map(len, parts)])
        return pa.table({"place": table["place"], "bucket": table["bucket"], "records": pa.array([packed(reply[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())})

    answered = Table(rows.df.mapInArrow(deal, "place long, bucket long, records binary, text binary").groupBy("bucket").applyInArrow(run, "place long, bucket long, records binary"), "neighbours", tasks)

    def receive(mine: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in mine.to_pylist():
            records, _, bucket, of, many, anchor, found = sent(row)
            order, reply = np.argsort(bucket, kind="stable"), np.zeros(len(records), np.int64)
            reply[order] = np.concatenate([np.zeros(0, np.int64), *[unpacked(x) for _, x in sorted(zip(replies["bucket"].to_pylist(), replies["records"].to_pylist()))]])
            bits = np.where(many > 1, -1, reply)[of].view(np.uint64)
            at, first, last = found[anchor].T
            data, ends = text_of(row)
            flags = np.zeros(len(data) + 1, bool)
            for d in range(span_of(depth)):
                flags[(at - d)[(bits >> np.uint64(d) & np.uint64(1) > 0) & (d <= at - first) & (at - last <= d)]] = True
            edges = np.diff(flags.astype(np.int8), prepend=np.int8(0))
            begin, end = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
            text = np.searchsorted(ends, begin, "right")
            move = unpacked(row["starts"]) - (ends - unpacked(row["lens"]))
            out.append({"place": row["place"], "spans": packed(np.stack([begin, end], 1) + move[text][:, None])})
        return pa.Table.from_pylist(out, pa.schema([("place", pa.int64()), ("spans", pa.binary())]))

    done = Table(rows.df.groupBy("place").cogroup(answered.df.groupBy("place")).applyInArrow(receive, "place long, spans binary"), "spans", tasks)
    answered.drop()
    rows.drop()
    return done


def repeated(texts: Table, depth: int, tasks: int) -> Table:
    """(place, spans): the ranges in each place's input where strings of `depth` bytes start that also start elsewhere, packed. texts has rows of TEXTS; tasks write a table, fewer if it holds no texts."""
    word, few = span_of(depth) + GRAM, max(1, tasks // 4, min(tasks, texts.spark.sparkContext.defaultParallelism))
    now = ranked_words(texts.df, depth, few)

    def step(ask, columns, answer, take, label):
        nonlocal now
        done = exchange(now.df, ask, columns, answer, take, STATE, label, few, True)
        now.drop()
        now = done

    top = 0
    while True:

        def ask(row: Row, k: int = top) -> tuple:
            return bucketed(row, *triples(row, k))

        def take(row: Row, reply: np.ndarray, of: np.ndarray, many: np.ndarray, k: int = top) -> Row:
            return row | {"names": [*row["names"], packed(reply[of])], "told": told_by(row, k, word)}

        step(ask, 3, named, take, f"names-{top}")
        least = now.df.agg(F.min("told")).first()[0]
        if least is None or least >= depth:
            break
        top += 1
    # The names of the last level are ranks of its sampled suffixes.
    for k in range(top, 0, -1):

        def ask(row: Row, k: int = k) -> tuple:
            row = row if row["ranks"] else row | {"ranks": row["names"][k + 1]}
            return bucketed(row, *merging(row, k))

        def take(row: Row, reply: np.ndarray, of: np.ndarray, many: np.ndarray, k: int = k) -> Row:
            return row | {"ranks": packed(reply[of]), "names": row["names"][:k]}

        step(ask, 5, order_of, take, f"ranks-{k}")
    done = compared(texts.df, now.df.withColumn("ranks", F.coalesce("ranks", F.col("names")[1])), depth, tasks)
    now.drop()
    return done
