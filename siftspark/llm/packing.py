"""Packing by shortest-pack-first over the length histogram.

The lengths of all pieces, at most LENGTH of them, are placed longest first, each into the packs with the least content
that have room, by counts of equal packs (patterns); the driver sees the histogram and the patterns only, both bounded
by LENGTH. Pieces then take the slots of their length by rank.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftspark.llm import textbytes
from siftspark.llm.common import gathered, staged

LENGTH = 4096
#: Pieces of text that a worker remembers, and new ones that it gathers before it sorts them in; beyond it, it starts anew.
REMEMBERED, RECENT = 3_000_000, 200_000
#: Rows of a (length, salt) group that a rank window sorts, about.
RANKED = 20_000


#: Kinds of bytes: white space, letters, digits, other ASCII, and those that keep a word whole: non-ASCII letters (they may
#: compose), apostrophes (contractions) and the sign that begins a special token.
SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[48:58] = DIGIT
KINDS[[*range(128, 256), ord("'"), ord("<")]] = WHOLE
KINDS[textbytes.SPACES] = SPACE


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that the tokenizer's model treats on their own: bytes in lower case, starts, ends, number of pieces before each text.

    Words end at ASCII white space, which the tokenizer drops and no rule of it reaches across. Words of plain ASCII
    are cut into runs of letters, single digits and runs of other characters, as its pattern does; others stay whole.
    """
    starts, ends, _ = textbytes.words(data, offsets)
    kind = KINDS[data]
    odd = np.concatenate([[0], np.cumsum(kind == WHOLE)])
    whole = odd[ends] > odd[starts]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[whole]] += 1
    edge[ends[whole]] -= 1
    inside = np.cumsum(edge[:-1]).astype(bool)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    cut[:-1] &= ~inside & (kind != SPACE)
    cut[starts] = True
    first = np.flatnonzero(cut[:-1])
    cut[ends] = True
    last = np.flatnonzero(cut[1:] & (kind != SPACE)) + 1
    return np.where(inside, data, textbytes.LOWER[data]), first, last, np.searchsorted(first, offsets)


class WordEncoder:
    """Ids of whole texts by the tokenizers library; equal pieces of text are encoded once and remembered by a 64-bit hash."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.known, self.recent = none, none
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin, self.counts = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.words = 0

    def append(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if len(held) < at + len(values):
            more = np.zeros(2 * (at + len(values)), held.dtype)
            more[:at] = held[:at]
            setattr(self, name, held := more)
        held[at : at + len(values)] = values

    def learn(self, hashes: np.ndarray, texts: list[str]) -> np.ndarray:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(counts.sum())
        self.append("flat", self.used, np.fromiter(chain.from_iterable(ids), np.uint32, total))
        self.append("begin", self.words, self.used + np.cumsum(counts) - counts)
        self.append("counts", self.words, counts)
        index = np.arange(self.words, self.words + len(ids))
        self.used, self.words = self.used + total, self.words + len(ids)
        self.recent = self.sorted_in(self.recent, hashes, index)
        if len(self.recent[0]) > RECENT:
            self.known = self.sorted_in(self.known, *self.recent)
            self.recent = self.recent[0][:0], self.recent[1][:0]
        return index

    @staticmethod
    def sorted_in(held: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(held[0], hashes)
        return np.insert(held[0], at, hashes), np.insert(held[1], at, index)

    @staticmethod
    def found(held: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
        if not len(held[0]):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(held[0], hashes), len(held[0]) - 1)
        return np.where(held[0][at] == hashes, held[1][at], -1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each text's."""
        if self.words > REMEMBERED:
            self.forget()
        data, starts, ends, before = split(data, offsets)
        names, example, of = np.unique(textbytes.slice_hashes(textbytes.prefix_hashes(data), starts, ends), return_index=True, return_inverse=True)
        index = self.found(self.known, names)
        index = np.where(index < 0, self.found(self.recent, names), index)
        new = np.flatnonzero(index < 0)
        if len(new):
            body = data.tobytes()
            index[new] = self.learn(names[new], [body[a:b].decode() for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist())])
        at = index[of]
        n = self.counts[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.begin[at] - total[:-1], n) + np.arange(total[-1])]
        return ids, np.diff(total[before])


@lru_cache(1)
def encoder_of(path: str) -> WordEncoder:
    """A worker's encoder: later tasks of the same worker find what it remembers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each document's ids and end_id, cut at multiples of `length`: doc_id, start, length, ids_crc32, doc_tokens, with keep_ids the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for part, data, offsets in textbytes.chunks(batches, 1):
            ids, counts = encoder.encode(data, offsets)
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            n = -(-counts // length)
            row = np.repeat(np.arange(len(counts)), n)
            start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * length
            size = np.minimum(length, counts[row] - start)
            first = (np.cumsum(counts) - counts)[row] + start
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), size.tolist())]
            columns = [part.column(0).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(counts[row], pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids)


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(number of packs, ((piece length, times), ...)): shortest pack first, lengths longest first."""
    room: dict[int, list[tuple[int, tuple]]] = {}
    order: list[int] = []

    def put(left: int, count: int, content: tuple) -> None:
        if left not in room:
            room[left] = []
            heapq.heappush(order, -left)
        room[left].append((count, content))

    for size in sorted(histogram, reverse=True):
        todo = histogram[size]
        while todo and order and -order[0] >= size:
            left = -order[0]
            groups = room[left]
            count, content = groups.pop()
            if not groups:
                del room[left]
                heapq.heappop(order)
            used = min(count, todo)
            if used < count:
                put(left, count - used, content)
            same = bool(content) and content[-1][0] == size
            put(left - size, used, (*content[:-1], (size, content[-1][1] + 1)) if same else (*content, (size, 1)))
            todo -= used
        fit = length // size
        if todo >= fit:
            put(length - fit * size, todo // fit, ((size, fit),))
        if todo % fit:
            put(length - todo % fit * size, 1, ((size, todo % fit),))
    return [(count, content) for left in sorted(room) for count, content in room[left]]


class Slots:
    """For each length the slots of its pieces by rank, as runs: one of a pattern's packs each."""

    def __init__(self, found: list[tuple[int, tuple]], length: int) -> None:
        runs, used, sequence = [], {}, 0
        for count, content in found:
            at, fill = 0, sum(s * n for s, n in content)
            padded = fill if fill & (fill - 1) == 0 else length
            for size, times in content:
                first = used.get(size, 0)
                used[size] = first + count * times
                runs.append((size, first, sequence, times, at, padded))
                at += size * times
            sequence += count
        runs.sort()
        self.size, self.first, self.sequence, self.times, self.at, self.padded = (np.array(x, np.int64) for x in (zip(*runs) if runs else [[]] * 6))
        self.key = (self.size << 45) + self.first

    def __call__(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (size << 45) + rank, "right") - 1
        nth = rank - self.first[k]
        return self.sequence[k] + nth // self.times[k], self.at[k] + nth % self.times[k] * size, self.padded[k]


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id, offset and padded_length to pieces. Sequences are padded to `length`, but not at a power of two."""
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = Slots(patterns(lengths, length), length)
    salts = max(64, sum(lengths.values()) // RANKED)
    rows = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    group = Window.partitionBy("length", "salt")
    counts = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    ranked = rows.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(group.orderBy("doc_id", "start", "ids_crc32")) - 1).drop("salt", "before")
    names = [c for c in cut.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset, padded = slots(np.asarray(batch.column("length"), np.int64), np.asarray(batch.column("rank"), np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset), pa.array(padded)], [*names, "sequence_id", "offset", "padded_length"])

    kinds = ", ".join(f"{c} {t}" for c, t in cut.dtypes)
    return ranked.select(*names, "rank").mapInArrow(place, kinds + ", sequence_id long, offset long, padded_length long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset, padded_length.

    A null text is a document of end_id alone. Repeated rows are packed each; an empty table gives none; other columns
    are ignored.
    """
    return pack(staged(pieces(gathered(docs), path, end_id, length, id_col, text_col, keep_ids), "pieces"), length)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, from pieces packed with keep_ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
