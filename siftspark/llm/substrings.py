"""Removal of byte strings that are found more than once in the corpus.

1. Of the grams of half its length in every window of LENGTH bytes the one with the least hash is its sample; equal
   windows have equal samples. Windows whose sample is found once in the corpus are not repeated; the rest are the texts of step 2.
2. Their suffixes are sorted by the difference-cover algorithm, and neighbours compared (difference_cover.py).
3. Every byte that a repeated window covers is cut.

Texts of any length are worked on in blocks that overlap by a window less one byte, so only the bytes of a place, a
flag each and what steps 1 and 2 know of its windows are held at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import textbytes
from siftspark.llm.common import Table, shuffle_width, tasks_for
from siftspark.llm.difference_cover import TEXTS, Row, exchange, least_in, packed, repeated, text_of, unpacked, with_anchors

LENGTH = 200
#: Bytes of text of one place, about (a longer text is one place), and of those whose samples one bucket gets.
PLACE_BYTES, BUCKET_BYTES = 1 << 22, 1 << 23
#: Windows of a block, and those whose hashes are held at once (a run of one sample that is cut there is only asked for twice).
BLOCK, HASHED = 1 << 20, 1 << 18


def samples(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """(first, last, hash): first and last window of each run of windows with one sample, and the sample's hash."""
    gram, out = length // 2, [np.zeros((0, 3), np.int64)]
    for begin in range(0, max(0, len(data) - length + 1), HASHED):
        part = data[begin : begin + HASHED + length - 1]
        place = np.arange(len(part) - gram + 1)
        hashes = textbytes.slice_hashes(textbytes.prefix_hashes(part), place, place + gram)
        marked = (hashes >> np.uint64(32) << np.uint64(32)) | place.astype(np.uint64)
        sample = (least_in(marked, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        window = np.arange(begin, begin + len(sample))
        text = np.searchsorted(ends, window, "right")
        inside = window + length <= ends[text]
        first = np.flatnonzero(np.concatenate([[True], (sample[1:] != sample[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])]))
        last = np.append(first[1:], len(sample)) - 1
        first, last = first[inside[first]], last[inside[first]]
        out.append(np.stack([begin + first, begin + last, hashes[sample[first]].view(np.int64)], 1))
    return np.concatenate(out)


def pieces(begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of windows, first to last and `length` - 1 bytes more, cut to BLOCK windows."""
    many = -(-(end - begin - length + 1) // BLOCK)
    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    first = np.repeat(begin, many) + nth * BLOCK
    return first, np.minimum(np.repeat(end, many), first + BLOCK + length - 1)


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, with keep_text also kept_text; and the columns in carry.

    Texts are UTF-8 bytes, null is empty. Every byte covered by a string of `length` bytes that also starts anywhere
    else, in the same text or another, is removed; strings are judged on the input. A repeated row is another text, so
    both lose all (if `length` bytes long); null ids are allowed; other columns are ignored. kept_text drops bytes of
    characters that were cut.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    kinds = {c: t for c, t in rows.dtypes if c.startswith("carry_")}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for part, data, offsets in textbytes.chunks(batches, 1, PLACE_BYTES):
            bodies = packed(np.diff(offsets)), zstandard.ZstdCompressor(3).compress(data.tobytes()), packed(samples(data, offsets[1:], length))
            whole = [pa.array([x], pa.binary()) for x in bodies]
            lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(i)) for i in (0, *range(2, part.num_columns))]
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), *whole, *lists], ["place", "lens", "data", "samples", "doc_id", *kinds])
            place += 1

    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = tasks_for(spark, size)
    texts = Table(rows.coalesce(tasks).mapInArrow(placed, "place long, lens binary, data binary, samples binary, doc_id array<long>" + "".join(f", {c} array<{t}>" for c, t in kinds.items())), "texts")
    buckets = max(4 * shuffle_width(spark), size // BUCKET_BYTES)

    def ask(row: Row) -> tuple:
        first, last, name = unpacked(row["samples"], 3).T
        found, of, many = np.unique(name, return_inverse=True, return_counts=True)
        return np.stack([found, many > 1], 1), (textbytes.mix(found.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), first, last, of

    def shared(records: np.ndarray) -> tuple[np.ndarray, int]:
        _, of, many = np.unique(records[:, 0], return_inverse=True, return_counts=True)
        return ((many > 1) | (np.bincount(of, records[:, 1], len(many)) > 0))[of].astype(np.int64), 0

    def segments(row: Row, reply: np.ndarray, first: np.ndarray, last: np.ndarray, of: np.ndarray) -> Row:
        data, ends = text_of(row)
        keep = reply[of] > 0
        first, last = first[keep], last[keep]
        new = np.concatenate([[True], first[1:] != last[:-1] + 1])[: len(first)]
        new[1:] |= np.searchsorted(ends, first[1:], "right") != np.searchsorted(ends, first[:-1], "right")
        begin, end = pieces(first[new], last[np.append(new[1:], True)[: len(new)]] + length, length)
        return with_anchors(row["place"], begin, end - begin, b"".join(data[a:b].tobytes() for a, b in zip(begin, end)), length)

    state = exchange(texts.df.select("place", "lens", "data", "samples"), ask, 2, shared, segments, TEXTS, "segments", tasks)
    spans = repeated(state, length, tasks)
    state.drop()
    names = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept_text": pa.string()} if keep_text else {})

    def cut(mine: pa.Table, found: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in names}
        for row in mine.select(["place", "lens", "data", "doc_id"]).to_pylist():
            data, ends = text_of(row)
            keep = np.ones(len(data), bool)
            for x in found["spans"].to_pylist():
                for a, b in unpacked(x, 2).tolist():
                    keep[a : b + length - 1] = False
            for key, a, b in zip(row["doc_id"], np.insert(ends, 0, 0)[:-1], ends):
                left, gone = data[a:b][keep[a:b]].tobytes(), np.concatenate([[False], ~keep[a:b]])
                values = [key, int(b - a), int(b - a) - len(left), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()]
                for c, v in zip(names, [*values, left.decode("utf-8", "ignore")]):
                    out[c].append(v)
        table = pa.table({c: pa.array(v, names[c]) for c, v in out.items()})
        for c in carry:
            table = table.append_column(c, mine[f"carry_{c}"].combine_chunks().flatten())
        return table

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text + "".join(f", {c} {kinds['carry_' + c]}" for c in carry)
    return texts.df.drop("samples").groupBy("place").cogroup(spans.df.groupBy("place")).applyInArrow(cut, schema).coalesce(tasks)
