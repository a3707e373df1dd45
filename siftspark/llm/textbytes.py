"""Vectorised work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is taken whole.
CHUNK = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


#: Odd base of the polynomial hash modulo 2**64, and its inverse, which moves the hash of a slice to the front.
BASE = 0xD1342543DE82EF95
UNBASE = _inverse(BASE)
#: A random-looking number for each byte value.
SYMBOL = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column and the n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def chunks(batches: Iterator[pa.RecordBatch], column: int, at_once: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice of a batch, its bytes, its offsets) with about at_once bytes or a single text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = raw(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + at_once, "right")) - 1)
            last = min(last, batch.num_rows, first + 4096)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and UNBASE, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (BASE, UNBASE))
        return self.up, self.down


powers = Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[e] - h[s] the polynomial hash of data[s:e] times BASE ** s."""
    up, _ = powers.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(SYMBOL[data] * up[: len(data)], out=out[1:])
    return out


def slice_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e] that depend on the bytes and the length alone."""
    _, down = powers.upto(len(h))
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MULTIPLIER)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without white space, and for each text the number of words before it (n + 1 counts)."""
    inside = ~SPACES[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def blocks(data: np.ndarray, at_once: int = CHUNK) -> Iterator[np.ndarray]:
    """A text in blocks of about at_once bytes, each of which ends before white space: a run without it lies in one block."""
    begin = 0
    while begin < len(data):
        end = begin + at_once
        while end < len(data):
            after = np.flatnonzero(SPACES[data[end : end + at_once]])
            if len(after):
                end += int(after[0])
                break
            end += at_once
        yield data[begin:end]
        begin = end


def by_block(f, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """f(data, offsets), (values of the texts' parts, each one's text), of which no part holds white space; a long text is worked on in blocks."""
    if len(offsets) != 2 or len(data) <= 2 * CHUNK:
        return f(data, offsets)
    out = np.concatenate([f(x, np.array([0, len(x)]))[0] for x in blocks(data)])
    return out, np.zeros(len(out), np.int64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each one's text."""
    starts, ends, first = words(data, offsets)
    return slice_hashes(prefix_hashes(data), starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(first))
