"""BPE encoding and decoding of byte-level vocabularies by batched merge rounds.

Distinct pieces of a batch lie one after another in a flat array of symbols. A round finds the rank of every
neighbouring pair by binary search over the sorted pair keys, takes for each piece the lowest rank, merges its
leftmost occurrence and those of the same pair after it that don't overlap, and compacts; rounds end when no piece has
a mergeable pair.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from siftspark.llm import textbytes

#: The split of byte-level vocabularies before the merges. \p{White_Space}: the library's \s; Python's has U+001C-001F too.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: From here on, code points can be letters or numbers in one of the two libraries only, as their Unicode versions differ;
#: texts with such code points are split by the tokenizers library itself.
FAR = "[\u0558-\U0010ffff]"
NO_RANK = np.int64(1 << 40)
#: Pieces that a worker remembers; beyond it, it starts anew.
REMEMBERED = 400_000
#: Symbols of a flat array; a longer piece has an array of its own.
FLAT = 1 << 18


def byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the others are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.size = max(self.bytes_of) + 1
        self.byte_id = np.full(256, -1, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right, made = (np.array(x, np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]))
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        blob = [self.bytes_of.get(i, b"") for i in range(self.size)]
        self.lengths = np.array([len(b) for b in blob], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(blob), np.uint8)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and the number of ids of each."""
        symbols = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        done_ids, done_owner = [], []
        while len(symbols):
            same = owner[1:] == owner[:-1]
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == key), self.ranks[at], NO_RANK)
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            best = np.minimum.reduceat(np.append(rank, NO_RANK), first)
            # The pair that starts at a piece's last symbol has no rank, so a piece's minimum is its own.
            per = np.diff(np.append(first, len(symbols)))
            live = np.repeat(best < NO_RANK, per)
            if not live.all():
                done_ids.append(symbols[~live])
                done_owner.append(owner[~live])
            hit = np.append(rank == np.repeat(best, per)[:-1], False) & live
            # In a run of adjacent hits (a a a), every second one is merged.
            run = np.flatnonzero(hit)
            if len(run):
                start = np.concatenate([[True], np.diff(run) != 1])
                place = np.arange(len(run)) - np.maximum.accumulate(np.where(start, np.arange(len(run)), 0))
                run = run[place % 2 == 0]
                symbols = symbols.copy()
                symbols[run] = self.made[at[run]]
                live[run + 1] = False
            symbols, owner = symbols[live], owner[live]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pieces))

    def decode(self, ids: np.ndarray) -> str:
        lengths = self.lengths[ids]
        at = np.repeat(self.starts[ids] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        return self.blob[at].tobytes().decode("utf-8", "replace")


class Encoder:
    """Remembers the ids of pieces; encodes texts as lists of pieces."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.pattern, self.far = regex.compile(PIECES), re.compile(FAR)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.vocabulary.special, key=len, reverse=True)) + ")") if self.vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        self.known = {t: i for i, t in enumerate(self.vocabulary.special)}
        ids = list(self.vocabulary.special.values())
        self.ids, self.counts = [np.array(ids, np.int64)], [np.ones(len(ids), np.int64)]
        self.flat = None

    def split(self, text: str) -> list[str]:
        if self.far.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def pieces(self, text: str) -> list[str]:
        if any(t in text for t in self.vocabulary.special):
            found = []
            for k, part in enumerate(self.specials.split(text)):
                found += [part] * bool(part) if k % 2 else self.split(part)
            return found
        return self.split(text)

    def learn(self, new: list[str]) -> None:
        part: list[bytes] = []
        size = 0
        for p in [*map(str.encode, new), None]:
            if part and (p is None or size + len(p) > FLAT):
                ids, counts = self.vocabulary.merged(part)
                self.ids.append(ids)
                self.counts.append(counts)
                part, size = [], 0
            if p is not None:
                part.append(p)
                size += len(p)
        self.flat = None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizers library gives them without truncation, padding or added special tokens."""
        if len(self.known) > REMEMBERED:
            self.forget()
        lists = [self.pieces(t) for t in texts]
        new = list({p: None for pieces in lists for p in pieces if p not in self.known})
        if new:
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new))))
            self.learn(new)
        if self.flat is None:
            self.flat, counts = np.concatenate(self.ids), np.concatenate(self.counts)
            self.ids, self.counts = [self.flat], [counts]
            self.begin = np.cumsum(counts) - counts
        out, counts, get = [], self.counts[0], self.known.__getitem__
        for pieces in lists:
            k = np.fromiter(map(get, pieces), np.int64, len(pieces))
            n = counts[k]
            total = np.cumsum(n)
            at = np.repeat(self.begin[k] - (total - n), n) + np.arange(total[-1] if len(total) else 0)
            out.append(self.flat[at])
        return out


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder: later tasks of the same worker find what it remembers."""
    return Encoder(path)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for part, _, _ in textbytes.chunks(batches, 1):
        yield part, [t or "" for t in part.column(1).to_pylist()]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids array<int>. Null texts have no ids; repeated rows are encoded each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for part, texts in texts_of(batches):
            ids = encoder.encode(texts)
            values = pa.array(np.concatenate(ids).astype(np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of the rows of encode_documents; special tokens are kept, broken UTF-8 becomes U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for batch in batches:
            column = batch.column(1)
            texts = [vocabulary.decode(np.asarray(x.values if x.is_valid else [], np.int64)) for x in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; encodes and decodes whole texts in one pass.

    A null text counts as empty and has no tokens; repeated rows are encoded each; an empty table gives none; other
    columns are ignored. A text is worked on whole, with some tens of bytes for each of its own.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for part, texts in texts_of(batches):
            ids = encoder.encode(texts)
            sha = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            back = [hashlib.sha256(encoder.vocabulary.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
