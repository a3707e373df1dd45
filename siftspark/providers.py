"""Interfaces to models. Only the query's text goes to an expander; rows never do."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siftspark.functions.text import STRIPPED, Expansion, parse_expansion


class Expander(Protocol):
    def __call__(self, query: str) -> str: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


def split_query(query: str) -> Expansion:
    """Without a model, or if it fails: the words of the query, no filters."""
    return Expansion([w for w in query.translate({ord(c): " " for c in STRIPPED}).split(" ") if w], [], None)


def expand(query: str, expander: Expander | None) -> Expansion:
    if expander is None:
        return split_query(query)
    try:
        return parse_expansion(expander(query))
    except (ValueError, TypeError, OverflowError, OSError):
        return split_query(query)


class HashEmbedder:
    """A deterministic embedder for tests: signed character trigrams, unit length."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, t in enumerate(texts):
            for i in range(max(1, len(t) - 2)):
                h = int.from_bytes(hashlib.blake2b(t[i : i + 3].encode(), digest_size=8).digest(), "little")
                out[row, h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


#: Texts of one run of a model, and tokens of a text that it sees.
BATCH, TOKENS = 16, 512


class Pooled:
    """An embedder of a session's token vectors: their mean over the real tokens, of unit length.

    encode(texts) gives (ids, mask), padded, of TOKENS tokens at most; run(ids, mask) gives vectors of (text, token, dimension).
    """

    def __init__(self, encode: Callable[[list[str], int], tuple[np.ndarray, np.ndarray]], run: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        self.encode, self.run = encode, run

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = []
        for first in range(0, len(texts), BATCH):
            ids, mask = self.encode(texts[first : first + BATCH], TOKENS)
            weight = mask[:, :, None].astype(np.float32)
            mean = (self.run(ids, mask) * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
            out.append(mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9))
        return np.concatenate(out).astype(np.float32) if out else np.zeros((0, 0), np.float32)


def onnx_embedder(folder: str) -> Pooled:
    """The model (model.onnx, tokenizer.json) in a folder that every worker sees."""
    import onnxruntime
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
    tokenizer.enable_padding()
    session = onnxruntime.InferenceSession(f"{folder}/model.onnx", providers=["CPUExecutionProvider"])
    takes, gives = {x.name for x in session.get_inputs()}, [x.name for x in session.get_outputs()]
    result = "last_hidden_state" if "last_hidden_state" in gives else gives[0]

    def encode(texts: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
        tokenizer.enable_truncation(most)
        found = tokenizer.encode_batch(texts)
        return np.array([e.ids for e in found], np.int64), np.array([e.attention_mask for e in found], np.int64)

    def run(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        return session.run([result], {k: v for k, v in feed.items() if k in takes})[0]

    return Pooled(encode, run)


def passages(make: Callable[[], Embedder]):
    """A pandas UDF that embeds texts; each worker makes its embedder once."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            yield pd.Series(list(model(part.fillna("").tolist())), index=part.index)

    return embed


def query_vector(query: str, embedder: Embedder | None) -> list[float] | None:
    """None without an embedder or if it fails: the search then is by keywords only."""
    if embedder is None:
        return None
    try:
        return [float(x) for x in embedder([f"query: {query}"])[0]]
    except (ValueError, RuntimeError, OSError):
        return None
