"""Model-backed steps as plain callables with deterministic stand-ins.

A deployment passes its own callables; each is created once per task. The
stand-ins make every plan runnable and repeatable without a model; they don't
reach a model's quality.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


class HashEmbedder:
    """Unit vectors of hashed word counts."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.size] += 1.0 if h & 0x80000000 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


class LetterEmbedder:
    """How often each letter and digit stands in a text, without case."""

    SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"

    def __call__(self, texts: list[str]) -> np.ndarray:
        signs = np.frombuffer(self.SIGNS.encode(), dtype=np.uint8)
        return np.stack([np.bincount(np.frombuffer(t.lower().encode(), dtype=np.uint8), minlength=256)[signs] for t in texts]).astype(np.float32)


class OverlapScorer:
    """Share of the query's words that the text has, less a small cost for length."""

    def __call__(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        out = np.zeros(len(pairs))
        for i, (q, t) in enumerate(pairs):
            words = set(q.lower().split())
            have = set(t.lower().split())
            out[i] = len(words & have) / max(1, len(words)) - 1e-6 * min(len(t), 10_000)
        return out


def embedding(text: Column | str, make: Callable[[], Embedder] = HashEmbedder, batch: int = 128) -> Column:
    """Column of vectors; the model is made once per task and called in batches."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            whole = [t if isinstance(t, str) else "" for t in texts]
            parts = [model(whole[i : i + batch]) for i in range(0, len(whole), batch)]
            yield pd.Series(list(np.concatenate(parts)) if parts else [])

    return embed(text)


def pair_score(query: Column | str, text: Column | str, make: Callable[[], PairScorer] = OverlapScorer) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in batches:
            yield pd.Series(model([(a or "", b or "") for a, b in zip(q, t)]), dtype=float)

    return score(query, text)
