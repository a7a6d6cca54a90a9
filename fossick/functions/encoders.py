"""Encoders of texts to unit vectors. Any object with ``dim`` and ``columns`` will do; ``HashingEncoder`` needs no model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Encoder(Protocol):
    dim: int
    name: str

    def columns(self, text: Column) -> Column:
        """array<float> of a text: of length one, null for a null text."""


class HashingEncoder:
    """Words and pairs of neighbouring words, hashed to ``dim`` numbers with signs; equal texts have equal vectors, and
    texts without words are all zero. A worker keeps nothing between batches."""

    def __init__(self, dim: int = 384):
        self.dim, self.name = dim, f"hashing-{dim}"

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            words = re.findall(r"\w+", t.lower())
            v = np.zeros(self.dim, np.float64)
            parts = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
            if parts:
                h = pd.util.hash_array(np.array(parts, object), categorize=False)
                np.add.at(v, (h % np.uint64(self.dim)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0))
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return out

    def columns(self, text: Column) -> Column:
        encode = self.encode

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(encode([None if x is None else str(x) for x in s]))

        return run(text)


def text_hash(text: Column) -> Column:
    """Sixteen hex digits that tell whether a vector is of this text."""
    return F.substring(F.sha2(text, 256), 1, 16)
