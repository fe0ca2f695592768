"""Embedding of texts by a pluggable function, and a stand-in whose vectors follow from the text alone."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

Embedder = Callable[[list[str]], np.ndarray]
PREFIX = "query: "
#: Texts that one call of an embedder gets.
BATCH = 64


def hashed(dimensions: int = 384) -> Embedder:
    """A stand-in for a model: a unit vector seeded by the text's hash, so equal texts are equal and others far apart."""

    def embed(texts: list[str]) -> np.ndarray:
        seeds = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") for t in texts]
        return np.stack([np.random.default_rng(s).normal(size=dimensions) for s in seeds])

    return embed


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def embedded(text: Column, make: Callable[[], Embedder], prefix: str = PREFIX) -> Column:
    """Unit vectors of texts; NULL for NULL. ``make`` gives the embedder once a task, so a model is loaded where it is used."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for s in batches:
            out: list = [None] * len(s)
            here = [i for i, t in enumerate(s) if t is not None]
            for at in range(0, len(here), BATCH):
                some = here[at : at + BATCH]
                for i, v in zip(some, unit_rows(np.asarray(embed([prefix + s.iloc[j] for j in some]), float)), strict=True):
                    out[i] = v.astype(np.float32)
            yield pd.Series(out)

    return run(text)
