"""Embeddings behind one small interface, with a deterministic offline default."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[Column], Column]


def hashed(dimension: int = 64) -> Embedder:
    """Signed feature hashing of a text's words into unit vectors, by Arrow batches.

    A model would be loaded once in the iterator, before its first batch.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dimension)
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                    v[h % dimension] += 1 if h >> 16 & 1 else -1
                norm = np.sqrt((v * v).sum())
                out.append((v / norm if norm else v).astype(np.float32))
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")


@dataclass(frozen=True)
class ModelConfig:
    """What an embedding model is loaded with."""

    name: str
    path: str
    device: str = "cpu"
    batch_size: int = 32
    normalize: bool = True
    longest: int = 512


#: Models by name; register_model() adds to them. Fixed values.
MODELS: dict[str, ModelConfig] = {"bge-m3": ModelConfig("bge-m3", "../../model/bge-m3", batch_size=16, longest=8192)}


def register_model(config: ModelConfig) -> None:
    MODELS[config.name] = config


def model_config(name: str) -> ModelConfig | None:
    """The settings of a model, or None where it is not known."""
    return MODELS.get(name)
