"""Embedding providers: protocol, life cycle, and a deterministic stand-in model."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .windows import DEFAULT_TOKENS, token_windows

BACKOFF_SECONDS = 30.0


class Model(Protocol):
    """What a loader returns: token counts (special tokens included) and unit vectors of windows."""

    max_tokens: int

    def count(self, text: str) -> int: ...

    def vector(self, text: str) -> np.ndarray: ...


class HashedModel:
    """Hashed words as a unit vector; a stand-in where no trained model is at hand. It knows words, not meanings."""

    max_tokens = DEFAULT_TOKENS

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def count(self, text: str) -> int:
        return len(re.findall(r"\w+|[^\w\s]", text)) + 2

    def vector(self, text: str) -> np.ndarray:
        out = np.zeros(self.dimensions)
        for word in re.findall(r"\w+", text.lower()) or [text]:
            digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            out[int.from_bytes(digest[:4], "little") % self.dimensions] += 1 if digest[4] & 1 else -1
        norm = np.linalg.norm(out)
        return out / norm if norm else np.eye(1, self.dimensions)[0]


def embed_text(model: Model, text: str) -> np.ndarray:
    """Mean of the windows' vectors weighted by their tokens without the special ones, as a unit vector."""
    windows = token_windows(text, model.count, model.max_tokens)
    empty = model.count("")
    vectors = [np.asarray(model.vector(w), float) for w, _ in windows]
    if len({v.shape for v in vectors}) != 1:
        raise ValueError("windows differ in dimension")
    weights = [max(1, n - empty) for _, n in windows]
    mean = np.average(vectors, axis=0, weights=weights)
    norm = np.linalg.norm(mean)
    if not np.isfinite(norm) or norm == 0:
        raise ValueError("the pooled vector has no direction")
    return mean / norm


class EmbeddingService:
    """Loads a model once, when it is needed; after a failure it waits before the next attempt."""

    def __init__(self, loader: Callable[[], Model], enabled: bool = True, backoff: float = BACKOFF_SECONDS, now: Callable[[], float] = time.monotonic):
        self.loader, self.backoff, self.now = loader, backoff, now
        self.state, self.last_error = ("idle" if enabled else "disabled"), None
        self.model: Model | None = None
        self._next = float("-inf")

    def load(self) -> Model:
        if self.state == "disabled":
            raise RuntimeError("embeddings are disabled")
        if self.model is None:
            if self.now() < self._next:
                raise RuntimeError(f"the model is unavailable: {self.last_error}")
            self.state = "loading"
            try:
                self.model = self.loader()
            except Exception as error:
                self.state, self.last_error, self._next = "unavailable", str(error), self.now() + self.backoff
                raise
            self.state, self.last_error = "ready", None
        return self.model

    def embed(self, text: str) -> list[float]:
        return embed_text(self.load(), text).tolist()


def embed_chunks(chunks: DataFrame, loader: Callable[[], Model]) -> DataFrame:
    """chunks with ``embedding`` and ``embedding_error``; a chunk that fails has a null vector and stays.

    Batches go to Python by Arrow; each task loads the model once.
    """
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embedding_error", T.StringType())])
    at, names = chunks.columns.index("content"), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loader()
        for batch in batches:
            vectors, errors = [], []
            for text in batch.column(at).to_pylist():
                try:
                    vectors.append(embed_text(model, text or "").astype(np.float32).tolist())
                    errors.append(None)
                except Exception as error:  # one chunk's failure is that chunk's
                    vectors.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=names)

    return chunks.mapInArrow(run, schema)
