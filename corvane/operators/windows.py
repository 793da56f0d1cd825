"""Token windows for embedding: halves of a text until each fits the model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.schemas import struct

#: Tokens that a model takes where it names no usable limit, and the largest limit that is believed.
DEFAULT_TOKENS, LARGEST_TOKENS = 512, 1_000_000
_ARROW = pa.list_(pa.struct([("window", pa.string()), ("tokens", pa.int32())]))


def token_windows(text: str, count: Callable[[str], int], limit: int) -> list[tuple[str, int]]:
    """(window, tokens), in order; joined they are the text. ``count`` includes special tokens.

    A single code point beyond the limit is an error.
    """
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError("the limit is a positive whole number")
    out, waiting = [], [text]
    while waiting:
        part = waiting.pop()
        tokens = count(part)
        if tokens <= limit:
            out.append((part, tokens))
        elif len(part) < 2:
            raise ValueError(f"one code point takes {tokens} tokens; the model takes {limit}")
        else:
            half = len(part) // 2
            waiting += [part[half:], part[:half]]
    return out


def max_tokens(limits: Column) -> Column:
    """The least believable limit of an array of doubles: whole, above 0 and at most a million; else the default."""
    usable = F.filter(limits, lambda x: (x == F.floor(x)) & (x > 0) & (x <= LARGEST_TOKENS))
    return F.coalesce(F.array_min(usable).cast("int"), F.lit(DEFAULT_TOKENS))


def windows(texts: DataFrame, count: Callable[[str], int], limit: int, key: str) -> DataFrame:
    """texts(key, content) to key, ix, window, tokens; a null content has no windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"window": w, "tokens": n} for w, n in token_windows(t, count, limit)] if t is not None else [] for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], names=[key, "w"])

    kind = T.ArrayType(struct("window string, tokens int"))
    schema = T.StructType([texts.schema[key], T.StructField("w", kind)])
    found = texts.select(key, "content").mapInArrow(run, schema)
    return found.select(key, F.posexplode("w").alias("ix", "x")).select(key, "ix", "x.window", "x.tokens")
