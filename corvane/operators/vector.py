"""Exact vector search, storage checks and pooling of window vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.schemas import CHUNK_KEY

from .keyword import clamp_limit


def vector_topk(stored: DataFrame, query: Sequence[float], limit: int = 10) -> DataFrame:
    """Keys and ``vector_score`` (dot product) of the best rows of stored(relative_path, start_line, embedding).

    Only keys and vectors are read; stored text is joined later, to the rows that are left. A
    stored vector of another length than the query's is an error for the whole query.
    """
    values = V.checked_query(query)
    same = F.assert_true(F.size("embedding") == len(values), "stored and query vectors differ in length")
    scored = stored.where(F.col("embedding").isNotNull()).select(*CHUNK_KEY, F.coalesce(same.cast("double"), V.dot(F.col("embedding"), V.literal(values))).alias("vector_score"))
    return scored.orderBy(F.desc("vector_score"), *CHUNK_KEY).limit(clamp_limit(limit))


def zip_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks(…, chunk_ix) with the vector of the same path and position; null vectors are not stored."""
    return chunks.join(vectors.where(F.col("embedding").isNotNull()), ["relative_path", "chunk_ix"])


def pooled(windows: DataFrame, by: list[str]) -> DataFrame:
    """Mean of windows(…, ix, tokens, embedding) weighted by max(1, tokens), scaled to unit length.

    Sums are taken by component, so a text of many windows is reduced where it lies.
    """
    weight = F.greatest(F.lit(1), F.col("tokens")).cast("double")
    each = windows.select(*by, weight.alias("w"), F.posexplode("embedding").alias("ix", "x"))
    sums = each.groupBy(*by, "ix").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("x"))
    lists = sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "x"))), lambda s: s["x"]).alias("mean"))
    size = V.norm(F.col("mean"))
    return lists.select(*by, F.transform("mean", lambda x: x / F.when(size > 0, size)).alias("embedding"))
