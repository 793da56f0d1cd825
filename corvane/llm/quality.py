"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Byte trigrams of the whole text are hashed to a fixed number of columns, weighted by
inverse document frequency and projected on the leading singular vectors of a labelled
sample. The labelled vectors are broadcast (their number is a parameter); every document
takes exact cosine products with all of them, block by block, and its nearest neighbours
vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

COLUMNS = 4096
#: Bytes whose trigrams are counted at once.
STRIDE = 1 << 20


def trigram_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed byte trigrams of a whole text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(COLUMNS, np.int64)
    for at in range(0, max(0, len(data) - 2), STRIDE):
        b = data[at : at + STRIDE + 2].astype(np.uint32)
        mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        mixed *= np.uint32(0x27D4EB2F)
        counts += np.bincount(mixed >> np.uint32(20), minlength=COLUMNS)
    return counts


def frequencies(texts: list[str | None]) -> np.ndarray:
    """Square roots of relative frequencies: unit vectors, or zero for texts of under three bytes."""
    counts = np.stack([trigram_counts(t) for t in texts]).astype(np.float32) if texts else np.zeros((0, COLUMNS), np.float32)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


@dataclass
class NeighbourVote:
    """Labelled vectors in the latent space, with what maps a text into it."""

    weights: np.ndarray  # inverse document frequency of each column
    basis: np.ndarray  # (columns, dimensions)
    vectors: np.ndarray  # unit vectors of the labelled texts
    labels: np.ndarray
    prior: float
    neighbours: int
    power: float

    def embed(self, features: np.ndarray) -> np.ndarray:
        latent = (features * self.weights) @ self.basis
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None], block: int = 128) -> np.ndarray:
        out = np.empty(len(texts))
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(texts), block):
            latent = self.embed(frequencies(texts[at : at + block]))
            cosines = latent @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** self.power
            total = votes.sum(axis=1)
            shares = (votes * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[at : at + block] = np.where(total > 1e-9, shares, self.prior)
        return np.clip(out, 0.0, 1.0)


def leading_directions(matrix: np.ndarray, dimensions: int, seed: int = 0) -> np.ndarray:
    """Right singular vectors of the largest singular values, by randomised subspace iteration."""
    rng = np.random.default_rng(seed)
    start = matrix @ rng.normal(size=(matrix.shape[1], dimensions + 16)).astype(np.float32)
    for _ in range(3):
        start, _ = np.linalg.qr(start)
        start = matrix @ (matrix.T @ start)
    basis, _ = np.linalg.qr(start)
    _, _, right = np.linalg.svd(basis.T @ matrix, full_matrices=False)
    return np.ascontiguousarray(right[:dimensions].T)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learn_from, rows: int, positives: int | None = None) -> DataFrame:
    """At most ``rows`` labelled ids, chosen by a hash of the id, with text and label; null ids, labels and texts don't take part.

    ``positives``: at most so many of label 1 and the rest of the others; without it, whatever
    comes. An id with several labels takes the largest, and the largest of several texts.
    """
    ids = labels.where(learn_from & F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    drawn = lambda own, n: own.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(n)
    chosen = drawn(ids, rows) if positives is None else drawn(ids.where("label = 1"), positives).unionByName(drawn(ids.where("label <> 1"), rows - positives))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` pairs of numbers


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x.astype(np.float16).tobytes() for x in frequencies(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])


def fit_neighbour_vote(
    docs: DataFrame, labels: DataFrame, learn_from, column: str = "quality", rows: int = 3000, dimensions: int = 48,
    neighbours: int = 15, power: float = 8.0,
) -> NeighbourVote | None:
    """Fits on at most ``rows`` labelled texts; what reaches the driver is ``rows`` vectors of fixed size.

    None without a labelled text.
    """
    common.prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, column, learn_from, rows)
    found = sample.mapInArrow(_featured, "doc_id long, label int, x binary").toPandas()
    found = found.sort_values(["doc_id", "x"]).drop_duplicates("doc_id", keep="last")
    if found.empty:
        return None
    features = np.frombuffer(b"".join(found["x"]), np.float16).reshape(-1, COLUMNS).astype(np.float32)
    weights = np.log((1 + len(features)) / (1 + (features > 0).sum(axis=0))).astype(np.float32) + 1
    basis = leading_directions(features * weights, min(dimensions, len(features)))
    vote = NeighbourVote(weights, basis, None, found["label"].to_numpy(np.float64), float(found["label"].mean()), neighbours, power)
    vote.vectors = vote.embed(features).astype(np.float32)
    return vote


def score_texts(docs: DataFrame, model, threshold: float, prior: float = 0.5) -> DataFrame:
    """docs with score (0 to 1) and predicted, and the columns it had (like-named ones are replaced).

    ``model`` has score(texts). Without one every score is ``prior``. A null text is scored
    as the empty text; repeated rows each get their row; an empty table gives no rows.
    """
    common.prepare(docs.sparkSession)
    kept = docs.drop("score", "predicted")
    at = kept.columns.index("text")
    schema = T.StructType([*kept.drop("text").schema.fields, T.StructField("score", T.DoubleType())])
    names = schema.names

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            scores = model.score(texts) if model else np.full(len(texts), prior)
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64())], names=names)

    return kept.mapInArrow(predict, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
