"""Toxicity by a character n-gram linear classifier with naive Bayes scaled features.

Presence of hashed character n-grams, scaled by the log-count ratio of the two classes,
enters a logistic regression. An n-gram's weight in the end is one number, so a score is
the sum over the distinct n-grams of a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .quality import labelled_sample

LENGTHS = (4, 5, 6)
BITS = 20
#: Bytes whose n-grams are hashed at once.
STRIDE = 1 << 20


class Scratch:
    """Arrays with one entry for each column, used again from text to text."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, bool)  # all False between texts
        self.place = np.zeros(1 << BITS, np.int32)


def distinct_ngrams(text: str | None, scratch: Scratch) -> Iterator[np.ndarray]:
    """Columns of the n-grams of a whole text (ASCII letters in lower case), each yielded once."""
    seen, place = scratch.seen, scratch.place
    data = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass").lower() + b" ", np.uint8)
    touched = []
    for at in range(0, len(data), STRIDE):
        part = data[at : at + STRIDE + max(LENGTHS) - 1].astype(np.uint32)
        n = min(STRIDE, len(part))
        rolling = np.zeros(len(part), np.uint32)
        for length in range(1, max(LENGTHS) + 1):
            if len(part) < length:
                break
            rolling = rolling[: len(part) - length + 1] * np.uint32(0x01000193) + part[length - 1 :]
            if length in LENGTHS:
                mixed = (rolling[:n] ^ (rolling[:n] >> np.uint32(15))) * np.uint32((0x85EBCA6B + 2 * length) & 0xFFFFFFFF)
                columns = mixed >> np.uint32(32 - BITS)
                fresh = columns[~seen[columns]]
                order = np.arange(len(fresh), dtype=np.int32)
                place[fresh] = order
                fresh = fresh[place[fresh] == order]  # of equal columns the last one stays
                seen[fresh] = True
                touched.append(fresh)
                yield fresh
    for columns in touched:
        seen[columns] = False


@dataclass
class NgramClassifier:
    weights: np.ndarray  # of presence, scaling included
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        scratch = Scratch()
        sums = [float(sum(self.weights[c].sum(dtype=np.float64) for c in distinct_ngrams(t, scratch))) for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64) + self.bias, -40, 40)))


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, smoothing: float, penalty: float, steps: int, least: int) -> NgramClassifier:
    """Logistic regression on presence times log-count ratio; n-grams in under ``least`` texts get no weight.

    Both classes have the same weight as a whole, however many texts there are of each.
    """
    size, n = 1 << BITS, len(rows)
    positive, negative = np.zeros(size), np.zeros(size)
    for row, label in zip(rows, labels.tolist(), strict=True):  # the n-grams of a text are distinct
        (positive if label else negative)[row] += 1
    known = positive + negative >= least
    n_pos, n_neg = max(1, (labels == 1).sum()), max(1, (labels == 0).sum())
    ratio = np.log((positive + smoothing) / (n_pos + 2 * smoothing)) - np.log((negative + smoothing) / (n_neg + 2 * smoothing))
    kept = np.flatnonzero(known)
    number = np.cumsum(known, dtype=np.int32) - 1  # of each known column
    scale = ratio[kept].astype(np.float32)
    parts = [number[row[known[row]]] for row in rows]
    edges = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(edges))
    columns = np.concatenate(parts) if parts else np.empty(0, np.int32)
    del parts
    values = scale[columns]
    weights, bias, share = np.zeros(len(kept)), 0.0, np.where(labels == 1, 0.5 / n_pos, 0.5 / n_neg)
    first, second, moment = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), 0
    for step in range(steps):
        gradient, error = penalty * weights, np.empty(n)
        for at in range(0, n, 500):  # few texts at a time keep the temporaries small
            low, high, stop = edges[at], edges[min(n, at + 500)], min(n, at + 500)
            own, column, value = owner[low:high] - at, columns[low:high], values[low:high]
            margin = np.bincount(own, weights=value * weights[column], minlength=stop - at) + bias
            error[at:stop] = share[at:stop] * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[at:stop])
            gradient += np.bincount(column, weights=value * error[at:stop][own], minlength=len(kept))
        gradient = np.append(gradient, error.sum())
        first += 0.1 * (gradient - first)
        second += 0.01 * (gradient**2 - second)
        moment = step + 1
        move = 0.05 * (1 - step / steps) * (first / (1 - 0.9**moment)) / (np.sqrt(second / (1 - 0.99**moment)) + 1e-10)
        weights, bias = weights - move[:-1], bias - move[-1]
    out = np.zeros(size, np.float32)
    out[kept] = scale * weights
    return NgramClassifier(out, float(bias))


def operating_point(margins: np.ndarray, labels: np.ndarray, cost: float) -> float:
    """The border between margins at which recall less ``cost`` times the rate of false positives is largest.

    Of several such borders the one in the widest gap.
    """
    order = np.argsort(-margins, kind="stable")
    m, positive = margins[order], labels[order] == 1
    recall, wrong = np.cumsum(positive) / max(1, positive.sum()), np.cumsum(~positive) / max(1, (~positive).sum())
    gaps = m[:-1] - m[1:]
    value = np.where(gaps > 0, (recall - cost * wrong)[:-1], -np.inf)
    if not len(value) or not np.isfinite(value.max()):
        return float(m[-1])
    k = max(np.flatnonzero(value >= value.max() - 1e-12), key=lambda i: gaps[i])
    return float((m[k] + m[k + 1]) / 2)


def fit_calibrated(rows: list[np.ndarray], labels: np.ndarray, threshold: float, cost: float, **options) -> NgramClassifier:
    """A classifier whose score is ``threshold`` at the operating point of margins found out of fold (two halves)."""
    found = fit_weights(rows, labels, **options)
    if min((labels == 1).sum(), (labels == 0).sum()) < 20:  # too few to tell
        return found
    half, margins = np.arange(len(rows)) % 2, np.empty(len(rows))
    for k in (0, 1):
        model = fit_weights([rows[i] for i in np.flatnonzero(half != k)], labels[half != k], **options)
        for i in np.flatnonzero(half == k).tolist():
            margins[i] = model.weights[rows[i]].sum(dtype=np.float64) + model.bias
    found.bias += float(np.log(threshold / (1 - threshold))) - operating_point(margins, labels, cost)
    return found


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scratch = Scratch()
    for batch in batches:
        found = [np.concatenate(list(distinct_ngrams(t, scratch))).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "label", "x"])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learn_from, column: str = "toxic", rows: int = 2400, positives: int = 800, threshold: float = 0.7, cost: float = 4.0,
    smoothing: float = 1.0, penalty: float = 0.01, steps: int = 40, least: int = 5,
) -> NgramClassifier | None:
    """Fits on at most ``rows`` labelled texts of any length, at most ``positives`` of them toxic.

    That bounds the driver's memory: a text counts by its distinct hashed n-grams. ``cost``: how
    much a rate of false positives weighs against recall where the score is ``threshold``.
    None without a labelled text. Ties of equal texts with unlike labels are not resolved:
    both are learned.
    """
    common.prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, column, learn_from, rows, positives)
    found = sample.mapInArrow(_featured, "doc_id long, label int, x binary").toPandas()
    found = found.sort_values(["doc_id", "x"]).drop_duplicates("doc_id", keep="last")
    if found.empty:
        return None
    features = [np.frombuffer(x, np.int32) for x in found["x"]]
    return fit_calibrated(features, found["label"].to_numpy(np.int64), threshold, cost, smoothing=smoothing, penalty=penalty, steps=steps, least=least)
