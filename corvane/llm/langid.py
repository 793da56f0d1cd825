"""Language identification by a byte convolutional network in numpy.

Bytes are embedded, convolved by filters of several widths, max-pooled over a window of
fixed length and classified by softmax. A text is cut into overlapping windows that cover
all of it; the windows' log-probabilities are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of a window; windows overlap by the widest filter less one.
WINDOW = 256
WIDTHS = {2: 8, 3: 12, 4: 12}
EMBEDDING = 6
WIDEST = max(WIDTHS)
UNDETERMINED = "und"


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, zero-padded at its end; (n, WINDOW), one at least."""
    step = WINDOW - WIDEST + 1
    n = max(1, -(-len(data) // step))
    padded = np.zeros((n - 1) * step + WINDOW, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


class ByteCnn:
    """Parameters: byte embedding, one matrix for the filters of all widths, output layer."""

    def __init__(self, classes: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes, filters = classes, sum(WIDTHS.values())
        self.mask = np.zeros((WIDEST * EMBEDDING, filters), np.float32)
        at = 0
        for width, n in WIDTHS.items():
            self.mask[: width * EMBEDDING, at : at + n] = 1
            at += n
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            "kernel": rng.normal(0, 0.4, self.mask.shape).astype(np.float32) * self.mask,
            "bias": np.zeros(filters, np.float32),
            "out": rng.normal(0, 0.2, (filters, len(classes))).astype(np.float32),
            "prior": np.zeros(len(classes), np.float32),
        }

    def columns(self, windows: np.ndarray) -> np.ndarray:
        vectors, last = self.p["embed"][windows], WINDOW - WIDEST + 1
        return np.concatenate([vectors[:, j : j + last] for j in range(WIDEST)], axis=2)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = (self.columns(windows) @ self.p["kernel"]).max(axis=1)
        return log_softmax(np.maximum(pooled + self.p["bias"], 0) @ self.p["out"] + self.p["prior"])

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(windows)
        columns = self.columns(windows)
        maps = columns @ p["kernel"]
        best = maps.argmax(axis=1)
        pooled = np.take_along_axis(maps, best[:, None, :], axis=1)[:, 0] + p["bias"]
        hidden = np.maximum(pooled, 0)
        delta = np.exp(log_softmax(hidden @ p["out"] + p["prior"]))
        delta[np.arange(n), target] -= 1
        delta /= n
        back = (delta @ p["out"].T) * (pooled > 0)
        picked = columns[np.arange(n)[:, None], best]  # (n, filters, width * embedding)
        embed = np.zeros_like(p["embed"])
        to_columns = (back[:, :, None] * p["kernel"].T[None]).reshape(n, -1, WIDEST, EMBEDDING)
        for j in range(WIDEST):
            np.add.at(embed, windows[np.arange(n)[:, None], best + j], to_columns[:, :, j])
        return {
            "embed": embed, "kernel": np.einsum("nf,nfc->cf", back, picked) * self.mask, "bias": back.sum(axis=0),
            "out": hidden.T @ delta, "prior": delta.sum(axis=0),
        }

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int, rate: float = 0.01, batch: int = 64, seed: int = 0) -> ByteCnn:
        """Adam on the cross-entropy, with a rate that falls to zero."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        total, t = epochs * -(-len(windows) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                t += 1
                for k, g in self.gradients(windows[order[at : at + batch]], target[order[at : at + batch]]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    step = rate * (1 - (t - 1) / total) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                    self.p[k] = (self.p[k] - step).astype(np.float32)
        return self

    def predict(self, texts: list[str | None], at_once: int = 64) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text, over all of its windows."""
        sums = np.zeros((len(texts), len(self.classes)))
        counts = np.zeros(len(texts), np.int64)
        held, owner, rows = [], [], 0

        def flush() -> None:
            nonlocal held, owner, rows
            if held:
                found, at = np.concatenate(held), np.repeat([o for o, _ in owner], [n for _, n in owner])
                for k in range(0, rows, at_once):
                    scored = self.log_probabilities(found[k : k + at_once])
                    np.add.at(sums, at[k : k + at_once], scored)
                held, owner, rows = [], [], 0

        letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        for i in np.flatnonzero(letters).tolist():
            windows = windows_of(texts[i].encode("utf-8", "surrogatepass"))
            counts[i] = len(windows)
            for k in range(0, len(windows), 16 * at_once):  # a long text in parts
                part = windows[k : k + 16 * at_once]
                held.append(part)
                owner.append((i, len(part)))
                rows += len(part)
                if rows >= 16 * at_once:
                    flush()
        flush()
        probabilities = np.exp(log_softmax(sums / np.maximum(counts, 1)[:, None]))
        best = probabilities.argmax(axis=1)
        names = [self.classes[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters, probabilities.max(axis=1), 0.0)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _sampled_windows(batches: Iterator[pa.RecordBatch], per_text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, langs = [], []
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            windows = windows_of((text or "").encode("utf-8", "surrogatepass"))
            for k in np.unique(np.linspace(0, len(windows) - 1, per_text).astype(int)):
                out.append(windows[k].tobytes())
                langs.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(langs, pa.string())], names=["window", "lang"])


def fit_language_model(
    docs: DataFrame, learn_from, texts_per_language: int = 700, windows_per_text: int = 2, max_languages: int = 1000, epochs: int = 6, least_steps: int = 300
) -> ByteCnn | None:
    """Trains on a bounded sample of docs(doc_id, text, lang) where ``learn_from`` holds and lang is not null.

    At most about ``texts_per_language`` texts of each language take part, chosen by a hash of the
    id; each gives ``windows_per_text`` windows. More than ``max_languages`` values of lang are an
    error, as the network could not be held. None if there is no labelled text.
    """
    labelled = docs.where(learn_from & F.col("lang").isNotNull())
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()
    if not sizes:
        return None
    if len(sizes) > max_languages:
        raise ValueError(f"lang has more than {max_languages} values")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, texts_per_language / r["count"]))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1_000_003)) / 1_000_003.0
    sample = labelled.where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("text", "lang")
    found = sample.mapInArrow(lambda it: _sampled_windows(it, windows_per_text), "window binary, lang string").toPandas()
    found = found.sort_values(["lang", "window"], kind="stable")  # the order of tasks must not matter
    if found.empty:
        return None
    classes = sorted(set(found["lang"]))
    windows = np.frombuffer(b"".join(found["window"]), np.uint8).reshape(-1, WINDOW)
    epochs = max(epochs, -(-least_steps * 64 // len(windows)))  # few texts are seen more often
    return ByteCnn(classes).fit(windows, np.searchsorted(classes, found["lang"]), epochs)


def identify_language(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """docs(doc_id, text) with lang_pred and score, and the columns it had (a like-named column is replaced).

    `und` with score 0 where the text is null, has no letters, or there is no model.
    Repeated rows each get their row; an empty table gives no rows.
    """
    common.prepare(docs.sparkSession)
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at, names = kept.columns.index("text"), schema.names

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found, scores = model.predict(texts) if model else ([UNDETERMINED] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=names)

    return kept.mapInArrow(predict, schema)
