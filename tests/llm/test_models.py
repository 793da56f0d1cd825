"""Scores and weights of the trained models against plain loops."""

import math
import random

import numpy as np
import pytest

from corvane.llm import langid, quality, toxicity


def test_neighbours_vote_by_similarity():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdef "), 60)) for _ in range(40)] + [None, "", "ab"]
    features = quality.frequencies(texts[:30])
    weights = rng.uniform(0.5, 2, quality.COLUMNS).astype(np.float32)
    vote = quality.NeighbourVote(weights, quality.leading_directions(features * weights, 8), None, rng.integers(0, 2, 30).astype(float), 0.25, 5, 3.0)
    vote.vectors = vote.embed(features)
    got = vote.score(texts, block=7)
    for text, score in zip(texts, got, strict=True):
        latent = [float(sum(f * w * b for f, w, b in zip(quality.frequencies([text])[0], weights, vote.basis[:, d], strict=True))) for d in range(8)]
        norm = math.sqrt(sum(x * x for x in latent))
        cosines = sorted(((sum(a * b for a, b in zip(latent, v, strict=True)) / norm if norm else 0.0, label) for v, label in zip(vote.vectors.tolist(), vote.labels, strict=True)), reverse=True)
        votes = [(max(c, 0) ** 3, label) for c, label in cosines[:5]]
        total = sum(v for v, _ in votes)
        assert score == pytest.approx(sum(v * label for v, label in votes) / total if total > 1e-9 else 0.25, abs=1e-4)


def slow_columns(text, lengths=toxicity.LENGTHS):
    data, out = b" " + text.encode().lower() + b" ", set()
    for n in lengths:
        for i in range(len(data) - n + 1):
            h = 0
            for b in data[i : i + n]:
                h = (h * 0x01000193 + b) & 0xFFFFFFFF
            out.add(((h ^ (h >> 15)) * (0x85EBCA6B + 2 * n) & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    return out


def test_toxicity_scores_are_sums_over_distinct_ngrams():
    rng = np.random.default_rng(4)
    weights = rng.normal(0, 0.05, 1 << toxicity.BITS).astype(np.float32)
    model = toxicity.NgramClassifier(weights, -0.3)
    texts = ["", "a", "Some words, some WORDS", "été " * 30, "".join(random.Random(1).choice("abc ") for _ in range(400))]
    want = [1 / (1 + math.exp(-(sum(float(weights[c]) for c in slow_columns(t)) - 0.3))) for t in texts]
    assert model.score(texts) == pytest.approx(want, abs=1e-6) and model.score([None])[0] == model.score([""])[0]


def test_toxicity_weights_against_a_dense_fit():
    rng = np.random.default_rng(5)
    labels = np.array([1] * 12 + [0] * 30)
    rows = [np.unique(np.concatenate([rng.integers(0, 40, 12), 100 + rng.integers(0, 3, 2) + 3 * y])).astype(np.int32) for y in labels]
    got = toxicity.fit_weights(rows, labels, smoothing=1.0, penalty=0.01, steps=25, least=3)
    size = 200
    x = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        x[i, r] = 1
    ratio = np.log((x[labels == 1].sum(0) + 1) / (12 + 2)) - np.log((x[labels == 0].sum(0) + 1) / (30 + 2))
    known = x.sum(0) >= 3
    x = x[:, known] * ratio[known]
    share = np.where(labels == 1, 0.5 / 12, 0.5 / 30)
    w, first, second = np.zeros(x.shape[1] + 1), 0.0, 0.0
    for step in range(25):
        error = share * (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - labels)
        gradient = np.append(x.T @ error + 0.01 * w[:-1], error.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        w = w - 0.05 * (1 - step / 25) * (first / (1 - 0.9 ** (step + 1))) / (np.sqrt(second / (1 - 0.99 ** (step + 1))) + 1e-10)
    want = np.zeros(size)
    want[known] = ratio[known] * w[:-1]
    assert np.allclose(got.weights[:size], want, atol=2e-3) and got.bias == pytest.approx(w[-1], abs=2e-3)


def test_operating_point():
    assert toxicity.operating_point(np.array([5.0, 4.0, 1.0, 0.0]), np.array([1, 1, 0, 0]), 1.0) == 2.5
    margins, labels = np.array([9.0, 8.0, 7.0, 6.0, 5.0, 1.0]), np.array([0, 1, 1, 1, 0, 0])
    best = max(((labels[margins >= t] == 1).sum() / 3 - (labels[margins >= t] == 0).sum() / 3, t) for t in margins)
    assert toxicity.operating_point(margins, labels, 1.0) == 5.5 and best[1] == 6.0
    assert toxicity.operating_point(np.array([1.0, 1.0]), np.array([1, 0]), 1.0) == 1.0  # ties have no border


def test_forward_pass_of_the_byte_network():
    model = langid.ByteCnn(["aa", "bb", "cc"], seed=3)
    rng = np.random.default_rng(6)
    model.p["bias"], model.p["prior"] = rng.normal(0, 0.1, 32).astype(np.float32), rng.normal(0, 0.1, 3).astype(np.float32)
    windows = langid.windows_of(bytes(rng.integers(1, 256, 400).astype(np.uint8)))
    got = model.log_probabilities(windows)
    embed, kernel = model.p["embed"].astype(float), model.p["kernel"].astype(float)
    widths = [w for w, n in langid.WIDTHS.items() for _ in range(n)]
    for window, scores in zip(windows, got, strict=True):
        hidden = []
        for f, width in enumerate(widths):
            best = max(
                sum(float(embed[window[t + j]] @ kernel[j * langid.EMBEDDING : (j + 1) * langid.EMBEDDING, f]) for j in range(width))
                for t in range(langid.WINDOW - langid.WIDEST + 1)
            )
            hidden.append(max(0.0, best + float(model.p["bias"][f])))
        logits = np.array(hidden) @ model.p["out"].astype(float) + model.p["prior"]
        assert scores == pytest.approx(logits - math.log(sum(map(math.exp, logits))), abs=1e-3)
