"""Passages and scores of the quality model, recomputed a byte and a number at a time."""

import math
import random

import numpy as np
import pytest

from hearthlake.llm.quality import CLASSES, PAIRS, PASSAGE, Model, passages


def naive_passages(text):
    data = (text or "").encode()
    if not data:
        return [[0.0] * (CLASSES.shape[1] + PAIRS + 5)]
    n = max(1, round(len(data) / PASSAGE))
    rows = []
    for k in range(n):
        own = data[k * PASSAGE : (k + 1) * PASSAGE if k + 1 < n else len(data)]
        row = [sum(CLASSES[b, c] for b in own) / len(own) for c in range(CLASSES.shape[1])]
        pairs = [0.0] * PAIRS
        for i in range(len(data) - 1):
            if min(i // PASSAGE, n - 1) == k:
                pairs[(data[i] * 167 + data[i + 1] * 59) % PAIRS] += PAIRS / 4 / len(own)
        words = own.split()
        tail = [0.0] * 5
        if words:
            tail = [len(own) / len(words) / 10, len(set(words)) / len(words), max(map(words.count, set(words))) / len(words), sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words), min(1.0, len(own) / PASSAGE)]
        rows.append(row + pairs + tail)
    return rows


@pytest.mark.parametrize("text", [None, "", " ", "x", "Aa 1!? ü\n" * 9, "word word other " * 120, "".join(random.Random(1).choices("ab, .É日#\n", k=1700))])
def test_passages_equal_counting(text):
    found, wanted = passages(text), naive_passages(text)
    assert found.shape == (len(wanted), len(wanted[0])) and np.allclose(found, wanted, atol=1e-5)


def test_scores_equal_the_formula_of_each_document():
    model, draw = Model(6), np.random.default_rng(3)
    sizes = np.array([1, 4, 2])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    x = draw.standard_normal((7, 6)).astype(np.float32)
    p = {k: v.astype(float) for k, v in model.weights.items()}
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    wanted = []
    for start, size in zip(starts, sizes, strict=True):
        hidden, scores = [], []
        for row in x[start : start + size]:
            h = [math.tanh(sum(row[i] * p["E"][i, j] for i in range(6)) + p["e"][j]) for j in range(p["E"].shape[1])]
            gate = [math.tanh(sum(h[i] * p["V"][i, j] for i in range(len(h)))) * sigmoid(sum(h[i] * p["U"][i, j] for i in range(len(h)))) for j in range(p["V"].shape[1])]
            hidden.append(h), scores.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
        mean = [sum(s * h[j] for s, h in zip(scores, hidden, strict=True)) / sum(scores) for j in range(len(hidden[0]))]
        wanted.append(sigmoid(sum(m * c for m, c in zip(mean, p["c"], strict=True)) + p["d"][0]))
    assert np.allclose(model.forward(x, starts, sizes)["y"], wanted, atol=1e-5)
