"""Logistic regression for the small labelled tables of this subpackage; it runs on the driver over rows whose number is bounded."""

from __future__ import annotations

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, classes: int, l2: float = 1e-3, turns: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial regression by full-batch gradient steps with momentum; the same rows give the same weights. Returns weights
    (features, classes) and biases."""
    n, d = x.shape
    kind = x.dtype if x.dtype == np.float32 else np.float64  # of all that is as large as x
    w, b = np.zeros((d, classes), kind), np.zeros(classes, kind)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    onehot = np.eye(classes, dtype=kind)[y]
    rate = 4.0 / max(1.0, float((x**2).sum(axis=1).mean()))
    for _ in range(turns):
        g = softmax(x @ w + b) - onehot
        vw = 0.9 * vw - rate * (x.T @ g / n + l2 * w)
        vb = 0.9 * vb - rate * g.mean(axis=0)
        w, b = w + vw, b + vb
    return w, b


def fit_sparse(rows: list[list[int]], y: np.ndarray, size: int, l2: float = 1e-4, turns: int = 1500) -> tuple[np.ndarray, float]:
    """Regression of two classes (0 and 1) over rows given as the numbers of their features, repeats included, with accelerated
    gradient steps; the same rows give the same weights. Returns a weight for each of `size` features and the bias."""
    lengths = np.array([len(r) for r in rows])
    flat = np.fromiter((i for r in rows for i in r), np.int64, int(lengths.sum()))
    of = np.repeat(np.arange(len(rows)), lengths)
    n = len(rows)
    # The largest share that a step can have: by the rows' squared lengths.
    counts = np.unique(of * size + flat, return_counts=True)
    square = np.bincount(counts[0] // size, counts[1].astype(float) ** 2, n)
    rate = 4.0 / (1.0 + float(np.mean(square)))
    w, b, vw, vb = np.zeros(size), 0.0, np.zeros(size), 0.0
    for _ in range(turns):
        z = np.bincount(of, (w + 0.9 * vw)[flat], n) + b + 0.9 * vb
        g = 1 / (1 + np.exp(-z)) - y
        vw = 0.9 * vw - rate * (np.bincount(flat, g[of], size) / n + l2 * (w + 0.9 * vw))
        vb = 0.9 * vb - rate * float(g.mean())
        w, b = w + vw, b + vb
    return w, b


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The scale of logits under which held-out rows are likeliest."""
    grid = np.geomspace(0.2, 5.0, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
