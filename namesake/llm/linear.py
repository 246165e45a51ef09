"""Sparse logistic regression in numpy on a bounded labelled sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_lowest


class Rows:
    """Sparse rows: of each, indices and values (1 where none are given)."""

    def __init__(self, indices: list[np.ndarray], width: int, values: list[np.ndarray] | None = None):
        self.n, self.width = len(indices), width
        self.row = np.repeat(np.arange(self.n), [len(x) for x in indices])
        self.index = np.concatenate(indices) if indices else np.zeros(0, int)
        self.value = np.concatenate(values) if values else np.ones(len(self.index))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.index], self.n)

    def transposed_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * g[self.row], self.width)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: Rows, y: np.ndarray, l1: float = 0.0, l2: float = 0.0, steps: int = 200, pairs: Rows | None = None, weight: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise log loss + l1 |w| + l2 |w|^2 / 2 + weight * mean((pairs w)^2) / 2.

    Accelerated proximal gradient steps; the step's length follows from the largest singular values.
    """
    paired = pairs is not None and pairs.n > 0 and weight > 0
    v = np.random.default_rng(0).normal(size=x.width + 1)
    for _ in range(20):  # power iteration, intercept included
        v /= np.linalg.norm(v) or 1
        u = x.dot(v[:-1]) + v[-1]
        z = np.append(x.transposed_dot(u), u.sum()) / (4 * max(1, x.n))
        if paired:
            z[:-1] += weight * pairs.transposed_dot(pairs.dot(v[:-1])) / pairs.n
        v = z
    rate = 1 / (1.1 * np.linalg.norm(v) + l2 + 1e-12)
    w, b = np.zeros(x.width), float(np.log((y.sum() + 0.5) / (x.n - y.sum() + 0.5)))
    wy, by, t = w.copy(), b, 1.0
    for _ in range(steps):
        error = (sigmoid(x.dot(wy) + by) - y) / max(1, x.n)
        gradient = x.transposed_dot(error) + l2 * wy
        if paired:
            gradient += weight * pairs.transposed_dot(pairs.dot(wy)) / pairs.n
        new = wy - rate * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        nb, nt = by - rate * error.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        wy, by = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w, b


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, c such that sigmoid(a * margin + c) is calibrated on these rows (Newton steps, smoothed targets)."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(design @ beta)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hessian, design.T @ (p - target)), -2, 2)
    return float(beta[0]), float(beta[1])


def labelled_ids(labels: DataFrame, column: str, keep: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of the per_class ids with the lowest hashes of each label 0 and 1, and how many have each.

    Rows without an id or a label don't count; an id with several labels has the highest. Rows whose hashes can't be
    among the lowest go first: what is ranked is about twice as many as are needed, however many there are.
    """
    known = labels.filter(keep & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = F.coalesce(*[F.when(F.col("label") == k, min(1.0, 2 * per_class / n)) for k, n in counts.items()], F.lit(1.0))
    cut = known.withColumn("h", F.xxhash64("doc_id", F.lit(7))).filter(in_lowest(F.col("h"), share))
    cut = cut.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))).filter(F.col("n") <= per_class)
    return cut.select("doc_id", "label"), counts
