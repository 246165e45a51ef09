"""Leading eigenvectors of a symmetric matrix: tridiagonal form, bisection by Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and Q of Q.T @ matrix @ Q, by Householder reflections."""
    a, n = np.array(matrix, float), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        if length == 0 or not np.any(x[1:]):
            continue
        v = x.copy()
        v[0] += np.copysign(length, x[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each point: the negative terms of its Sturm sequence."""
    tiny = np.finfo(float).tiny / EPS
    count, d = np.zeros(len(points), int), np.ones(len(points))
    for i, a in enumerate(diagonal):
        d = a - points - (off[i - 1] ** 2 / d if i else 0.0)
        d = np.where(np.abs(d) < tiny, -tiny, d)
        count += d < 0
    return count


def bisect(diagonal: np.ndarray, off: np.ndarray, many: int) -> np.ndarray:
    """The `many` largest eigenvalues, falling; all are halved in on side by side until their brackets can't shrink."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = np.full(many, (diagonal - reach).min()), np.full(many, (diagonal + reach).max())
    ranks = n - 1 - np.arange(many)  # of the wanted ones, from the smallest
    for _ in range(2000):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        less = below(diagonal, off, middle) > ranks
        low, high = np.where(less, low, middle), np.where(less, middle, high)
    return low + (high - low) / 2


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """x of (T - shift) x = right by elimination with exchange of neighbouring rows; pivots are `least` at least."""
    n = len(diagonal)
    first, second, third, b = diagonal - shift, np.append(off, 0.0), np.zeros(n), right.copy()
    for i in range(n - 1):
        lower = off[i]
        if abs(first[i]) >= abs(lower):
            pivot = first[i] if abs(first[i]) > least else np.copysign(least, first[i])
            first[i], factor = pivot, lower / pivot
            first[i + 1] -= factor * second[i]
            b[i + 1] -= factor * b[i]
        else:
            factor = first[i] / lower
            next_first, next_second = first[i + 1], second[i + 1]
            first[i], first[i + 1] = lower, second[i] - factor * next_first
            second[i], second[i + 1], third[i] = next_first, -factor * next_second, next_second
            b[i], b[i + 1] = b[i + 1], b[i] - factor * b[i + 1]
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        rest = b[i] - (second[i] * x[i + 1] if i + 1 < n else 0.0) - (third[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = rest / (first[i] if abs(first[i]) > least else np.copysign(least, first[i]))
        if abs(x[i]) > 1e200:  # keep the direction, not the length
            x, b = x / 1e200, b / 1e200
    return x


def leading(matrix: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The `many` largest eigenvalues, falling, and their unit eigenvectors as rows.

    Vectors of eigenvalues nearer than a thousandth of the norm to the one before are a cluster: each is kept at right
    angles to those before it in the cluster during its iteration. Equal eigenvalues give some orthonormal basis.
    """
    n, many = len(matrix), min(many, len(matrix))
    diagonal, off, q = tridiagonal(matrix)
    norm = max(np.abs(diagonal).max(initial=0.0) + 2 * np.abs(off).max(initial=0.0), np.finfo(float).tiny / EPS)
    values = bisect(diagonal, off, many)
    random, vectors, start, shift = np.random.default_rng(0), np.zeros((many, n)), 0, np.inf
    for j in range(many):
        if j and values[j - 1] - values[j] > 1e-3 * norm:
            start = j
        shift = min(values[j], shift - 10 * EPS * norm) if j > start else values[j]  # equal ones are parted a little
        x = random.standard_normal(n)
        for _ in range(8):
            x = solved(diagonal, off, shift, x / np.linalg.norm(x), EPS * norm)
            for _ in range(2):
                x -= vectors[start:j].T @ (vectors[start:j] @ x)
            x /= np.linalg.norm(x)
            if np.linalg.norm(residual(diagonal, off, values[j], x)) <= 4 * n**0.5 * EPS * norm:
                break
        vectors[j] = x
    return values, vectors @ q.T


def residual(diagonal: np.ndarray, off: np.ndarray, value: float, x: np.ndarray) -> np.ndarray:
    y = (diagonal - value) * x
    y[:-1] += off * x[1:]
    y[1:] += off * x[:-1]
    return y
