import math
import random

import numpy as np
import pytest

from namesake.llm.eigen import leading
from namesake.llm.whitening import Fit, summed, usable, whiten

SCHEMA = "vec_id long, embedding array<float>, x string, c int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)


def whole(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def brute(rows, many=16):
    """vec_id, deviation and whitened with numpy's own solver; the sign of a component is that of its largest entry."""
    good = [(i, whole(v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:many], vectors[:, ::-1][:, :many]
    return n, sums, values, vectors, good


def normal(v):
    return v * np.sign(v[np.argmax(np.abs(v))])


def check(rows, got, many=16):
    n, sums, values, vectors, good = brute(rows, many)
    table = {}
    for r in got:
        table.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    x_of = {}
    for i, x in good:
        x_of.setdefault(i, x)
    assert len(got) == len(good) * len(values)
    total = np.trace(np.cov(np.array(sorted({tuple(x) for _, x in good})).T, bias=True))
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / total) < 1e-9
    for (i, deviation), _ in table.items():
        assert deviation in {sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True)) for j, x in good if j == i}
    for k in range(len(values)):
        mine = np.array([(np.array(x_of[i]) - sums / n) @ normal(vectors[:, k]) / values[k] ** 0.5 for i in x_of])
        theirs = np.array([next(rs[k + 1][0].whitened for (j, _), rs in table.items() if j == i) for i in x_of])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6


def made(count, d, seed=0):
    r = np.random.default_rng(seed)
    return [(i, [float(c) for c in r.normal(size=d) * (1 + np.arange(d)) / d]) for i in range(count)]


def test_against_numpy(spark):
    rows = made(400, 24)
    odd = [(1000, None), (1001, []), (1002, [None] + [0.5] * 23), (1003, [math.nan] * 24), (1004, [math.inf] + [0.0] * 23), (1005, [3e38] + [0.0] * 23)]
    copies = [(2000 + i, rows[0][1]) for i in range(200)] + [(None, rows[1][1]), (7, rows[7][1])]
    got = whiten(frame(spark, rows + odd + copies)).collect()
    assert {r.vec_id for r in got}.isdisjoint(range(1000, 1006))
    check(rows + odd[:5] + [x for x in copies if x[0] is not None] + [(None, rows[1][1])], got)


def test_fewer_dimensions_than_components(spark):
    rows = made(50, 3)
    got = whiten(frame(spark, rows)).collect()
    check(rows, got)
    assert {r.component for r in got} == {1, 2, 3}


def test_other_lengths_and_flat_directions(spark):
    rows = [(i, [a, a, 0.25, b]) for i, (a, b) in enumerate((random.Random(i).random(), random.Random(1000 + i).random()) for i in range(60))]
    got = whiten(frame(spark, [*rows, (99, [1.0, 2.0])])).collect()
    assert len(got) == 120 and {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-9 and got[0].n == len({tuple(whole(v)) for _, v in rows})


def test_equal_vectors_and_empty(spark):
    assert whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []
    assert whiten(frame(spark, [])).collect() == [] and whiten(frame(spark, [(1, None)])).collect() == []


def test_whole_numbers(spark):
    rows = spark.range(2000).selectExpr("array(id + 4000000000000000, id) as x")
    sums = summed(rows, lambda m: m.sum(axis=0), (2,), "decimal(38,0)")
    assert sums.tolist() == [2000 * 4_000_000_000_000_000 + 1_999_000, 1_999_000]
    assert usable(frame(spark, [(1, [0.5, -0.01])])).collect()[0].x == [1_000_032, 999_999]


def test_deviation_beyond_64_bits(spark):
    """The way by Python's numbers gives what the way by 64 bits gives, and goes on where that one ends."""
    fit = Fit.__new__(Fit)
    fit.n, fit.sums = 10**9, np.array([10**9 * 1_000_000, 10**9 * 1_000_001], object)
    assert fit.deviation()(np.array([[1_000_100, 1_000_000]])) == [(100 * 10**9) ** 2 + (10**9) ** 2]
    fit.n, fit.sums = 3, np.array([10, 20], object)
    assert fit.deviation()(np.array([[5, 6], [-1, 0]])) == [25 + 4, 169 + 400]


@pytest.mark.parametrize("matrix", [
    np.eye(20), np.zeros((6, 6)), np.array([[3.0]]), np.diag(np.arange(30.0)),
    np.kron(np.eye(8), [[2.0, 1.0], [1.0, 2.0]]), np.diag([1.0] * 12 + [1 + 1e-13] * 4), np.ones((17, 17)),
    np.diag(2.0 * np.ones(40)) + np.diag(np.ones(39), 1) + np.diag(np.ones(39), -1),
    np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
    1e12 * np.eye(9) + np.ones((9, 9)), 1e-12 * (np.eye(9) + np.ones((9, 9))),
])
def test_eigenvectors_of_hard_matrices(matrix):
    values, vectors = leading(matrix, 16)
    size = max(np.abs(matrix).max() * len(matrix), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][: len(values)]).max() < 1e-14 * size
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(vectors @ matrix - values[:, None] * vectors).max() < 1e-13 * size


def test_eigenvectors_of_random_matrices():
    r = np.random.default_rng(1)
    for n in (2, 5, 64, 150):
        a = r.normal(size=(n, n))
        a = a @ a.T
        values, vectors = leading(a, 16)
        assert np.abs(vectors @ a - values[:, None] * vectors).max() < 1e-13 * values[0]
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13
