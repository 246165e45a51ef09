"""Whitening of embeddings by the leading components of their covariance."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .eigen import leading

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries of greater size count as not finite: sums of their whole numbers could leave 64 bits in a task.
MOST = float(1 << 30)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the vector in whole numbers, of rows whose entries are all there and finite."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.forall(c, lambda v: F.coalesce(F.abs(v) < MOST, F.lit(False))) & (F.size(c) > 0)
    rows = embeddings.select("vec_id", F.when(whole, c).alias("c")).filter("c is not null")
    return rows.select("vec_id", F.transform("c", lambda v: (F.floor(v * SCALE) + SHIFT).cast("long")).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: str = "double") -> np.ndarray:
    """The sum of make(vectors as a matrix) over all batches: each task adds up its own rows, Spark adds up the tasks' sums.

    Of kind "decimal(38,0)" whole numbers are added exactly. The sum comes to the driver: shape is bounded by the vectors'
    dimensions, whatever the number of rows.
    """
    sent = "double" if kind == "double" else "long"

    def run(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + make(matrix(batch.column(0)))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(np.ravel(total))], names=["k", "v"])

    table = rows.select("x").mapInArrow(run, f"k long, v {sent}").groupBy("k").agg(F.sum(F.col("v").cast(kind)).alias("v")).toArrow()
    out = np.zeros(math.prod(shape), float if kind == "double" else object)
    for k, v in zip(table["k"].to_pylist(), table["v"].to_pylist(), strict=True):
        out[k] = v if kind == "double" else int(v)
    return out.reshape(shape)


class Fit:
    """The number n and sums S of the distinct vectors, and the components of their covariance."""

    def __init__(self, fit: DataFrame, dimensions: int, n: int, many: int):
        self.n = n
        self.sums = summed(fit, lambda m: m.sum(axis=0), (dimensions,), "decimal(38,0)")
        centred = self.centring()
        covariance = summed(fit, lambda m: centred(m).T @ centred(m), (dimensions, dimensions)) / n
        values, vectors = leading(covariance, many)
        # Directions in which the vectors don't differ, but for rounding, have no scale.
        real = values > 1e-10 * max(values[0], 0.0)
        self.values, self.vectors, self.explained = values[real], vectors[real], values[real] / np.trace(covariance) if real.any() else values[real]
        project, k = self.projection(), len(self.values)
        mean = summed(fit, lambda m: project(m).sum(axis=0), (k,)) / n
        spread = summed(fit, lambda m: (project(m) - mean).T @ (project(m) - mean), (k, k)) / n
        self.identity_error = float(np.abs(spread - np.eye(k)).max(initial=0.0))

    def centring(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S/n: the whole part of S/n comes off in whole numbers, so that nothing is lost where x is large."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return lambda m: (m - whole) - part

    def projection(self) -> Callable[[np.ndarray], np.ndarray]:
        centred, scaled = self.centring(), self.vectors.T / np.sqrt(self.values)
        return lambda m: centred(m) @ scaled

    def deviation(self) -> Callable[[np.ndarray], list[int]]:
        """Sum of (n*x - S)^2 of each row, exactly: in 64 bits where they are enough, else in Python's numbers."""
        n, sums = self.n, self.sums

        def work(m):
            reach = max(n * max(abs(int(m.max())), abs(int(m.min()))) + max(abs(s) for s in sums), 1)
            if reach < 1 << 62:
                off = n * m - np.array([int(s) for s in sums], np.int64)
                if int(np.abs(off).max()) ** 2 * m.shape[1] < 1 << 62:
                    return (off * off).sum(axis=1).tolist()
            return [sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in m.tolist()]

        return work


def whiten(embeddings: DataFrame, many: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold null, non-finite or over-large entries (MOST) are dropped, and so are those of another
    length than most of the distinct ones (of as many, the longer). Repeated vectors count once in the fit, however many rows
    they have, and repeated rows each get their result. Components with no spread (under 10^-10 of the first) have no scale
    and give no rows, so that equal vectors, like an empty table, give none. A deviation over 2^63 is an error. Other
    columns aren't read.

    The driver holds sums over dimensions by dimensions and the components, nothing that grows with the rows; the tasks get the
    components with their code.
    """
    rows = usable(embeddings)
    distinct = materialize(rows.select("x").distinct())
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if sizes is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    of_size = F.size("x") == sizes["d"]
    fit = Fit(distinct.filter(of_size), sizes["d"], sizes["n"], many)
    project, deviation, k = fit.projection(), fit.deviation(), len(fit.values)

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m or not k:
                continue
            x, at = matrix(batch.column(1)), np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fit.n)),
                    pa.array(deviation(x), pa.int64()).take(pa.array(at)),
                    pa.array(project(x).ravel()),
                    pa.array(np.tile(fit.explained, m)),
                    pa.array(np.full(m * k, fit.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.filter(of_size).select("vec_id", "x").mapInArrow(run, schema)
