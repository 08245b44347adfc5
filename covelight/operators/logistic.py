"""Weighted logistic regression with an L2 penalty on all coefficients, the intercept included, by Newton's method: each step is
one pass, in which tasks add up loss, gradient and curvature of their rows; (d + 1)^2 sums come to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

CHUNK = 4096


def _sums(rows: DataFrame, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    d = len(b)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d))
        loss = 0.0
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                x = np.column_stack([v, np.ones(len(v))])
                y, w = part.column("y").to_numpy(), part.column("weight").to_numpy()
                z = x @ b
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                loss += float((w * (np.logaddexp(0, z) - y * z)).sum())
                total[0] += x.T @ (w * (p - y))
                total[1:] += (x * (w * p * (1 - p))[:, None]).T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.append(i.ravel(), -1), pa.int32()), "j": pa.array(np.append(j.ravel(), 0), pa.int32()), "x": pa.array(np.append(total.ravel(), loss))})

    out, loss = np.zeros((d + 1, d)), 0.0
    for i, j, x in rows.mapInArrow(add, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x")).collect():
        if i < 0:
            loss = x
        else:
            out[i, j] = x
    return loss, out[0], out[1:]


def logistic(rows: DataFrame, steps: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """Coefficients, the intercept last, of rows (v, y 0 or 1, weight): least sum of weight * log loss + |coefficients|^2 / 2. A step
    that makes it worse is halved."""
    rows = cut(rows.where("v is not null").select(F.col("v").cast("array<double>").alias("v"), F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("weight")))
    first = rows.select(F.size("v")).first()
    b = np.zeros((first[0] if first else 0) + 1)
    best, before = np.inf, b
    for _ in range(steps):
        loss, gradient, curve = _sums(rows, b)
        value = loss + 0.5 * float(b @ b)
        if value > best + 1e-12 * abs(best):
            b = (b + before) / 2
            continue
        step = np.linalg.solve(curve + np.eye(len(b)), gradient + b)
        best, before, b = value, b, b - step
        if np.abs(step).max() < tolerance:
            break
    return np.round(b, 12)


def probability(b: np.ndarray, v: str | Column = "v") -> Column:
    """The probability of y = 1 at a vector."""

    @F.pandas_udf("double")
    def run(x):
        import pandas as pd

        m = np.array(x.tolist(), np.float64).reshape(len(x), -1)
        return pd.Series(1 / (1 + np.exp(-np.clip(m @ b[:-1] + b[-1], -500, 500))))

    return run(v)
