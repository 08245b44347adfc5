"""Column builders for score and vector arithmetic. Everything is computed in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the selection method.
FLAT_RANGE = 1e-12
NORM_EPSILON = 1e-8
SUM_EPSILON = 1e-12
SIGMOID_CLIP = 50.0
STRENGTH_FLOOR = 1e-8
GATE_POWER = 4.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def min_max(c: str | Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low), 0 where the range is flat."""
    return F.when(col(c).isNotNull() & (high - low < FLAT_RANGE), 0.0).otherwise((col(c).cast("double") - low) / (high - low))


def normalize(df: DataFrame, column: str, out: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Adds `column` min-max scaled within each group. Bounds come from one small aggregate (partial sums on the map side),
    joined back, so no group is ever gathered in one task. Nulls stay null."""
    bounds = df.groupBy(*by).agg(F.min(column).cast("double").alias("_low"), F.max(column).cast("double").alias("_high"))
    joined = df.join(bounds, list(by)) if by else df.crossJoin(F.broadcast(bounds))
    return joined.withColumn(out or column, min_max(column, F.col("_low"), F.col("_high"))).drop("_low", "_high")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: str | Column) -> Column:
    """v / (|v| + 1e-8). The length is an array's only element, as inside the inner lambda it would be worked out for each component."""
    size = F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + NORM_EPSILON
    return F.get(F.transform(F.array(size), lambda s: F.transform(col(v), lambda x: x.cast("double") / s)), F.lit(0))


def clipped_cosine(a: str | Column, b: str | Column) -> Column:
    return F.greatest(dot(a, b), F.lit(0.0))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 - max(a.b, -1) of unit vectors."""
    return 1.0 - F.greatest(dot(a, b), F.lit(-1.0))


def sigmoid(x: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-SIGMOID_CLIP), F.least(F.lit(SIGMOID_CLIP), col(x)))))


def gate_activation(gate: str | Column, temperature: float = 0.05) -> Column:
    return sigmoid((col(gate) - 0.5) / temperature)


def power_gates(strengths: Sequence[Column], power: float = GATE_POWER) -> list[Column]:
    """max(s, 1e-8)^power over their sum."""
    powers = [F.pow(F.greatest(s, F.lit(STRENGTH_FLOOR)), F.lit(power)) for s in strengths]
    total = sum(powers[1:], powers[0]) + SUM_EPSILON
    return [p / total for p in powers]


def softmax(values: Sequence[Column], temperature: float = 1.0) -> list[Column]:
    """Softmax of a few columns of one row, the largest subtracted first."""
    t = max(temperature, 1e-6)
    top = F.greatest(*values) if len(values) > 1 else values[0]
    powers = [F.exp((v - top) / t) for v in values]
    total = sum(powers[1:], powers[0]) + SUM_EPSILON
    return [p / total for p in powers]


def mean_vector(df: DataFrame, by: Sequence[str], vector: str, out: str, weight: Column | None = None, total: bool = False) -> DataFrame:
    """Element-wise mean (or sum) of `vector` by group: elements are summed as rows, with partial sums on the map side."""
    w = F.lit(1.0) if weight is None else weight
    parts = df.select(*by, w.alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    value = F.sum(F.col("_x").cast("double") * F.col("_w"))
    sums = parts.groupBy(*by, "_i").agg((value if total else value / F.sum("_w")).alias("_x"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(out))
