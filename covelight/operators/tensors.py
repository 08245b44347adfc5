"""Slices as tensors: a column of struct(shape, data), data in row order, read from arrays of labels or of class scores.

Functions work on Arrow batches: rows of one shape are stacked and computed as one array. A null tensor gives null; data of another
number than its shape says raises.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constraints import missing_ids, require

TENSOR = "shape array<int>, data array<double>"
COUNTS = ("total", "whole", "core", "enhancing")


def tensor(data: str | Column, *shape: int) -> Column:
    """A tensor of the given shape from an array of its numbers."""
    return F.struct(F.array(*[F.lit(n) for n in shape]).alias("shape"), (F.col(data) if isinstance(data, str) else data).cast("array<double>").alias("data"))


def read_slices(spark: SparkSession, folder: str, pattern: str = "*.npy") -> DataFrame:
    """(subject_id, slice, tensor) of one array a file, named <subject>_slice<number>.npy."""

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in pdf["content"]]
            yield pd.DataFrame({"file": pdf["file"], "shape": [list(a.shape) for a in arrays], "data": [a.astype(np.float64).ravel() for a in arrays]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    loaded = files.mapInPandas(load, f"file string, {TENSOR}")
    number = F.regexp_extract("file", r"_slice(\d+)", 1)
    return loaded.select(F.substring_index(F.regexp_replace("file", r"\.npy$", ""), "_slice", 1).alias("subject_id"), F.when(number != "", number.cast("int")).alias("slice"), F.struct("shape", "data").alias("tensor"))


def _stacks(t: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their tensors as one array) by shape; rows without a tensor are left out."""
    known = np.flatnonzero(t["data"].notna().to_numpy() & t["shape"].notna().to_numpy())
    shapes = {i: tuple(int(n) for n in t["shape"].iloc[i]) for i in known}
    for shape in sorted(set(shapes.values())):
        at = np.array([i for i in known if shapes[i] == shape])
        flat = [np.asarray(t["data"].iloc[i], np.float64) for i in at]
        if any(x.size != int(np.prod(shape)) for x in flat):
            raise ValueError(f"a tensor of shape {shape} has another number of values")
        yield at, np.stack(flat).reshape(len(at), *shape)


def _each(schema: str, compute: Callable[[np.ndarray], dict[str, Sequence]]) -> Callable[[str | Column], Column]:
    """A function of a tensor column; compute gives each result's column from a stack of tensors."""

    @F.pandas_udf(schema)
    def run(t: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({c.split()[0]: pd.Series([None] * len(t), dtype=object) for c in schema.split(", ")})
        for at, stack in _stacks(t):
            for name, values in compute(stack).items():
                for i, x in zip(at, values, strict=True):
                    out.at[i, name] = x
        return out

    return run


def _softmax(x: np.ndarray) -> dict[str, Sequence]:
    e = np.exp(x - x.max(1, keepdims=True))
    return {"shape": [list(x.shape[1:])] * len(x), "data": list((e / e.sum(1, keepdims=True)).reshape(len(x), -1))}


def _summary(p: np.ndarray) -> dict[str, Sequence]:
    p = p.reshape(len(p), p.shape[1], -1)
    return {"entropy": (-(p * np.log(p + 1e-8)).sum(1)).mean(1).tolist(), "foreground": p[:, 1:].sum(1).mean(1).tolist(), "mean_probs": p.mean(2).tolist()}


def _classes(p: np.ndarray) -> dict[str, Sequence]:
    return {"shape": [list(p.shape[2:])] * len(p), "data": list(p.argmax(1).reshape(len(p), -1).astype(np.float64))}


def _counts(x: np.ndarray) -> dict[str, Sequence]:
    x = x.reshape(len(x), -1)
    return {"total": [x.shape[1]] * len(x), "whole": (x > 0).sum(1).tolist(), "core": ((x == 1) | (x == 3)).sum(1).tolist(), "enhancing": (x == 3).sum(1).tolist()}


def softmax_maps(scores: str | Column) -> Column:
    """Class scores (class first) as probabilities at each place."""
    return _each(TENSOR, _softmax)(scores)


def probability_summary(probabilities: str | Column) -> Column:
    """struct(entropy, foreground, mean_probs): means over all places of the entropy, of the share of all classes but the first,
    and of each class."""
    return _each("entropy double, foreground double, mean_probs array<double>", _summary)(probabilities)


def class_map(probabilities: str | Column) -> Column:
    """The class of largest probability at each place, the first of equal ones."""
    return _each(TENSOR, _classes)(probabilities)


def label_counts(labels: str | Column) -> Column:
    """struct(total, whole, core, enhancing): numbers of places, of labels above 0, of 1 or 3, of 3."""
    return _each("total long, whole long, core long, enhancing long", _counts)(labels)


def view_consistency(base: str | Column, *views: str | Column) -> Column:
    """Mean share of places at which each view's class is the base's; 0 without a view, null where a view is."""

    @F.pandas_udf("double")
    def run(first: pd.DataFrame, *others: pd.DataFrame) -> pd.Series:
        total, missing = np.zeros(len(first)), first["data"].isna().to_numpy().copy()
        own = {int(i): x.argmax(0) for at, stack in _stacks(first) for i, x in zip(at, stack, strict=True)}
        for o in others:
            missing |= o["data"].isna().to_numpy()
            for at, stack in _stacks(o):
                for i, x in zip(at, stack, strict=True):
                    if int(i) in own:
                        total[i] += (x.argmax(0) == own[int(i)]).mean()
        return pd.Series(np.where(missing, None, total / max(len(others), 1)), dtype=object)

    return run(base, *views)


def subject_morphology(slices: DataFrame, subjects: DataFrame | None = None, subject: str = "subject_id", labels: str = "tensor") -> DataFrame:
    """Per subject the counts of all its label slices and their shares, as subjects.morphology_stats gives them from single
    pixels. subjects: those that must have a slice, or it raises."""
    if subjects is not None:
        require(missing_ids(subjects, slices, subject), "subjects without a label slice")
    counted = slices.select(subject, label_counts(labels).alias("c")).groupBy(subject).agg(*[F.sum(f"c.{c}").alias(c) for c in COUNTS])
    size = F.greatest("total", F.lit(1))
    return counted.withColumns({f"{c}_ratio": F.col(c) / size for c in COUNTS[1:]}).withColumn("has_enhancing", (F.col("enhancing") > 0).cast("double"))


def subject_state(slices: DataFrame, subject: str = "subject_id", order: str = "slice", probabilities: str = "tensor", ratio: float = 0.3, weight: float = 0.25) -> DataFrame:
    """(subject, uncertainty, foreground, k): means over each subject's best-ranked slices, ranked by foreground and entropy."""
    from .subjects import slice_ranking, top_fraction

    flat = slices.select(subject, order, probability_summary(probabilities).alias("p")).select(subject, order, F.col("p.entropy").alias("uncertainty"), F.col("p.foreground").alias("foreground"))
    ranked = flat.withColumn("_ranking", slice_ranking("foreground", "uncertainty", weight))
    return top_fraction(ranked, subject, [order], "_ranking", ["uncertainty", "foreground"], ratio)
