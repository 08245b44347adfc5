"""The source's clusters and the target selectors built on k-means (operators/kmeans.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .kmeans import MOVES, SEED, STARTS, kmeans, squared_distances
from .logistic import logistic, probability


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(squared_distances(v, centres))


def assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds cluster (nearest centre, ties to the lower number) and distances (to every centre)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            d = _distances(np.array(pdf["v"].tolist()).reshape(len(pdf), -1), centres)
            yield pdf.assign(cluster=d.argmin(1).astype(np.int32), distances=list(d))

    return rows.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", cluster int, distances array<double>")


def source_clusters(rows: DataFrame, k: int = 32, starts: int = STARTS, moves: int = MOVES, seed: int = SEED) -> DataFrame:
    """(pos, cluster); everything is cluster 0 when at most one cluster is possible."""
    rows = cut(rows.select("pos", "v"))
    k = min(k, rows.count())
    if k <= 1:
        return rows.select("pos", F.lit(0).alias("cluster"))
    rows = rows.select("pos", "v", F.lit(1.0).alias("weight"))
    return assign(rows, kmeans(rows, k, starts, moves, seed=seed).centres).select("pos", "cluster")


def _filled(chosen: list[int], rows: DataFrame, budget: int, weight: str) -> DataFrame:
    """Fill up by weight, then number the picks."""
    if len(chosen) < budget:
        more = rows.orderBy(F.desc(weight), F.asc("pos")).limit(budget + len(chosen)).select("pos").collect()
        chosen = chosen + [r["pos"] for r in more if r["pos"] not in set(chosen)]
    return rows.sparkSession.createDataFrame([(i + 1, p) for i, p in enumerate(chosen[:budget])], "rank int, pos long")


def weighted_support(rows: DataFrame, budget: int, starts: int = STARTS, moves: int = MOVES, seed: int = SEED) -> DataFrame:
    """(rank, pos): per cluster its member of best 0.7 (1 - N(distance)) + 0.3 N(weight); rows: pos, v, weight."""
    rows = cut(rows.select("pos", "v", F.greatest(F.col("weight").cast("double"), F.lit(1e-6)).alias("weight")))
    placed = cut(assign(rows, kmeans(rows, budget, starts, moves, seed=seed).centres).drop("v"))
    spread = placed.select(F.posexplode("distances").alias("cluster", "d")).groupBy("cluster").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    bounds = rows.agg(F.min("weight").alias("w0"), F.max("weight").alias("w1"))
    own = placed.withColumn("d", F.element_at("distances", F.col("cluster") + 1)).join(F.broadcast(spread), "cluster").crossJoin(F.broadcast(bounds))
    scaled = lambda x, a, b: F.when(F.col(b) - F.col(a) < 1e-12, 0.0).otherwise((F.col(x) - F.col(a)) / (F.col(b) - F.col(a)))
    priority = 0.7 * (1.0 - scaled("d", "low", "high")) + 0.3 * scaled("weight", "w0", "w1")
    best = own.groupBy("cluster").agg(F.max_by("pos", F.struct(priority.alias("p"), (-F.col("pos")).alias("n"))).alias("pos")).orderBy("cluster").collect()
    return _filled([r["pos"] for r in best], rows, budget, "weight")


def _nearest_unused(rows: DataFrame, centres: np.ndarray, budget: int, order: str = "pos") -> list[int]:
    """For each centre in turn the nearest row not taken yet, whatever its cluster; ties by `order`. A centre needs
    its `budget` nearest rows at most, so budget^2 rows reach the driver."""
    placed = assign(rows, centres).select("pos", F.col(order).alias("o"), F.posexplode("distances").alias("cluster", "d"))
    near = Window.partitionBy("cluster").orderBy("d", "o")  # tasks keep their own best `budget` of each centre first
    best: dict[int, list[int]] = {}
    for r in placed.withColumn("place", F.row_number().over(near)).where(F.col("place") <= budget).orderBy("cluster", "place").collect():
        best.setdefault(r["cluster"], []).append(r["pos"])
    chosen: list[int] = []
    for c in range(len(centres)):
        chosen += [p for p in best.get(c, []) if p not in chosen][:1]
    return chosen


def uncertainty_clusters(rows: DataFrame, budget: int, starts: int = STARTS, moves: int = MOVES, seed: int = SEED) -> DataFrame:
    """Clustering weighted by uncertainty, then the nearest unused row of each centre (CLUE)."""
    scaled = cut(rows.select("pos", "v", F.greatest(F.col("weight").cast("double"), F.lit(1e-8)).alias("weight")))
    total = scaled.agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("n"))
    scaled = scaled.crossJoin(F.broadcast(total)).select("pos", "v", (F.col("weight") / (F.col("s") + 1e-8) * F.col("n")).alias("weight"))
    return _filled(_nearest_unused(scaled, kmeans(scaled, budget, starts, moves, seed=seed).centres, budget), scaled, budget, "weight")


def inconsistent_clusters(rows: DataFrame, budget: int, factor: int = 10, starts: int = STARTS, moves: int = MOVES, seed: int = SEED) -> DataFrame:
    """Clustering of the (1 + factor) * budget rows of largest local inconsistency (`weight`), ties going to the higher
    position, then the nearest unused candidate of each centre (LADA)."""
    rows = cut(rows.select("pos", "v", "weight"))
    near = cut(rows.orderBy(F.desc("weight"), F.desc("pos")).limit((1 + factor) * budget))
    near = near.select("pos", "v", F.lit(1.0).alias("weight"), F.struct(F.col("weight").alias("a"), F.col("pos").alias("b")).alias("o"))
    return _filled(_nearest_unused(near, kmeans(near.select("pos", "v", "weight"), budget, starts, moves, seed=seed).centres, budget, "o"), rows, budget, "weight")


def domain_selection(source: DataFrame, target: DataFrame, budget: int) -> DataFrame:
    """(rank, pos, score): target rows that least look like source: (1 - p) / p times their uncertainty, p from a
    balanced logistic regression of source (1) against target (0) with a penalised intercept."""
    target = cut(target.where("v is not null").select("pos", "v", "weight"))
    both = source.where("v is not null").select("v", F.lit(1.0).alias("y")).unionByName(target.select("v", F.lit(0.0).alias("y")))
    counts = {r["y"]: r["count"] for r in both.groupBy("y").count().collect()}
    n = sum(counts.values())
    weight = F.when(F.col("y") == 1.0, n / 2 / max(counts.get(1.0, 0), 1)).otherwise(n / 2 / max(counts.get(0.0, 0), 1))
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), probability(logistic(both.withColumn("weight", weight)))))
    scored = target.select("pos", "v", F.greatest(F.col("weight").cast("double"), F.lit(1e-8)).alias("_u")).select("pos", "_u", p.alias("_p"))
    scored = scored.select("pos", ((1 - F.col("_p")) / F.col("_p") * F.col("_u")).alias("score"))
    top = scored.orderBy(F.desc("score"), F.asc("pos")).limit(budget)
    return top.select(F.row_number().over(_by_score()).alias("rank"), "pos", "score")


def _by_score():
    return Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc("pos"))
