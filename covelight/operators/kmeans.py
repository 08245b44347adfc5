"""Weighted k-means with several k-means++ starts, each step one pass over the rows for all starts together.

Seeding draws candidates in a few rounds instead of one pass a centre: a round takes, for every start, the rows that win a
race with rates weight times squared distance to the start's candidates so far, which is sampling by those odds without
replacement. The candidates, weighted by the rows nearest to them, are few; plain k-means++ among them gives the start's
centres. Then all starts are moved at once until each stands still, and the one of least inertia is the result.

A row's random numbers follow from its position, the seed, the start and the round alone, and sums are rounded to twelve
digits, so the result depends neither on partitions nor on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

STARTS, MOVES, TOLERANCE, SEED = 10, 300, 1e-4, 2025
#: Rounds of candidates, and candidates a round and start as a multiple of k.
ROUNDS, OVERSAMPLING = 5, 2
#: Rows held as one matrix; distances worked out at a time.
CHUNK, DISTANCES = 4096, 1 << 20
DIGITS = 12


@dataclass(frozen=True)
class Clusters:
    """The best start: its centres (k x d), inertia, number and moves; and every start's inertia."""

    centres: np.ndarray
    inertia: float
    start: int
    moves: int
    inertias: tuple[float, ...]


def uniforms(pos: np.ndarray, seed: int, start: int, step: int) -> np.ndarray:
    """A number in (0, 1] for each position: two rounds of a multiply-and-shift mix of 64 bits."""
    with np.errstate(over="ignore"):
        x = pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + start * 8191 + step * 127 + 1) % (1 << 63))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / (1 << 53)


def squared_distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """n x k, at twelve digits, so equal distances stay equal however rows are grouped."""
    d = (v * v).sum(1)[:, None] - 2.0 * (v @ centres.T) + (centres * centres).sum(1)[None, :]
    return np.maximum(np.round(d, DIGITS), 0.0)


def _packed(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to the cores there are, whatever file they lie in, up to CHUNK of them as one matrix (bytes of doubles)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                found = (part.column("pos").to_numpy(), part.column("v").flatten().to_numpy(zero_copy_only=False), part.column("weight").to_numpy())
                yield pa.RecordBatch.from_pydict({k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("pos", "v", "weight"), found, strict=True)})

    dealt = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "pos")
    return cut(dealt.mapInArrow(pack, "pos binary, v binary, weight binary"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pos, matrix, weights) of up to CHUNK rows."""
    for batch in batches:
        for pos, v, weight in zip(*(batch.column(c) for c in ("pos", "v", "weight")), strict=True):
            ids = np.frombuffer(pos.as_buffer(), np.int64)
            yield ids, np.frombuffer(v.as_buffer()).reshape(len(ids), -1), np.frombuffer(weight.as_buffer())


def _draw(rows: DataFrame, candidates: list[np.ndarray], count: int, seed: int, step: int) -> list[np.ndarray]:
    """For each start the `count` rows that win its race. Candidates have no distance left and cannot win again."""

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in candidates]
        for pos, v, weight in _chunks(batches):
            for s, c in enumerate(candidates):
                rate = weight * (squared_distances(v, c).min(1) if len(c) else 1.0)
                with np.errstate(divide="ignore"):
                    time = -np.log(uniforms(pos, seed, s, step)) / rate
                order = np.lexsort((pos, time))[:count]
                order = order[np.isfinite(time[order])]
                best[s] = sorted([*best[s], *((float(time[i]), int(pos[i]), v[i]) for i in order)], key=lambda x: x[:2])[:count]
        found = [(s, *x) for s, b in enumerate(best) for x in b]
        yield pa.RecordBatch.from_pydict({"start": pa.array([f[0] for f in found], pa.int32()), "time": pa.array([f[1] for f in found], pa.float64()), "pos": pa.array([f[2] for f in found], pa.int64()), "v": pa.array([f[3] for f in found], pa.list_(pa.float64()))})

    first = Window.partitionBy("start").orderBy("time", "pos")
    won = rows.mapInArrow(race, "start int, time double, pos long, v array<double>").withColumn("place", F.row_number().over(first)).where(F.col("place") <= count)
    out: list[list] = [[] for _ in candidates]
    for r in sorted(won.select("start", "place", "v").collect()):
        out[r["start"]].append(r["v"])
    return [np.array([*c, *new], np.float64) if len(new) else c for c, new in zip(candidates, out, strict=True)]


def _held(rows: DataFrame) -> RDD:
    """(v, weight) of _packed's rows as a cached RDD: a move is then a small job without planning, whose tasks find their rows in memory."""
    return rows.select("v", "weight").rdd.map(lambda r: (bytes(r[0]), bytes(r[1]))).persist(StorageLevel.MEMORY_AND_DISK)


def _sums(rows: RDD, sets: list[np.ndarray], vectors: bool = True) -> list[tuple[np.ndarray, float]]:
    """For each set of centres: per centre the weighted sum of its rows' vectors and their weight (k x (d + 1), or the weight
    alone), and the set's inertia. Each task adds up its own rows and gives one row; there are as many tasks as cores."""
    every, ends = np.concatenate(sets), np.cumsum([len(c) for c in sets])
    width = every.shape[1] if vectors else 0

    def add(parts: Iterator[tuple[bytes, bytes]]) -> Iterator[bytes]:
        total, inertia = np.zeros((len(every), width + 1)), np.zeros((len(sets), width + 1))
        step = max(1, DISTANCES // len(every))
        for v_, weight_ in parts:
            weights = np.frombuffer(weight_)
            vs = np.frombuffer(v_).reshape(len(weights), -1)
            for a in range(0, len(weights), step):
                v, weight = vs[a : a + step], weights[a : a + step]
                rows_ = np.column_stack([v * weight[:, None], weight]) if vectors else weight[:, None]
                d, at = squared_distances(v, every), np.arange(len(v))
                own = np.zeros(d.shape)
                for s, end in enumerate(ends):
                    first = end - len(sets[s])
                    label = first + d[:, first:end].argmin(1)
                    own[at, label] = 1.0
                    inertia[s, -1] += (d[at, label] * weight).sum()
                total += own.T @ rows_
        yield np.concatenate([total, inertia]).tobytes()

    found = sum(np.frombuffer(t).reshape(-1, width + 1) for t in rows.mapPartitions(add).collect())  # a row a core
    return [(t, float(found[len(every) + s, -1])) for s, t in enumerate(np.split(found[: len(every)], ends[:-1]))]


def plus_plus(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ among a few weighted points: each next one drawn by weight times squared distance, the best of several draws."""
    rng = np.random.default_rng(seed)
    tries = 2 + int(np.log(k))
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    near = squared_distances(points, points[chosen]).min(1)
    while len(chosen) < k:
        odds = weights * near
        if odds.sum() <= 0:
            break
        drawn = rng.choice(len(points), tries, p=odds / odds.sum())
        after = np.minimum(near, squared_distances(points, points[drawn]).T)
        best = int((after * weights).sum(1).argmin())
        chosen.append(int(drawn[best]))
        near = after[best]
    return points[chosen]


def _farthest(rows: DataFrame, centres: np.ndarray, n: int) -> np.ndarray:
    """The n rows that add most to the inertia."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for pos, v, weight in _chunks(batches):
            far = squared_distances(v, centres).min(1) * weight
            best = sorted([*best, *((-float(far[i]), int(pos[i]), v[i]) for i in np.lexsort((pos, -far))[:n])], key=lambda x: x[:2])[:n]
        yield pa.RecordBatch.from_pydict({"far": pa.array([b[0] for b in best], pa.float64()), "pos": pa.array([b[1] for b in best], pa.int64()), "v": pa.array([b[2] for b in best], pa.list_(pa.float64()))})

    found = rows.mapInArrow(top, "far double, pos long, v array<double>").orderBy("far", "pos").limit(n).collect()
    return np.array([r["v"] for r in found])


def _moved(rows: DataFrame, centres: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Each centre at the mean of its rows; a centre without any at the row farthest from its own."""
    full = sums[:, -1] > 0
    new = centres.copy()
    new[full] = np.round(sums[full, :-1] / sums[full, -1:], DIGITS)
    if not full.all():
        far = _farthest(rows, centres, int((~full).sum()))
        new[np.flatnonzero(~full)[: len(far)]] = far
    return new


def kmeans(rows: DataFrame, k: int, starts: int = STARTS, moves: int = MOVES, tolerance: float = TOLERANCE, seed: int = SEED) -> Clusters:
    """The best of `starts` weighted k-means of rows (pos, v, weight). A start stops when the squared shift of its centres is at
    most `tolerance` times the mean variance of the vectors' places, when nothing moves, or after `moves` moves.

    Rows of weight 0 or null vectors have no say. Fewer distinct rows than k give fewer centres. To the driver come
    (1 + ROUNDS * OVERSAMPLING * k) candidates a start and, of each core, k * (d + 1) sums a start and move, whatever the number of rows.
    """
    rows = _packed(rows.where("v is not null and weight > 0").select(F.col("pos").cast("long").alias("pos"), F.col("v").cast("array<double>").alias("v"), F.col("weight").cast("double").alias("weight")))
    sets = _draw(rows, [np.zeros((0, 1))] * starts, 1, seed, 0)
    if not len(sets[0]):
        raise ValueError("k-means needs a row of positive weight")
    for step in range(1, ROUNDS + 1):
        sets = _draw(rows, sets, OVERSAMPLING * k, seed, step)
    least = _variance(rows) * tolerance
    inertia, made = [np.inf] * starts, [0] * starts
    going = list(range(starts))
    held = _held(rows)
    try:
        weights = [w[:, 0] for w, _ in _sums(held, sets, vectors=False)]
        sets = [plus_plus(c, np.maximum(w, 1e-12), min(k, len(c)), seed + s) for s, (c, w) in enumerate(zip(sets, weights, strict=True))]
        for _ in range(moves):
            if not going:
                break
            after = []
            for s, (sums, _) in zip(going, _sums(held, [sets[s] for s in going]), strict=True):
                new = _moved(rows, sets[s], sums)
                shift = float(((new - sets[s]) ** 2).sum())
                sets[s], made[s] = new, made[s] + 1
                if shift > max(least, 0.0):
                    after.append(s)
            going = after
        for s, (_, x) in enumerate(_sums(held, sets, vectors=False)):
            inertia[s] = float(f"{x:.10g}")
    finally:
        held.unpersist()
    best = int(np.argmin(inertia))
    return Clusters(sets[best], inertia[best], best, made[best], tuple(inertia))


def _variance(rows: DataFrame) -> float:
    """Mean variance of the vectors' places, unweighted."""

    def total(mean: np.ndarray | float, power: int) -> tuple[int, np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, x = 0, None
            for _, v, _ in _chunks(batches):
                part = ((v - mean) ** power).sum(0)
                n, x = n + len(v), part if x is None else x + part
            if n:
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(-1, len(x)), pa.int32()), "x": pa.array(np.append(float(n), x))})

        sums = dict(rows.mapInArrow(add, "i int, x double").groupBy("i").agg(F.sum("x")).collect())
        return int(sums.pop(-1)), np.array([sums[i] for i in range(len(sums))])

    n, x = total(0.0, 1)
    return float(f"{(total(x / n, 2)[1] / n).mean():.10g}")
