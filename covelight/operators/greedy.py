"""Greedy selection that stays exact without holding the pool in one place.

All objectives here only fall for a row as more rows are picked (k-center's from its second pick on). So one distributed scan gives every row's present
value, the best `batch` rows come to the driver with their vectors, and picks go on among these for as long as
the best of them is no worse than the best row left behind; then the pool is scanned again with the picks so far. The driver
holds batch + budget vectors, the tasks budget vectors, whatever the size of the pool.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Fixed values of the selection method.
PRIORITY_WEIGHT = 0.05
REDUNDANCY = 0.08
BATCH = 1024


@dataclass
class Objective:
    """What the picks so far make a row worth; v: vectors, q: similarities to the support, base: own score."""

    picks: list[np.ndarray] = field(default_factory=list)
    #: The first pick goes by another measure, so values before it bound nothing.
    own_first = False

    def _closest(self, v: np.ndarray) -> np.ndarray:
        return (v @ np.array(self.picks).T).max(1)

    def take(self, v: np.ndarray, q: np.ndarray) -> None:
        self.picks.append(v)

    def values(self, v: np.ndarray, q: np.ndarray, base: np.ndarray) -> np.ndarray:
        raise NotImplementedError


@dataclass
class KCenter(Objective):
    """Distance to the nearest pick plus a small share of the row's priority; the first pick is the best priority."""

    own_first = True

    def values(self, v, q, base):
        if not self.picks:
            return np.where(base > 0, base, 0.0)
        return 1.0 - np.maximum(self._closest(v), -1.0) + PRIORITY_WEIGHT * base


@dataclass
class Coverage(Objective):
    """What the row adds to the support's best similarities, less a penalty for the pick it is closest to."""

    penalty: float = REDUNDANCY
    covered: np.ndarray | None = None

    def take(self, v, q):
        super().take(v, q)
        self.covered = q if self.covered is None else np.maximum(self.covered, q)

    def values(self, v, q, base):
        if not self.picks:
            return q.sum(1)
        return np.maximum(q - self.covered, 0.0).sum(1) - self.penalty * np.maximum(self._closest(v), 0.0)


@dataclass
class Redundancy(Objective):
    """The row's own score less a penalty for the pick it is closest to."""

    penalty: float = REDUNDANCY

    def values(self, v, q, base):
        return base - self.penalty * np.maximum(self._closest(v), 0.0) if self.picks else base


def _matrix(lists, n: int) -> np.ndarray:
    return np.array(list(lists), np.float64).reshape(n, -1)


def _scan(pool: DataFrame, objective: Objective, picked: set[int], batch: int) -> pd.DataFrame:
    """The batch + 1 best rows that are not picked, best first, ties by lower pos."""

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in parts:
            pdf = pdf[~pdf["pos"].isin(picked)]
            if len(pdf):
                n = len(pdf)
                pdf = pdf.assign(value=objective.values(_matrix(pdf["v"], n), _matrix(pdf["q"], n), pdf["base"].to_numpy(np.float64)))
                held = pdf if held is None else pd.concat([held, pdf])
                held = held.sort_values(["value", "pos"], ascending=[False, True]).head(batch + 1)
        if held is not None:
            yield held

    schema = "pos long, v array<double>, q array<double>, base double, value double"
    rows = pool.mapInPandas(best, schema).orderBy(F.desc("value"), F.asc("pos")).limit(batch + 1).collect()
    return pd.DataFrame([r.asDict() for r in rows], columns=["pos", "v", "q", "base", "value"])


def greedy(pool: DataFrame, budget: int, objective: Objective, seeds: list[int] | tuple[int, ...] = (), batch: int = BATCH) -> DataFrame:
    """(rank, pos, value): up to `budget` picks. pool: pos, v and, where the objective wants them, q and base. Rows with a null
    vector are left out. Seeds are taken first, in order, with a null value."""
    for name, default in (("q", F.array().cast("array<double>")), ("base", F.lit(0.0))):
        if name not in pool.columns:
            pool = pool.withColumn(name, default)
    pool = pool.where(F.col("v").isNotNull()).select(F.col("pos").cast("long").alias("pos"), "v", "q", F.col("base").cast("double").alias("base"))
    chosen: list[tuple[int, float | None]] = []
    seeds = list(dict.fromkeys(seeds))[:budget]
    if seeds:
        given = {r["pos"]: r for r in pool.where(F.col("pos").isin(seeds)).collect()}
        for pos in seeds:
            if pos in given:
                objective.take(np.array(given[pos]["v"]), np.array(given[pos]["q"]))
                chosen.append((pos, None))
    while len(chosen) < budget:
        near = _scan(pool, objective, {p for p, _ in chosen}, batch)
        if not len(near):
            break
        bound = (near["value"].iloc[batch], -near["pos"].iloc[batch]) if len(near) > batch else None
        near = near.head(batch)
        n = len(near)
        v, q, base, pos = _matrix(near["v"], n), _matrix(near["q"], n), near["base"].to_numpy(np.float64), near["pos"].to_numpy()
        free, fresh = np.ones(n, bool), True
        while len(chosen) < budget and free.any():
            value = np.where(free, objective.values(v, q, base), -np.inf)
            top = value.max()
            k = int(np.flatnonzero(value == top)[pos[value == top].argmin()])
            if bound is not None and not fresh and (top, -pos[k]) < bound:
                break
            fresh = False
            free[k] = False
            objective.take(v[k], q[k])
            chosen.append((int(pos[k]), float(top)))
            if objective.own_first and len(objective.picks) == 1:
                break
        if bound is None and not free.any():
            break
    rows = [(i + 1, p, x) for i, (p, x) in enumerate(chosen)]
    return pool.sparkSession.createDataFrame(rows, "rank int, pos long, value double")


def k_center(pool: DataFrame, budget: int) -> DataFrame:
    """Coreset: start at the best positive priority (`base`), else at the first row; then always the farthest row."""
    return greedy(pool, budget, KCenter())


def coverage_greedy(pool: DataFrame, budget: int, penalty: float = REDUNDANCY) -> DataFrame:
    """Target-anchored coverage; pool has q, each row's clipped similarities to the support. Goes on at negative values."""
    return greedy(pool, budget, Coverage(penalty=penalty))


def rank_scores(order: DataFrame, pool: DataFrame) -> DataFrame:
    """(pos, facility): 1 - place / max(1, picks - 1) for picks, 0 for the rest, so the last pick has 0 as well."""
    n = order.agg(F.count(F.lit(1)).alias("_n"))
    ranked = order.crossJoin(F.broadcast(n)).select("pos", (1.0 - (F.col("rank") - 1) / F.greatest(F.lit(1), F.col("_n") - 1)).alias("facility"))
    return pool.select("pos").join(ranked, "pos", "left").na.fill(0.0, ["facility"])


#: Rows that one pass of mutual_information looks at pair by pair.
PAIRED = 64
#: Rows of a block at least, so that a task has more to do than to start; candidates and pool rows of one matrix product.
LEAST, TALL, WIDE = 8192, 512, 512
#: The longest vector and largest cap that single precision is used for.
SINGLE = 1e9
#: Twice the rounding of single precision; what a bound is raised by, as gains are compared at nine digits.
ROUNDING, DIGITS = 1.2e-7, 1e-9


def mutual_information(pool: DataFrame, budget: int, eta: float = 1.0, stop_at_negative: bool = False, batch: int = PAIRED) -> DataFrame:
    """(rank, pos, value): greedy facility-location mutual information with the support: the sum over pool rows i of
    min(best similarity of i to a pick, eta times its best similarity to the support). Ties go to the lower pos."""
    chosen, _ = lazy_mutual_information(pool, budget, eta, batch)
    if stop_at_negative:
        chosen = chosen[: next((i for i, (_, x) in enumerate(chosen) if x < 0), len(chosen))]
    return pool.sparkSession.createDataFrame([(i + 1, p, x) for i, (p, x) in enumerate(chosen)], "rank int, pos long, value double")


def lazy_mutual_information(pool: DataFrame, budget: int, eta: float = 1.0, batch: int = PAIRED) -> tuple[list[tuple[int, float]], int]:
    """The picks with their gains, and how many passes over the pool they took.

    Rows of equal vectors and caps gain and add alike, so they are one row with a number of copies. Gains only fall, so each row's last known gain
    bounds the present one. A table keeps these bounds with the number of picks they are of; the `batch` rows of the highest ones come to the driver, and
    a pass gives their present gains and, for each two of them, the gain of one once the other is picked. So a pass settles two picks, and more while
    no other row's upper bound reaches a row's lower one. Where more than `batch` rows may be better than the best one left of these, another pass
    takes from their bounds what the picks since took from their gains: only pool rows that came nearer to the picks count there, between the similarity
    they had and the one they have. Bounds are worked out in single precision, with its largest error added; where too many rows stay within that,
    theirs are in double precision. The driver holds `batch` rows, their pairs and `budget` picks, whatever the size of the pool.
    """
    pool = pool.where("v is not null").select(F.col("pos").cast("long").alias("pos"), F.col("v").cast("array<double>").alias("v"), F.greatest(F.array_max("q"), F.lit(0.0)).cast("double").alias("cap"))
    rows = cut(pool.groupBy("v", "cap").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda x, y: x + y * y))
    distinct, total, dims, largest = rows.agg(F.count(F.lit(1)), F.sum("n"), F.max(F.size("v")), F.max(F.greatest(length, F.abs(F.lit(eta) * F.col("cap"))))).first()
    if not distinct or budget < 1:
        return [], 0
    right = _pool_blocks(rows, distinct, dims, eta)
    every = rows.select("pos", "v", F.lit(0).alias("seen"))
    # 0: the picks since are not in the bounds, 1: all bounds that matter are of single precision, 2: of double precision
    exact = 1 if largest <= SINGLE else 2
    gain = F.round("x", 9) if exact == 2 else F.col("x") + F.col("slack") + DIGITS
    bounds = cut(every.join(_gains(every, distinct, right, [], exact == 1), "pos").select("pos", "v", "seen", gain.alias("gain")))
    picks: list[tuple[int, np.ndarray]] = []
    known: dict[int, float] = {}
    passes, end = 1, min(budget, total)
    free_of = lambda df: df.where(~F.col("pos").isin([p for p, _ in picks]))
    while len(picks) < end:
        left = free_of(bounds)
        if known:
            fresh = pool.sparkSession.createDataFrame(list(known.items()), "pos long, now double")  # a batch a pass
            left = left.join(F.broadcast(fresh), "pos", "left").select("pos", "v", "seen", F.least("gain", "now").alias("gain"))
        found = left.orderBy(F.desc("gain"), F.asc("pos")).limit(batch + 1).collect()
        rest = (found[batch]["gain"], -found[batch]["pos"]) if len(found) > batch else (-np.inf, 0)
        found, before = found[:batch], len(picks)
        own, after = _paired_gains(right, np.array([r["v"] for r in found]).reshape(len(found), dims), [v for _, v in picks])
        passes += 1
        if own.max(initial=0.0) <= 0 and rest[0] <= 0:
            break
        free, upper, lower = np.ones(len(found), bool), own.copy(), own.copy()
        while free.any() and len(picks) < end:
            order = sorted(np.flatnonzero(free).tolist(), key=lambda c: (-lower[c], found[c]["pos"]))
            best = order[0]
            key = lambda c, x: (x[c], -found[c]["pos"])
            if lower[best] <= 0 or key(best, lower) < rest or any(key(c, upper) > key(best, lower) for c in order[1:]):
                break
            free[best] = False
            picks.append((found[best]["pos"], np.array(found[best]["v"])))
            lost = own - after[:, best]
            upper, lower = np.minimum(upper, after[:, best]), lower - lost
            if (~free).sum() == 1:
                lower = upper.copy()  # after one pick both are the gain itself
            upper, lower = np.round(upper, 9), np.round(lower, 9)
        known.update((found[c]["pos"], float(upper[c])) for c in np.flatnonzero(free).tolist())
        exact = 0 if len(picks) > before else exact
        if len(picks) == end or len(picks) > before + 1 or exact == 2:
            continue  # after more than one pick the lower bounds are poor
        reach = free_of(left).where(F.col("gain") >= float(lower[free].max(initial=0.0)))
        count, oldest = reach.agg(F.count(F.lit(1)), F.min("seen")).first()
        if count > batch:
            exact, passes, known = 1 if not exact and largest <= SINGLE else 2, passes + 1, {}
            now = _gains(reach.select("pos", "v", "seen"), count, right, [v for _, v in picks], exact == 1, oldest if exact == 1 else None)
            gain = F.round("x", 9) if exact == 2 else F.least(F.col("gain"), F.col("gain") - F.col("x") + F.col("slack") + DIGITS)
            renewed = F.col("x").isNotNull()
            both = free_of(bounds).join(now, "pos", "left")
            bounds = cut(both.select("pos", "v", F.when(renewed, len(picks)).otherwise(F.col("seen")).alias("seen"), F.when(renewed, gain).otherwise(F.col("gain")).alias("gain")))
    if len(picks) < end:  # nothing gains any more, copies of picks neither
        more = free_of(pool).select("pos", "v").orderBy("pos").limit(end - len(picks)).collect()
        picks += [(r["pos"], np.array(r["v"])) for r in more]
    values = _gains_in_order(right, [v for _, v in picks])
    return [(p, x) for (p, _), x in zip(picks, values, strict=True)], passes + 1


@dataclass
class PoolBlocks:
    """A pool in `number` blocks: r_block, r_v: the vectors, behind each its cap and its number of copies."""

    blocks: DataFrame
    number: int
    dims: int


def _some_rows(block: bytes, dims: int) -> Iterator[np.ndarray]:
    y = np.frombuffer(block).reshape(-1, dims + 2)
    return (y[at : at + WIDE] for at in range(0, len(y), WIDE))


def _block_size(count: int, dims: int, groups: int) -> int:
    """Rows of a block, so that there are `groups` of them, fewer of few rows and more where a block would be too large."""
    from .neighbours import GROUP

    return min(max(1, GROUP // max(1, dims)), max(LEAST, -(-count // groups)))


def _pool_blocks(rows: DataFrame, count: int, dims: int, eta: float) -> PoolBlocks:
    from .neighbours import ASKED
    from .similarity import _packed

    size = _block_size(count, dims, ASKED)
    some = rows.where("cap > 0").withColumn("v", F.concat("v", F.array(F.lit(eta) * F.col("cap"), F.col("n").cast("double"))))  # others add nothing
    return PoolBlocks(cut(_packed(some, "pos", "v", "r", size, count)), -(-count // size), dims)


def _gains(candidates: DataFrame, count: int, right: PoolBlocks, had: list[np.ndarray], single: bool, oldest: int | None = None) -> DataFrame:
    """(pos, x, slack, looked) of each of the `count` candidates (pos, v, seen) over the pool's blocks after the picks `had`. x: its gain or, where `oldest` is
    the least `seen`, what the picks after its first `seen` took from its gain; slack: how far off x is at most in single precision; looked: how many pool
    rows were compared. Both sides lie in a few blocks, and each meets each in a task of its own, so a row is copied once for each block of the other side."""
    from .neighbours import ASKING
    from .similarity import _packed

    size, dims = _block_size(count, right.dims, ASKING), right.dims
    asking, kind = -(-count // size), np.float32 if single else np.float64
    left = _packed(candidates.withColumn("v", F.concat("v", F.array(F.col("seen").cast("double")))), "pos", "v", "l", size, count, kind)

    def counts(y: np.ndarray, seen: int) -> tuple[np.ndarray, np.ndarray]:
        """The similarities between which pool rows count for candidates that have `seen` picks."""
        now = _capped(y, had)
        return (now, y[:, -2]) if oldest is None else (_capped(y, had[:seen]), now)

    def touched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for number, block in zip(pdf["r_block"], pdf["r_v"], strict=True):
                kept = [y[np.less(*counts(y, oldest or 0))].tobytes() for y in _some_rows(block, dims)]
                yield pd.DataFrame({"r_block": [number], "r_v": [b"".join(kept)]})

    def add(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"pos": [], "x": [], "slack": [], "looked": []})
        ids = np.frombuffer(a["l_ids"].iloc[0], np.int64)
        x = np.frombuffer(a["l_v"].iloc[0], kind).reshape(len(ids), -1)
        order = np.argsort(x[:, -1], kind="stable")
        ids, x, seen = ids[order], x[order, :-1], x[order, -1].astype(int)
        length = np.linalg.norm(x, axis=1).astype(np.float64)
        starts = np.flatnonzero(np.append(True, seen[1:] != seen[:-1])) if oldest is not None else np.zeros(1, int)
        spans = list(zip(seen[starts].tolist(), starts.tolist(), np.append(starts[1:], len(ids)).tolist(), strict=True))
        gain, slack, looked = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for y in _some_rows(b["r_v"].iloc[0], dims):
            for since, start, end in spans:
                low, high = counts(y, since)
                use = low < high
                n = y[use, -1]
                w, low, high = y[use, :-2] * n[:, None], (low[use] * n).astype(kind), (high[use] * n).astype(kind)
                if single:
                    slack[start:end] += ROUNDING * ((dims + 8) * np.linalg.norm(w, axis=1).sum() * length[start:end] + 32 * high.sum(dtype=np.float64)) + 1e-30
                looked[start:end] += len(n)
                w = w.astype(kind).T
                for i in range(start, end if len(n) else start, TALL):
                    j = min(i + TALL, end)
                    s = x[i:j] @ w
                    np.minimum(s, high, out=s)
                    s -= low
                    gain[i:j] += np.maximum(s, 0, out=s).sum(1)
        return pd.DataFrame({"pos": ids, "x": gain, "slack": slack, "looked": looked})

    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = lambda df: df.repartition(asking * right.number, "l_block", "r_block").groupBy("l_block", "r_block")
    asked = right.blocks.select("r_block", "r_v").mapInPandas(touched, "r_block long, r_v binary")
    met = dealt(left.withColumn("r_block", numbers(right.number))).cogroup(dealt(asked.withColumn("l_block", numbers(asking))))
    found = met.applyInPandas(add, "pos long, x double, slack double, looked long")
    return found.groupBy("pos").agg(*(F.sum(c).alias(c) for c in ("x", "slack", "looked")))


def _capped(y: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """What each row of a pool's block has already: its best similarity to the picks, up to its cap."""
    return np.minimum(np.maximum((y[:, :-2] @ np.array(others).T).max(1), 0.0), y[:, -2]) if others else np.zeros(len(y))


def _paired_gains(pool: PoolBlocks, c: np.ndarray, had: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gains of the candidates c, and after[a, b], the gain of a once b is picked too: a row adds the part of its gain from a that
    exceeds its gain from b."""
    k, dims = len(c), pool.dims

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, after = np.zeros(k), np.zeros((k, k))
        for pdf in parts:
            for y in (y for block in pdf["r_v"] for y in _some_rows(block, dims)):
                gain = np.maximum(np.minimum(y[:, :-2] @ c.T, y[:, -2:-1]) - _capped(y, had)[:, None], 0.0) * y[:, -1:]
                own += gain.sum(0)
                after += np.maximum(gain[:, :, None] - gain[:, None, :], 0.0).sum(0)
        a, b = np.indices((k, k))
        yield pd.DataFrame({"a": np.append(a.ravel(), np.arange(k)), "b": np.append(b.ravel(), np.full(k, -1)), "x": np.append(after.ravel(), own)})

    own, after = np.zeros(k), np.zeros((k, k))
    for a, b, x in pool.blocks.select("r_v").mapInPandas(add, "a int, b int, x double").groupBy("a", "b").agg(F.sum("x")).collect():
        if b < 0:
            own[a] = round(x, 9)
        else:
            after[a, b] = round(x, 9)
    return own, after


def _gains_in_order(pool: PoolBlocks, picks: list[np.ndarray]) -> list[float]:
    """What each pick adds to those before it."""
    dims = pool.dims

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(picks))
        for pdf in parts:
            for y in (y for block in pdf["r_v"] for y in _some_rows(block, dims)):
                best = np.maximum.accumulate(np.minimum(np.maximum(y[:, :-2] @ np.array(picks).T, 0.0), y[:, -2:-1]), axis=1)
                total += (np.diff(best, axis=1, prepend=0.0) * y[:, -1:]).sum(0)
        yield pd.DataFrame({"k": np.arange(len(picks)), "gain": total})

    found = dict(pool.blocks.select("r_v").mapInPandas(add, "k int, gain double").groupBy("k").agg(F.round(F.sum("gain"), 9)).collect())
    return [found.get(k, 0.0) for k in range(len(picks))]
