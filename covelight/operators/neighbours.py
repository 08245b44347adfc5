"""Exact nearest neighbours by clipped cosine, with cells of rows left out that cannot hold one.

Equal vectors are looked up once: of each distinct vector only its k + 1 lowest rows can be anybody's neighbours. Rows go to
the nearest of a bounded number of pivots, drawn and then moved to the mean of their rows; a pivot's cell is cut into blocks of about BLOCK rows by hash. Each block is
compared with itself first, which gives every row a similarity that its k-th neighbour at least has; where a block has too few rows, the balls
around give it. A cell whose ball
about its pivot lies farther away than that is left out.

Blocks are dealt into ASKING groups of rows that ask and ASKED groups that are asked, more of them only where a group would exceed
GROUP numbers; a task meets one of each. So a row is copied once for each group that it needs, not for each block, and below
ASKED * GROUP numbers the shuffle grows as the input. In a task single-precision products with a bound of their error find what may be
among a row's best; only those are computed in double precision.

On data without clusters, in many dimensions, hardly a cell can be left out and the work is that of all pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.scoring import mean_vector

#: Rows in a block; pivots at most, whose vectors every task holds.
BLOCK, PIVOTS = 2048, 4096
#: Pivots for each block's worth of rows: smaller cells are left out more often.
DENSER = 4
#: What cosines may be wrong by.
MARGIN = 1e-7
#: What two products of the same rows may differ by at thirteen digits.
ROUNDING = 1e-12
#: Groups that ask and that are asked, at least; numbers in a group's vectors, about (64 MB).
ASKING, ASKED, GROUP = 16, 8, 1 << 23
#: Rows that ask at a time in a task.
CHUNK = 4096

_BLOCK = "cell int, part int, ids binary, v binary, least binary, widest double, shortest double, n long"
_ASK = "asking int, asked int, cell int, part int, ids binary, v binary, least binary, pairs long"
_BEST = "cell int, part int, i binary, j binary, sim binary"


def _matrix(rows: pd.Series, n: int) -> np.ndarray:
    return np.array(rows.tolist(), np.float64).reshape(n, -1)


def _directions(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Clipped products at thirteen digits, so equal rows tie wherever they stand in a matrix."""
    return np.maximum(np.round(x @ y.T, 13), 0.0)


def _first(i: np.ndarray, j: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each i are, by i, falling similarity and j."""
    order = np.lexsort((j, -sim, i))
    by = i[order]
    starts = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    return order[np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by)))) < k]


def _best(x: np.ndarray, least: np.ndarray, need: np.ndarray, blocks: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, j, similarity) of the k best that reach `least`, over the blocks (number of the cell, ids, vectors) whose cell a row
    needs. Single precision leaves out what is surely too little; ties go to the lower j."""
    at, j, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor, x32 = least - ROUNDING, x.astype(np.float32)  # `least` comes from another product
    slack = (x.shape[1] + 8) * 1.2e-7 * max(float(np.linalg.norm(x, axis=1).max(initial=0.0)), 1e-30)
    new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        nonlocal at, j, sim
        if new:
            at, j, sim = (np.concatenate([old, *(n[c] for n in new)]) for c, old in enumerate((at, j, sim)))
            keep = sim >= floor[at]
            at, j, sim = at[keep], j[keep], sim[keep]
            if len(at):
                top = _first(at, j, sim, k)
                at, j, sim = at[top], j[top], sim[top]
                full = np.flatnonzero(np.bincount(at, minlength=len(x)) == k)
                worst = np.full(len(x), np.inf)
                np.minimum.at(worst, at, sim)
                floor[full] = np.maximum(floor[full], worst[full])
            new.clear()

    for cell, ids, y in blocks:
        rows = np.flatnonzero(need[:, cell])
        if not len(rows):
            continue
        own = x32 if len(rows) == len(x) else x32[rows]
        bound = (floor[rows] - slack * max(1.0, float(np.linalg.norm(y, axis=1).max()))).astype(np.float32)
        bound = np.where(bound > 0, np.nextafter(bound, np.float32(0)), np.float32(-np.inf))  # all are 0 at least
        near = own @ y.astype(np.float32).T >= bound[:, None]
        r, c = np.divmod(np.flatnonzero(near.ravel()), len(ids))
        for a in range(0, len(r), 1 << 18):
            p, q = rows[r[a : a + (1 << 18)]], c[a : a + (1 << 18)]
            new.append((p, ids[q], np.maximum(np.round(np.einsum("ij,ij->i", x[p], y[q]), 13), 0.0)))
        if sum(len(n[0]) for n in new) > 3 * k * len(x):
            settle()
    settle()
    return at, j, sim


@dataclass
class Search:
    """blocks: each block with its rows' least similarities, and the groups it is in; asks: rows that a group has to be compared
    with, dealt to pairs of groups; needs: which cells a row needs."""

    blocks: DataFrame
    asks: DataFrame
    distinct: DataFrame
    k: int
    groups: tuple[int, int]
    needs: Callable[..., np.ndarray]

    def pairs(self) -> int:
        """Row pairs that are compared."""
        return self.asks.agg(F.sum("pairs")).first()[0] or 0


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with cell, the pivot of the nearest direction."""
    width = rows.schema["v"].dataType.simpleString()

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                yield pdf.assign(cell=np.round(_directions(_matrix(pdf["v"], len(pdf))) @ pivots.T, 12).argmax(1).astype(np.int32))

    return rows.mapInPandas(place, f"pos long, v {width}, cell int")


def search(rows: DataFrame, k: int, block: int = BLOCK, most_pivots: int = PIVOTS) -> Search:
    """Finds which comparisons the k nearest neighbours of rows (pos, v) need. Null vectors have no neighbours."""
    rows = rows.where("v is not null").select(F.col("pos").cast("long").alias("pos"), F.col("v").cast("array<double>").alias("v"))
    lowest = Window.partitionBy("v").orderBy("pos")
    distinct = cut(rows.withColumn("copy", F.row_number().over(lowest)).where(F.col("copy") <= k + 1).drop("copy"))
    n = distinct.count()
    wanted = min(most_pivots, DENSER * -(-n // block)) if n > block else 1
    drawn = distinct.select("v", F.xxhash64("pos").alias("h"), "pos").orderBy("h", "pos").limit(wanted).collect()
    pivots = _directions(np.array([r["v"] for r in drawn], np.float64).reshape(len(drawn), -1)) if drawn else np.zeros((1, 1))
    if wanted > 1:  # a pivot amid its rows has a narrower ball about it
        for cell, mean in mean_vector(_cells(distinct, pivots), ["cell"], "v", "mean").select("cell", "mean").collect():
            pivots[cell] = np.round(_directions(np.array([mean])), 12)
    placed = cut(_cells(distinct, pivots))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))  # a row a pivot at most
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("pos"), "parts").cast("int")).drop("parts")
    tasks = min(ASKING * ASKED, wanted)  # a stated number: rows are few bytes beside the work on them

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        v, ids, cell = _matrix(pdf["v"], len(pdf)), pdf["pos"].to_numpy(np.int64), int(pdf["cell"].iloc[0])
        sim = _similar(v, v)
        least = np.partition(sim, -(k + 1), axis=1)[:, -(k + 1)] if len(v) > k else np.full(len(v), -1.0)
        widest = float((_directions(v) @ pivots[cell]).min())  # the cosine of the widest angle to the pivot
        return pd.DataFrame({"cell": [cell], "part": [int(pdf["part"].iloc[0])], "ids": [ids.tobytes()], "v": [v.tobytes()], "least": [least.tobytes()], "widest": [widest], "shortest": [float(np.linalg.norm(v, axis=1).min())], "n": [len(v)]})

    blocks = cut(dealt.repartition(tasks, "cell", "part").groupBy("cell", "part").applyInPandas(pack, _BLOCK))
    # a row a pivot: the widest angle, the shortest vector, rows and parts of each cell
    width, shortest, sizes_, numbers = np.full(len(pivots), np.nan), np.zeros(len(pivots)), np.zeros(len(pivots), int), np.zeros(len(pivots), int)
    for cell, *found in blocks.groupBy("cell").agg(F.min("widest"), F.min("shortest"), F.sum("n"), F.max("part") + 1).collect():
        width[cell], shortest[cell], sizes_[cell], numbers[cell] = found

    def reached(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        """For rows of small blocks: a similarity that k + 1 rows have at least, from the far ends of the nearest balls."""
        far = c * width - np.sqrt((1 - c * c) * np.maximum(1 - width * width, 0))  # the cosine of the sum of both angles
        far = np.where(np.isnan(width) | (c < 0) | (far < 0) | (c + width <= 0), 0.0, far * shortest * np.linalg.norm(v, axis=1, keepdims=True))
        order = np.argsort(-far, axis=1, kind="stable")
        enough = (np.cumsum(sizes_[order], axis=1) > k).argmax(1)
        return np.where(sizes_.sum() > k, np.take_along_axis(far, order, 1)[np.arange(len(v)), enough] - MARGIN, -1.0)

    # groups of consecutive blocks of about as many rows; a cell of many parts lies in several
    total, dims = int(sizes_.sum()), pivots.shape[1]
    asking, asked = (max(1, min(few, int(numbers.sum())), -(-total * dims // GROUP)) for few in (ASKING, ASKED))
    before = np.cumsum(sizes_) - sizes_

    def group(cell, part, count: int):
        return ((before[cell] + part * sizes_[cell] // np.maximum(numbers[cell], 1)) * count // max(total, 1)).astype(int)

    cells = np.repeat(np.arange(len(pivots)), numbers)
    parts_ = np.arange(len(cells)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
    member = np.zeros((len(pivots), asked), np.float32)  # the share of a cell's rows in each group, about
    np.add.at(member, (cells, group(cells, parts_, asked)), 1.0)
    member *= (sizes_ / np.maximum(numbers, 1))[:, None]

    def needs(v: np.ndarray, least: np.ndarray, which: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Which cells can hold a row's k nearest."""
        c, w = np.clip(_directions(v) @ pivots[which].T, -1, 1), width[which]
        # the cosine of (angle to the pivot - the cell's widest angle); 1 inside the ball
        reach = np.where(c >= w, 1.0, c * w + np.sqrt((1 - c * c) * np.maximum(1 - w * w, 0)))
        return ~np.isnan(w) & (np.maximum(reach, 0.0) + MARGIN >= least[:, None])

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for b in pdf.itertuples():
                ids, least = np.frombuffer(b.ids, np.int64), np.frombuffer(b.least)
                v = np.frombuffer(b.v).reshape(len(ids), -1)
                if len(v) <= k:
                    least = reached(v, np.clip(_directions(v) @ pivots.T, -1, 1))
                met = needs(v, least).astype(np.float32) @ member
                for g in np.flatnonzero(met.any(0)).tolist():
                    rows_ = np.flatnonzero(met[:, g])
                    yield pd.DataFrame({"asking": [int(group(b.cell, b.part, asking))], "asked": [g], "cell": [b.cell], "part": [b.part], "ids": [ids[rows_].tobytes()], "v": [v[rows_].tobytes()], "least": [least[rows_].tobytes()], "pairs": [round(float(met[:, g].sum(dtype=np.float64)))]})

    @F.pandas_udf("int")
    def asked_group(cell: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series(group(cell.to_numpy(), part.to_numpy(), asked))

    return Search(blocks.withColumn("asked", asked_group("cell", "part")), blocks.mapInPandas(ask, _ASK), distinct, k, (asking, asked), needs)


def _compared(found: Search) -> DataFrame:
    """(cell, part, i, j, sim): the k + 1 best of each block's rows in each group that they ask; a row is its own neighbour too."""
    k, needs = found.k + 1, found.needs

    def meet(asks: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(blocks):
            return pd.DataFrame({"cell": [], "part": [], "i": [], "j": [], "sim": []})
        cells, number = np.unique(blocks["cell"].to_numpy(), return_inverse=True)
        held = [(n, np.frombuffer(b.ids, np.int64), np.frombuffer(b.v)) for n, b in zip(number.tolist(), blocks.itertuples(), strict=True)]
        held = [(n, ids, v.reshape(len(ids), -1)) for n, ids, v in held]
        lengths = asks["ids"].map(len).to_numpy() // 8
        out, a = [], 0
        while a < len(asks):
            b = a + max(1, int(np.searchsorted(np.cumsum(lengths[a:]), CHUNK, "right")))
            part = asks.iloc[a:b]
            ids, least = np.frombuffer(b"".join(part["ids"]), np.int64), np.frombuffer(b"".join(part["least"]))
            x = np.frombuffer(b"".join(part["v"])).reshape(len(ids), -1)
            at, j, sim = _best(x, least, needs(x, least, cells), held, k)
            of = np.repeat(np.arange(a, b), lengths[a:b])[at]  # ascends, as `at` does
            for n, (s, e) in enumerate(zip(np.searchsorted(of, np.arange(a, b)), np.searchsorted(of, np.arange(a, b), "right"), strict=True)):
                row = part.iloc[n]
                out.append((row["cell"], row["part"], ids[at[s:e]].tobytes(), j[s:e].tobytes(), sim[s:e].tobytes()))
            a = b
        return pd.DataFrame(out, columns=["cell", "part", "i", "j", "sim"])

    asking, asked = found.groups
    copies = found.blocks.select(F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("asking"), "asked", "cell", "part", "ids", "v")
    dealt = lambda df: df.repartition(asking * asked, "asking", "asked").groupBy("asking", "asked")
    return dealt(found.asks.drop("pairs")).cogroup(dealt(copies)).applyInPandas(meet, _BEST)


def neighbour_lists(rows: DataFrame, k: int, block: int = BLOCK, most_pivots: int = PIVOTS) -> DataFrame:
    """(i, best): for each row of rows (pos, v) its k other rows of largest clipped cosine as (d, j), d = - similarity, in order."""
    rows = rows.select("pos", F.col("v").cast("array<double>").alias("v"))
    found = search(rows, k, block, most_pivots)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, sim = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("i", np.int64), ("j", np.int64), ("sim", np.float64)))
        top = _first(i, j, sim, k + 1)
        i, j, sim = i[top], j[top], sim[top]
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
        return pd.DataFrame({"i": i[starts], "d": np.split(-sim, starts[1:]) if len(i) else [], "j": np.split(j, starts[1:]) if len(i) else []})

    lists = _compared(found).groupBy("cell", "part").applyInPandas(merge, "i long, d array<double>, j array<long>")  # k + 1 a row
    lists = lists.select("i", F.arrays_zip("d", "j").alias("best"))
    # each distinct vector's list, from its lowest row, to all rows of that vector
    of = found.distinct.groupBy("v").agg(F.min("pos").alias("i"))
    named = lists.join(of, "i").select("v", "best")
    return rows.where("v is not null").join(named.hint("merge"), "v").select(F.col("pos").alias("i"), F.slice(F.filter("best", lambda b: b["j"] != F.col("pos")), 1, k).alias("best"))


def nearest(rows: DataFrame, k: int, key: str = "pos", vector: str = "v", block: int = BLOCK, most_pivots: int = PIVOTS) -> DataFrame:
    """(i, j, sim, rank): for each row its k other rows of largest clipped cosine, ties by lower j; vectors are of length 1 at most.
    Fewer other rows give fewer neighbours; rows without a vector give and get none."""
    every = neighbour_lists(rows.select(F.col(key).alias("pos"), F.col(vector).alias("v")), k, block, most_pivots)
    return every.select("i", F.posexplode("best").alias("rank", "b")).select("i", F.col("b.j").alias("j"), (-F.col("b.d")).alias("sim"), (F.col("rank") + 1).alias("rank"))
