"""Pruned neighbours and quantiles by rank against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covelight.operators import neighbours, quantiles, similarity


def frame(spark, v, parts=4):
    return spark.createDataFrame([(i * 2, None if x is None else [float(y) for y in x]) for i, x in enumerate(v)], "pos long, v array<double>").repartition(parts)


def plain(v, k):
    v = np.array(v)
    sim = np.maximum(np.round(v @ v.T, 13), 0.0)
    out = {}
    for i in range(len(v)):
        others = [j for j in range(len(v)) if j != i]
        out[2 * i] = [(2 * j, round(float(sim[i, j]), 9)) for j in sorted(others, key=lambda j: (-sim[i, j], j))[:k]]
    return {i: x for i, x in out.items() if x}


def found(df, k, **more):
    out = {}
    for r in neighbours.nearest(df, k, **more).orderBy("i", "rank").collect():
        out.setdefault(r["i"], []).append((r["j"], round(r["sim"], 9)))
        assert r["rank"] == len(out[r["i"]])
    return out


def clustered(seed, n, groups, d, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, d))
    v = c[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("seed, k, block, pivots", [(1, 5, 2048, 4096), (2, 5, 20, 4096), (3, 3, 16, 4), (4, 40, 16, 8)])
@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_neighbours_are_those_of_brute_force(spark, seed, k, block, pivots, kind):
    v = clustered(seed, 160, 6, 8) if kind == "clusters" else clustered(seed, 160, 160, 5, 1.0)
    assert found(frame(spark, v), k, block=block, most_pivots=pivots) == plain(v, k)


def test_copies_short_vectors_zeros_and_nulls(spark):
    v = clustered(7, 60, 4, 6)
    v[10:35] = v[2]  # a group of copies larger than k
    v[40:44] = 0.0
    v[45] *= 0.3
    v[46] = -v[47]
    got = found(frame(spark, v), 4, block=8, most_pivots=5)
    assert got == plain(v, 4)
    assert [j for j, _ in got[60]] == [4, 20, 22, 24]  # a copy's neighbours are the lowest other copies
    assert found(frame(spark, [*v, None]), 4, block=8) == plain(v, 4)


def test_few_rows(spark):
    assert found(frame(spark, [[1.0, 0.0]]), 3) == {}
    assert found(frame(spark, [[1.0, 0.0], [0.0, 1.0]]), 3) == {0: [(2, 0.0)], 2: [(0, 0.0)]}
    assert neighbours.nearest(spark.createDataFrame([], "pos long, v array<double>"), 3).count() == 0


def test_pairs_grow_far_slower_than_the_square_on_clusters(spark):
    counts = []
    for n in (600, 2400):
        v = clustered(9, n, n // 30, 12, 0.02)
        counts.append(neighbours.search(frame(spark, v), 5, block=40).pairs())
        assert counts[-1] < 0.35 * n * n
    assert counts[1] < 6 * counts[0]  # all pairs would be 16 times as many


def test_noise_costs_no_more_than_all_pairs(spark):
    v = clustered(5, 400, 400, 16, 1.0)
    assert neighbours.search(frame(spark, v), 5, block=50).pairs() <= 400 * 400


def test_a_row_is_copied_once_a_group_not_once_a_block(spark):
    got = neighbours.search(frame(spark, clustered(6, 400, 400, 16, 1.0)), 5, block=10)
    copies = got.asks.agg(F.sum(F.length("ids") / 8)).first()[0]
    assert got.blocks.count() > 4 * neighbours.ASKED and 400 <= copies <= 400 * neighbours.ASKED


def test_single_precision_loses_no_neighbour(spark):
    rng = np.random.default_rng(8)
    v = np.array([1.0, 0, 0, 0]) + rng.normal(size=(120, 4)) * 1e-5  # similarities differ from the ninth digit on
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert found(frame(spark, v), 4, block=16) == plain(v, 4)
    floor = np.full(120, -1.0)
    at, j, sim = neighbours._best(v, floor, np.ones((120, 1), bool), [(0, np.arange(120), v)], 5)
    assert np.bincount(at).tolist() == [5] * 120 and (sim >= 1 - 1e-8).all()


@pytest.mark.parametrize("limit", [4096, 3])
def test_support_held_by_tasks_and_in_blocks_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(similarity, "SUPPORT", limit)
    v = clustered(3, 50, 5, 4)
    left, right = frame(spark, v), frame(spark, v[:9]).withColumn("weight", 1.0 + F.col("pos") % 3)
    sim = np.maximum(v @ v[:9].T, 0)
    want = {(2 * i, 2 * int(j), r + 1) for i in range(50) for r, j in enumerate(np.argsort(-sim[i], kind="stable")[:4])}
    assert {(r["i"], r["j"], r["rank"]) for r in similarity.top_similar(left, right, 4, block=7).collect()} == want
    w = 1.0 + np.arange(0, 18, 2) % 3
    raw = np.array([(sim[i][b] * w[b]).sum() / w[b].sum() for i, b in enumerate(np.argsort(-sim, axis=1, kind="stable")[:, :4])])
    got = similarity.query_match(left, right, 4).orderBy("pos").collect()
    assert [r["match_raw"] for r in got] == pytest.approx(raw.tolist())
    assert [r["match"] for r in got] == pytest.approx(((raw - raw.min()) / np.ptp(raw)).tolist())


def test_plans_against_a_support_have_no_shuffle_and_blocks_no_nested_loop(spark):
    v = frame(spark, clustered(1, 30, 3, 4))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spread, few = spark.createDataFrame(v.collect(), v.schema), v.limit(5)
    assert "Exchange" not in plan(similarity.top_similar(spread, few, 2)) and "Join" not in plan(similarity.top_similar(spread, few, 2))
    met = plan(similarity.blocks_met(similarity._packed(v, "pos", "v", "l", 10), similarity._packed(v, "pos", "v", "r", 10)))
    assert "NestedLoop" not in met and "Cartesian" not in met


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 40, list(range(101)), [0.5] * 50 + [-1.0, 9.0, 9.0], [-0.0, 0.0, 1e300, -1e300]])
def test_quantiles_are_linear_between_ranks(spark, values):
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double").repartition(5)
    fractions = [0.0, 0.1, 1 / 3, 0.5, 2 / 3, 0.99, 1.0]
    assert quantiles.quantiles(df, "x", fractions) == pytest.approx(np.quantile(values, fractions).tolist(), rel=1e-12)


def test_quantiles_of_many_random_values_and_of_none(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=5000), 2)
    df = spark.createDataFrame([(float(a),) for a in x], "x double").repartition(7)
    assert quantiles.quantiles(df, "x", [0.1, 0.25, 0.9]) == pytest.approx(np.quantile(x, [0.1, 0.25, 0.9]).tolist(), rel=1e-12)
    assert quantiles.ranked_values(df, "x", ranks=[0, 17, 4999, 5000]) == (5000, {0: x.min(), 17: np.sort(x)[17], 4999: x.max()})
    assert quantiles.quantiles(df.where("x > 1000"), "x", [0.5]) == [None]
