"""k-means with several starts, and the selectors on it, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covelight.operators import clustering
from covelight.operators.kmeans import DIGITS, kmeans, squared_distances, uniforms


def blobs(seed, n, k, d, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d)) * 2
    v = centres[rng.integers(0, k, n)] + rng.normal(size=(n, d)) * spread
    return v, np.round(rng.uniform(0.2, 3, n), 3)


def frame(spark, v, w):
    return spark.createDataFrame([(i, x.tolist(), float(y)) for i, (x, y) in enumerate(zip(v, w, strict=True))], "pos long, v array<double>, weight double")


def plain(v, w, k, starts=10, seed=0):
    """The best inertia of plain weighted k-means++ starts, each moved until it stands still."""
    best = np.inf
    for s in range(starts):
        rng = np.random.default_rng(seed + s)
        c = v[[rng.choice(len(v), p=w / w.sum())]]
        while len(c) < k:
            odds = w * ((v[:, None] - c) ** 2).sum(2).min(1)
            c = np.vstack([c, v[rng.choice(len(v), p=odds / odds.sum())]])
        for _ in range(300):
            label = ((v[:, None] - c) ** 2).sum(2).argmin(1)
            new = np.array([np.average(v[label == j], axis=0, weights=w[label == j]) if (label == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c, atol=1e-12):
                break
            c = new
        best = min(best, (w * ((v[:, None] - c) ** 2).sum(2).min(1)).sum())
    return best


@pytest.mark.parametrize("seed, n, k, d", [(1, 300, 5, 4), (2, 240, 8, 3), (3, 150, 4, 6)])
def test_inertia_is_no_worse_than_the_best_of_ten_plain_starts(spark, seed, n, k, d):
    v, w = blobs(seed, n, k, d, 0.4)
    got = kmeans(frame(spark, v, w), k)
    assert got.inertia == min(got.inertias) and len(got.inertias) == 10
    assert got.inertia == pytest.approx((w * ((v[:, None] - got.centres) ** 2).sum(2).min(1)).sum(), rel=1e-8)
    assert got.inertia <= plain(v, w, k) * (1 + 1e-4)


def test_the_result_does_not_depend_on_partitions_or_their_order(spark):
    v, w = blobs(4, 200, 6, 3, 0.8)
    df = frame(spark, v, w)
    a, b = kmeans(df.repartition(7), 6, starts=3), kmeans(df.orderBy(F.desc("pos")).coalesce(1), 6, starts=3)
    assert np.allclose(a.centres, b.centres, atol=1e-9) and a.start == b.start and a.inertias == b.inertias
    assert not np.allclose(a.centres, kmeans(df, 6, starts=3, seed=7).centres) or a.inertia > 0


def test_moves_end_where_every_centre_is_its_rows_mean(spark):
    v, w = blobs(5, 200, 5, 3)
    c = kmeans(frame(spark, v, w), 5, tolerance=0.0).centres
    label = squared_distances(v, c).argmin(1)
    for j in range(5):
        assert np.allclose(c[j], np.average(v[label == j], axis=0, weights=w[label == j]), atol=1e-9)


def test_few_distinct_rows_null_vectors_and_weights_of_zero(spark):
    rows = [(i, [float(i % 2), 0.0], 1.0) for i in range(20)] + [(50, None, 1.0), (51, [9.0, 9.0], 0.0)]
    got = kmeans(spark.createDataFrame(rows, "pos long, v array<double>, weight double"), 4)
    assert sorted(got.centres.tolist()) == [[0.0, 0.0], [1.0, 0.0]] and got.inertia == 0.0
    with pytest.raises(ValueError):
        kmeans(spark.createDataFrame([], "pos long, v array<double>, weight double"), 2)


def test_draws_follow_the_weights():
    pos = np.arange(100_000)
    u = uniforms(pos, 2025, 3, 1)
    assert 0 < u.min() and u.max() <= 1 and abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002
    assert abs(np.corrcoef(u, uniforms(pos, 2025, 4, 1))[0, 1]) < 0.01
    wins = (-np.log(u[::2]) / 3 < -np.log(u[1::2])).mean()  # a row of three times the weight wins three races of four
    assert abs(wins - 0.75) < 0.01


def scale(x):
    return np.zeros(len(x)) if np.ptp(x) < 1e-12 else (x - x.min()) / np.ptp(x)


def fill(chosen, w, budget):
    return (chosen + [int(i) for i in np.argsort(-w, kind="mergesort") if i not in chosen])[:budget]


def nearest_free(v, centres, order):
    chosen = []
    for c in centres:
        d = np.round(((v - c) ** 2).sum(1), DIGITS)
        chosen.append(next(int(i) for i in sorted(range(len(v)), key=lambda i: (d[i], order[i])) if i not in chosen))
    return chosen


@pytest.fixture(scope="module")
def weighed(spark):
    v, w = blobs(6, 120, 6, 5, 0.5)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, w, frame(spark, v, w)


def picks(df):
    return [r["pos"] for r in df.orderBy("rank").collect()]


def test_source_clusters_are_the_nearest_centres(weighed):
    v, _, df = weighed
    c = kmeans(df.withColumn("weight", F.lit(1.0)), 6).centres
    got = {r["pos"]: r["cluster"] for r in clustering.source_clusters(df, 6).collect()}
    assert got == dict(enumerate(squared_distances(v, c).argmin(1).tolist())) and len(set(got.values())) == 6
    assert {r["cluster"] for r in clustering.source_clusters(df.where("pos = 1"), 5).collect()} == {0}


@pytest.mark.parametrize("budget", [4, 7])
def test_weighted_support(weighed, budget):
    v, w, df = weighed
    c = kmeans(df, budget).centres
    label, chosen = squared_distances(v, c).argmin(1), []
    for j in range(budget):
        priority = 0.7 * (1 - scale(np.linalg.norm(v - c[j], axis=1))) + 0.3 * scale(w)
        chosen.append(next(int(i) for i in np.argsort(-priority, kind="mergesort") if label[i] == j))
    assert picks(clustering.weighted_support(df, budget)) == fill(chosen, w, budget)


@pytest.mark.parametrize("budget", [4, 7])
def test_uncertainty_clusters(weighed, budget):
    v, w, df = weighed
    c = kmeans(df.withColumn("weight", F.col("weight") / float(w.sum() + 1e-8) * len(w)), budget).centres
    assert picks(clustering.uncertainty_clusters(df, budget)) == fill(nearest_free(v, c, range(len(v))), w, budget)


@pytest.mark.parametrize("budget", [4, 7])
def test_inconsistent_clusters(weighed, budget):
    v, w, df = weighed
    near = np.argsort(w, kind="mergesort")[-5 * budget :]
    c = kmeans(df.where(F.col("pos").isin(near.tolist())).withColumn("weight", F.lit(1.0)), budget).centres
    chosen = [int(near[i]) for i in nearest_free(v[near], c, range(len(near)))]
    assert picks(clustering.inconsistent_clusters(df, budget, 4)) == fill(chosen, w, budget)


def test_selectors_fill_up_where_rows_repeat(spark):
    df = frame(spark, np.array([[1.0, 0.0]] * 5 + [[0.0, 1.0]] * 3), np.arange(8.0) + 1)
    assert sorted(picks(clustering.weighted_support(df, 4))) == [4, 5, 6, 7]


@pytest.mark.parametrize("select", [clustering.weighted_support, clustering.uncertainty_clusters, clustering.inconsistent_clusters])
def test_selectors_work_their_rows_out_once(spark, select):
    v, w = blobs(9, 40, 3, 3, 0.5)
    worked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def weigh(x):
        worked.add(1)
        return x

    df = frame(spark, v, w).withColumn("weight", weigh("weight"))
    select(df, 3).count()
    assert worked.value <= 2 * len(v)


def test_rows_of_one_partition_are_dealt_to_all_cores(spark):
    from covelight.operators import kmeans as module

    v, w = blobs(10, 400, 3, 3)
    packed = module._packed(frame(spark, v, w).coalesce(1))
    assert packed.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert packed.count() > 1


def test_moves_read_rows_held_in_memory(spark, monkeypatch):
    """However many moves: no query more is planned, and nothing stays held."""
    from covelight.operators import kmeans as module

    v = np.random.default_rng(4).normal(size=(300, 3))
    rows = frame(spark, v, np.ones(300))
    planned, old = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, *a, **k: (planned.append(1), old(self, *a, **k))[1])
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    counts = []
    for moves in (2, 12):
        planned.clear()
        assert module.kmeans(rows, 4, starts=2, moves=moves, tolerance=0.0).moves <= moves
        counts.append(len(planned))
    assert counts[0] == counts[1]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_sums_by_parts_of_a_matrix(spark, monkeypatch):
    """Sets of unequal sizes, distances worked out for two rows at a time: sums and inertia of a plain version."""
    from covelight.operators import kmeans as module

    rng = np.random.default_rng(9)
    v, w = rng.normal(size=(37, 3)), rng.uniform(0.1, 2.0, 37)
    sets = [rng.normal(size=(4, 3)), rng.normal(size=(2, 3)), rng.normal(size=(5, 3))]
    monkeypatch.setattr(module, "DISTANCES", 22)
    held = module._held(module._packed(frame(spark, v, w)))
    for vectors in (True, False):
        for c, (sums, inertia) in zip(sets, module._sums(held, sets, vectors), strict=True):
            d = ((v[:, None] - c[None]) ** 2).sum(2)
            label = d.argmin(1)
            whole = np.array([[*((v[label == i] * w[label == i, None]).sum(0) if vectors else ()), w[label == i].sum()] for i in range(len(c))])
            np.testing.assert_allclose(sums, whole, atol=1e-9)
            assert abs(inertia - (d.min(1) * w).sum()) < 1e-9
    held.unpersist()
