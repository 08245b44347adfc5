import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from covelight.operators import constraints, curation, greedy, grid, neighbours, ranking, reliability, similarity, subjects
from covelight.sources import files, sinks


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = np.maximum(v @ v[:7].T, 0)
    rows = [(i, v[i].tolist(), q[i].tolist(), float(i % 5)) for i in range(len(v))]
    return v, q, spark.createDataFrame(rows, "pos long, v array<double>, q array<double>, base double").repartition(5)


def brute_coverage(v, q, k, penalty):
    covered, red, chosen = np.zeros(q.shape[1]), np.zeros(len(v)), []
    for _ in range(k):
        value = np.maximum(q - covered, 0).sum(1) - penalty * red
        value[chosen] = -np.inf
        i = int(value.argmax())
        chosen.append(i)
        covered, red = np.maximum(covered, q[i]), np.maximum(red, v @ v[i])
    return chosen


@pytest.mark.parametrize("batch", [4, 1000])
def test_coverage_does_not_depend_on_the_batch(pool, batch):
    v, q, df = pool
    got = greedy.greedy(df, 20, greedy.Coverage(), batch=batch).orderBy("rank").collect()
    assert [r["pos"] for r in got] == brute_coverage(v, q, 20, 0.08)


@pytest.mark.parametrize("batch", [3, 1000])
def test_k_center(pool, batch):
    v, _, df = pool
    df = df.select("pos", "v")
    chosen = [0]
    while len(chosen) < 12:
        far = 1 - np.maximum((v @ v[chosen].T).max(1), -1)
        far[chosen] = -np.inf
        chosen.append(int(far.argmax()))
    assert [r["pos"] for r in greedy.greedy(df, 12, greedy.KCenter(), batch=batch).orderBy("rank").collect()] == chosen


def test_seeded_greedy_takes_seeds_first_and_fills_up(pool):
    v, _, df = pool
    got = [r["pos"] for r in greedy.greedy(df, 9, greedy.Redundancy(), [7, 7, 3, 999], batch=5).orderBy("rank").collect()]
    chosen = [7, 3]
    while len(chosen) < 9:
        value = np.arange(90) % 5 - 0.08 * np.maximum((v @ v[chosen].T).max(1), 0)
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
    assert got == chosen


def test_greedy_takes_all_of_a_small_pool(pool):
    assert greedy.coverage_greedy(pool[2].where("pos < 4"), 10).count() == 4
    assert greedy.coverage_greedy(pool[2].where("pos < 0"), 10).count() == 0


def plain_mutual_information(v, cap, k):
    kk, now, chosen, gains = np.maximum(v @ v.T, 0), np.zeros(len(v)), [], []
    for _ in range(k):
        gain = np.round((np.minimum(np.maximum(kk, now[:, None]), cap[:, None]) - np.minimum(now, cap)[:, None]).sum(0), 9)
        gain[chosen] = -np.inf
        chosen.append(int(gain.argmax()))
        gains.append(gain.max())
        now = np.maximum(now, kk[chosen[-1]])
    return chosen, gains


@pytest.mark.parametrize("batch", [3, 20, 1000])
def test_mutual_information(pool, batch):
    v, q, df = pool
    chosen, gains = plain_mutual_information(v, q.max(1), 12)
    got = greedy.mutual_information(df, 12, batch=batch).orderBy("rank").collect()
    assert [r["pos"] for r in got] == chosen
    assert [r["value"] for r in got] == pytest.approx(gains, abs=1e-7)


def test_mutual_information_of_copies_goes_by_position(spark, pool):
    v, q, _ = pool
    v, q = np.repeat(v[:8], 4, axis=0), np.repeat(q[:8], 4, axis=0)
    df = spark.createDataFrame([(i, v[i].tolist(), q[i].tolist()) for i in range(32)], "pos long, v array<double>, q array<double>").repartition(3)
    for batch in (2, 5, 64):
        assert [r["pos"] for r in greedy.mutual_information(df, 32, batch=batch).orderBy("rank").collect()] == plain_mutual_information(v, q.max(1), 32)[0]


def test_mutual_information_takes_less_than_a_pass_a_pick(pool):
    _, _, df = pool
    _, passes = greedy.lazy_mutual_information(df, 24)
    assert passes <= 0.7 * 24


def test_mutual_information_of_gains_close_together_takes_few_passes(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 24))  # after a pick every old gain is far above every new one
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = np.maximum(v @ v[:6].T, 0)
    df = spark.createDataFrame([(i, v[i].tolist(), q[i].tolist()) for i in range(300)], "pos long, v array<double>, q array<double>")
    chosen, passes = greedy.lazy_mutual_information(df, 5, batch=4)
    assert [p for p, _ in chosen] == plain_mutual_information(v, q.max(1), 5)[0] and passes <= 3 * 5 + 1


def test_mutual_information_looks_at_copies_once_and_then_at_rows_that_came_nearer(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = np.maximum(v @ v[:6].T, 0)
    copied = np.repeat(np.arange(300), 3)
    df = spark.createDataFrame([(i, v[j].tolist(), q[j].tolist()) for i, j in enumerate(copied)], "pos long, v array<double>, q array<double>").repartition(4)
    looked, gains = [], greedy._gains

    def counted(*args):
        found = gains(*args)
        looked.append(found.agg(F.sum("looked")).first()[0])
        return found

    monkeypatch.setattr(greedy, "_gains", counted)
    chosen, _ = greedy.lazy_mutual_information(df, 6, batch=4)
    want, values = plain_mutual_information(v[copied], q[copied].max(1), 6)
    assert [p for p, _ in chosen] == want and [x for _, x in chosen] == pytest.approx(values, abs=1e-7)
    assert looked[0] <= 300 * 300 and len(looked) >= 5 and sum(looked) <= 3 * 300 * 300  # six picks, and all pairs of rows are nine times 300 * 300


def test_mutual_information_of_copies_ends_where_nothing_gains(spark, pool):
    v, q, _ = pool
    v, q = np.repeat(v[:8], 40, axis=0), np.repeat(q[:8], 40, axis=0)
    df = spark.createDataFrame([(i, v[i].tolist(), q[i].tolist()) for i in range(320)], "pos long, v array<double>, q array<double>").repartition(3)
    chosen, passes = greedy.lazy_mutual_information(df, 100, batch=8)
    assert [p for p, _ in chosen] == plain_mutual_information(v, q.max(1), 100)[0] and passes <= 10


def test_mutual_information_of_gains_that_single_precision_cannot_tell_apart(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(60, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[20:] = v[0] + rng.normal(size=(40, 16)) * 1e-7  # their gains differ at the seventh digit
    q = np.maximum(v @ (v[:6] + 0.1).T, 0)
    df = spark.createDataFrame([(i, v[i].tolist(), q[i].tolist()) for i in range(60)], "pos long, v array<double>, q array<double>").repartition(3)
    for batch in (2, 5):
        assert [r["pos"] for r in greedy.mutual_information(df, 8, batch=batch).orderBy("rank").collect()] == plain_mutual_information(v, q.max(1), 8)[0]


def test_last_pick_scores_nothing(spark):
    order = spark.createDataFrame([(1, 5, 0.0), (2, 6, 0.0), (3, 7, 0.0)], "rank int, pos long, value double")
    got = {r["pos"]: r["facility"] for r in greedy.rank_scores(order, spark.createDataFrame([(i,) for i in range(4, 9)], "pos long")).collect()}
    assert got == {4: 0.0, 5: 1.0, 6: 0.5, 7: 0.0, 8: 0.0}


def test_blocks_do_not_change_neighbours(pool):
    v, _, df = pool
    sim = np.maximum(v @ v.T, 0)
    np.fill_diagonal(sim, -1)
    want = {(i, int(j)) for i in range(90) for j in np.argsort(-sim[i], kind="stable")[:5]}
    for block in (16, 2048):
        assert {(r["i"], r["j"]) for r in neighbours.nearest(df, 5, block=block).collect()} == want


def test_density_of_a_single_row_is_zero(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "pos long, v array<double>")
    assert similarity.source_density(df).collect()[0][1:] == (0.0, 0.0)


def test_missing_class_falls_back_to_the_mean(spark):
    s = spark.createDataFrame([(1, [1.0, 0.0], 2), (2, [0.0, 1.0], 0)], "pos long, v array<double>, bin int")
    t = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.8, 0.6], 1)], "pos long, v array<double>, bin int")
    got = {r["pos"]: r["margin_raw"] for r in similarity.prototype_margin(s, t).collect()}
    assert got[1] == pytest.approx(1.8 / np.hypot(1.8, 0.6), abs=1e-6)
    assert got[2] == pytest.approx(-0.6, abs=1e-6)


def test_ties_at_the_cut(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([2.0, 1.0, 1.0, 1.0, 0.0])], "pos long, x double")
    assert [r["pos"] for r in ranking.top_k(df, "x", 2).orderBy("rank").collect()] == [0, 1]
    assert [r["pos"] for r in ranking.tail_k(df, "x", 2).orderBy("rank").collect()] == [3, 0]


def test_flat_correlation_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(ranking.safe_correlation("a", "b").alias("r")).first()["r"] == 0.0
    assert df.where("a > 5").agg(ranking.safe_correlation("a", "b").alias("r")).first()["r"] == 0.0


@pytest.mark.parametrize("values", ["many", "ties", "one", "odd"])
def test_hot_subjects_are_ranked_by_ranges(spark, monkeypatch, values):
    monkeypatch.setattr(subjects, "HOT_ROWS", 50)
    rng = np.random.default_rng(4)
    n = 900
    x = {"many": rng.normal(size=n), "ties": rng.integers(0, 4, n) / 4, "one": np.full(n, 2.5), "odd": np.where(rng.random(n) < 0.2, np.inf, rng.normal(size=n))}[values]
    s = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcdefgh"), n))
    rows = [(str(a), i, float(b), float(i % 13)) for i, (a, b) in enumerate(zip(s, x, strict=True))]
    df = spark.createDataFrame(rows, "s string, i int, rank double, y double").withColumn("_bin", F.lit("clash")).repartition(6)
    got = {r["s"]: (r["y"], r["k"]) for r in subjects.top_fraction(df, "s", ["i"], "rank", ["y"]).collect()}
    monkeypatch.setattr(subjects, "HOT_ROWS", 10**6)
    want = {r["s"]: (r["y"], r["k"]) for r in subjects.top_fraction(df, "s", ["i"], "rank", ["y"]).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)
    own = sorted((-b, i) for a, i, b, _ in rows if a == "hot")
    k = int(np.ceil(0.3 * len(own)))
    assert got["hot"] == (pytest.approx(np.mean([i % 13 for _, i in own[:k]])), k)


def test_late_influence_uses_the_steps_that_there_are(spark):
    rows = [(p, s, float(p * 10 + s)) for p in (0, 1) for s in (1, 2, 40, 90)]
    got = subjects.influence(spark.createDataFrame(rows, "pos long, step int, score double"), last=3)
    assert got.count() == 2 and got.agg(F.max("late")).first()[0] == 1.0
    plain = subjects.influence(spark.createDataFrame([(0, 1, 9.0), (0, 40, 0.0), (1, 1, 0.0), (1, 40, 1.0)], "pos long, step int, score double"), last=1).orderBy("pos").collect()
    assert [r["late"] for r in plain] == [0.0, 1.0]


def test_top_fraction_rounds_up(spark):
    rows = [("a", i, float(i), float(i)) for i in range(10)] + [("b", 0, 1.0, 7.0)]
    got = {r["s"]: (r["x"], r["k"]) for r in subjects.top_fraction(spark.createDataFrame(rows, "s string, i int, rank double, x double"), "s", ["i"], "rank", ["x"]).collect()}
    assert got == {"a": (8.0, 3), "b": (7.0, 1)}


def test_late_influence_uses_the_last_steps(spark):
    rows = [(p, s, float(p * 10 + (s if p else -s))) for p in (0, 1) for s in range(5)]
    got = subjects.influence(spark.createDataFrame(rows, "pos long, step int, score double")).orderBy("pos").collect()
    assert [r["influence"] for r in got] == [0.0, 1.0] and [r["late"] for r in got] == [0.0, 1.0]


def test_grid_size_and_filter_errors(spark):
    runs = grid.method_grid(spark, ["A"], [50])
    assert runs.count() == 57
    assert runs.select("run_id").distinct().count() == 57
    with pytest.raises(ValueError):
        grid.filter_manifest(runs, tokens=["nothing"])


def test_constraints(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [tuple(r) for r in constraints.duplicate_ids(a, ["k"]).collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        constraints.require(constraints.duplicate_ids(a, ["k"]), "repeated")
    with pytest.raises(ValueError):
        constraints.reorder(a, spark.createDataFrame([(3, 0)], "k int, pos int"), "k")


def test_files(spark, tmp_path):
    p = tmp_path / "ids.txt"
    p.write_text("b\n\n  a \r\nc\n")
    assert [tuple(r) for r in files.read_ids(spark, str(p)).orderBy("pos").collect()] == [("b", 0), ("a", 1), ("c", 2)]
    p.write_text("a\na\n")
    with pytest.raises(ValueError):
        files.read_ids(spark, str(p), unique=True)
    files.write_ids(spark.createDataFrame([(2, "x"), (1, "y")], "rank int, subject_id string"), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["y", "x"]
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"budget": 5, "facility_backend": "Coverage"}))
    assert files.read_config(str(c), 9) == curation.SelectorConfig(budget=9)
    c.write_text(json.dumps({"budgett": 5}))
    with pytest.raises(ValueError):
        files.read_config(str(c))
    runs = grid.method_grid(spark, ["A"], [50]).where("source_method = 'orient'")
    n = sinks.write_manifest(runs, 50, str(tmp_path / "m.json"))
    assert files.read_manifest(spark, str(tmp_path / "m.json")).count() == n == 7


@pytest.mark.parametrize("n_support", [9, 2])
def test_adaptive_reliability_weights_against_numpy(spark, pool, n_support):
    v, _, df = pool
    rng = np.random.default_rng(8)
    s = rng.random((len(v), 4)).round(2)
    scores = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(s)], "pos long, P double, a double, b double, c double")
    w = 1.0 + np.arange(n_support) % 3
    support = spark.createDataFrame([(i, v[i].tolist(), float(x)) for i, x in enumerate(w)], "pos long, v array<double>, weight double")
    scale = lambda x: (x - x.min()) / (x.max() - x.min())

    def match(rows):
        rows = sorted(rows)
        sim = np.maximum(v @ v[rows].T, 0)
        top = np.argsort(-sim, axis=1, kind="stable")[:, :8]
        x, y = np.take_along_axis(sim, top, 1), w[rows][top]
        return scale((x * y).sum(1) / (y.sum(1) + 1e-12))

    def stable(base, variants, k=12):
        best = lambda x: set(np.argsort(-x, kind="stable")[:k].tolist())
        return np.mean([t for x in variants for t in (0.5 * (np.corrcoef(base, x)[0, 1] + 1), len(best(base) & best(x)) / k)]) if variants else 1.0

    draws = [sorted(range(n_support), key=lambda j: hashlib.md5(f"2025:{i}:{j}".encode()).hexdigest())[: round(0.8 * n_support)] for i in range(8)] if n_support > 2 else []
    r = np.array([0.5 + 0.5 * s[:, 0].std(), stable(scale(s[:, 1:].mean(1)), [scale(x) for x in s[:, 1:].T]), stable(match(range(n_support)), [match(d) for d in draws])])
    want = np.exp((r - r.max()) / 0.3)
    got = reliability.adaptive_reliability_weights(scores, df, support, "P", ["a", "b", "c"], top=12, temperature=0.3).first()
    assert list(got) == pytest.approx((want / want.sum()).tolist(), abs=1e-9)


@pytest.fixture
def many_parts(spark):
    """Small files' splits and small ranges stay apart."""
    options = {"spark.sql.files.maxPartitionBytes": 4001, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_are_numbered_by_ranges(spark, many_parts, tmp_path):
    rows = spark.range(1000).selectExpr("(id * 37) % 1000 as k").repartition(7)
    got = ranking.number_rows(rows, F.desc("k"), first=1)
    assert "Window" not in got._jdf.queryExecution().toString()
    assert got.rdd.getNumPartitions() > 1
    assert sorted((r["pos"], r["k"]) for r in got.collect()) == [(i + 1, 999 - i) for i in range(1000)]
    assert ranking.number_rows(rows.limit(0), "k").count() == 0
    p = tmp_path / "ids.txt"
    p.write_bytes("".join(f" id{i}" + ("\n", "\r\n", "\r", "\n\n")[i % 4] for i in range(3000)).encode())
    got = files.read_ids(spark, str(p))
    assert "Window" not in got._jdf.queryExecution().toString() and got.rdd.getNumPartitions() > 1
    assert [tuple(r) for r in got.orderBy("pos").collect()] == [(f"id{i}", i) for i in range(3000)]
