"""The domain classifier and the split dispatcher against plain versions."""

import numpy as np
import pytest

from covelight.operators import clustering, splits
from covelight.operators.ranking import random_subset
from covelight.plans import catalog


def plain_domain_scores(source, target, weight):
    """Balanced logistic regression with a penalised intercept, by Newton's method; source is class 1."""
    x = np.column_stack([np.vstack([source, target]), np.ones(len(source) + len(target))])
    y = np.r_[np.ones(len(source)), np.zeros(len(target))]
    w = np.where(y == 1, len(y) / 2 / len(source), len(y) / 2 / len(target))
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.eye(len(b)), x.T @ (w * (p - y)) + b)
        b -= step
        if np.abs(step).max() < 1e-12:
            break
    p = np.clip(1 / (1 + np.exp(-np.column_stack([target, np.ones(len(target))]) @ b)), 1e-6, 1 - 1e-6)
    return (1 - p) / p * np.maximum(weight, 1e-8)


@pytest.mark.parametrize("shift", [0.1, 1.5])
def test_domain_selection(spark, shift):
    rng = np.random.default_rng(3)
    source, target = rng.normal(size=(80, 4)), rng.normal(size=(30, 4)) + shift
    weight = rng.uniform(0, 1, 30)
    weight[4] = 0.0
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(source)], "pos long, v array<double>")
    t = spark.createDataFrame([(i, v.tolist(), float(w)) for i, (v, w) in enumerate(zip(target, weight, strict=True))], "pos long, v array<double>, weight double").repartition(3)
    want = plain_domain_scores(source, target, weight)
    got = clustering.domain_selection(s, t, 12).orderBy("rank").collect()
    assert [r["pos"] for r in got] == np.argsort(-want, kind="mergesort")[:12].tolist()
    assert [r["score"] for r in got] == pytest.approx(np.sort(want)[::-1][:12].tolist(), rel=1e-4)


def test_each_split_of_the_dispatcher_is_its_operators(spark, sf):
    from covelight.operators.greedy import k_center

    source, state = catalog.source(spark, sf), catalog.experiment._state(spark, sf)
    found = {}
    for r in splits.all_splits(source, state, "T1", (8,)).orderBy("rank").collect():
        found.setdefault((r["kind"], r["method"]), []).append(r["pos"])
    pos = lambda df: [r["pos"] for r in df.orderBy("rank").collect()]
    assert found["source", "full_source"] == sorted(r["pos"] for r in source.select("pos").collect())
    assert found["source", "coreset"] == pos(k_center(source.select("pos", "v"), 8))
    for i in (1, 2, 3):
        assert found["source", f"random{i}"] == pos(random_subset(source.select("pos"), "pos", 8, f"{i}:T1:8"))
    rows = sorted(state.collect(), key=lambda r: r["pos"])
    v = np.array([r["v"] for r in rows])
    unc = np.array([r["uncertainty"] for r in rows])
    s = np.array([r["v"] for r in source.orderBy("pos").collect()])
    want = plain_domain_scores(s, v, unc)
    assert found["target", "aada"] == [rows[i]["pos"] for i in np.argsort(-want, kind="mergesort")[:10]]
    chosen = [0]
    while len(chosen) < 10:
        far = 1 - np.maximum((v @ v[chosen].T).max(1), -1)
        far[chosen] = -np.inf
        chosen.append(int(far.argmax()))
    assert found["target", "coreset"] == [rows[i]["pos"] for i in chosen]
    for m in ("random1", "coreset", "lada", "aada", "ada_clue"):
        picks = spark.createDataFrame([(p,) for p in found["target", m]], "pos long")
        assert found["source", f"orient_{m}"] == pos(splits.orient(source, state, picks, 8))
