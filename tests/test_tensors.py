"""Slices as tensors against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covelight.operators import subjects, tensors

KIND = "subject_id string, slice int, tensor struct<shape: array<int>, data: array<double>>"


def frame(spark, rows):
    return spark.createDataFrame([(s, i, None if x is None else (list(x.shape), x.astype(float).ravel().tolist())) for s, i, x in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def maps():
    rng = np.random.default_rng(1)
    out = [(f"s{i % 4}", i, rng.normal(size=(4, *shape))) for i, shape in enumerate([(3, 5)] * 9 + [(2, 2)] * 6 + [(1, 7)] * 2)]
    return [(s, i, np.exp(x) / np.exp(x).sum(0)) for s, i, x in out]


def test_summaries_of_mixed_shapes_and_nulls(spark, maps):
    df = frame(spark, [*maps, ("none", 99, None)])
    got = {r["slice"]: r for r in df.select("slice", tensors.probability_summary("tensor").alias("p"), tensors.class_map("tensor").alias("c")).collect()}
    for _, i, p in maps:
        assert got[i]["p"]["entropy"] == pytest.approx(-(p * np.log(p + 1e-8)).sum(0).mean())
        assert got[i]["p"]["foreground"] == pytest.approx(p[1:].sum(0).mean())
        assert got[i]["p"]["mean_probs"] == pytest.approx(p.mean((1, 2)).tolist())
        assert got[i]["c"]["data"] == p.argmax(0).ravel().tolist() and got[i]["c"]["shape"] == list(p.shape[1:])
    assert got[99]["p"]["entropy"] is None and got[99]["c"]["data"] is None
    scores = frame(spark, [(s, i, np.log(p)) for s, i, p in maps]).select("slice", tensors.softmax_maps("tensor").alias("p"))
    want = {i: p for _, i, p in maps}
    assert all(r["p"]["data"] == pytest.approx(want[r["slice"]].ravel().tolist()) for r in scores.collect())


def test_label_files_to_subject_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    labels = {(s, i): rng.integers(0, 4, (6, 6)) for s in ("a", "b_x", "c") for i in range(rng.integers(1, 5))}
    labels["a", 0] = np.zeros((3, 2), int)
    for (s, i), x in labels.items():
        np.save(tmp_path / f"{s}_slice{i}.npy", x.astype(np.uint8))
    slices = tensors.read_slices(spark, str(tmp_path))
    assert {(r["subject_id"], r["slice"]) for r in slices.collect()} == set(labels)
    got = {r["subject_id"]: r for r in tensors.subject_morphology(slices, slices.select("subject_id").distinct()).collect()}
    pixels = spark.createDataFrame([(s, int(c)) for (s, _), x in labels.items() for c in x.ravel()], "subject_id string, c int")
    for r in subjects.morphology_stats(pixels, "subject_id", "c").collect():
        assert all(got[r["subject_id"]][k] == pytest.approx(x) for k, x in r.asDict().items() if k != "subject_id")
    with pytest.raises(ValueError, match="without a label slice"):
        tensors.subject_morphology(slices, spark.createDataFrame([("nobody",)], "subject_id string"))


def test_subject_state_from_slices(spark, maps):
    got = {r["subject_id"]: r for r in tensors.subject_state(frame(spark, maps)).collect()}
    for s in {s for s, *_ in maps}:
        own = sorted(((-(p[1:].sum(0).mean() - 0.25 * (p * np.log(p + 1e-8)).sum(0).mean()), i, p) for t, i, p in maps if t == s), key=lambda x: x[:2])
        k = int(np.ceil(0.3 * len(own)))
        assert got[s]["k"] == k and got[s]["foreground"] == pytest.approx(np.mean([p[1:].sum(0).mean() for *_, p in own[:k]]))


def test_consistency_of_views(spark, maps):
    rng = np.random.default_rng(3)
    rows = [(i, p, [np.roll(p, rng.integers(0, 2), 0) for _ in range(3)]) for _, i, p in maps]
    kind = "struct<shape: array<int>, data: array<double>>"
    pack = lambda x: (list(x.shape), x.ravel().tolist())
    df = spark.createDataFrame([(i, pack(p), *map(pack, v)) for i, p, v in rows] + [(-1, pack(rows[0][1]), None, None, None)], f"i int, p {kind}, a {kind}, b {kind}, c {kind}")
    got = {r["i"]: r["x"] for r in df.select("i", tensors.view_consistency("p", "a", "b", "c").alias("x")).collect()}
    for i, p, views in rows:
        assert got[i] == pytest.approx(np.mean([(v.argmax(0) == p.argmax(0)).mean() for v in views]))
    assert got[-1] is None


def test_wrong_numbers_of_values_raise(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0])], "i int, x array<double>")
    with pytest.raises(Exception, match="another number of values"):
        df.select(tensors.label_counts(tensors.tensor("x", 2, 2))).collect()
    assert df.select(tensors.label_counts(tensors.tensor("x", 3)).alias("c")).first()["c"]["whole"] == 2
    assert df.where(F.col("i") > 5).select(tensors.label_counts(tensors.tensor("x", 3))).collect() == []
