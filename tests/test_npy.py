"""The .npy data source: files of NumPy's own, written and read back."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from covelight.sources import files, npy

ARRAYS = {
    "f8": np.linspace(-1, 1, 37), "f4": np.arange(12, dtype="<f4") / 7, "big": np.arange(9, dtype=">f8") * 1.5, "big4": np.arange(6, dtype=">f4").reshape(3, 2), "ints": np.arange(-3, 20, dtype="<i4"),
    "bytes": np.arange(200, dtype="u1"), "half": np.array([0.5, 2.0], "<f2"), "flags": np.array([True, False, True]), "wide": np.arange(60, dtype="<f8").reshape(12, 5),
    "columns": np.asfortranarray(np.arange(21, dtype="<f4").reshape(7, 3)), "deep": np.arange(24, dtype="<i8").reshape(4, 3, 2), "none": np.zeros((0, 4), "<f4"), "empty": np.zeros(0, "<f8"), "one": np.ones((5, 1), "<f4"),
}


@pytest.mark.parametrize("name", ARRAYS)
@pytest.mark.parametrize("part_bytes", [1 << 20, 24])
def test_every_kind_of_array_is_read_as_numpy_reads_it(spark, tmp_path, name, part_bytes):
    x = ARRAYS[name]
    np.save(tmp_path / "x.npy", x)
    got = npy.read_array(spark, str(tmp_path / "x.npy"), part_bytes=part_bytes).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(len(x)))
    assert [r["value"] for r in got] == x.reshape(len(x), -1 if len(x) else 0).tolist() if x.ndim > 1 else [r["value"] for r in got] == x.tolist()
    parts = npy.read_array(spark, str(tmp_path / "x.npy"), part_bytes=24).rdd.getNumPartitions()
    assert parts >= min(2, x.nbytes // 64)


@pytest.mark.parametrize("version", [(1, 0), (2, 0), (3, 0)])
def test_header_versions(tmp_path, version):
    with open(tmp_path / "x.npy", "wb") as f:
        np.lib.format.write_array(f, np.arange(5.0), version=version)
    assert npy.read_header(str(tmp_path / "x.npy")).rows == 5


def test_ids_are_zipped_by_position_and_lengths_come_from_headers(spark, tmp_path):
    np.save(tmp_path / "s.npy", np.array([0.5, 0.25, 0.125], "<f4"))
    np.save(tmp_path / "t.npy", np.array([[1.0], [2.0], [3.0]]))
    ids = spark.createDataFrame([("c", 2), ("a", 0), ("b", 1)], "subject_id string, pos long")
    assert {r["subject_id"]: r["score"] for r in npy.read_scores(spark, str(tmp_path / "s.npy"), ids, "score").collect()} == {"a": 0.5, "b": 0.25, "c": 0.125}
    assert sorted(r["x"] for r in npy.read_scores(spark, str(tmp_path / "t.npy"), ids, "x").collect()) == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError, match="3 rows, not 2"):
        npy.read_array(spark, str(tmp_path / "s.npy"), ids.limit(2))
    np.save(tmp_path / "w.npy", np.zeros((3, 2)))
    with pytest.raises(ValueError, match="more than one number"):
        npy.read_scores(spark, str(tmp_path / "w.npy"))


def test_other_files_are_refused(tmp_path):
    (tmp_path / "a.npy").write_bytes(b"not an array at all")
    np.save(tmp_path / "b.npy", np.array([{}, None], dtype=object), allow_pickle=True)
    np.save(tmp_path / "c.npy", np.arange(100.0))
    whole = (tmp_path / "c.npy").read_bytes()
    (tmp_path / "c.npy").write_bytes(whole[:-8])
    np.save(tmp_path / "d.npy", np.float64(3))
    for name, why in (("a", "no .npy"), ("b", "object"), ("c", "shorter"), ("d", "one number")):
        with pytest.raises(ValueError, match=why):
            npy.read_header(str(tmp_path / f"{name}.npy"))


def test_numpy_loads_what_was_written(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") / 3).alias("value")).repartition(7)
    npy.write_array(df, str(tmp_path / "new/x.npy"))
    got = np.load(tmp_path / "new/x.npy")
    assert got.dtype == np.dtype("<f4") and np.allclose(got, np.arange(1000) / 3)
    wide = df.select("pos", F.array("value", F.lit(2.0), -F.col("value")).alias("v"))
    npy.write_array(wide, "file:" + str(tmp_path / "y.npy"), "v", dtype=">f8")
    got = np.load(tmp_path / "y.npy")
    assert got.shape == (1000, 3) and got.dtype == np.dtype(">f8") and np.array_equal(got[:, 2], -np.arange(1000) / 3)
    back = npy.read_array(spark, str(tmp_path / "y.npy")).orderBy("pos").collect()
    assert [r["value"][0] for r in back] == (np.arange(1000) / 3).tolist()
    npy.write_array(df.where("pos < 0"), str(tmp_path / "z.npy"))
    assert np.load(tmp_path / "z.npy").shape == (0,)
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".part")]


@pytest.mark.parametrize("what, value", [("gap", "value"), ("twice", "value"), ("null", "null_value"), ("uneven", "arrays")])
def test_a_job_that_fails_leaves_the_old_file_and_no_half_one(spark, tmp_path, what, value):
    np.save(tmp_path / "x.npy", np.arange(3.0))
    df = spark.range(50).select(F.col("id").alias("pos"), F.col("id").cast("double").alias("value"))
    df = df.withColumns({"null_value": F.when(F.col("pos") != 20, F.col("value")), "arrays": F.when(F.col("pos") < 30, F.array("value", "value")).otherwise(F.array("value"))})
    df = df.where("pos <> 17") if what == "gap" else df.union(df.where("pos = 9")) if what == "twice" else df
    with pytest.raises(Exception):  # noqa: B017
        npy.write_array(df, str(tmp_path / "x.npy"), value)
    assert os.listdir(tmp_path) == ["x.npy"] and np.array_equal(np.load(tmp_path / "x.npy"), np.arange(3.0))


def test_a_task_that_writes_again_changes_nothing(tmp_path):
    import pyarrow as pa

    writer = npy.NpyWriter(str(tmp_path / "x.npy"), "<f8", None)
    batch = lambda a, b: pa.RecordBatch.from_pydict({"pos": pa.array(range(a, b), pa.int64()), "value": pa.array([float(i) for i in range(a, b)])})
    lost = writer.write(iter([batch(0, 3)]))
    kept = [writer.write(iter([batch(3, 6)])), writer.write(iter([batch(0, 2), batch(2, 3)]))]
    assert lost.runs == kept[1].runs == [(0, 3)] and not (tmp_path / "x.npy").exists()
    writer.commit(kept)
    assert np.load(tmp_path / "x.npy").tolist() == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


@pytest.fixture
def target_folder(tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(6, 4)).astype("<f4")
    (tmp_path / files.TARGET_IDS).write_text("".join(f"s{i}\n" for i in range(6)))
    np.save(tmp_path / files.TARGET_VECTORS, v)
    scores = {name: rng.uniform(size=6).astype("<f4") for name in files.TARGET_SCORES}
    for name, file in files.TARGET_SCORES.items():
        np.save(tmp_path / file, scores[name].reshape(6, 1) if name == "consistency" else scores[name])
    return tmp_path, v, scores


def test_target_state(spark, target_folder):
    folder, v, scores = target_folder
    got = files.read_state(spark, str(folder)).orderBy("pos").collect()
    assert [r["subject_id"] for r in got] == [f"s{i}" for i in range(6)] and "importance" not in got[0]
    assert np.allclose([r["v"] for r in got], v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8), atol=1e-6)
    for name, x in scores.items():
        assert [r[name] for r in got] == x.tolist()
    np.save(folder / files.TARGET_OPTIONAL["importance"], np.arange(6.0))
    state = files.read_state(spark, str(folder))
    assert sorted(r["importance"] for r in state.collect()) == list(range(6))
    files.write_state_arrays(state, str(folder / "copy"))
    back = files.read_state(spark, str(folder / "copy"))
    assert np.allclose([r["v"] for r in back.orderBy("pos").collect()], [r["v"] for r in state.orderBy("pos").collect()], atol=1e-6)
    assert {(r["subject_id"], r["uncertainty"]) for r in back.collect()} == {(r["subject_id"], r["uncertainty"]) for r in state.collect()}


def test_target_state_of_uneven_or_repeated_parts_raises(spark, target_folder):
    folder, _, scores = target_folder
    np.save(folder / files.TARGET_SCORES["foreground"], np.zeros(5))
    with pytest.raises(ValueError, match="5 rows, not 6"):
        files.read_state(spark, str(folder))
    (folder / files.TARGET_IDS).write_text("a\na\n")
    with pytest.raises(ValueError, match="repeated"):
        files.read_state(spark, str(folder))


def test_source_pool(spark, tmp_path):
    rng = np.random.default_rng(2)
    (tmp_path / files.SOURCE_IDS).write_text("b\n\na\nc\n")
    np.save(tmp_path / files.SOURCE_VECTORS, rng.normal(size=(3, 5)))
    parts = {name: rng.uniform(size=3) for name in "PGM"}
    for name, x in parts.items():
        np.save(tmp_path / f"reliability_{name}.npy", x)
    for name, file in files.SOURCE_SCORES.items():
        np.save(tmp_path / file, np.array([0.0, 0.5, 1.0]))
    weights = {"P": 0.5, "G": 0.3, "M": 0.2}
    (tmp_path / files.SOURCE_SPEC).write_text(json.dumps({"weights": weights, "component_files": {k: f"reliability_{k}.npy" for k in "PGM"}}, indent=1))
    got = files.read_source(spark, str(tmp_path)).orderBy("pos").collect()
    raw = sum(weights[k] * parts[k] for k in "PGM")
    assert [r["subject_id"] for r in got] == ["b", "a", "c"] and [r["L"] for r in got] == [0.0, 0.5, 1.0]
    assert [r["R"] for r in got] == pytest.approx(((raw - raw.min()) / np.ptp(raw)).tolist())


def test_selection_scores_are_written_in_rank_order(spark, tmp_path):
    picks = spark.createDataFrame([(2, "b", 0.25), (1, "a", 0.75), (3, "c", -1.5)], "rank int, subject_id string, score double")
    files.write_selection(picks, str(tmp_path / "selected_scores.parquet"))
    assert np.load(tmp_path / "selected_scores.npy").tolist() == [0.75, 0.25, -1.5]


def test_index_of_slices(spark, tmp_path):
    for name in ("s1_slice002.npy", "s1_slice001.npy", "s2_slice001.npy", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = {r["subject_id"]: r["files"] for r in files.read_index(spark, str(tmp_path), "*.npy").collect()}
    assert got == {"s1": ["s1_slice001.npy", "s1_slice002.npy"], "s2": ["s2_slice001.npy"]}
