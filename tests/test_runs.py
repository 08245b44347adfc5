"""Run files, guards, splits and the entry point without the text operators."""

import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from covelight.operators import constraints, curation, grid, splits, subjects
from covelight.plans import catalog
from covelight.sources import files, runs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_paths_and_guards(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("SOME_ROOT", "from/env")
    assert runs.resolve_path("given", "SOME_ROOT", "d", "/r") == "/r/given"
    assert runs.resolve_path(None, "SOME_ROOT", "d", "/r") == "/r/from/env"
    assert runs.resolve_path(None, "OTHER_ROOT", "/abs/d", "/r") == "/abs/d"
    df = spark.createDataFrame([("/r/a/b",), ("/rr/a",), (None,)], "p string")
    assert [r[0] for r in df.select(runs.relative_path("p", "/r")).collect()] == ["a/b", "/rr/a", None]
    runs.require_paths(spark, [str(tmp_path)])
    with pytest.raises(FileNotFoundError, match="nowhere"):
        runs.require_paths(spark, [str(tmp_path), str(tmp_path / "nowhere")])


def test_yaml_round_trip(spark, tmp_path):
    files.write_yaml({"b": 1, "a": [1, 2]}, str(tmp_path / "x.yaml"))
    assert (tmp_path / "x.yaml").read_text().startswith("b: 1")
    assert json.loads(runs.read_yaml(spark, str(tmp_path)).first()["record"]) == {"a": [1, 2], "b": 1}


def test_config_file_with_the_contracts_names(tmp_path):
    values = {"budget": 5, "facility_backend": "AUTO", "facility_magnification_eta": 1.0, "redundancy_lambda": 0.1, "consensus_multi_quota": 4, "gate_power": 4.0, "facility_show_progress": False}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(values))
    got = files.read_config(str(path), 9)
    assert (got.budget, got.facility_backend, got.redundancy_lambda) == (9, "auto", 0.1)
    path.write_text('{"no_such_key": 1}')
    with pytest.raises(ValueError, match="no_such_key"):
        files.read_config(str(path))


def test_grid_file(tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"budgets": [5], "targets": ["A"], "target_methods": ["coreset", "ours"], "source_methods": ["full_source", "ours"]}))
    got = grid.read_grid(str(path))
    assert got["anchored"] == "ours" and got["target_methods"] == ["coreset", "anchored"] and got["source_methods"] == ["full_source", "anchored"]


def test_run_summary_and_state(spark, sf, tmp_path):
    rows = [(i, i + 1, 1.0 - i / 10, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, True, True, False, True) for i in range(3)]
    picks = spark.createDataFrame(rows, "pos long, rank int, score double, R double, I double, L double, M double, D double, F double, A double, r_top boolean, h_top boolean, f_top boolean, multi boolean")
    diag = spark.createDataFrame([(0.1, 0.2, 0.7)], "a_sparse double, a_coverage double, a_consensus double")
    ids = spark.createDataFrame([(i, f"s{9 - i}") for i in range(4)], "pos long, subject_id string")
    config = curation.SelectorConfig(budget=3, facility_backend="auto")
    record = runs.write_run(curation.Selection(picks, diag, picks), ids, config, "T1", str(tmp_path / "data"), str(tmp_path / "res"))
    assert [r["subject_id"] for r in files.read_ids(spark, record["source_split"]).orderBy("pos").collect()] == ["s9", "s8", "s7"]
    saved = json.loads((tmp_path / "res/T1/run_config.json").read_text())
    assert saved["selected_total"] == 3 and saved["config"]["budget"] == 3 and not {"R_top", "H"} & set(saved["diagnostics"])
    assert "| T1 | 3 | auto | 0.100 | 0.200 | 0.700 | 3 | 3 | 0 | 3 |" in runs.write_summary([record], str(tmp_path / "res"), config)
    assert runs.SUMMARY in (tmp_path / "res" / runs.POINTER).read_text() and (tmp_path / "res/summary.json").exists()
    with pytest.raises(ValueError, match="exceeds"):
        runs.write_run(curation.Selection(picks, diag, picks), ids, curation.SelectorConfig(budget=5), "T1", str(tmp_path), str(tmp_path))
    with pytest.raises(RuntimeError, match="expected"):
        runs.write_run(curation.Selection(picks, diag, picks), ids, curation.SelectorConfig(budget=2), "T1", str(tmp_path), str(tmp_path))
    evaluation = spark.createDataFrame([("val", 1, "a"), ("test", 1, "b")], "kind string, rank int, subject_id string")
    runs.write_target_state(picks, evaluation, str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "state/evaluation.parquet")).count() == 2
    spec = runs.write_reliability_spec(spark.createDataFrame([(0.5, 0.3, 0.2)], "w_p double, w_g double, w_m double"), ids, ["c1"], {"n": 4}, str(tmp_path), "softmax")
    assert spec["weights"] == {"P": 0.5, "G": 0.3, "M": 0.2} and spec["target_support_ids"][0] == "s9"


def test_gradients_are_used_again_for_the_same_ordered_ids_alone(spark, tmp_path):
    made = []

    def compute(ids):
        made.append(1)
        return ids.select("subject_id", F.array(F.lit(1.0)).alias("gradient"))

    ids = spark.createDataFrame([("a", 0), ("b", 1)], "subject_id string, pos long")
    turned = spark.createDataFrame([("b", 0), ("a", 1)], "subject_id string, pos long")
    for rows in (ids, ids.repartition(3), turned):
        assert runs.cached_gradients(spark, str(tmp_path), "c1", rows, compute).count() == 2
    assert len(made) == 2


def test_splits(spark, sf):
    got = catalog.QUERIES["split_dispatch"](spark, sf).toPandas()
    sizes = got.groupby(["kind", "method"]).size()
    assert len(sizes) == 8 + 1 + 3 + 1 + 7
    assert set(sizes["target"]) == {10} and sizes["source"].drop("full_source").eq(8).all()
    assert not got.duplicated(["kind", "method", "rank"]).any() and not got.duplicated(["kind", "method", "pos"]).any()
    source, state = catalog.source(spark, sf), catalog.target(spark, sf)
    with pytest.raises(ValueError, match="without a vector"):
        splits.orient(source, state, spark.createDataFrame([(-5,)], "pos long"), 3)


def test_small_checks(spark):
    ids = spark.createDataFrame([(1,), (2,)], "pos long")
    assert constraints.length_mismatch(ids, {"a": ids, "b": ids.limit(1)}, "pos").select("array").collect()[0][0] == "b"
    df = spark.createDataFrame([([1, 2, 0], [1, 0, 0], [0.2, 0.4, 0.4], 2, "k")], "a array<int>, b array<int>, p array<double>, view int, id string")
    row = df.select(subjects.class_agreement("a", "b"), subjects.top_class("p"), subjects.foreground_score("p"), subjects.noise_view("p", "view", 0.1, "id")).first()
    assert (round(row[0], 6), row[1], round(row[2], 6)) == (0.666667, 1, 0.8) and all(abs(x - y) <= 0.1 for x, y in zip(row[3], (0.2, 0.4, 0.4), strict=True))


def test_configs_of_missing_splits_raise(spark):
    rows = grid.method_grid(spark, ["A"], [5], ["coreset"], ["lada"])
    with pytest.raises(ValueError, match="missing"):
        grid.run_configs(rows, spark.createDataFrame([], "split string, n long"), strict=True)
    assert grid.run_configs(rows, spark.createDataFrame([], "split string, n long")).count() == 0


def test_entry_point_without_the_text_operators(tmp_path):
    shutil.copytree(f"{ROOT}/covelight", tmp_path / "covelight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'seeded_greedy_select' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=False).returncode == 0


def test_a_grid_of_one_file_of_targets_is_expanded_by_several_tasks(spark):
    targets = spark.range(5000).coalesce(1).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("target"))
    rows = grid.method_grid(spark, targets, [50, 100])
    assert rows.rdd.getNumPartitions() == 3
    one = grid.method_grid(spark, ["T7"], [50, 100])
    assert rows.where("target = 'T7'").exceptAll(one).count() == 0 and rows.count() == 5000 * one.count()
    kept = grid.config_records(one, keep=["source_method"])
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString() and kept.columns[-1] == "source_method"
