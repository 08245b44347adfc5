"""Configs and manifests written by tasks."""

import json
import os

import pytest
import yaml
from pyspark.sql import functions as F

from covelight.operators import grid
from covelight.plans import catalog
from covelight.sources import files, runs, sinks


def test_all_runs_of_the_grid_are_written_and_read_back(spark, tmp_path):
    rows = grid.method_grid(spark, catalog.TARGETS, [50])
    domains = grid.config_records(rows).select(F.explode("domains").alias("d")).select("d.split", F.col("d.count").alias("n")).distinct()
    counts = domains.groupBy("split").agg(F.max("n").cast("long").alias("n")).withColumn("n", F.coalesce("n", F.lit(500).cast("long")))
    counts = counts.union(spark.createDataFrame([(f"data/target_splits/{t}/eval", 5) for t in catalog.TARGETS], "split string, n long"))
    configs = grid.run_configs(rows, counts).repartition(5)
    folder = tmp_path / "configs/b50"
    n = sinks.write_configs(configs, str(folder))
    assert n == configs.count() == len(os.listdir(folder)) > 200 and os.listdir(tmp_path / "configs") == ["b50"]
    back = runs.read_yaml(spark, str(folder))
    want = {r["run_id"]: json.loads(r["j"]) for r in configs.select("run_id", F.to_json(F.struct("model", "data", "optimizer", "scheduler", "training"), {"ignoreNullFields": "false"}).alias("j")).collect()}
    assert {r["path"].rpartition("/")[2].removesuffix(".yaml"): json.loads(r["record"]) for r in back.collect()} == want
    first = yaml.safe_load((folder / sorted(os.listdir(folder))[0]).read_text())
    assert list(first) == ["model", "data", "optimizer", "scheduler", "training"]
    manifest = grid.config_records(rows).select("run_id", "save_dir")
    assert sinks.write_manifest(manifest, 50, str(tmp_path / "m.json"), "run_id") == rows.count()
    found = json.loads((tmp_path / "m.json").read_text())
    assert found["budget"] == 50 and found["generated_count"] == len(found["rows"]) == rows.count()
    assert [r["run_id"] for r in found["rows"]] == sorted(r["run_id"] for r in manifest.collect())
    assert files.read_manifest(spark, str(tmp_path / "m.json")).count() == rows.count()


def test_a_failed_task_leaves_what_was_there(spark, tmp_path):
    good = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, x int")
    assert sinks.write_configs(good, str(tmp_path / "c")) == 2
    assert sinks.write_manifest(good, 5, str(tmp_path / "m.json")) == 2
    before = (tmp_path / "m.json").read_text()
    bad = spark.range(40).select(F.concat(F.lit("r"), "id").alias("run_id"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("x")).repartition(4, "run_id")
    for write in (lambda: sinks.write_configs(bad, str(tmp_path / "c")), lambda: sinks.write_manifest(bad, 5, str(tmp_path / "m.json"))):
        with pytest.raises(Exception, match="broken"):
            write()
    assert sorted(os.listdir(tmp_path)) == ["c", "m.json"] and sorted(os.listdir(tmp_path / "c")) == ["a.yaml", "b.yaml"]
    assert (tmp_path / "m.json").read_text() == before


def test_written_again_and_empty(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "run_id string, x int")
    sinks.write_configs(rows, str(tmp_path / "c"))
    sinks.write_configs(rows.where("run_id = 'b'"), str(tmp_path / "c"))
    assert os.listdir(tmp_path / "c") == ["b.yaml"] and (tmp_path / "c/b.yaml").read_text() == "x: null\n"
    assert sinks.write_manifest(rows.where("false"), 5, str(tmp_path / "m.json")) == 0
    assert json.loads((tmp_path / "m.json").read_text()) == {"budget": 5, "generated_count": 0, "rows": []}
    with pytest.raises(ValueError, match="name that another has"):
        sinks.write_configs(rows.union(rows), str(tmp_path / "c"))
