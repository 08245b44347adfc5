"""Checks over a package folder on disk."""

import json

import numpy as np
import pytest
import yaml

from covelight.sources import package

TARGETS, BUDGET = ("AA", "BB"), 4


@pytest.fixture
def root(tmp_path):
    for t in TARGETS:
        cache = tmp_path / "cache" / t
        cache.mkdir(parents=True)
        (cache / "source_ids.txt").write_text("".join(f"s{i}\n\n" for i in range(6)))
        np.save(cache / "source_embeddings_l2.npy", np.zeros((6, 3), "<f4"))
        for part, file in package.PARTS.items():
            if file.endswith(".npy") and part != "source_embeddings":
                np.save(cache / file, np.zeros(6))
        for file in ("reliability_spec.json", "manifest.json"):
            (cache / file).write_text(json.dumps({"a": 1}))
        for split, n in ((f"source_splits/{t}/anchored_{BUDGET}", BUDGET), (f"target_splits/{t}/anchored_10", 10)):
            (tmp_path / "data" / split).mkdir(parents=True)
            (tmp_path / "data" / split / "train_subjects.txt").write_text("".join(f"x{i}\n" for i in range(n)))
        (tmp_path / "data/target_splits" / t / "eval").mkdir()
        for part in ("val", "test"):
            (tmp_path / "data/target_splits" / t / "eval" / f"{part}_subjects.txt").write_text("v\n")
        folder = tmp_path / f"configs/generated/b{BUDGET}"
        folder.mkdir(parents=True, exist_ok=True)
        write_config(tmp_path, t)
    return tmp_path


def write_config(root, t, source=None):
    split = lambda kind, name: str(root / "data" / kind / t / name)
    record = {
        "data": {"domains": [{"name": "source", "split_txt": source or split("source_splits", f"anchored_{BUDGET}")}, {"name": "target", "split_txt": split("target_splits", "anchored_10")}], "val": {"split_txt": split("target_splits", "eval")}, "test": {"split_txt": split("target_splits", "eval")}},
        "training": {"save_dir": str(root / "results" / t)},
    }
    (root / f"configs/generated/b{BUDGET}/train_{t}_S{BUDGET}.yaml").write_text(yaml.safe_dump(record))


def found(spark, root):
    return sorted(tuple(r) for r in package.package_violations(spark, str(root), TARGETS, BUDGET).collect())


def test_a_whole_package_passes(spark, root):
    assert found(spark, root) == []
    parts = {(r["target"], r["part"]): r["rows"] for r in package.state_parts(spark, str(root / "cache")).collect()}
    assert len(parts) == 2 * len(package.PARTS) and parts["AA", "source_ids"] == parts["BB", "G"] == 6 and parts["AA", "manifest"] is None
    configs = package.package_configs(spark, str(root / f"configs/generated/b{BUDGET}"), TARGETS, str(root)).orderBy("target").collect()
    assert [(r["target"], r["save_dir"], r["domains"][0]["split"]) for r in configs] == [(t, f"results/{t}", f"data/source_splits/{t}/anchored_{BUDGET}") for t in TARGETS]


def test_one_missing_part_one_short_array_and_one_wrong_config_are_three_rows(spark, root):
    (root / "cache/AA/influence.npy").unlink()
    np.save(root / "cache/BB/reliability_G.npy", np.zeros(5))
    write_config(root, "AA", source=str(root / f"data/source_splits/BB/anchored_{BUDGET}"))
    assert found(spark, root) == [
        ("length", "BB/G", "5", "6"), ("missing_part", "AA/influence", None, None),
        ("source_split", f"train_AA_S{BUDGET}", f"data/source_splits/BB/anchored_{BUDGET}", f"data/source_splits/AA/anchored_{BUDGET}"),
    ]


def test_broken_arrays_short_lists_small_pools_and_missing_configs(spark, root):
    (root / "cache/AA/reliability_P.npy").write_bytes(b"no array")
    (root / "cache/BB/source_ids.txt").write_text("a\nb\n")
    (root / "data/source_splits/AA" / f"anchored_{BUDGET}" / "train_subjects.txt").write_text("a\n\n")
    (root / "data/target_splits/AA/eval/val_subjects.txt").write_text("\n")
    (root / f"configs/generated/b{BUDGET}/train_BB_S{BUDGET}.yaml").unlink()
    got = found(spark, root)
    assert ("length", "AA/P", "-1", "6") in got and ("pool_size", "BB", "2", str(BUDGET)) in got and ("config", "BB", None, None) in got
    assert ("source_count", f"train_AA_S{BUDGET}", "1", str(BUDGET)) in got and ("val_list", f"train_AA_S{BUDGET}", "data/target_splits/AA/eval", None) in got
    assert len([g for g in got if g[0] == "length" and g[1].startswith("BB/")]) == 6 and len(got) == 11
