"""Whole-package checks as tables of what is wrong: (check, item, found, expected). An empty table is a pass;
`constraints.require` turns rows into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constraints import duplicate_ids, missing_ids

#: Tables that one target's state is made of.
STATE_PARTS = ("source_ids", "source_embeddings", "P", "G", "M", "influence", "late_influence", "target_support", "reliability_spec")


def _wrong(rows: DataFrame, check: str, item: str | Column, found: str | Column, expected: str | Column) -> DataFrame:
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return rows.select(F.lit(check).alias("check"), text(item).alias("item"), text(found).alias("found"), text(expected).alias("expected"))


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def state_violations(parts: DataFrame, budget: int, targets: Sequence[str], required: Sequence[str] = STATE_PARTS) -> DataFrame:
    """parts: target, part, rows. Parts that a target lacks, parts that have not one row for each source id, pools below the budget."""
    spark = parts.sparkSession
    wanted = spark.createDataFrame([(t, p) for t in targets for p in required], "target string, part string")
    missing = wanted.join(parts, ["target", "part"], "left_anti")
    pools = parts.where("part = 'source_ids'").select("target", F.col("rows").alias("pool"))
    aligned = [p for p in required if p not in ("source_ids", "target_support", "reliability_spec")]
    uneven = parts.where(F.col("part").isin(aligned)).join(pools, "target").where("rows <> pool")
    small = pools.where(F.col("pool") < budget)
    item = F.concat_ws("/", "target", "part")
    return _all([_wrong(missing, "missing_part", item, F.lit(None), F.lit(None)), _wrong(uneven, "length", item, "rows", "pool"), _wrong(small, "pool_size", "target", "pool", F.lit(budget))])


def training_violations(manifest: DataFrame, targets: Sequence[str], budget: int, configs: DataFrame) -> DataFrame:
    """manifest: target, budget, config_path; configs: config_path of those that exist. One row a target, the same
    targets, the budget, and a config behind every path."""
    spark = manifest.sparkSession
    wanted = spark.createDataFrame([(t,) for t in targets], "target string")
    size = manifest.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != len(targets))
    return _all([
        _wrong(size, "row_count", F.lit("manifest"), "n", F.lit(len(targets))),
        _wrong(missing_ids(wanted, manifest, "target"), "missing_target", "target", F.lit(None), F.lit(None)),
        _wrong(missing_ids(manifest, wanted, "target"), "unknown_target", "target", F.lit(None), F.lit(None)),
        _wrong(manifest.where(~F.col("budget").eqNullSafe(F.lit(budget))), "budget", "target", "budget", F.lit(budget)),
        _wrong(missing_ids(manifest, configs, "config_path"), "config_path", "config_path", F.lit(None), F.lit(None)),
    ])


def domain_violations(configs: DataFrame, expected: DataFrame, counts: DataFrame, names: Sequence[str] = ("source", "target")) -> DataFrame:
    """What is wrong with configs of two domains. configs: run_id, domains (array of (name, split)), val_split, test_split;
    expected: run_id, source_split, target_split, source_count, target_count; counts: split, part (train, val, test), n.

    Both domains in order, with the expected splits and numbers of subjects, and lists to validate and test on."""
    placed = configs.join(expected, "run_id")
    order = F.concat_ws(",", F.transform("domains", lambda d: d["name"]))
    parts = [_wrong(configs.where(order != ",".join(names)), "domains", "run_id", order, F.lit(",".join(names)))]
    train = counts.where("part = 'train'").select("split", "n")
    for i, (name, want) in enumerate(zip(names, ("source", "target"), strict=True)):
        own = placed.select("run_id", F.get("domains", F.lit(i))["split"].alias("split"), F.col(f"{want}_split").alias("wanted"), F.col(f"{want}_count").alias("size"))
        parts.append(_wrong(own.where(~F.col("split").eqNullSafe(F.col("wanted"))), f"{name}_split", "run_id", "split", "wanted"))
        sized = own.where("split is not null").join(train, "split", "left")
        parts.append(_wrong(sized.where(~F.col("n").eqNullSafe(F.col("size").cast("long"))), f"{name}_count", "run_id", "n", "size"))
    for part in ("val", "test"):
        lists = counts.where((F.col("part") == part) & (F.col("n") > 0)).select(F.col("split").alias(f"{part}_split"))
        parts.append(_wrong(configs.join(lists, f"{part}_split", "left_anti"), f"{part}_list", "run_id", f"{part}_split", F.lit(None)))
    return _all(parts)


def grid_violations(manifest: DataFrame, expected_rows: int, counts: DataFrame, pools: DataFrame, root: str = "results", target_count: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """What is wrong with a manifest of runs: run_id, target, budget, source_method, save_dir, domains (array of (name, split)).

    counts: split, n; pools: target, pool; keys: the manifest's own top-level names. Checked are its number of rows, repeated run
    ids, each split's size (the whole pool for full_source, else the budget; target_count for a target), save_dir under
    root, and that it says nothing of skipped runs."""
    spark = manifest.sparkSession
    size = manifest.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected_rows)
    domains = manifest.select("run_id", "target", "budget", "source_method", F.explode("domains").alias("d")).select("*", "d.name", "d.split")
    sized = domains.join(counts, "split", "left").join(pools, "target", "left")
    want = F.when(F.col("name") == "target", F.lit(target_count).cast("long")).when(F.col("source_method") == "full_source", F.col("pool").cast("long")).otherwise(F.col("budget").cast("long"))
    skipped = spark.createDataFrame([(k,) for k in keys if k.startswith("skipped")], "key string")
    return _all([
        _wrong(size, "row_count", F.lit("manifest"), "n", F.lit(expected_rows)),
        _wrong(duplicate_ids(manifest, ["run_id"]), "run_id", "run_id", "n", F.lit(1)),
        _wrong(sized.where(~F.col("n").cast("long").eqNullSafe(want)), "split_count", F.concat_ws("/", "run_id", "name"), "n", want),
        _wrong(manifest.where(~F.col("save_dir").startswith(f"{root}/")), "save_dir", "run_id", "save_dir", F.lit(root)),
        _wrong(skipped, "skipped", "key", F.lit(None), F.lit(None)),
    ])


def split_row_counts(manifest: DataFrame, splits: DataFrame) -> DataFrame:
    """Each run's domains with the number of subjects in their splits (0 where a split is missing): run_id, name, split, n."""
    domains = manifest.select("run_id", F.explode("domains").alias("d")).select("run_id", "d.name", "d.split")
    return domains.join(splits.groupBy("split").agg(F.count_distinct("subject_id").alias("n")), "split", "left").select("run_id", "name", "split", F.coalesce("n", F.lit(0)).alias("n"))
