"""The method grid: allowed pairs, run ids, splits, config records and manifest filters."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constraints import require

# Method names.
SOURCE_METHODS = ("target_only", "full_source", "random1", "random2", "random3", "coreset", "orient", "anchored")
TARGET_METHODS = ("random1", "random2", "random3", "coreset", "lada", "aada", "ada_clue", "anchored")
NONE = "none"
TARGET_BUDGET = 10
FILTER_FIELDS = ("run_id", "target", "source_method", "target_method")
#: Targets that one task expands.
TARGETS_A_TASK = 2000


def pair_allowed(source: str | Column, target: str | Column) -> Column:
    """anchored goes with anchored alone; orient with anything else; target_only needs a target; full_source takes all."""
    s, t = (F.col(c) if isinstance(c, str) else c for c in (source, target))
    return (
        F.when(s == "anchored", t == "anchored")
        .when((s == "orient") & (t == "anchored"), False)
        .when(s == "target_only", t != NONE)
        .when(s == "full_source", True)
        .otherwise(t != NONE)
    )


def run_id(budget: Column, target: Column, source: Column, method: Column) -> Column:
    return F.format_string("B%d_%s_S%s_T%s", budget, target, source, method)


def source_split(source: Column, method: Column, budget: Column) -> Column:
    """Name of the source split; null where no source is used."""
    return (
        F.when(source == "target_only", F.lit(None).cast("string"))
        .when(source == "full_source", "full_source")
        .when(source == "orient", F.format_string("orient_%s_%d", method, budget))
        .otherwise(F.format_string("%s_%d", source, budget))
    )


def target_split(method: Column, budget: int = TARGET_BUDGET) -> Column:
    return F.when(method == NONE, F.lit(None).cast("string")).when(method == "ada_clue", f"clue_{budget}").otherwise(F.concat(method, F.lit(f"_{budget}")))


def pair_methods(source_methods: Sequence[str] = SOURCE_METHODS, target_methods: Sequence[str] = TARGET_METHODS) -> list[str]:
    """The target methods of a grid; the full source goes without one, too."""
    return ([NONE] if "full_source" in source_methods else []) + list(target_methods)


def method_grid(spark: SparkSession, targets: Sequence[str] | DataFrame, budgets: Sequence[int], source_methods: Sequence[str] = SOURCE_METHODS, target_methods: Sequence[str] = TARGET_METHODS) -> DataFrame:
    """(budget, target, source_method, target_method, run_id, source_split, target_split, n_domains). targets: a few names, or a
    table with a column target, whose rows are expanded where they lie."""
    methods = pair_methods(source_methods, target_methods)
    if isinstance(targets, DataFrame):  # a small file is one task's, its expansion is not
        rows = targets.select("target").repartition(max(1, -(-targets.count() // TARGETS_A_TASK)), "target")
    else:
        rows = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    for name, values in (("budget", list(budgets)), ("source_method", list(source_methods)), ("target_method", methods)):
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    rows = rows.select("budget", "target", "source_method", "target_method")
    grid = rows.where(pair_allowed("source_method", "target_method"))
    b, t, s, m = (F.col(c) for c in ("budget", "target", "source_method", "target_method"))
    grid = grid.withColumns({"run_id": run_id(b, t, s, m), "source_split": source_split(s, m, b), "target_split": target_split(m)})
    return grid.withColumn("n_domains", F.col("source_split").isNotNull().cast("int") + F.col("target_split").isNotNull().cast("int"))


def config_records(grid: DataFrame, root: str = "data", keep: Sequence[str] = ()) -> DataFrame:
    """One nested config per grid row: domains (source, then target, absent ones left out) and evaluation lists; then the grid's
    columns `keep`."""
    path = lambda kind, name: F.concat_ws("/", F.lit(root), F.lit(kind), F.col("target"), F.col(name))
    source = F.when(F.col("source_split").isNotNull(), F.struct(F.lit("source").alias("name"), path("source_splits", "source_split").alias("split"), F.col("budget").alias("count")))
    target = F.when(F.col("target_split").isNotNull(), F.struct(F.lit("target").alias("name"), path("target_splits", "target_split").alias("split"), F.lit(TARGET_BUDGET).alias("count")))
    evaluation = F.concat_ws("/", F.lit(root), F.lit("target_splits"), F.col("target"), F.lit("eval"))
    return grid.select("run_id", F.array_compact(F.array(source, target)).alias("domains"), evaluation.alias("eval_split"), F.concat_ws("/", F.lit("results"), F.col("run_id")).alias("save_dir"), *keep)


#: The training run's constants.
MODEL = {"name": "efficientvit_l1", "in_channels": 4, "num_classes": 4, "pretrained": True}
OPTIMIZER = {"lr": 0.0001, "weight_decay": 1.0e-05}
SCHEDULER = {"T_max": 20, "eta_min": 1.0e-06}
IMG_SIZE, BATCH_SIZE, WORKERS, EPOCHS = 512, 4, 4, 20


def _constants(values: dict) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])


def run_configs(grid: DataFrame, counts: DataFrame, root: str = "data", data_path: str = "data/slices", strict: bool = False) -> DataFrame:
    """(run_id, model, data, optimizer, scheduler, training): the whole config of each runnable row of the grid.

    counts: split, n, of the splits that exist, evaluation lists included. A row with a split that is missing or of another size than the
    budget (TARGET_BUDGET for a target; any for the full source), or without its evaluation list, is left out, or raises if strict.
    """
    records = config_records(grid, root, ["source_method"])
    parts = records.select("run_id", "source_method", F.explode("domains").alias("d")).join(counts.select(F.col("split").alias("_split"), "n"), F.col("d.split") == F.col("_split"), "left")
    whole = (F.col("source_method") == "full_source") & (F.col("d.name") == "source")
    wrong = parts.where(F.col("n").isNull() | (~whole & (F.col("n") != F.col("d.count")))).select("run_id", F.col("d.split").alias("split"), "n")
    lists = counts.select(F.col("split").alias("eval_split"))
    bad = wrong.select("run_id", "split").union(records.join(lists, "eval_split", "left_anti").select("run_id", "eval_split"))
    if strict:
        require(bad, "splits that are missing or of a wrong size")
    kept = records.join(bad.select("run_id").distinct(), "run_id", "left_anti")
    side = lambda part: F.struct(F.lit(data_path).alias("path"), F.lit(part).alias("split"), F.col("eval_split").alias("split_txt"))
    domains = F.transform("domains", lambda d: F.struct(d["name"].alias("name"), F.lit(data_path).alias("path"), F.lit("train").alias("split"), d["split"].alias("split_txt")))
    data = F.struct(
        F.lit(True).alias("skip_empty_train"), F.lit(False).alias("skip_empty_val"), domains.alias("domains"), side("val").alias("val"), side("test").alias("test"),
        F.lit(IMG_SIZE).alias("img_size"), F.lit(BATCH_SIZE).alias("batch_size"), F.lit(WORKERS).alias("num_workers"),
    )
    training = F.struct(F.lit(EPOCHS).alias("epochs"), F.col("save_dir"), F.lit(False).alias("feature_mode"))
    return kept.select("run_id", _constants(MODEL).alias("model"), data.alias("data"), _constants(OPTIMIZER).alias("optimizer"), _constants(SCHEDULER).alias("scheduler"), training.alias("training"))


def read_grid(path: str) -> dict[str, list]:
    """budgets, targets, source_methods and target_methods of a grid's JSON file, the method common to both lists that no
    baseline goes by, is read as `anchored`; its own name is returned beside."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    own = [m for m in found["source_methods"] if m in found["target_methods"] and m not in SOURCE_METHODS]
    if len(own) > 1:
        raise ValueError(f"more than one method of the grid is unknown: {own}")
    swap = lambda names: ["anchored" if n in own else n for n in names]
    return {**found, "source_methods": swap(found["source_methods"]), "target_methods": swap(found["target_methods"]), "anchored": own[0] if own else "anchored"}


def filter_manifest(manifest: DataFrame, wanted: dict[str, Sequence[str]] | None = None, tokens: Sequence[str] = ()) -> DataFrame:
    """Rows whose fields are in all non-empty lists and that have every token among their fields; raises for a token no row has."""
    for field, values in (wanted or {}).items():
        if field not in FILTER_FIELDS:
            raise ValueError(f"no field {field!r} to filter by")
        if values:
            manifest = manifest.where(F.col(field).isin(list(values)))
    if not tokens:
        return manifest
    own = F.array(*[F.col(f) for f in FILTER_FIELDS])
    known = manifest.select(F.explode(own).alias("t")).where(F.col("t").isin(list(tokens))).distinct()
    missing = set(tokens) - {r["t"] for r in known.collect()}
    if missing:
        raise ValueError(f"no run has {sorted(missing)}")
    return manifest.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tokens]), own)) == 0)
