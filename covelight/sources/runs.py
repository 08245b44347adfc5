"""A run's files: where they are, what must be there, and what a selection leaves behind.

Records and summaries are small (one a target) and written by the driver, to any place that places.py reaches; subjects, scores,
states, gradients and configs are written by tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence
from dataclasses import asdict

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.curation import Selection, SelectorConfig, selected_counts, signal_means
from . import places
from .files import write_ids, write_selection

SUMMARY, POINTER = "SELECTION_SUMMARY.md", "SUMMARY_POINTER.md"


def resolve_path(given: str | None, variable: str, default: str, root: str) -> str:
    """What the caller gave, else the environment's variable, else the default; relative paths count from root."""
    chosen = given or os.environ.get(variable) or default
    return chosen if os.path.isabs(chosen) or "://" in chosen else os.path.normpath(os.path.join(root, chosen))


def relative_path(path: str | Column, root: str) -> Column:
    """path below root without root, any other path as it is."""
    c, top = F.col(path) if isinstance(path, str) else path, root.rstrip("/") + "/"
    return F.when(c.startswith(top), F.substring(c, len(top) + 1, 1 << 20)).otherwise(c)


def require_paths(spark: SparkSession, paths: Sequence[str], what: str = "inputs") -> None:
    """Raises for those paths that do not exist, before anything is planned over them; any of Spark's file systems will do."""
    missing = []
    for path in paths:
        try:
            spark.read.format("binaryFile").load(path)
        except AnalysisException:
            missing.append(path)
    if missing:
        raise FileNotFoundError(f"missing {what}: {', '.join(missing)}")


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(path, record): each YAML file below path as a JSON text, for from_json or get_json_object; one small file a row."""

    @F.pandas_udf("string")
    def as_json(content: pd.Series) -> pd.Series:
        import yaml

        return content.map(lambda c: json.dumps(yaml.safe_load(bytes(c)), sort_keys=True))

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.y*ml").load(path).select("path", as_json("content").alias("record"))


def write_json(record: object, path: str) -> None:
    places.write_text(path, json.dumps(record, indent=2, sort_keys=True) + "\n")


def write_run(selection: Selection, ids: DataFrame, config: SelectorConfig, target: str, data_root: str, results_root: str, method: str = "anchored") -> dict:
    """Writes what one selection gave: the ordered ids as the target's split and as a result, the scores, and run_config.json.

    ids: pos, subject_id. A pool below the budget, or another number of picks than the budget, raises. Returns the record."""
    pool = ids.count()
    if config.budget > pool:
        raise ValueError(f"{target}: budget {config.budget} exceeds the pool of {pool}")
    named = selection.picks.join(ids.select("pos", "subject_id"), "pos")
    chosen = named.count()
    if chosen != config.budget:
        raise RuntimeError(f"{target}: {chosen} subjects selected, {config.budget} expected")
    split, results = f"{data_root}/{target}/{method}_{config.budget}", f"{results_root}/{target}"
    write_ids(named, f"{split}/train_subjects.txt")
    write_ids(named, f"{results}/selected_ids.txt")
    write_selection(named, f"{results}/selected_scores.parquet")
    row = lambda df: df.first().asDict()
    record = {
        "target": target, "source_split": f"{split}/train_subjects.txt", "results_root": results, "selected_total": chosen,
        "diagnostics": {**row(selection.diagnostics), "facility_backend": config.facility_backend, "selected_counts": row(selected_counts(selection.picks))},
        "signal_means": row(signal_means(selection.picks)),
    }
    write_json({"method": method, "config": asdict(config), **record}, f"{results}/run_config.json")
    return record


def write_summary(records: Sequence[dict], results_root: str, config: SelectorConfig) -> str:
    """summary.json, a Markdown table of activations (three decimals) and counts, and a file that points to it."""
    write_json(list(records), f"{results_root}/summary.json")
    lines = ["# Selected subsets", "", "```json", json.dumps(asdict(config), indent=2, sort_keys=True), "```", "", "| target | selected | backend | sparse | coverage | consensus | R-top | H-top | F-top | multi |", "|---|---:|---|---:|---:|---:|---:|---:|---:|---:|"]
    for r in records:
        d, n = r["diagnostics"], r["diagnostics"]["selected_counts"]
        lines.append(f"| {r['target']} | {r['selected_total']} | {d['facility_backend']} | {d['a_sparse']:.3f} | {d['a_coverage']:.3f} | {d['a_consensus']:.3f} | {n['n_r_top']} | {n['n_h_top']} | {n['n_f_top']} | {n['n_multi']} |")
    text = "\n".join(lines) + "\n"
    for name, body in ((SUMMARY, text), (POINTER, f"See `{SUMMARY}`.\n")):
        places.write_text(f"{results_root}/{name}", body)
    return text


def write_target_state(state: DataFrame, evaluation: DataFrame, folder: str) -> None:
    """The target's subjects with vectors and scores as one table, a row a subject, and its evaluation lists beside it.

    evaluation: kind (val, test), rank, subject_id."""
    state.write.mode("overwrite").parquet(f"{folder}/state.parquet")
    evaluation.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/evaluation.parquet")


def write_reliability_spec(weights: DataFrame, support: DataFrame, checkpoints: Sequence[str], counts: dict[str, int], folder: str, rule: str) -> dict:
    """The fusion weights, the rule they follow, the support's ids (a few rows), the checkpoints and the tables' sizes."""
    w = weights.first().asDict()
    record = {
        "weights": {k.removeprefix("w_").upper(): v for k, v in w.items()}, "rule": rule, "target_support_ids": [r[0] for r in support.orderBy("pos").select("subject_id").collect()],
        "gradient_checkpoints": list(checkpoints), "component_files": {k: f"{k}.parquet" for k in "PGM"}, "counts": counts,
    }
    write_json(record, f"{folder}/reliability_spec.json")
    return record


def ids_digest(ids: DataFrame, key: str = "subject_id", order: str = "pos") -> str:
    """A digest of the ordered list of ids, made of one hash a row, so no list comes to the driver."""
    one = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.col(order).cast("string"), F.col(key).cast("string")), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    row = ids.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(one), F.lit(0)).alias("s")).first()
    return hashlib.sha256(f"{row['n']}:{row['s']}".encode()).hexdigest()[:24]


def cached_gradients(spark: SparkSession, folder: str, checkpoint: str, ids: DataFrame, compute) -> DataFrame:
    """The gradients (subject_id, gradient) of one checkpoint for an ordered list of ids (subject_id, pos).

    They are computed, by compute(ids), and written once; the written table is used again for exactly the same ordered ids alone."""
    place = f"{folder}/checkpoint={checkpoint}/ids={ids_digest(ids)}"
    try:
        spark.read.format("binaryFile").load(f"{place}/_SUCCESS")
    except AnalysisException:
        compute(ids).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
