"""Reading and writing the method's files: id lists, arrays of vectors and scores, configs and manifests."""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.scoring import normalize, unit
from ..operators.constraints import duplicate_ids, require
from ..operators.curation import SelectorConfig
from ..operators.ranking import number_rows
from ..operators.subjects import parent_subject
from . import npy, places


def read_ids(spark: SparkSession, path: str, unique: bool = False) -> DataFrame:
    """(subject_id, pos) of the non-blank trimmed lines, numbered in the order of the file; raises for repeats if unique."""
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("subject_id"))
    out = number_rows(lines.where("subject_id <> ''"), "file_path", "file_block_start", "line").select("subject_id", "pos")
    if unique:
        require(duplicate_ids(out, ["subject_id"]), f"repeated ids in {path}")
    return out


#: File names of a target's state, fixed values: its vectors and one score a subject each; the last one may be missing.
TARGET_IDS, TARGET_VECTORS = "target_subject_ids.txt", "target_subject_vecs.npy"
TARGET_SCORES = {"uncertainty": "target_uncertainty.npy", "foreground": "target_subject_fg_score.npy", "inconsistency": "lada_li_scores.npy", "consistency": "target_consistency.npy"}
TARGET_OPTIONAL = {"importance": "aada_importance_scores.npy"}
#: File names of a target's source cache, fixed values.
SOURCE_IDS, SOURCE_VECTORS, SOURCE_SPEC = "source_ids.txt", "source_embeddings_l2.npy", "reliability_spec.json"
SOURCE_SCORES = {"influence": "influence.npy", "late_influence": "late_influence.npy"}


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """A target's subjects: subject_id, pos, v (scaled to unit length), uncertainty, foreground, inconsistency, consistency and,
    where the file is there, importance. Every array must have one row an id; lengths come from the files' headers."""
    ids = cut(read_ids(spark, f"{folder}/{TARGET_IDS}", unique=True))
    rows = npy.read_array(spark, f"{folder}/{TARGET_VECTORS}", ids, "embedding").withColumn("v", unit("embedding")).drop("embedding")
    extra = {name: file for name, file in TARGET_OPTIONAL.items() if places.exists(f"{folder}/{file}")}
    for name, file in (TARGET_SCORES | extra).items():
        rows = rows.join(npy.read_scores(spark, f"{folder}/{file}", ids, name).select("pos", name), "pos")
    return rows


def read_source(spark: SparkSession, folder: str) -> DataFrame:
    """A target's source pool: subject_id, pos, v, R (the reliability components by their weights, min-max scaled), I and L."""
    ids = cut(read_ids(spark, f"{folder}/{SOURCE_IDS}", unique=True))
    spec = read_record(spark, f"{folder}/{SOURCE_SPEC}")
    rows = npy.read_array(spark, f"{folder}/{SOURCE_VECTORS}", ids, "embedding").withColumn("v", unit("embedding")).drop("embedding")
    score = F.lit(0.0)
    for name in ("P", "G", "M"):
        part = npy.read_scores(spark, f"{folder}/{spec['component_files'][name]}", ids, name)
        rows = rows.join(part.select("pos", F.col(name).cast("double").alias(name)), "pos")
        score = score + float(spec["weights"][name]) * F.col(name)
    rows = rows.withColumn("_r", score)
    for name, out in (("influence", "I"), ("late_influence", "L")):
        part = npy.read_scores(spark, f"{folder}/{SOURCE_SCORES[name]}", ids, out)
        rows = rows.join(part.select("pos", F.col(out).cast("double").alias(out)), "pos")
    return normalize(rows, "_r", "R").select("subject_id", "pos", "v", "R", "I", "L")


def write_state_arrays(state: DataFrame, folder: str) -> None:
    """A target's state (subject_id, pos, v, scores) as the files that read_state reads."""
    write_ids(state.select("subject_id", F.col("pos").alias("rank")), f"{folder}/{TARGET_IDS}")
    npy.write_array(state, f"{folder}/{TARGET_VECTORS}", "v")
    for name, file in (TARGET_SCORES | TARGET_OPTIONAL).items():
        if name in state.columns:
            npy.write_array(state, f"{folder}/{file}", F.col(name).cast("double"))


def read_record(spark: SparkSession, path: str) -> dict:
    """One small JSON file, from any of Spark's file systems."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_index(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(subject_id, files): the folder's files, sorted, by the subject their names begin with. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return files.groupBy(parent_subject("file").alias("subject_id")).agg(F.sort_array(F.collect_list("file")).alias("files"))


def read_config(path: str, budget: int | None = None, spark: SparkSession | None = None) -> SelectorConfig:
    """Selector constants from a JSON file (read by Spark where a session is given); an unknown key is an error."""
    if spark is not None:
        values = read_record(spark, path)
    else:
        with open(path) as f:
            values = json.load(f)
    unknown = set(values) - {x.name for x in fields(SelectorConfig)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    if budget is not None:
        values["budget"] = budget
    if "facility_backend" in values:
        values["facility_backend"] = values["facility_backend"].lower()
    return SelectorConfig(**values)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a manifest, a bare array or an object with `rows`."""
    found = spark.read.json(path, multiLine=True)
    return found.select(F.inline("rows")) if "rows" in found.columns else found


def write_ids(selection: DataFrame, path: str) -> None:
    """One id per line in rank order, as one small text file (a selection has budget rows)."""
    selection.coalesce(1).sortWithinPartitions("rank").select(F.col("subject_id").cast("string")).write.mode("overwrite").text(path)


def write_selection(selection: DataFrame, path: str) -> None:
    """(rank, subject_id, score) as Parquet, and the scores in rank order as an array beside it (.npy in place of .parquet)."""
    selection.select("rank", "subject_id", "score").write.mode("overwrite").parquet(path)
    npy.write_array(selection, path.removesuffix(".parquet") + ".npy", F.col("score").cast("double"), F.col("rank") - 1)


def write_yaml(record: dict, path: str) -> None:
    import yaml

    places.write_text(path, yaml.safe_dump(record, sort_keys=False))
