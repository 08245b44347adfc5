"""A package folder as tables: what each target's state holds, by file names and headers alone, its configs and split lists, and
what is wrong with all of them. Files are listed and read by Spark; of an array only its header is read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import validation
from .files import SOURCE_IDS, SOURCE_SCORES, SOURCE_SPEC, SOURCE_VECTORS
from .npy import read_header
from .runs import read_yaml, relative_path

#: Parts of a source cache by file name, fixed values.
PARTS = {"source_ids": SOURCE_IDS, "source_embeddings": SOURCE_VECTORS, "P": "reliability_P.npy", "G": "reliability_G.npy", "M": "reliability_M.npy", **SOURCE_SCORES, "reliability_spec": SOURCE_SPEC, "manifest": "manifest.json"}
#: The part of a split that a list's file name says.
LISTS = {"train_subjects.txt": "train", "val_subjects.txt": "val", "test_subjects.txt": "test"}
CONFIG = "data struct<domains: array<struct<name: string, split_txt: string>>, val: struct<split_txt: string>, test: struct<split_txt: string>>, training struct<save_dir: string>"


def _file(path: str | Column = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _folder(path: str | Column = "path") -> Column:
    return F.element_at(F.split(path, "/"), -2)


def _by_name(names: dict[str, str]) -> Column:
    """The key of a file's name, null for other files."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (v, k)]), _file())


def array_rows(paths: DataFrame) -> DataFrame:
    """(path, rows) of .npy files by their headers; -1 for one that is no whole array."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(path: str) -> int:
            try:
                return read_header(path).rows
            except ValueError:
                return -1

        for pdf in parts:
            yield pdf.assign(rows=pdf["path"].map(rows).astype("int64"))

    return paths.select("path").mapInPandas(read, "path string, rows long")


def id_counts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, rows): the non-blank lines of each id list below a folder; an empty list has 0."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").rlike(r"\S").cast("long").alias("own"))
    files = _listed(spark, folder, pattern).select("path")
    counts = lines.groupBy(_plain("path").alias("path")).agg(F.sum("own").alias("rows"))
    return files.select(_plain("path").alias("path")).join(counts, "path", "left").select("path", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def _plain(path: str) -> Column:
    """One spelling of a local path."""
    return F.regexp_replace(path, "^file:/+", "/")


def _listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and length of the files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def state_parts(spark: SparkSession, cache: str) -> DataFrame:
    """(target, part, rows) of the caches below a folder, one folder a target; rows is null for parts that are no list of rows."""
    files = cut(_listed(spark, cache).select("path", _folder().alias("target"), _by_name(PARTS).alias("part")).where("part is not null").withColumn("path", _plain("path")))
    arrays = array_rows(files.where(_file().endswith(".npy")))
    return files.join(arrays.unionByName(id_counts(spark, cache, SOURCE_IDS)), "path", "left").select("target", "part", "rows")


def split_counts(spark: SparkSession, data: str, root: str) -> DataFrame:
    """(split, part, n): the subjects in each list of each split, by the split's folder relative to root."""
    names = {part: file for file, part in LISTS.items()}
    counts = id_counts(spark, data, "*_subjects.txt").withColumn("part", _by_name(names)).where("part is not null")
    folder = F.regexp_replace("path", "/[^/]+$", "")
    return counts.select(relative_path(folder, _local(root)).alias("split"), "part", F.col("rows").alias("n"))


def _local(root: str) -> str:
    import re

    return re.sub(r"^file:/+", "/", root)


def package_configs(spark: SparkSession, configs: str, targets: Sequence[str], root: str) -> DataFrame:
    """run_id (the file's name), target, domains (name, split), val_split, test_split, save_dir of the configs in a folder; paths
    relative to root."""
    parsed = read_yaml(spark, configs).select(F.regexp_replace(_file(), r"\.ya?ml$", "").alias("run_id"), F.from_json("record", CONFIG).alias("c"))
    target = F.regexp_extract("run_id", "(?:^|_)(" + "|".join(targets) + ")(?:_|$)", 1)
    own = lambda c: relative_path(c, _local(root))
    domains = F.transform("c.data.domains", lambda d: F.struct(d["name"].alias("name"), own(d["split_txt"]).alias("split")))
    return parsed.select("run_id", target.alias("target"), domains.alias("domains"), own(F.col("c.data.val.split_txt")).alias("val_split"), own(F.col("c.data.test.split_txt")).alias("test_split"), own(F.col("c.training.save_dir")).alias("save_dir"))


def package_violations(spark: SparkSession, root: str, targets: Sequence[str], budget: int, method: str = "anchored", support: int = 10, names: Sequence[str] = ("source", "target")) -> DataFrame:
    """(check, item, found, expected) over a whole package: cache/<target>, data/source_splits and data/target_splits, and
    configs/generated/b<budget>. An empty table is a pass."""
    states = validation.state_violations(cut(state_parts(spark, f"{root}/cache")), budget, targets, tuple(PARTS))
    counts = cut(split_counts(spark, f"{root}/data", root))
    configs = cut(package_configs(spark, f"{root}/configs/generated/b{budget}", targets, root))
    wanted = spark.createDataFrame([(t, f"data/source_splits/{t}/{method}_{budget}", f"data/target_splits/{t}/{method}_{support}", budget, support) for t in targets], "target string, source_split string, target_split string, source_count int, target_count int")
    missing = validation._wrong(wanted.join(configs, "target", "left_anti"), "config", "target", F.lit(None), F.lit(None))
    expected = configs.join(wanted, "target").select("run_id", "source_split", "target_split", "source_count", "target_count")
    return states.unionByName(missing).unionByName(validation.domain_violations(configs, expected, counts, names))
