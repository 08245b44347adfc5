"""Integrity checks as queries that return what is wrong; `require` turns rows into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(violations: DataFrame, what: str) -> None:
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def duplicate_ids(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_ids(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has; empty where the sets are equal."""
    left = missing_ids(a, b, key).withColumn("side", F.lit("left"))
    return left.unionByName(missing_ids(b, a, key).withColumn("side", F.lit("right")))


def reorder(rows: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """rows in the given order (key, pos); raises when a key of the order is missing."""
    require(missing_ids(order, rows, key), "ids without a row")
    return order.select(key, "pos").join(rows.drop("pos"), key)


def split_cardinality(splits: DataFrame, keys: Sequence[str], expected: str, subject: str) -> DataFrame:
    """Splits whose number of rows or of distinct subjects is not the expected one."""
    sizes = splits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(subject).alias("n_distinct"), F.max(expected).alias("expected"))
    return sizes.where("n <> expected or n_distinct <> expected")


def length_mismatch(ids: DataFrame, arrays: dict[str, DataFrame], key: str) -> DataFrame:
    """(array, n, expected): aligned tables that do not have exactly one row per id."""
    out = None
    for name, rows in arrays.items():
        sizes = ids.agg(F.count(F.lit(1)).alias("expected")).crossJoin(rows.join(ids.select(key), key, "left_semi").agg(F.count_distinct(key).alias("n"), F.count(F.lit(1)).alias("rows")))
        bad = sizes.where("n <> expected or rows <> expected").select(F.lit(name).alias("array"), "rows", "expected")
        out = bad if out is None else out.unionByName(bad)
    return out


def manifest_violations(manifest: DataFrame, expected_rows: int, root: str = "results") -> DataFrame:
    """(check, detail): wrong number of rows, repeated run ids, save_dir outside root, wrong number of domains."""
    size = manifest.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected_rows).select(F.lit("row_count").alias("check"), F.col("n").cast("string").alias("detail"))
    twice = duplicate_ids(manifest, ["run_id"]).select(F.lit("run_id").alias("check"), F.col("run_id").alias("detail"))
    outside = manifest.where(~F.col("save_dir").startswith(f"{root}/")).select(F.lit("save_dir").alias("check"), F.col("save_dir").alias("detail"))
    empty = manifest.where(F.size("domains") == 0).select(F.lit("domains").alias("check"), F.col("run_id").alias("detail"))
    return size.unionByName(twice).unionByName(outside).unionByName(empty)
