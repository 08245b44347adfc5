"""Exact quantiles by rank: equal values are counted first, distinct ones dealt by ranges, and only the ranges that hold a
wanted rank are looked at again. No task holds more than its range, and a value shared by many rows is one row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def ranked_values(df: DataFrame, column: str, ranks: Sequence[int] = (), fractions: Sequence[float] = ()) -> tuple[int, dict[int, float]]:
    """(number of values, value at each rank) of the ascending order; ranks count from 0, fractions ask for the ranks around
    fraction * (n - 1). Nulls are no values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    dealt = cut(counts.repartitionByRange("x").sortWithinPartitions("x")).withColumn("part", F.spark_partition_id())
    # a row a range comes to the driver
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in sizes)
    places = [f * (total - 1) for f in fractions] if total else []
    wanted = sorted({r for r in ranks if 0 <= r < total} | {math.floor(p) for p in places} | {math.ceil(p) for p in places})
    asked, before = [], 0
    for part, n in sizes:
        asked += [(part, r, r - before) for r in wanted if before <= r < before + n]
        before += n
    if not asked:
        return total, {}
    inside = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.where(F.col("part").isin(sorted({p for p, *_ in asked}))).withColumn("until", F.sum("n").over(inside))
    spots = df.sparkSession.createDataFrame(asked, "part int, rank long, at long")
    held = rows.join(F.broadcast(spots), "part").where((F.col("at") < F.col("until")) & (F.col("at") >= F.col("until") - F.col("n")))
    return total, {r["rank"]: r["x"] for r in held.select("rank", "x").collect()}


def quantiles(df: DataFrame, column: str, fractions: Sequence[float]) -> list[float | None]:
    """The quantiles, linear between the two values around each; None where there is no value."""
    total, at = ranked_values(df, column, fractions=fractions)
    out: list[float | None] = []
    for f in fractions:
        if not total:
            out.append(None)
            continue
        place = f * (total - 1)
        low, high = at[math.floor(place)], at[math.ceil(place)]
        out.append(low + (high - low) * (place - math.floor(place)))
    return out
