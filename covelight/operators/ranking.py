"""Rankings, set overlaps, correlation and stability of score vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def top_k(df: DataFrame, value: str, k: int, by: Sequence[str] = (), pos: str = "pos") -> DataFrame:
    """The k rows of largest value (of each group), ties to the lower position, with `rank`. Without groups this is one
    distributed top-k; with groups Spark keeps k rows of a group per task before it deals them."""
    order = [F.desc(value), F.asc(pos)]
    if not by:
        df = df.orderBy(*order).limit(k)
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn("rank", F.row_number().over(window.orderBy(*order))).where(F.col("rank") <= k)


def number_rows(df: DataFrame, *order: str | Column, out: str = "pos", first: int = 0) -> DataFrame:
    """Adds first, first + 1, ... in the given order. Rows are sorted by ranges and written; a row's number is its place in
    its partition and the number of rows in those before it, so no task sees more than its range."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")).drop("_id")
    before, at = [], first
    for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        before.append((r["_part"], at))
        at += r["n"]
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def tail_k(df: DataFrame, value: str, k: int, pos: str = "pos") -> DataFrame:
    """The last k rows of an ascending stable sort: at the cut higher positions win; rank ascends with value."""
    kept = df.orderBy(F.desc(value), F.desc(pos)).limit(k)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc(value), F.asc(pos))))


def membership(df: DataFrame, tops: dict[str, tuple[str, int]], key: str = "pos") -> DataFrame:
    """Adds a boolean column for each name: is the row in the top k of a value? tops: name -> (value, k)."""
    rows = df
    for name, (value, k) in tops.items():
        members = top_k(rows, value, k, pos=key).select(F.col(key), F.lit(True).alias(name))
        df = df.join(F.broadcast(members), key, "left").na.fill(False, [name])
    return df


def _count(c: Column) -> Column:
    return F.sum(c.cast("long"))


def overlap_fraction(a: str, b: str) -> Column:
    """|A and B| / max(1, min(|A|, |B|)) of two flags, as an aggregate."""
    smaller = F.greatest(F.lit(1), F.least(_count(F.col(a)), _count(F.col(b))))
    return _count(F.col(a) & F.col(b)) / smaller


def agreement(a: str, b: str, c: str) -> Column:
    """Share of the rows in any of three flags that are in two or more; 0 where none is."""
    votes = F.col(a).cast("int") + F.col(b).cast("int") + F.col(c).cast("int")
    return F.coalesce(_count(votes >= 2) / F.nullif(_count(votes >= 1), F.lit(0)), F.lit(0.0))


def safe_correlation(a: str, b: str) -> Column:
    """Pearson's r as an aggregate, 0 where either side is flat, clipped to [-1, 1]."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    n = F.count(F.lit(1))
    top = F.sum(x * y) - F.sum(x) * F.sum(y) / n
    flat = F.sqrt(F.greatest(F.lit(0.0), F.sum(x * x) - F.sum(x) * F.sum(x) / n) * F.greatest(F.lit(0.0), F.sum(y * y) - F.sum(y) * F.sum(y) / n))
    return F.coalesce(F.when(flat < 1e-12, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(top, flat)))), F.lit(0.0))


def top_overlap(df: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """One row: share of the top k by a that is in the top k by b."""
    both = membership(df, {"_a": (a, k), "_b": (b, k)})
    size = F.greatest(F.lit(1), F.least(F.lit(k), F.count(F.lit(1))))
    return both.agg((_count(F.col("_a") & F.col("_b")) / size).alias("overlap"))


def stability(df: DataFrame, base: str, variants: Sequence[str], k: int) -> DataFrame:
    """One row: mean over the variants of (r + 1) / 2 and the top-k overlap with base; 1 without variants."""
    if not variants:
        return df.sparkSession.createDataFrame([(1.0,)], "stability double")
    flags = membership(df, {f"_top_{i}": (c, k) for i, c in enumerate([base, *variants])})
    size = F.greatest(F.lit(1), F.least(F.lit(k), F.count(F.lit(1))))
    terms = []
    for i, c in enumerate(variants, 1):
        terms += [0.5 * (safe_correlation(base, c) + 1.0), _count(F.col("_top_0") & F.col(f"_top_{i}")) / size]
    return flags.agg((sum(terms[1:], terms[0]) / len(terms)).alias("stability"))


def random_subset(df: DataFrame, key: str, k: int, seed: int | str) -> DataFrame:
    """k rows in the order of md5(seed:key), the same on any engine and partitioning; with rank."""
    drawn = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string").cast("string")).cast("binary")))
    kept = drawn.orderBy("_h", key).limit(k)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h", key))).drop("_h")
