"""Small helpers shared by the text operators: checkpoints and Arrow text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of vectorised work holds, a longer document apart.
BLOCK_BYTES = 1 << 18


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; a folder of our own only in local mode, where none is named (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-covelight-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so a lost executor costs no recomputation.

    The copy is a Parquet table: a reader of few columns reads only those.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: A key is hot with more rows than this part of all rows, and than HOT_ROWS; so at most PARTS keys are.
PARTS, HOT_ROWS = 4096, 1000


def hot_keys(df: DataFrame, key: str) -> DataFrame | None:
    """(key, copies): the keys of df that hold too many rows for one task, at most PARTS, and how often to split them."""
    share = max(df.count() / PARTS, HOT_ROWS)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where((F.col("copies") > share) & F.col(key).isNotNull())
    hot = cut(counts.select(key, F.ceil(F.col("copies") / share).cast("int").alias("copies")))
    return hot if hot.limit(1).count() else None


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """left joined with right, unique by key, where a few keys may hold much of left.

    Rows of left with a hot key are dealt by `by` too, and right's row is copied for each part. hot: hot_keys of left where
    they are known; else left is counted, so it should be a written table. At most PARTS hot keys are broadcast.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if hot is None:
        return left.join(right.hint("merge"), key, how)
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), "copies"), F.lit(0)).cast("int"))
    copied = right.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    return dealt.drop("copies").join(copied.drop("copies").hint("merge"), [key, "_part"], how).drop("_part")


#: Rows and bytes of whole texts that one Arrow batch holds, a longer row apart; Spark's own 10,000 rows or 64 MB would be
#: held several times over in each worker.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_ROWS rows at most, unless the session already asks for fewer, and end them at
    BATCH_BYTES, unless the session has a limit of its own instead of Spark's."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in (f"{64 << 20}b", "64MB"):
        spark.conf.set(name, BATCH_BYTES)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; any other column is left in the scan."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `most` bytes each; every row is in exactly one."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def text_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each block of a batch's text column."""
    data, offsets = utf8(batch.column("text"))
    for a, b in blocks(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
