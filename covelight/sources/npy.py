"""NumPy's .npy files as a Spark data source: spark.read.format("npy") and df.write.format("npy").

Reading looks at the header alone to plan, then each task reads its own range of rows. Writing puts each task's rows at
their places in a file of another name; the commit checks that the places are exactly 0 to n - 1, writes the header and
renames the file, so a job that fails or is tried again leaves no half file.
"""

from __future__ import annotations

import ast
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, StructType

from .places import open_place

FORMAT, MAGIC = "npy", b"\x93NUMPY"
#: Bytes of rows that one partition reads, and of the header that is written.
PART_BYTES, HEADER_BYTES = 32 << 20, 128
#: Spark's type of each kind of number; narrower ones are widened.
TYPES = {"b1": "boolean", "i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "u2": "int", "u4": "long", "f2": "float", "f4": "float", "f8": "double"}


@dataclass(frozen=True)
class Header:
    """What a file says of itself; width: numbers in a row, None for one dimension; start: where the numbers begin."""

    dtype: np.dtype
    rows: int
    width: int | None
    by_column: bool
    start: int

    @property
    def row_bytes(self) -> int:
        return self.dtype.itemsize * (1 if self.width is None else self.width)

    @property
    def spark_type(self) -> str:
        kind = TYPES.get(self.dtype.str[1:])
        if kind is None:
            raise ValueError(f"arrays of {self.dtype} cannot be read")
        return kind if self.width is None else f"array<{kind}>"


def read_header(path: str) -> Header:
    """The header of a file; arrays of more than two dimensions give rows of all the numbers behind the first one. Raises
    ValueError for other files, arrays of objects and files shorter than their header says."""
    system, place = open_place(path)
    with system.open_input_file(place) as f:
        size, lead = f.size(), f.read_at(12, 0)
        if lead[:6] != MAGIC or len(lead) < 12 or lead[6] not in (1, 2, 3):
            raise ValueError(f"{path} is no .npy file")
        begin = 10 if lead[6] == 1 else 12
        length = int.from_bytes(lead[8:begin], "little")
        said = ast.literal_eval(f.read_at(length, begin).decode("latin1" if lead[6] < 3 else "utf8"))
    dtype, shape = np.dtype(said["descr"]), said["shape"]
    if dtype.hasobject or dtype.fields:
        raise ValueError(f"{path}: arrays of {dtype} cannot be read")
    if not shape:
        raise ValueError(f"{path} holds one number, not an array")
    by_column = bool(said["fortran_order"]) and len(shape) > 1
    if by_column and len(shape) > 2:
        raise ValueError(f"{path}: more than two dimensions in column order")
    width = None if len(shape) == 1 else int(np.prod(shape[1:]))
    header = Header(dtype, int(shape[0]), width, by_column, begin + length)
    if size < header.start + header.rows * header.row_bytes:
        raise ValueError(f"{path} is shorter than its header says")
    return header


@dataclass
class Rows(InputPartition):
    first: int
    end: int


class NpyReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.header, self.part_bytes = path, read_header(path), part_bytes

    def partitions(self) -> list[InputPartition]:
        step = max(1, self.part_bytes // max(self.header.row_bytes, 1))
        return [Rows(a, min(a + step, self.header.rows)) for a in range(0, self.header.rows, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        h, n = self.header, partition.end - partition.first
        if not n:
            return
        system, place = open_place(self.path)
        with system.open_input_file(place) as f:
            if h.by_column:  # a stretch of each column
                one = h.dtype.itemsize
                columns = [np.frombuffer(f.read_at(n * one, h.start + (c * h.rows + partition.first) * one), h.dtype) for c in range(h.width)]
                data = np.stack(columns, 1) if columns else np.zeros((n, 0), h.dtype)
            else:
                data = np.frombuffer(f.read_at(n * h.row_bytes, h.start + partition.first * h.row_bytes), h.dtype)
        kind = pa.from_numpy_dtype(_widened(h.dtype))
        flat = pa.array(np.ascontiguousarray(data).reshape(-1).astype(_widened(h.dtype)), kind)
        ends = np.arange(n + 1, dtype=np.int32) * (h.width or 0)
        value = flat if h.width is None else pa.ListArray.from_arrays(pa.array(ends), flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.end)), value], ["pos", "value"])


def _widened(dtype: np.dtype) -> np.dtype:
    """The native type that Spark's type holds."""
    return np.dtype({"u1": "i2", "u2": "i4", "u4": "i8", "f2": "f4"}.get(dtype.str[1:], dtype.str[1:]))


@dataclass
class Written(WriterCommitMessage):
    """Runs of rows: (first, number)."""

    runs: list[tuple[int, int]]


class NpyWriter(DataSourceArrowWriter):
    """Files are written in place, so their folder must be one that the driver and all executors mount."""

    def __init__(self, path: str, dtype: str, width: int | None):
        local = re.sub(r"^file:/+", "/", path)
        if "://" in local:
            raise ValueError(f"{path}: .npy files are written in place, into a shared mounted folder")
        self.path, self.dtype, self.width = os.path.abspath(local), dtype, width
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.part"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        runs: list[list[int]] = []
        dtype = np.dtype(self.dtype)
        row_bytes = dtype.itemsize * (1 if self.width is None else self.width)
        handle = os.open(self.temporary, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            for batch in iterator:
                pos, value = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                if value.null_count or batch.column(0).null_count:
                    raise ValueError("an array has no place for a null")
                if self.width is not None:
                    if set(np.diff(value.offsets.to_numpy())) - {self.width} or value.flatten().null_count:
                        raise ValueError(f"every row must hold {self.width} numbers")
                    value = value.flatten()
                data = value.to_numpy(zero_copy_only=False).astype(dtype).tobytes()
                cuts = [0, *(np.flatnonzero(np.diff(pos) != 1) + 1).tolist(), len(pos)] if len(pos) else []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    _put(handle, data[a * row_bytes : b * row_bytes], HEADER_BYTES + int(pos[a]) * row_bytes)
                    if runs and runs[-1][0] + runs[-1][1] == pos[a]:
                        runs[-1][1] += b - a
                    else:
                        runs.append([int(pos[a]), b - a])
            os.fsync(handle)
        finally:
            os.close(handle)
        return Written([(a, n) for a, n in runs])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        at = 0
        for first, n in sorted(r for m in messages if m for r in m.runs):
            if first != at:
                self.abort(messages)
                raise ValueError(f"{self.path}: row {min(first, at)} is {'missing' if first > at else 'there twice'}")
            at += n
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        handle = os.open(self.temporary, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            _put(handle, header_bytes(self.dtype, at, self.width), 0)
            os.fsync(handle)
        finally:
            os.close(handle)
        os.replace(self.temporary, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


def _put(handle: int, data: bytes, at: int) -> None:
    done = 0
    while done < len(data):
        done += os.pwrite(handle, data[done:], at + done)


def header_bytes(dtype: str, rows: int, width: int | None) -> bytes:
    shape = f"({rows},)" if width is None else f"({rows}, {width})"
    said = f"{{'descr': '{np.dtype(dtype).str}', 'fortran_order': False, 'shape': {shape}, }}"
    return MAGIC + bytes([1, 0]) + (HEADER_BYTES - 10).to_bytes(2, "little") + said.ljust(HEADER_BYTES - 11).encode() + b"\n"


class NpySource(DataSource):
    """Columns pos (0 on) and value, a number or an array of numbers. Options: path; partBytes to read; dtype and, for arrays,
    width to write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"pos long, value {read_header(self.options['path']).spark_type}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(self.options["path"], int(self.options.get("partbytes", PART_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        width = self.options.get("width")
        if isinstance(schema[1].dataType, ArrayType) != (width is not None):
            raise ValueError("arrays, and only arrays, need a width")
        return NpyWriter(self.options["path"], self.options.get("dtype", "<f4"), None if width is None else int(width))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)


def read_array(spark: SparkSession, path: str, ids: DataFrame | None = None, name: str = "value", part_bytes: int = PART_BYTES) -> DataFrame:
    """(pos, name) of a file, or ids (subject_id, pos) with the file's row at each position. Another number of rows than ids
    raises before any number is read."""
    register(spark)
    if ids is not None:
        rows, wanted = read_header(path).rows, ids.count()
        if rows != wanted:
            raise ValueError(f"{path} has {rows} rows, not {wanted}")
    found = spark.read.format(FORMAT).option("partBytes", part_bytes).load(path).withColumnRenamed("value", name)
    return found if ids is None else ids.join(found, "pos")


def read_scores(spark: SparkSession, path: str, ids: DataFrame | None = None, name: str = "value") -> DataFrame:
    """read_array for one number a row; a single column counts as one number, too."""
    found = read_array(spark, path, ids, name)
    if isinstance(found.schema[name].dataType, ArrayType):
        if read_header(path).width != 1:
            raise ValueError(f"{path} has more than one number a row")
        found = found.withColumn(name, F.get(name, F.lit(0)))
    return found


def write_array(rows: DataFrame, path: str, value: str | Column = "value", pos: str | Column = "pos", dtype: str = "<f4") -> None:
    """Writes one row a position, 0 to n - 1, dealt by ranges of positions. All arrays must be of the first one's length."""
    register(rows.sparkSession)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    placed = rows.select(col(pos).cast("long").alias("pos"), col(value).alias("value"))
    writer = placed.repartitionByRange("pos").sortWithinPartitions("pos").write.format(FORMAT).mode("overwrite").option("dtype", dtype)
    if isinstance(placed.schema["value"].dataType, ArrayType):
        first = placed.select(F.size("value")).first()
        writer = writer.option("width", first[0] if first else 0)
    writer.save(path)
