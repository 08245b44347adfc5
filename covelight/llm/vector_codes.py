"""Vectors as short codes: each of several parts by the nearest entry of a codebook, in whole numbers throughout.

Codebooks are moved by a fixed number of rounds, one pass over the vectors each. A pass compares a part with an entry by
lower bounds first: with both cut into blocks of s places and sums S per block, and residual norms r of what the block
means leave over,

    |u - e|^2  >=  sum over blocks of (S_u - S_e)^2 / s  +  (r_u - r_e)^2.

One block, then two, then four, and so on; an entry whose bound lies above the distance of an entry already measured is
out, and what is left is measured exactly. Bounds are rounded downwards, so neither the nearest entry nor a tie is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

#: Components beyond this cannot be squared and summed in 64 bits.
LARGEST = 1 << 27
#: Rows compared at a time; what the bounds lose by rounding, relative.
ROWS, SLACK = 4096, 1e-9
#: So many label sums of 16 bytes are broadcast; more are joined by shuffle.
LABELS = 10_000


def quantize(vectors: DataFrame, parts: int = 8, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, q: each component x as the integer floor(scale * x), little-endian in one binary value.

    Rows go whose vector is null, is empty, holds a null or a non-finite component, or one past LARGEST after scaling. All
    vectors must be of one length, a multiple of `parts`: that of the smallest vec_id; other lengths go as well."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("q"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) <= LARGEST))
    rows = rows.where(fine & (F.size("v") > 0) & (F.size("v") % parts == 0)).select("vec_id", "label", F.col("q").cast("array<int>").alias("q"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("q")
            data = q.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            ends = 4 * (q.offsets.to_numpy() - q.offsets[0].as_py())
            yield batch.set_column(2, "q", pa.array([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()))

    packed = cut(rows.mapInArrow(pack, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, q binary"))
    first = packed.orderBy(F.asc_nulls_last("vec_id"), "q").limit(1).select(F.length("q")).first()
    return packed.where(F.length("q") == first[0]) if first else packed


def _squared(u: np.ndarray, e: np.ndarray) -> np.ndarray:
    d = u - e
    return np.einsum("ij,ij->i", d, d)


def _blocks(width: int) -> list[int]:
    """Numbers of blocks from coarse to fine, each dividing the width."""
    return [b for b in (1, 2, 4, 8, 16, 32) if b < width and width % b == 0]


class Codebook:
    """The entries of one part with their block sums and residual norms."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = [(b, *self._summary(entries, b)) for b in _blocks(entries.shape[1])]

    @staticmethod
    def _summary(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block sums and residual norms; what is under the root is whole, times the block's size, before it is divided."""
        s = x.shape[1] // blocks
        sums = x.reshape(len(x), blocks, s).sum(2)
        rest = s * np.einsum("ij,ij->i", x, x) - np.einsum("ij,ij->i", sums, sums)
        return sums, np.sqrt(rest.astype(np.float64) / s)

    def nearest(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of each row's nearest entry, ties to the lower index; how many pairs were measured."""
        n, k = len(u), len(self.entries)
        best = np.full((n, k), np.iinfo(np.int64).max)
        open_ = np.ones((n, k), bool)
        upper, rows = None, np.arange(n)
        measured = 0
        for blocks, sums, norms in self.levels:
            mine, rest = self._summary(u, blocks)
            s = u.shape[1] // blocks
            bound = np.zeros((n, k))
            for b in range(blocks):
                gap = (mine[:, b, None] - sums[None, :, b]).astype(np.float64)
                bound += gap * gap / s
            apart = np.maximum(np.abs(rest[:, None] - norms) - SLACK * (rest[:, None] + norms), 0)
            bound = (bound + apart * apart) * (1 - SLACK)
            if upper is None:  # measure the entry that the coarsest bounds put first
                first = bound.argmin(1)
                upper = best[rows, first] = _squared(u, self.entries[first])
                measured += n
            open_ &= bound <= upper[:, None]
        open_ &= best == np.iinfo(np.int64).max
        i, j = np.nonzero(open_)
        best[i, j] = _squared(u[i], self.entries[j])
        index = best.argmin(1)
        return index, best[rows, index], measured + len(i)


def _matrices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integer matrix) of ROWS rows of a batch at a time."""
    q = batch.column("q").to_pylist()
    for a in range(0, len(q), ROWS):
        yield a, np.frombuffer(b"".join(q[a : a + ROWS]), "<i4").reshape(-1, width).astype(np.int64)


def fit(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> list[np.ndarray]:
    """The codebooks (parts x entries x width) of quantize's rows. They start as the vectors of the smallest vec_ids (null ids
    last; rows of one id by their values); fewer vectors give fewer entries. Each round assigns every part to its nearest
    entry and replaces an entry by the componentwise floor of its parts' mean; an unused entry stays.

    What reaches the driver is one sum per part, entry and place: entries x length numbers, whatever the number of rows."""
    begin = rows.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect()
    if not begin:
        return []
    start = np.stack([np.frombuffer(r[0], "<i4").astype(np.int64) for r in begin])
    width = start.shape[1] // parts
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        for p, e, count, sums in _sums(rows, books).collect():
            books[p][e] = [x // count for x in sums]
    return books


def _sums(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, entry, count, sums of the parts nearest to each used entry; each task sums up its own rows first."""
    parts, (k, width) = len(books), books[0].shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Codebook(b) for b in books]
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for _, m in _matrices(batch, parts * width):
                for p, table in enumerate(tables):
                    u = m[:, p * width : (p + 1) * width]
                    index, _, _ = table.nearest(u)
                    np.add.at(sums[p], index, u)
                    counts[p] += np.bincount(index, minlength=k)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "count": pa.array(counts[p, e], pa.int64()), "sums": pa.array(list(sums[p, e]), pa.list_(pa.int64()))})

    each = rows.select("q").mapInArrow(add, "part int, entry int, count long, sums array<long>")
    return each.groupBy("part", "entry").agg(F.sum("count").alias("count"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]).select("part", "entry", "count", F.array(*[f"s{i}" for i in range(width)]))


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (entry indexes in part order, two hex digits each), error (squared distances summed over parts)."""
    kind = rows.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Codebook(b) for b in books]
        width = books[0].shape[1] if books else 1
        for batch in batches:
            for a, m in _matrices(batch, width * len(books)):
                found = [t.nearest(m[:, p * width : (p + 1) * width])[:2] for p, t in enumerate(tables)]
                codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
                part = batch.slice(a, len(m))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(f[1] for f in found))], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "q").mapInArrow(code, f"vec_id long, label {kind}, code string, error long")


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = 4096) -> DataFrame:
    """codes with `approximation`: the entries that a code names, as doubles on the vectors' own scale."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in e]) for e in b.tolist()]) for b in books])
    at = lambda i: F.conv(F.substring("code", i * 2 + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approximation", F.flatten(F.array(*[F.get(F.get(entries, F.lit(p)), at(p)) for p in range(len(books))])))


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, null ones together), codebooks_sha256: a row a kept
    vector. Repeated rows are kept; an empty table gives no rows; columns but vec_id, embedding and label are not read."""
    rows = quantize(vectors, parts)
    books = fit(rows, parts, entries, rounds)
    coded = cut(encode(rows, books)).withColumn("_label", F.when(F.col("label").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("label").cast("string"))))
    sums = cut(coded.groupBy("_label").agg(F.sum("error").alias("label_error")))
    small = sums.count() <= LABELS
    joined = coded.join(F.broadcast(sums), "_label") if small else spread_join(coded, sums, "_label", "vec_id")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
