"""A count-min sketch that answers one question: about how often may this key have been seen?

Two rows of 2^bits cells, each cell a counter that stops at the highest level asked for. Every partition builds its own
sketch and gives its touched cells as 16-bit offsets within blocks of 65,536 cells, as often as it counted them; past
256 partitions blocks are merged in two rounds, so no task holds a block's share of all partitions. What is left at the
end is one bit a cell for the first level asked for and one for some cells together for others, little over ROWS * 2^bits / 8 bytes. The width follows the number of keys up to
`max_bits`, so the merged sketch has a fixed greatest size. Counters only overestimate: past that width more keys
look repeated, but none that is repeated is ever missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .wordhash import mix

ROWS = 2
_BLOCK = 16
#: Partitions' pieces of a block that one task merges.
_FAN_IN = 256
_PARTIAL = "plane int, block int, salt int, cell binary"
_FLUSH = 1 << 20
#: Higher levels are rare: one bit for so many cells (a power of two) tells them.
_COARSE = 6


def width_for(keys: float, max_bits: int, spare: int = 8) -> int:
    """Cells (as a power of two) for about `keys` keys: `spare` a key, at least 2^16, at most 2^max_bits."""
    return int(min(max_bits, max(_BLOCK, np.ceil(np.log2(max(keys, 1) * spare)))))


def cells(keys: np.ndarray, plane: int, bits: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x51ED270B * (plane + 1))) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Repeats:
    """planes[r][0] has a set bit for each cell of row r that was counted levels[0] times or more; planes[r][k] one for
    each 2^_COARSE cells of which one was counted levels[k] times or more."""

    bits: int
    levels: tuple[int, ...]
    planes: tuple[tuple[np.ndarray, ...], ...]

    def level(self, keys: np.ndarray) -> np.ndarray:
        """How many of the levels a key may have reached; never fewer than it has."""
        out = np.full(len(keys), len(self.levels), np.int8)
        for r, planes in enumerate(self.planes):
            at = cells(keys, r, self.bits)
            bit = [(plane[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(np.int8) for plane, x in zip(planes, [at] + [at >> _COARSE] * (len(planes) - 1), strict=True)]
            out = np.minimum(out, bit[0] * sum(bit[1:], start=np.int8(1)))
        return out

    def may_repeat(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that was counted twice or more, and for few others."""
        return self.level(keys) > 0


def _partial(keys: np.ndarray, bits: int, salt: int, cap: int) -> Iterator[tuple]:
    for r in range(ROWS):
        cell, n = np.unique(cells(keys, r, bits), return_counts=True)
        cell = np.repeat(cell, np.minimum(n, cap))
        block = cell >> _BLOCK
        at = np.flatnonzero(np.diff(block, prepend=-1))
        offsets = (cell & 0xFFFF).astype("<u2")
        for a, b in zip(at, [*at[1:], len(cell)], strict=True):
            yield r, int(block[a]), salt, offsets[a:b].tobytes()


def _merge(cell: list[bytes]) -> np.ndarray:
    return np.bincount(np.frombuffer(b"".join(cell), "<u2"), minlength=1 << _BLOCK)


def count(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, levels: tuple[int, ...] = (2,)) -> Repeats:
    """Sketch all keys that keys_of reads from df's batches."""
    salts, cap = -(-df.rdd.getNumPartitions() // _FAN_IN), max(levels)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % salts

        def give(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = list(_partial(np.concatenate(held), bits, salt, cap))
            for a in range(0, len(rows), 2048):
                columns = list(zip(*rows[a : a + 2048], strict=True))
                types = [pa.int32()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["plane", "block", "salt", "cell"])

        held: list[np.ndarray] = []
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                if sum(map(len, held)) >= _FLUSH:
                    yield from give(held)
                    held = []
        if held:
            yield from give(held)

    def merge(pdf):
        n = np.minimum(_merge(list(pdf["cell"])), cap)
        return pdf.iloc[:1].assign(cell=np.repeat(np.arange(len(n)), n).astype("<u2").tobytes())

    def finish(pdf):
        n = _merge(list(pdf["cell"]))
        return pdf.iloc[:1][["plane", "block"]].assign(bitmap=b"".join(np.packbits(x, bitorder="little").tobytes() for x in [n >= levels[0], *((n >= k).reshape(-1, 1 << _COARSE).any(1) for k in levels[1:])]))

    parts = df.mapInArrow(build, _PARTIAL)
    if salts > 1:
        parts = parts.groupBy("plane", "block", "salt").applyInPandas(merge, _PARTIAL)
    merged = parts.groupBy("plane", "block").applyInPandas(finish, "plane int, block int, bitmap binary")
    sizes = [(1 << _BLOCK) // 8] + [(1 << _BLOCK - _COARSE) // 8] * (len(levels) - 1)
    planes = tuple(tuple(np.zeros(size << bits - _BLOCK, np.uint8) for size in sizes) for _ in range(ROWS))
    for r, block, bitmap in cut(merged).toLocalIterator():  # little over ROWS * 2^bits / 8 bytes at most in all
        at = 0
        for plane, size in zip(planes[r], sizes, strict=True):
            plane[block * size : (block + 1) * size] = np.frombuffer(bitmap, np.uint8, size, at)
            at += size
    return Repeats(bits, levels, planes)


def total_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
