"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-cased letters, digits and other non-ASCII characters with everything else as single spaces. A
test item of m bytes may differ from a passage by k = floor(max_error * m) edits. Cut into k + 1 pieces, at least one
piece stands unchanged in any such passage, so the pieces of all items are sought exactly in one pass (Aho-Corasick)
and each hit's surroundings, if they share enough 5-grams with the item, are checked with Myers' bit-parallel edit distance, on integers as wide as the item.

Items are taken in blocks of `block_bytes`, one pass over the documents for each, so no number of items overfills a task.
Items with a null or empty text (after that normalisation) match nothing; items with a null id cannot be reported, so
find_leaks passes over them, but drop_leaks seeks them too; null, empty and whole long texts are fine; equal items all
match; repeated documents get repeated results; other columns are not read. An item too short for an edit must stand
between spaces or text ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP else 32 for c in range(256))
_STRIDE = 64
_GRAM = 5
SCHEMA = "doc_id long, item_ids array<long>, distances array<int>"


def normalise(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split())


class Matcher:
    """Finds the items in normalised texts."""

    def __init__(self, items: list[tuple[int, bytes]], max_error: float) -> None:
        self.items = [(i, t, int(max_error * len(t))) for i, t in items if t]
        self.auto = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        self.bits, self.grams = [], []
        for n, (_, text, k) in enumerate(self.items):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                where.setdefault(text[a:b].decode("latin-1"), []).append((n, b))
            bits: dict[int, int] = {}
            for j, c in enumerate(text):
                bits[c] = bits.get(c, 0) | 1 << j
            self.bits.append(bits)
            self.grams.append([text[j : j + _GRAM] for j in range(len(text) - _GRAM + 1)])
        for piece, at in where.items():
            self.auto.add_word(piece, at)
        self.auto.make_automaton()

    def distance(self, n: int, window: bytes) -> int:
        """Least edit distance between item n and any part of window (Myers 1999)."""
        _, text, _ = self.items[n]
        bits, m = self.bits[n], len(text)
        mask, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score, best = mask, 0, m, m
        for c in window:
            eq = bits.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            right, left = down | (~(xh | up) & mask), up & xh
            if right & top:
                score += 1
            elif left & top:
                score -= 1
                if score < best:
                    best = score
            right, left = (right << 1) & mask, (left << 1) & mask
            up, down = left | (~(xv | right) & mask), right & xv
        return best

    def plausible(self, n: int, window: bytes) -> bool:
        """False only where too few of the item's 5-grams occur in window for k edits, each of which changes 5 at most."""
        grams = self.grams[n]
        there = {window[j : j + _GRAM] for j in range(len(window) - _GRAM + 1)}
        return sum(g in there for g in grams) >= len(grams) - _GRAM * self.items[n][2]

    def find(self, text: bytes, first: bool = False) -> dict[int, int]:
        """{index of item: least distance} of the items within their budget of some part of text; if first, only the first one met."""
        found: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        for end, at in self.auto.iter(text.decode("latin-1")) if len(self.auto) else ():
            for n, offset in at:
                if first and found:
                    return found
                if found.get(n) == 0:
                    continue
                _, item, k = self.items[n]
                start = end + 1 - offset
                if k == 0:
                    if start >= 0 and (start == 0 or text[start - 1] == 32) and (end + 1 == len(text) or text[end + 1] == 32):
                        found[n] = 0
                    continue
                block = (start - k) // _STRIDE
                if (n, block) in tried:
                    continue
                tried.add((n, block))
                window = text[max(0, block * _STRIDE) : (block + 1) * _STRIDE + len(item) + 2 * k]
                if self.plausible(n, window) and (best := self.distance(n, window)) <= k:
                    found[n] = min(best, found.get(n, k))
        return found


def _item_blocks(items: DataFrame, item_col: str, text_col: str, most: int, nameless: bool = False) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of about `most` characters; those with a null id only if nameless."""
    held, size = [], 0
    rows = items.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull() & (F.col(item_col).isNotNull() | F.lit(nameless))).distinct()
    for item, text in rows.toLocalIterator():
        held.append((item, normalise(text)))
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


_matchers: dict[int, Matcher] = {}


def _matcher(shared, max_error: float) -> Matcher:
    if shared.value[0] not in _matchers:
        _matchers.clear()
        _matchers[shared.value[0]] = Matcher(shared.value[1], max_error)
    return _matchers[shared.value[0]]


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_error: float = 0.08, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, leaked, item_ids (sorted) and their least distances."""
    docs = id_text(df, id_col, text_col)
    found = None
    for number, block in enumerate(_item_blocks(items, item_col, item_text_col, block_bytes)):
        shared = df.sparkSession.sparkContext.broadcast((hash((number, tuple(block))), sorted(block)))
        if found is None:
            state = docs.select("doc_id", "text", F.array().cast("array<long>").alias("item_ids"), F.array().cast("array<int>").alias("distances"))
        else:
            state = found
        found = state.mapInArrow(_search(shared, max_error), "doc_id long, text string, item_ids array<long>, distances array<int>")
    if found is None:
        found = docs.select("doc_id", F.array().cast("array<long>").alias("item_ids"), F.array().cast("array<int>").alias("distances"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("leaked"), "item_ids", "distances")


def _search(shared, max_error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, max_error)
        for batch in batches:
            ids, least = batch.column("item_ids").to_pylist(), batch.column("distances").to_pylist()
            for i, text in enumerate(batch.column("text")):
                if hits := matcher.find(normalise(text.as_py() or "")):
                    best = dict(zip(ids[i], least[i], strict=True))
                    for n, d in hits.items():
                        item = matcher.items[n][0]
                        best[item] = min(best.get(item, d), d)
                    ids[i], least[i] = list(sorted(best)), [best[x] for x in sorted(best)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(ids, pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int32()))], ["doc_id", "text", "item_ids", "distances"])

    return run


def drop_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", max_error: float = 0.08, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of df, with all their columns, in whose text no item is found, items without an id included."""

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, max_error)
            for batch in batches:
                texts = batch.column(text_col)
                yield batch.filter(pa.array([not matcher.find(normalise(x.as_py() or ""), first=True) for x in texts], pa.bool_()))

        return run

    for number, block in enumerate(_item_blocks(items, "item_id", "text", block_bytes, nameless=True)):
        ordered = sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        shared = df.sparkSession.sparkContext.broadcast((hash((number, tuple(block))), ordered))
        df = df.mapInArrow(keep(shared), df.schema)
    return df
