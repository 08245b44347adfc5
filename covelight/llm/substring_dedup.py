"""Removal of repeated word windows, with a count-min sketch before the exact grouping.

A window is `size` consecutive words of one document. Pass one sketches, for every window, the smallest hash among
its `gram`-word sequences (each position once): that sequence occurs at least as often as the window, so the
merged sketch overestimates the window's count. Pass two hashes exactly those windows whose sequence may repeat,
keeps each window's first start in its document, and groups them: the smallest doc_id owns the window, every other
document loses it. Later starts within a document are found again beside the text. Words in a lost window go.

A null, empty or short text has no window and loses nothing; the whole text is read whatever its length. Rows that
share a doc_id count as one document (identical rows get identical results; if their texts differ, the positions
that either loses are lost in both). Each row with a null doc_id is a document of its own, after all others and in
the order of its text. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from .common import id_text, text_blocks
from .repeat_sketch import Repeats, count, total_bytes, width_for
from .wordhash import Words, covered, mix, span_hashes, windows_of, words_of

_LAST = 2**63 - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with doc_key: doc_id, and for each null doc_id a key of its own above all of them. Rows without an id are numbered
    and written, so both passes see the same keys; with none, nothing is."""
    nameless = F.count(F.when(F.col("doc_id").isNull(), 1))
    least, most, nulls = docs.agg(F.min("doc_id"), F.max("doc_id"), nameless).first()
    if not nulls:
        return docs.withColumn("doc_key", F.col("doc_id"))
    least, most = (least, most) if most is not None else (0, 0)
    down = max(0, most + nulls - _LAST)
    if least - down < -_LAST:
        raise ValueError("the ids fill all 64 bits and leave no key for rows without one")
    numbered = number_rows(docs.where("doc_id is null"), F.xxhash64("text"), "text", out="doc_key", first=most - down + 1)
    known = docs.where("doc_id is not null").withColumn("doc_key", F.col("doc_id") - F.lit(down))
    return known.unionByName(numbered.select("doc_id", "text", F.col("doc_key").cast("long").alias("doc_key")))


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each `width` consecutive entries, by doubling."""
    have = 1
    while have * 2 <= width:
        x, have = pick(x[:-have], x[have:]), have * 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _keys(words: Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, the window's smallest gram hash, hashes of the grams that are some window's smallest)."""
    counts = np.maximum(np.diff(words.first) - (size - 1), 0)
    total = int(counts.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64)
    begin = np.repeat(words.first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(total)
    at = np.arange(len(words.hashes) - gram + 1)
    grams = span_hashes(words.hashes, at, at + gram)
    span = size - gram + 1
    least = _sliding(grams, span, np.minimum)
    own = least[begin]
    top = np.zeros(len(least), np.uint64)  # windows across two rows do not count
    top[begin] = own
    padded = np.concatenate([np.zeros(span - 1, np.uint64), top, np.zeros(span - 1, np.uint64)])
    anchor = _sliding(padded, span, np.maximum) == grams
    return begin, own, grams[anchor]


def sketch_windows(docs: DataFrame, size: int, gram: int, max_bits: int) -> Repeats:
    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in text_blocks(batch):
            yield _keys(words_of(data, offsets), size, gram)[2]

    # About one word in (size - gram + 2) / 2 is an anchor, and a word has about six bytes.
    return count(docs, keys_of, width_for(total_bytes(docs) / (3 * (size - gram + 2)), max_bits))


def _first_in_row(words: Words, begin: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indices of the windows that no earlier window of their row equals."""
    _, first = np.unique(hashes ^ mix(words.row_of()[begin].astype(np.uint64) + np.uint64(1)), return_index=True)
    return np.sort(first)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20, gram: int = 8, max_bits: int = 28) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (the words left, joined by one space)."""
    spark = df.sparkSession
    docs = _keyed(id_text(df, id_col, text_col))
    seen = spark.sparkContext.broadcast(sketch_windows(docs.select("doc_id", "text"), size, gram, max_bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_key").to_numpy()
            for a, _, data, offsets in text_blocks(batch):
                words = words_of(data, offsets)
                begin, own, _ = _keys(words, size, gram)
                begin = begin[seen.value.may_repeat(own)]
                hashes = span_hashes(words.hashes, begin, begin + size)
                first = _first_in_row(words, begin, hashes)
                begin, hashes = begin[first], hashes[first]
                row = words.row_of()[begin]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids[a + row]), pa.array((begin - words.first[row]).astype(np.int32))], ["window", "doc_key", "start"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost_list = batch.column("lost")
            for a, b, data, offsets in text_blocks(batch):
                words = words_of(data, offsets)
                n = len(words.starts)
                begin, hashes = windows_of(words, size)
                later = np.ones(len(begin), bool)
                later[_first_in_row(words, begin, hashes)] = False
                own = lost_list.slice(a, b - a)
                sizes = np.array([0 if x is None else x for x in pc.list_value_length(own).to_pylist()], np.int64)
                given = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.first[:-1], sizes)
                gone = covered(n, np.concatenate([begin[later], given[given < n]]), size) if n else np.zeros(0, bool)
                kept, counts, removed = [], np.diff(words.first), np.zeros(b - a, np.int64)
                text = data.tobytes()
                for i in range(b - a):
                    tokens = text[offsets[i] : offsets[i + 1]].split()
                    mask = gone[words.first[i] : words.first[i + 1]]
                    if mask.any():
                        removed[i] = mask.sum()
                        tokens = [t for t, g in zip(tokens, mask.tolist(), strict=True) if not g]
                    kept.append(b" ".join(tokens).decode())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(counts), pa.array(removed), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    found = docs.select("doc_key", "text").mapInArrow(candidates, "window long, doc_key long, start int")
    owners = found.groupBy("window").agg(F.min("doc_key").alias("owner"), F.max("doc_key").alias("other")).where("owner <> other").select("window", "owner")
    # Both sides are dealt by window; a window that very many documents share is a skewed partition that AQE splits.
    lost = found.join(owners.hint("merge"), "window").where("doc_key <> owner").groupBy("doc_key").agg(F.collect_list("start").alias("lost"))
    return docs.join(lost.hint("merge"), "doc_key", "left").select("doc_id", "text", "lost").mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_text string")
