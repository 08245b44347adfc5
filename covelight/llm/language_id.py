"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three lower-cased characters (anything but a letter counts as a space), with
1 + log(count) times the inverse document frequency, scaled to length one. The document frequencies are summed over
every document that may be learned from. Weights come from the follow-the-regularised-leader rule with L1 and L2
penalties on a bounded sample (`max_train` documents, spread over the languages, chosen by a hash of the id); a
fifth of the sample is held back to fit the temperature of the softmax.

Rows whose crc32(id as text) mod 3 is 1 are held out: neither their text nor their label is learned from; rows with
a null id or label teach nothing either. A null text or one without a letter is `und` with score 0, as is every
row when there is nothing to learn from. Ties go to the language that sorts first. Texts are read whole; repeated rows get
repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_SPLITS = 1_000_003


@dataclass(frozen=True)
class LanguageModel:
    """weights: buckets x languages, already times the inverse document frequency apart."""

    langs: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def counts_of(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's n-grams; none where it has no letter."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return none
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    chars = np.where(_is_letter()[chars], chars, np.uint64(0))
    if not chars.any():
        return none
    chars = np.concatenate([[np.uint64(0)], chars, [np.uint64(0)]]).astype(np.uint64)
    one, two = chars[1:-1], chars[1:] * np.uint64(0x9E3779B97F4A7C15)
    pair = chars[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + two
    three = pair[:-1] * np.uint64(0x165667B19E3779F9) + chars[2:] * np.uint64(0xFF51AFD7ED558CCD)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    grams = [(one * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))[one > 0], pair[(chars[:-1] > 0) | (chars[1:] > 0)], three[(chars[:-2] > 0) | (chars[1:-1] > 0) | (chars[2:] > 0)]]
    got = np.concatenate([(((g ^ (g >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)) >> shift).astype(np.int64) for g in grams])
    counts = np.bincount(got, minlength=buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def _held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def _frequencies(docs: DataFrame, buckets: int) -> tuple[int, np.ndarray]:
    """Number of documents and document frequency of each bucket, over all of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                at, _ = counts_of(text.as_py(), buckets)
                seen[at] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["bucket", "n"])

    # At most buckets + 1 rows come back, whatever the number of documents.
    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found, total = np.zeros(buckets, np.int64), 0
    for bucket, n in rows:
        if bucket < 0:
            total = n
        else:
            found[bucket] = n
    return total, found


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, k: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax over k classes; each row is (buckets, values, class)."""
    z, n = np.zeros((buckets + 1, k)), np.zeros((buckets + 1, k))

    def weight(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, buckets), np.append(x, 1.0)
            w = weight(at)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(buckets + 1))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The softmax temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 14, max_train: int = 4000) -> LanguageModel | None:
    """Learn from the rows that are not held out; None where there are none. At most about max_train documents' features
    reach the driver (a hash of the id picks them, so the number varies by chance around the bound). Every language of these
    rows is a class: learning holds 16 bytes a bucket and language (262 KB a language with 16,384 buckets), the model 4."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~_held_out())
    many = docs.groupBy("lang").count().collect()
    if not many:
        return None
    langs = tuple(sorted(r["lang"] for r in many))
    total, seen = _frequencies(docs, buckets)
    idf = np.log((1 + total) / (1 + seen)) + 1
    share = F.create_map(*[F.lit(v) for r in many for v in (r["lang"], min(1.0, max_train / len(many) / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(_SPLITS))
    picked = docs.where(draw < F.element_at(share, F.col("lang")) * _SPLITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [counts_of(t.as_py(), buckets) for t in batch.column("text")]
            arrays = [batch.column("doc_id"), batch.column("lang"), pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "at", "counts"])

    rows = picked.mapInArrow(run, "doc_id long, lang string, at binary, counts binary").collect()
    number = {lang: k for k, lang in enumerate(langs)}
    train, hold = [], []
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["at"])):
        at = np.frombuffer(r["at"], np.int32).astype(np.int64)
        if len(at):
            x = vector(at, np.frombuffer(r["counts"], np.int32), idf)
            (hold if r["doc_id"] // 3 % 5 == 0 else train).append((at, x, number[r["lang"]]))
    weights, bias = ftrl(train, buckets, len(langs))
    logits = np.array([x @ weights[at] + bias for at, x, _ in hold]).reshape(len(hold), len(langs))
    return LanguageModel(langs, idf.astype(np.float32), weights.astype(np.float32), bias, _temperature(logits, np.array([y for *_, y in hold], np.int64)))


def classify(model: LanguageModel | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs, scores = [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        at, counts = counts_of(text.as_py(), len(model.idf)) if model else ((), ())
        if not len(at):
            langs.append(UNKNOWN)
            continue
        s = (vector(at, counts, model.idf) @ model.weights[at] + model.bias) / model.temperature
        p = np.exp(s - s.max())
        k = int(p.argmax())
        langs.append(model.langs[k])
        scores[i] = p[k] / p.sum()
    return langs, scores


def identify(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score. The model, of a fixed number of buckets, goes to the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = classify(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", _held_out())
    return docs.mapInArrow(run, SCHEMA)


def keep_identified(df: DataFrame, model: LanguageModel | None, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known with at least min_score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = classify(model, batch.column(text_col))
            yield batch.filter(pa.array([lang != UNKNOWN and s >= min_score for lang, s in zip(langs, scores, strict=True)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
