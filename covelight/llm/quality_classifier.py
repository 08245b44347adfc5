"""Quality by hierarchical empirical Bayes: a document's own evidence over the posterior of its site and path.

* Evidence: a few measures of the whole text, each cut into fixed bins; the log-likelihood ratio of a bin comes from
  counts over all labelled documents (one grouped sum, add-one smoothed), and a document's evidence is `share` times the
  sum over its measures (the measures overlap, so their plain sum would be too sure).
* Sites: each host, and each path in a host, has a number of good and of all documents: labelled ones count 1, others
  count `soft` with the chance their evidence gives. A host's rate is shrunk to the global rate, a path's to its host's,
  by concentrations that the spread between the groups gives (analysis of variance, beta-binomial). Sparse sites so
  stay near the prior.
* Quality is the logistic of evidence plus the path's log odds; kept means `cut_off` or more.

The document table's `source` is the host and `lang` the path by default. All counts are grouped sums over all documents;
only totals and the bins' table (measures x bins) reach the driver. A null text has the evidence of an empty one; a null host
or path is a group of its own; labels that are null or of unknown documents count for nothing and repeated labels
are averaged. Without labels the global rate is one half and evidence 0. Repeated rows get repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_blocks
from .quality_rules import judge
from .wordhash import words_of

#: Inner bin edges of each measure.
EDGES = {
    "words": (5, 15, 30, 60, 150, 400, 1500),
    "symbols": (0.002, 0.01, 0.03, 0.06, 0.12, 0.2),
    "repeats": (0.01, 0.05, 0.1, 0.2, 0.4, 0.7),
    "bad_lines": (0.05, 0.2, 0.4, 0.6, 0.9),
    "capitals": (0.02, 0.05, 0.1, 0.3, 0.6),
    "word_length": (3.0, 3.8, 4.5, 5.5, 7.0, 9.0),
    "variety": (0.1, 0.25, 0.4, 0.55, 0.7, 0.85),
}
_BINS = max(map(len, EDGES.values())) + 1
_UPPER = np.array([65 <= c <= 90 for c in range(256)])


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    got = judge(data, offsets)
    words = words_of(data, offsets)
    n = np.maximum(got["n_words"], 1)
    chars = np.maximum(got["word_chars"], 1)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
    distinct = np.array([len(np.unique(words.hashes[a:b])) for a, b in zip(words.first, words.first[1:], strict=False)])
    return {
        "words": got["n_words"], "symbols": got["n_symbols"] / chars, "repeats": got["n_repeat_words"] / n, "bad_lines": 1 - got["kept_chars"] / chars,
        "capitals": np.diff(upper[offsets]) / chars, "word_length": got["word_chars"] / n, "variety": distinct / n,
    }


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _concentration(groups: DataFrame, good: str, all_: str, parent: Column) -> float:
    """Concentration of the beta prior of the groups' rates around their parent's, from sums over the groups."""
    n, rate = F.col(all_), F.col(good) / F.col(all_)
    between, within = F.sum(n * (rate - parent) ** 2), F.sum(n * rate * (1 - rate))
    b, w, total, squares, count = groups.where(n > 0).agg(between, within, F.sum(n), F.sum(n * n), F.count(F.lit(1))).first()
    if not count or count < 2 or total <= count:
        return 10.0
    msb, msw, n0 = b / (count - 1), w / (total - count), (total - squares / total) / (count - 1)
    rho = (msb - msw) / (msb + (n0 - 1) * msw) if msb + (n0 - 1) * msw > 0 else 0.0
    return float(1 / np.clip(rho, 1e-4, 0.9) - 1)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_id: str = "doc_id", label_col: str = "quality", share: float = 0.6, soft: float = 0.2, cut_off: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, evidence, host_rate, path_rate, quality, kept."""
    names = list(EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch):
                got = measures(data, offsets)
                bins = [pa.array(np.searchsorted(EDGES[m], got[m], "right").astype(np.int32)) for m in names]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("doc_id", "host", "path")] + bins, ["doc_id", "host", "path", *names])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))
    seen = docs.select("doc_id", "host", "path", "text").mapInArrow(run, "doc_id long, host string, path string, " + ", ".join(f"{m} int" for m in names))
    known = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    rows = cut(seen.join(known, "doc_id", "left"))

    good, every = F.sum("label"), F.count("label")
    k, n = rows.agg(good, every).first()
    rate = ((k or 0) + 1) / (n + 2)
    tall = rows.where("label is not null").select("label", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(m).alias("bin")) for i, m in enumerate(names)])).alias("f"))
    ratios = np.zeros((len(names), _BINS))
    for m, b, x, y in tall.groupBy("f.m", "f.bin").agg(F.sum("label"), F.sum(1 - F.col("label"))).collect():  # measures x bins rows
        ratios[m, b] = np.log((x + 1) / ((k or 0) + _BINS)) - np.log((y + 1) / (n - (k or 0) + _BINS))
    pick = lambda i, m: F.element_at(F.array(*[F.lit(float(v)) for v in ratios[i]]), F.col(m) + 1)
    scored = rows.withColumn("evidence", share * sum((pick(i, m) for i, m in enumerate(names)), F.lit(0.0)))
    chance = 1 / (1 + F.exp(-F.col("evidence") - float(np.log(rate / (1 - rate)))))
    weight = F.when(F.col("label").isNull(), soft).otherwise(1.0)
    paths = cut(scored.groupBy("host", "path").agg(F.sum(weight * F.coalesce("label", chance)).alias("good"), F.sum(weight).alias("all")))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("all").alias("host_all"))
    m1 = _concentration(hosts, "host_good", "host_all", F.lit(rate))
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + m1 * rate) / (F.col("host_all") + m1))
    placed = paths.join(hosts, "host")
    m2 = _concentration(placed, "good", "all", F.col("host_rate"))
    sites = cut(placed.select("host", "path", "host_rate", ((F.col("good") + m2 * F.col("host_rate")) / (F.col("all") + m2)).alias("path_rate")))
    # One row a site; a site with a third of all documents is a skewed partition of this join, which AQE splits.
    both = scored.join(sites, ["host", "path"])
    quality = 1 / (1 + F.exp(-F.col("evidence") - _logit(F.col("path_rate"))))
    return both.select("doc_id", "evidence", "host_rate", "path_rate", quality.alias("quality")).withColumn("kept", F.col("quality") >= cut_off)
