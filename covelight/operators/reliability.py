"""Fusion weights of the prototype, gradient and match scores by their reliability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.scoring import normalize, softmax
from .ranking import random_subset, stability
from .similarity import query_match


def support_subsets(support: DataFrame, draws: int = 8, share: float = 0.8, seed: int = 2025, key: str = "pos") -> list[DataFrame]:
    """`draws` subsets of max(2, round(share * n)) rows, each in the order of md5(seed:draw:key); none of two rows or fewer."""
    n = support.count()
    if n <= 2:
        return []
    keep = max(2, round(share * n))
    return [random_subset(support, key, keep, f"{seed}:{i}").drop("rank") for i in range(draws)]


def adaptive_reliability_weights(
    scores: DataFrame, source: DataFrame, support: DataFrame, prior: str, checkpoints: Sequence[str], top: int = 150, temperature: float = 1.0, match_top: int = 8, draws: int = 8, seed: int = 2025
) -> DataFrame:
    """One row (w_p, w_g, w_m): softmax of the reliabilities of P, G and M. scores: pos, `prior` (P) and a column for each
    checkpoint's gradient scores; source: pos, v; support: pos, v, weight. P's is half of one plus its deviation. G is the
    checkpoints' mean, min-max scaled, and its variants each of them scaled; M is the match with the support, and its
    variants the matches with subsets of it. Their reliability is the stability against the variants on the `top` rows."""
    wide = scores.select("pos", prior, *checkpoints).join(source.select("pos"), "pos", "left_semi")
    mean = sum((F.col(c).cast("double") for c in checkpoints), F.lit(0.0)) / max(len(checkpoints), 1)
    wide = normalize(wide.withColumn("_g", mean), "_g")
    g = [f"_g{i}" for i in range(len(checkpoints))]
    for name, c in zip(g, checkpoints, strict=True):
        wide = normalize(wide, c, name)
    matched = source.join(scores.select("pos"), "pos", "left_semi")
    subsets = support_subsets(support, draws, seed=seed)
    m = [f"_m{i}" for i in range(len(subsets))]
    for name, part in zip(["_m", *m], [support, *subsets], strict=True):
        wide = wide.join(query_match(matched, part, match_top).select("pos", F.col("match").alias(name)), "pos")
    wide = cut(wide)
    p = wide.agg((0.5 + 0.5 * F.stddev_pop(prior)).alias("p"))
    both = stability(wide, "_g", g, top).withColumnRenamed("stability", "g").crossJoin(stability(wide, "_m", m, top).withColumnRenamed("stability", "m"))
    weights = softmax([F.col(c) for c in ("p", "g", "m")], temperature)
    return p.crossJoin(both).select(*[w.alias(n) for n, w in zip(("w_p", "w_g", "w_m"), weights, strict=True)])
