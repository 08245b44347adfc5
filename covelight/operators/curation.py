"""Target-anchored source selection: signals, diagnostics and gates, consensus groups, quota seeds, seeded greedy."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.scoring import gate_activation, power_gates, sigmoid
from .greedy import Redundancy, coverage_greedy, greedy, mutual_information, rank_scores
from .ranking import agreement, membership, overlap_fraction, top_k
from .similarity import centroid_alignment, coverage_trust, low_density_flag, query_match, source_density, support_similarities
from .clustering import source_clusters

#: Above this share of the influence top that the late top lacks, late influence takes over.
LATE_SWITCH = 0.08


#: Which greedy each backend's name stands for. `auto` is always coverage: a default must not hang on what is installed.
BACKENDS = {"auto": "coverage", "numpy": "coverage", "coverage": "coverage", "submodlib": "mutual_information", "mutual_information": "mutual_information"}


@dataclass(frozen=True)
class SelectorConfig:
    """Constants of the selector. The first 23 have the names, fixed values, of its configuration files, and their values but for the backend, `auto` there."""

    budget: int = 150
    top_utility_pool: int = 500
    top_signal_pool: int = 220
    top_facility_pool: int = 250
    facility_backend: str = "coverage"
    facility_magnification_eta: float = 1.0
    facility_stop_if_negative_gain: bool = False
    facility_show_progress: bool = False
    gate_power: float = 4.0
    gate_temperature: float = 0.05
    sparse_rho0: float = 0.60
    sparse_tau: float = 0.08
    coverage_alignment0: float = 0.28
    coverage_alignment_tau: float = 0.04
    barrier_weight: float = 10.0
    redundancy_lambda: float = 0.08
    sparse_match_weight: float = 0.05
    sparse_low_density_weight: float = 0.02
    consensus_multi_quota: int = 45
    consensus_facility_intercept: float = 50.0
    consensus_facility_late_slope: float = 60.0
    consensus_signal_intercept: float = 15.0
    consensus_signal_late_slope: float = 30.0
    clusters: int = 32
    match_top: int = 8

    def __post_init__(self) -> None:
        if self.budget <= 0:
            raise ValueError("the budget must be positive")
        if self.facility_backend not in BACKENDS:
            raise ValueError(f"no facility backend {self.facility_backend!r}")


def with_query(source: DataFrame, support: DataFrame) -> DataFrame:
    """source with q: its clipped similarities to the support rows (a stated set of a few rows), in their pos order."""
    return support_similarities(source, support)


def facility_order(source: DataFrame, support: DataFrame, config: SelectorConfig) -> DataFrame:
    """(rank, pos, value): the facility pool in the order in which the backend picks it."""
    pool = cut(with_query(source, support))  # each scan of the greedy reads it again
    if BACKENDS[config.facility_backend] == "coverage":
        return coverage_greedy(pool, config.top_facility_pool, config.redundancy_lambda)
    return mutual_information(pool, config.top_facility_pool, config.facility_magnification_eta, config.facility_stop_if_negative_gain)


def signals(source: DataFrame, support: DataFrame, scores: DataFrame, config: SelectorConfig) -> DataFrame:
    """One wide row per source row: pos, v, R, I, L (from scores), M, D, density_raw, F, A, cluster."""
    source, support, scores = cut(source), cut(support), cut(scores)  # each signal reads them again
    density = source_density(source)
    match = query_match(source, support, config.match_top).select("pos", F.col("match").alias("M"))
    order = cut(facility_order(source, support, config))
    picked = source.join(F.broadcast(order.select("pos")), "pos", "left_semi")
    wide = source.join(scores, "pos").join(density.select("pos", "density_raw", F.col("density").alias("D")), "pos").join(match, "pos")
    wide = wide.join(rank_scores(order, source).withColumnRenamed("facility", "F"), "pos").join(centroid_alignment(source, picked).withColumnRenamed("alignment", "A"), "pos")
    return cut(wide.join(source_clusters(source, config.clusters), "pos"))


def tops(wide: DataFrame, config: SelectorConfig) -> DataFrame:
    """wide with r_top, i_top, l_top, H (the influence in use), h_top, f_top, u_top and late_distinctness on every row."""
    k = config.top_signal_pool
    flagged = membership(wide, {"r_top": ("R", k), "i_top": ("I", k), "l_top": ("L", k), "f_top": ("F", config.top_facility_pool), "u_top": ("R", config.top_utility_pool)})
    late = flagged.agg((1.0 - overlap_fraction("i_top", "l_top")).alias("late_distinctness"))
    both = flagged.crossJoin(F.broadcast(late))
    use = F.col("late_distinctness") > LATE_SWITCH
    return cut(both.withColumn("H", F.when(use, F.col("L")).otherwise(F.col("I"))).withColumn("h_top", F.when(use, F.col("l_top")).otherwise(F.col("i_top"))))


def diagnostics(flagged: DataFrame, trust: DataFrame, config: SelectorConfig) -> DataFrame:
    """One row: trust, late distinctness, alignment, strengths, gates and activations."""
    sums = flagged.agg(
        F.max("late_distinctness").alias("late_distinctness"),
        ((overlap_fraction("r_top", "f_top") + overlap_fraction("h_top", "f_top")) / 2).alias("alignment"),
        agreement("r_top", "h_top", "f_top").alias("agreement"),
    ).crossJoin(trust)
    sparse = sigmoid((config.sparse_rho0 - F.col("trust")) / config.sparse_tau)
    row = sums.withColumn("s_sparse", sparse)
    row = row.withColumn("s_coverage", (1 - F.col("s_sparse")) * sigmoid((F.col("alignment") - config.coverage_alignment0) / config.coverage_alignment_tau))
    row = row.withColumn("s_consensus", (1 - F.col("s_sparse")) * (1 - F.col("s_coverage")) * F.col("agreement"))
    names = ("sparse", "coverage", "consensus")
    for name, gate in zip(names, power_gates([F.col(f"s_{n}") for n in names], config.gate_power), strict=True):
        row = row.withColumn(f"gate_{name}", gate)
    for name in names:
        row = row.withColumn(f"a_{name}", gate_activation(f"gate_{name}", config.gate_temperature))
    return row


def consensus(flagged: DataFrame) -> DataFrame:
    """flagged with multi (in two of the three tops or more), consensus score and group (null outside the tops)."""
    d = F.col("late_distinctness")
    votes = F.col("r_top").cast("int") + F.col("h_top").cast("int") + F.col("f_top").cast("int")
    scored = flagged.withColumn("multi", votes >= 2)
    score = (0.20 + 0.05 * d) * F.col("R") + (0.15 + 0.05 * d) * F.col("H") + 0.15 * F.col("D") + 0.20 * F.col("A") + (0.20 - 0.05 * d) * F.col("f_top").cast("double") + (0.10 - 0.05 * d) * F.col("multi").cast("double")
    group = F.when(F.col("multi"), "multi").when(F.col("f_top"), "facility_only").when(F.col("r_top"), "reliability_only").when(F.col("h_top"), "influence_only")
    return scored.withColumn("consensus", score).withColumn("group", group)


def group_quotas(late_distinctness: float, config: SelectorConfig) -> dict[str, int]:
    """Seeds of each group at full scale; halves round to even."""
    signal = max(0, round(config.consensus_signal_intercept + config.consensus_signal_late_slope * late_distinctness))
    return {"multi": config.consensus_multi_quota, "facility_only": max(0, round(config.consensus_facility_intercept - config.consensus_facility_late_slope * late_distinctness)), "reliability_only": signal, "influence_only": signal}


def cluster_quotas(mass: dict[int, float], members: int, budget: int) -> dict[int, int]:
    """Shares of `budget` by mass, at least one each: while they are too many the first largest gives one up (never its last),
    while too few the largest remainder gains one, whether or not its cluster has that many rows."""
    labels, total = sorted(mass), sum(mass.values())
    quota = {c: max(1, math.floor(budget * mass[c] / total)) for c in labels}
    while sum(quota.values()) > budget:
        most = max(labels, key=quota.__getitem__)
        if quota[most] == 1:
            break
        quota[most] -= 1
    while sum(quota.values()) < min(budget, members):
        quota[max(labels, key=lambda c: budget * mass[c] / total - quota[c])] += 1
    return quota


def quota_seeds(grouped: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(group, pos, score, place): for each group its quota of rows, spread over clusters, best first.
    Only one sum per group and cluster (four times the number of clusters at most) reaches the driver."""
    wanted = {g: q for g, q in quotas.items() if q > 0}
    sums = grouped.where(F.col("group").isin(list(wanted))).groupBy("group", "cluster").agg((F.sum(F.greatest("consensus", F.lit(0.0))) + 1e-8).alias("mass"), F.count(F.lit(1)).alias("n")).collect()
    rows = []
    for g, budget in wanted.items():
        own = [r for r in sums if r["group"] == g]
        if own:
            quota = cluster_quotas({r["cluster"]: r["mass"] for r in own}, sum(r["n"] for r in own), budget)
            rows += [(g, c, q, budget) for c, q in quota.items()]
    spark = grouped.sparkSession
    limits = spark.createDataFrame(rows, "group string, cluster int, quota int, budget int")
    ranked = top_k(grouped.select("group", F.col("cluster").cast("int").alias("cluster"), "pos", F.col("consensus").alias("score")).where(F.col("group").isNotNull()), "score", max([q for *_, q, _ in rows], default=0), ["group", "cluster"])
    kept = ranked.join(F.broadcast(limits), ["group", "cluster"]).where(F.col("rank") <= F.col("quota")).drop("rank")
    placed = top_k(kept, "score", max(wanted.values(), default=0), ["group"])
    return placed.where(F.col("rank") <= F.col("budget")).select("group", "pos", "score", F.col("rank").alias("place"))


def base_scores(grouped: DataFrame, diag: DataFrame, config: SelectorConfig) -> DataFrame:
    """grouped with low_density, sparse and base."""
    rows = low_density_flag(grouped).withColumn("low_density", F.col("low_density").cast("double"))
    rows = rows.crossJoin(F.broadcast(diag.select("a_sparse", "a_coverage", "a_consensus")))
    sparse = F.col("R") + config.sparse_match_weight * F.col("M") + config.sparse_low_density_weight * F.col("low_density")
    barrier = lambda flag: config.barrier_weight * (1.0 - F.col(flag).cast("double"))
    base = F.col("a_sparse") * (sparse - barrier("u_top")) + F.col("a_coverage") * (F.col("R") - barrier("f_top")) + F.col("a_consensus") * F.col("consensus")
    return rows.withColumn("sparse", sparse).withColumn("base", base)


@dataclass
class Selection:
    """picks: (rank, pos, score, R, I, L, M, D, F, A, flags); diagnostics: one row."""

    picks: DataFrame
    diagnostics: DataFrame
    grouped: DataFrame


def select_sources(source: DataFrame, support: DataFrame, scores: DataFrame, config: SelectorConfig | None = None) -> Selection:
    """The whole selection. source: pos, v; support: pos, v, weight; scores: pos, R, I, L."""
    config = config or SelectorConfig()
    source, support = cut(source), cut(support)
    flagged = tops(signals(source, support, scores, config), config)
    diag = cut(diagnostics(flagged, coverage_trust(source, support), config))
    grouped = cut(base_scores(consensus(flagged), diag, config))
    found = diag.select("late_distinctness", "a_consensus").first()
    quotas = {g: round(found["a_consensus"] * q) for g, q in group_quotas(found["late_distinctness"], config).items()}
    seeds = quota_seeds(grouped, quotas).orderBy(F.desc("score"), F.asc("pos")).select("pos").distinct().join(grouped.select("pos", "consensus"), "pos").orderBy(F.desc("consensus"), F.asc("pos")).limit(config.budget)
    order = [r["pos"] for r in seeds.collect()]
    pool = grouped.where("u_top or r_top or h_top or f_top").select("pos", "v", "base")
    picks = greedy(pool, config.budget, Redundancy(penalty=config.redundancy_lambda), order)
    keep = ("base", "R", "I", "L", "M", "D", "F", "A", "r_top", "h_top", "f_top", "multi")
    return Selection(picks.select("rank", "pos").join(grouped.select("pos", *keep), "pos").withColumnRenamed("base", "score"), diag, grouped)


def signal_means(picks: DataFrame) -> DataFrame:
    """One row: means of the seven signals over the selection, 0 for an empty one."""
    return picks.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ("R", "I", "L", "M", "D", "F", "A")])


def selected_counts(picks: DataFrame) -> DataFrame:
    """One row: picks in each top and in several."""
    return picks.agg(*[F.count_if(c).alias(f"n_{c}") for c in ("r_top", "h_top", "f_top", "multi")], F.count(F.lit(1)).alias("n"))
