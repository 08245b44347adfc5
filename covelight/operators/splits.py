"""Splits: which subjects each method gives to each target, as rows (kind, method, budget, rank, pos)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.scoring import unit
from .clustering import domain_selection, inconsistent_clusters, uncertainty_clusters, weighted_support
from .constraints import missing_ids, require
from .curation import with_query
from .greedy import coverage_greedy, k_center
from .ranking import number_rows, random_subset
from .subjects import acquisition_weights

#: Fixed value: what the target-oriented baseline takes off for likeness to its own picks.
ORIENT_PENALTY = 0.08
#: Fixed value: rows of a target split.
TARGET_BUDGET = 10
SCHEMA = "kind string, method string, budget int, rank int, pos long"


def for_targets(rows: DataFrame, targets: Sequence[str] | str, column: str = "target") -> DataFrame:
    """The rows of the named targets; "all" keeps every row."""
    return rows if targets == "all" else rows.where(F.col(column).isin([targets] if isinstance(targets, str) else list(targets)))


def present_slices(slices: DataFrame, foreground: str, skip_empty: bool = True) -> DataFrame:
    """Slices with some foreground, or all of them if not skip_empty; a null foreground counts as none."""
    return slices.where(F.coalesce(F.col(foreground) > 0, F.lit(False))) if skip_empty else slices


def subject_rows(slices: DataFrame, subject: str, *order: str) -> DataFrame:
    """(subject, rows): the numbers of each subject's rows in the given order over all rows, ascending."""
    return number_rows(slices.select(subject, *order), *order, out="_row").groupBy(subject).agg(F.sort_array(F.collect_list("_row")).alias("rows"))


def subject_gradient(gradients: DataFrame, keys: Sequence[str], vector: str = "v", weight: str = "n") -> DataFrame:
    """keys, gradient: the mean of slice (or batch mean) gradients weighted by their numbers of slices, at unit length."""
    parts = gradients.select(*keys, F.col(weight).cast("double").alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    sums = parts.groupBy(*keys, "_i").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"))
    whole = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_g"))
    return whole.select(*keys, F.transform("_g", lambda s: s["_m"]).alias("_g")).select(*keys, unit("_g").alias("gradient"))


def full_source(source: DataFrame, order: str = "pos") -> DataFrame:
    """(rank, pos): every row, in the order of the pool."""
    return number_rows(source.select("pos", *({order} - {"pos"})), order, out="rank", first=1).select(F.col("rank").cast("int").alias("rank"), "pos")


def orient(source: DataFrame, target: DataFrame, picks: DataFrame, budget: int) -> DataFrame:
    """(rank, pos): coverage greedy over source (pos, v) towards those rows of target that another method has picked.

    picks without a row in target raise. It always makes `budget` picks, at negative values too.
    """
    require(missing_ids(picks, target, "pos"), "picked targets without a vector")
    chosen = target.join(picks.select("pos"), "pos", "left_semi").select("pos", "v")
    return coverage_greedy(cut(with_query(source, chosen)), budget, ORIENT_PENALTY).select("rank", "pos")


def target_methods(state: DataFrame, source: DataFrame, name: str, factor: int = 10) -> dict[str, Callable[[int], DataFrame]]:
    """Each target method as a function of its budget that gives (rank, pos). state: pos, v, uncertainty, foreground,
    inconsistency, consistency and, where it is known, domain_score; name: the target's, from which random draws are seeded."""
    scored = lambda weight: state.select("pos", "v", F.col(weight).alias("weight"))

    def domain(budget: int) -> DataFrame:
        if "domain_score" in state.columns:
            best = state.orderBy(F.desc("domain_score"), F.asc("pos")).limit(budget)
            return number_rows(best.select("pos", "domain_score"), F.desc("domain_score"), F.asc("pos"), out="rank", first=1).select(F.col("rank").cast("int").alias("rank"), "pos")
        return domain_selection(source, scored("uncertainty"), budget).select("rank", "pos")

    def anchored(budget: int) -> DataFrame:
        weighed = acquisition_weights(state, "uncertainty", "foreground", "inconsistency", "consistency")
        return weighted_support(weighed.select("pos", "v", "weight"), budget)

    return {
        **{f"random{i}": (lambda budget, i=i: random_subset(state.select("pos"), "pos", budget, f"{i}:{name}").select("rank", "pos")) for i in (1, 2, 3)},
        "coreset": lambda budget: k_center(state.select("pos", "v"), budget).select("rank", "pos"),
        "lada": lambda budget: inconsistent_clusters(scored("inconsistency"), budget, factor),
        "aada": domain,
        "ada_clue": lambda budget: uncertainty_clusters(scored("uncertainty"), budget),
        "anchored": anchored,
    }


def _rows(picks: DataFrame, kind: str, method: str, budget: int | None) -> DataFrame:
    return cut(picks.select(F.lit(kind).alias("kind"), F.lit(method).alias("method"), F.lit(budget).cast("int").alias("budget"), F.col("rank").cast("int").alias("rank"), F.col("pos").cast("long").alias("pos")))


def all_splits(
    source: DataFrame, state: DataFrame, name: str, budgets: Sequence[int], anchored: Callable[[int], DataFrame] | None = None, methods: Sequence[str] | None = None, target_budget: int = TARGET_BUDGET
) -> DataFrame:
    """Every split of one target, rows of SCHEMA: the target methods' splits, the source baselines at each budget (the
    whole source once, with a null budget), the anchored selection (a function of the budget, if given) and, for each
    target method but the anchored one, the oriented baseline towards its picks."""
    source, state = cut(source), cut(state)  # every method reads them, some many times
    found = target_methods(state, source, name)
    out = [_rows(found[m](target_budget), "target", m, target_budget) for m in (methods or found)]
    picks = dict(zip(methods or found, out, strict=True))
    out.append(_rows(full_source(source), "source", "full_source", None))
    for budget in budgets:
        for i in (1, 2, 3):
            out.append(_rows(random_subset(source.select("pos"), "pos", budget, f"{i}:{name}:{budget}"), "source", f"random{i}", budget))
        out.append(_rows(k_center(source.select("pos", "v"), budget), "source", "coreset", budget))
        if anchored:
            out.append(_rows(anchored(budget), "source", "anchored", budget))
        for m in picks:
            if m != "anchored":
                out.append(_rows(orient(source, state, picks[m], budget), "source", f"orient_{m}", budget))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def eval_splits(rows: DataFrame, kinds: Sequence[str] = ("val", "test")) -> DataFrame:
    """The evaluation lists as they are: rows of `kinds` with their order; target, kind, rank, subject_id."""
    return rows.where(F.col("kind").isin(list(kinds))).select("target", "kind", "rank", "subject_id")
