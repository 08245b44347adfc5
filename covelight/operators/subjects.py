"""From slices to subjects: top-fraction means, morphology, influence and acquisition weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.scoring import clipped_cosine, mean_vector, normalize, unit
from .ranking import number_rows
from .similarity import bounded


def slice_ranking(foreground: str, entropy: str, weight: float = 0.25) -> Column:
    return F.col(foreground) + weight * F.col(entropy)


#: A subject is hot with more slices than this, and than one in HOT_PART of all; so at most HOT_PART subjects are.
HOT_ROWS, HOT_PART = 1_000_000, 4096


def _best_fraction(slices: DataFrame, subject: str, pos: Sequence[str], ranking: str, ratio: float, least: int) -> DataFrame:
    """The min(max(ceil(ratio * n), least), n) best-ranked slices of each subject; earlier slices win ties.

    A subject's slices are ranked where they meet, but for hot subjects: theirs are counted in a histogram between their lowest
    and highest value, bins above the one that holds the last slice go in as a whole, and the slices of that bin alone
    are ranked, by ranges. No task sorts a hot subject."""
    wanted = F.least(F.greatest(F.ceil(F.lit(ratio) * F.col("_n")), F.lit(least)), F.col("_n"))
    sizes = slices.groupBy(subject).agg(F.count(F.lit(1)).alias("_n"), F.min(F.col(ranking).cast("double")).alias("_low"), F.max(F.col(ranking).cast("double")).alias("_high"))
    most, total = sizes.where(F.col(subject).isNotNull()).agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if most <= (share := max(HOT_ROWS, total / HOT_PART)):
        return _ranked(slices, subject, pos, ranking).where(F.col("_r") <= wanted).drop("_n", "_r")
    hot = F.broadcast(cut(sizes.where((F.col("_n") > share) & F.col(subject).isNotNull()).withColumn("_k", wanted)))
    rest = _ranked(slices.join(hot.select(subject), subject, "left_anti"), subject, pos, ranking).where(F.col("_r") <= wanted)
    return rest.drop("_n", "_r").unionByName(_best_of_hot(slices.join(hot, subject), subject, pos, ranking))


def _ranked(slices: DataFrame, subject: str, pos: Sequence[str], ranking: str) -> DataFrame:
    w = Window.partitionBy(subject)
    return slices.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(ranking), *[F.asc(p) for p in pos])))


def _best_of_hot(slices: DataFrame, subject: str, pos: Sequence[str], ranking: str, bins: int = 4096) -> DataFrame:
    """slices: with _n, _low, _high and _k, the number wanted. Null and NaN rankings come last and first, as in a sort."""
    x = F.col(ranking).cast("double")
    scaled = F.floor((x - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * bins)
    place = F.when(x.isNull(), -1).when(F.isnan(x), bins + 1).otherwise(F.coalesce(scaled, F.lit(0))).cast("int")
    slices = cut(slices.withColumn("_bin", place))
    counts = slices.groupBy(subject, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.max("_k").alias("_k"))  # at most bins + 2 rows a hot subject
    above = F.coalesce(F.sum("_c").over(Window.partitionBy(subject).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = counts.withColumn("_above", above).where((F.col("_above") < F.col("_k")) & (F.col("_above") + F.col("_c") >= F.col("_k")))
    marked = slices.drop("_k").join(F.broadcast(cut(edge.select(subject, F.col("_bin").alias("_edge"), (F.col("_k") - F.col("_above")).alias("_left")))), subject)
    close = number_rows(marked.where("_bin = _edge"), F.col(subject), F.desc(ranking), *[F.asc(p) for p in pos], out="_place")
    first = cut(close.groupBy(subject).agg(F.min("_place").alias("_first")))  # a row a hot subject
    inside = close.join(F.broadcast(first), subject).where("_place - _first < _left").drop("_place", "_first")
    extra = ("_n", "_low", "_high", "_bin", "_edge", "_left")
    return marked.where("_bin > _edge").drop(*extra).unionByName(inside.drop(*extra))


def top_fraction(slices: DataFrame, subject: str, pos: Sequence[str], ranking: str, values: Sequence[str], ratio: float = 0.3, least: int = 1) -> DataFrame:
    """(subject, values..., k): means over the k = min(max(ceil(ratio * n), least), n) best-ranked slices of each subject;
    earlier slices win ties."""
    kept = _best_fraction(slices.select(subject, *dict.fromkeys([*pos, ranking, *values])), subject, pos, ranking, ratio, least)
    return kept.groupBy(subject).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("k"))


def top_fraction_vectors(slices: DataFrame, subject: str, pos: Sequence[str], ranking: str, vector: str, ratio: float = 0.3, least: int = 1) -> DataFrame:
    """(subject, vector): element-wise means over the same slices."""
    kept = _best_fraction(slices.select(subject, *dict.fromkeys([*pos, ranking, vector])), subject, pos, ranking, ratio, least)
    return mean_vector(kept, [subject], vector, vector)


def morphology_stats(pixels: DataFrame, subject: str, label: str) -> DataFrame:
    """Per subject: counts of all labels, of > 0, of 1 or 3, of 3; their shares of all; whether 3 occurs."""
    total = F.count(F.lit(1))
    whole, core, part = (F.count_if(F.col(label) > 0), F.count_if(F.col(label).isin(1, 3)), F.count_if(F.col(label) == 3))
    size = F.greatest(total, F.lit(1))
    return pixels.groupBy(subject).agg(total.alias("total"), whole.alias("whole"), core.alias("core"), part.alias("enhancing"), (whole / size).alias("whole_ratio"), (core / size).alias("core_ratio"), (part / size).alias("enhancing_ratio"), (part > 0).cast("double").alias("has_enhancing"))


MORPHOLOGY = ("whole_ratio", "core_ratio", "enhancing_ratio", "has_enhancing")
MORPHOLOGY_WEIGHTS = (1.0, 1.0, 1.5, 0.5)


def morphology_score(stats: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds morphology: weighted sum of the four features, each scaled by the reference's bounds and clipped to [0, 1]."""
    bounds = reference.agg(*[f(c).alias(f"_{n}_{c}") for c in MORPHOLOGY for n, f in (("lo", F.min), ("hi", F.max))])
    joined = stats.crossJoin(F.broadcast(bounds))
    parts = [w * bounded(c, F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c, w in zip(MORPHOLOGY, MORPHOLOGY_WEIGHTS, strict=True)]
    return joined.withColumn("morphology", sum(parts[1:], parts[0])).drop(*bounds.columns)


def influence(scores: DataFrame, key: str = "pos", step: str = "step", score: str = "score", last: int = 3) -> DataFrame:
    """(key, influence, late): min-max of the mean score over all checkpoints, and over the last `last` that there are."""
    final = scores.select(step).distinct().orderBy(F.desc(step)).limit(last).agg(F.min(step).alias("_cut"))  # a few checkpoints
    sums = scores.crossJoin(F.broadcast(final)).groupBy(key).agg(F.avg(score).alias("influence"), F.avg(F.when(F.col(step) >= F.col("_cut"), F.col(score))).alias("late"))
    return normalize(normalize(sums, "influence"), "late")


def gradient_scores(source: DataFrame, target: DataFrame, step: str = "step", vector: str = "v", key: str = "pos") -> DataFrame:
    """(key, step, score): clipped cosine to the unit mean of the target's gradients of the same checkpoint."""
    goal = mean_vector(target, [step], vector, "_mean").select(step, unit("_mean").alias("_goal"))
    return source.join(F.broadcast(goal), step).select(key, step, clipped_cosine(vector, "_goal").alias("score"))


def acquisition_weights(df: DataFrame, uncertainty: str, foreground: str, inconsistency: str, consistency: str) -> DataFrame:
    """Adds weight = N(uncertainty * foreground) + 0.5 N(inconsistency) + 0.15 N(consistency)."""
    df = normalize(df.withColumn("_uf", F.col(uncertainty) * F.col(foreground)), "_uf")
    df = normalize(normalize(df, inconsistency, "_li"), consistency, "_co")
    return df.withColumn("weight", F.col("_uf") + 0.5 * F.col("_li") + 0.15 * F.col("_co")).drop("_uf", "_li", "_co")


def reliability_utility(df: DataFrame, weights: dict[str, float], out: str = "R") -> DataFrame:
    """Adds the min-max scaled weighted sum of component columns."""
    parts = [w * F.col(c) for c, w in weights.items()]
    return normalize(df.withColumn(out, sum(parts[1:], parts[0])), out)


def importance(probability: str, uncertainty: str) -> Column:
    """(1 - p) / p * max(uncertainty, 1e-8), p clipped to [1e-6, 1 - 1e-6]."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(probability).cast("double")))
    return (1 - p) / p * F.greatest(F.col(uncertainty).cast("double"), F.lit(1e-8))


def slice_importance(probability: str, entropy: str) -> Column:
    return (1 - F.col(probability)) / (F.col(probability) + 1e-8) * F.col(entropy)


def entropy_of(probabilities: str) -> Column:
    """-sum p log(p + 1e-8) of a class-probability array."""
    return F.aggregate(F.col(probabilities), F.lit(0.0), lambda s, p: s - p * F.log(p + 1e-8))


def mean_probabilities(rows: DataFrame, keys: Sequence[str], probabilities: str) -> DataFrame:
    """keys and `probabilities`: the mean of the class-probability arrays of each group, class by class."""
    parts = rows.select(*keys, F.posexplode(probabilities).alias("_i", "_p")).groupBy(*keys, "_i").agg(F.avg("_p").alias("_p"))
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_p"))).alias("_a")).select(*keys, F.transform("_a", lambda s: s["_p"]).alias(probabilities))


def foreground_score(probabilities: str) -> Column:
    """One minus the background's (first class's) probability, as the sum of the other classes'."""
    p = F.col(probabilities)
    return F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), F.lit(0.0), lambda s, x: s + x)


def top_class(probabilities: str) -> Column:
    """The number of the largest class probability, the first of equal ones."""
    return (F.array_position(F.col(probabilities), F.array_max(probabilities)) - 1).cast("int")


def class_agreement(a: str, b: str) -> Column:
    """Share of the places at which two arrays of classes agree; 0 for empty ones."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(same, F.greatest(F.size(a), F.size(b))), F.lit(0.0))


def noise_view(vector: str, view: str, scale: float, key: str) -> Column:
    """The vector under view 2 (plus) or 3 (minus) of deterministic noise in [-scale, scale), drawn by key and place; other
    views leave it as it is."""
    sign = F.when(F.col(view) == 2, 1.0).when(F.col(view) == 3, -1.0).otherwise(0.0)
    noise = lambda i: F.pmod(F.xxhash64(F.col(key), i), F.lit(1 << 20)) / float(1 << 19) - 1.0
    return F.transform(vector, lambda x, i: x + sign * scale * noise(i))


def schedule(progress: str, scale: float = 1.0) -> Column:
    """scale * (2 / (1 + exp(-10 p)) - 1)."""
    return scale * (2.0 / (1.0 + F.exp(-10.0 * F.col(progress))) - 1.0)


def view_factor(view: str, jitter: float) -> Column:
    """Brightness factor of a deterministic view: 1 - j, 1 + j, 1, 1, then 1 + j/2 or 1 - j/2 by parity."""
    v = F.col(view)
    return F.when(v == 0, 1 - jitter).when(v == 1, 1 + jitter).when(v.isin(2, 3), 1.0).when(v % 2 == 0, 1 + 0.5 * jitter).otherwise(1 - 0.5 * jitter)


def parent_subject(name: str | Column) -> Column:
    """Text before the first `_slice`."""
    return F.substring_index(name, "_slice", 1)
