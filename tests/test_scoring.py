import math

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from covelight.functions import scoring
from covelight.operators.curation import SelectorConfig, cluster_quotas, group_quotas


def test_constant_scores_scale_to_zero(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0)], "pos long, x double")
    assert [r["y"] for r in scoring.normalize(df, "x", "y").collect()] == [0.0, 0.0]


def test_scaling_keeps_nulls_and_works_by_group(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0), (4, "b", None)], "pos long, g string, x double")
    assert {r["pos"]: r["y"] for r in scoring.normalize(df, "x", "y", ["g"]).collect()} == {1: 0.0, 2: 1.0, 3: 0.0, 4: None}


def test_scaling_an_empty_table(spark):
    assert scoring.normalize(spark.createDataFrame([], "pos long, x double"), "x", "y").count() == 0


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    zero, other = [r["u"] for r in df.select(scoring.unit("v").alias("u")).collect()]
    assert zero == [0.0, 0.0] and math.isclose(other[0], 0.6, rel_tol=1e-6)


def test_negative_cosines_are_clipped(spark):
    df = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(scoring.clipped_cosine("a", "b").alias("c"), scoring.cosine_distance("a", "b").alias("d")).first()
    assert (r["c"], r["d"]) == (0.0, 2.0)


def test_gates_and_softmax_sum_to_one(spark):
    df = spark.createDataFrame([(0.1, 0.0, 0.9)], "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    assert math.isclose(sum(df.select(*[g.alias(str(i)) for i, g in enumerate(scoring.power_gates(cols))]).first()), 1, abs_tol=1e-6)
    assert math.isclose(sum(df.select(*[g.alias(str(i)) for i, g in enumerate(scoring.softmax(cols))]).first()), 1, abs_tol=1e-6)


def test_quotas_round_halves_to_even():
    c = SelectorConfig()
    assert group_quotas(0.125, c)["facility_only"] == 42  # 42.5
    assert group_quotas(0.05, c)["reliability_only"] == 16  # 16.5
    assert group_quotas(1.0, c)["facility_only"] == 0


def test_quota_never_takes_a_clusters_last_seed():
    assert cluster_quotas({0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0}, 5, 3) == dict.fromkeys(range(5), 1)


@given(st.lists(st.floats(1e-6, 10), min_size=1, max_size=8), st.integers(1, 60))
def test_quotas_add_up(mass, budget):
    quota = cluster_quotas(dict(enumerate(mass)), 1000, budget)
    assert min(quota.values()) >= 1
    assert sum(quota.values()) == max(budget, len(mass))


def test_a_length_is_worked_out_once_a_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([],), (None,), ([1.0, None],)], "v array<double>").select(scoring.unit("v").alias("u"))
    assert "/ (SQRT(" not in df._jdf.queryExecution().optimizedPlan().toString()  # a component is divided by a number at hand
    got = [r["u"] for r in df.collect()]
    assert got[0] == [3.0 / (5.0 + 1e-8), 4.0 / (5.0 + 1e-8)] and got[1:] == [[], None, [None, None]]
