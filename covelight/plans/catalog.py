"""Every query of the library by name, with its SQL twin where there is one.

Test tables stand in for the method's: embeddings are subjects (label below 8: source; the others: target, the first ten
of them the support), lineitem rows are slices of the subject l_partkey, events are labelled pixels of user_id, suppliers are
the targets of the method grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.lineage import cut
from ..operators import clustering, constraints, curation, greedy, grid, ranking, reliability, similarity, subjects

FLAGSHIP = "seeded_greedy_select"
CONFIG = curation.SelectorConfig(budget=40, top_utility_pool=150, top_signal_pool=60, top_facility_pool=60, clusters=8)
TARGETS = ("T1", "T2", "T3", "T4")
BUDGETS = (50, 100, 150, 200)
K_CENTER, COVER = 20, 40

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.unit_vectors(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), "label", "embedding")).drop("embedding")


def source(spark: SparkSession, sf: str) -> DataFrame:
    return embedded(spark, sf).where("label < 8").select("pos", "v")


def target(spark: SparkSession, sf: str) -> DataFrame:
    return embedded(spark, sf).where("label >= 8").select("pos", "v")


def support(spark: SparkSession, sf: str) -> DataFrame:
    return target(spark, sf).orderBy("pos").limit(10).withColumn("weight", 1.0 + F.col("pos") % 3)


def slice_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Per subject: unc, fg, li, cons, late."""
    late = F.coalesce(F.avg(F.when(F.col("l_linenumber") <= 3, F.col("l_tax"))), F.lit(0.0))
    return _t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("pos")).agg(
        F.avg("l_discount").alias("unc"), F.avg("l_tax").alias("fg"), F.avg(F.col("l_quantity") / 50).alias("li"), F.avg((F.col("l_returnflag") == "N").cast("double")).alias("cons"), late.alias("late")
    )


def _scores(own: DataFrame) -> DataFrame:
    rows = subjects.reliability_utility(own, {"unc": 0.5, "li": 0.5})
    return scoring.normalize(scoring.normalize(rows, "fg", "I"), "late", "L").select("pos", "R", "I", "L")


def source_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(cut(slice_scores(spark, sf).join(source(spark, sf).select("pos"), "pos")))  # each scale reads it again


def scored_source(spark: SparkSession, sf: str) -> DataFrame:
    """Source rows with a slice; which is all that a score needs."""
    return source(spark, sf).join(_t(spark, sf, "lineitem").select(F.col("l_partkey").alias("pos")), "pos", "left_semi")


def scored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """scored_source, support and source_scores with one pass over the slices, which are most of the input."""
    rows = cut(source(spark, sf))
    own = cut(slice_scores(spark, sf).join(rows.select("pos"), "pos"))
    return rows.join(own.select("pos"), "pos", "left_semi"), support(spark, sf), _scores(own)


# SQL parts. Lists are DOUBLE[]; N(x) is the min-max scale.
def _n(x: str, over: str = "") -> str:
    lo, hi = f"min({x}) over ({over})", f"max({x}) over ({over})"
    return f"(case when {hi} - {lo} < 1e-12 then 0.0 else ({x} - {lo}) / ({hi} - {lo}) end)"


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


E = """e as (select vec_id as pos, label, list_transform(embedding::double[], lambda x: x / (sqrt(list_inner_product(embedding::double[], embedding::double[])) + 1e-8)) as v from embeddings)"""
SRC = f"""{E}, src as (select pos, v from e where label < 8), tgt as (select pos, v from e where label >= 8),
sup as (select pos, v, (1.0 + pos % 3)::double as weight from tgt order by pos limit 10)"""
SLICES = """ss as (select l_partkey as pos, avg(l_discount) as unc, avg(l_tax) as fg, avg(l_quantity / 50) as li, avg((l_returnflag = 'N')::int::double) as cons,
coalesce(avg(case when l_linenumber <= 3 then l_tax end), 0.0) as late from lineitem group by 1)"""
SIM = "greatest(list_inner_product(a.v, b.v), 0.0)"
NEAR = f"""near as (select i, j, sim, rn from (select a.pos as i, b.pos as j, {SIM} as sim, row_number() over (partition by a.pos order by {SIM} desc, b.pos) as rn from src a join src b on a.pos <> b.pos) where rn <= 20),
dens as (select s.pos, coalesce(avg(n.sim), 0.0) as density_raw from src s left join near n on n.i = s.pos group by 1)"""
MATCH = f"""qs as (select a.pos as i, b.pos as j, b.weight as w, {SIM} as sim, row_number() over (partition by a.pos order by {SIM} desc, b.pos) as rn from src a, sup b),
mraw as (select i as pos, sum(sim * greatest(w, 1e-6)) / (sum(greatest(w, 1e-6)) + 1e-12) as m from qs where rn <= 8 group by 1), mt as (select pos, m as match_raw, {_n('m')} as "match" from mraw)"""


def _cover(src: str, steps: int, name: str = "fac", penalty: float = 0.08) -> str:
    return f"""sq_{name} as (select a.pos, any_value(a.v) as v, list({SIM} order by b.pos) as q from {src} a, sup b group by a.pos),
{name}(step, pick, pos, v, q, cov, red, picked, val) as (
select 0, -1::bigint, pos, v, q, list_transform(q, lambda x: 0.0::double), 0.0::double, false, 0.0::double from sq_{name}
union all
select step + 1, bpos, pos, v, q, list_transform(range(1, len(q) + 1), lambda i: greatest(cov[i], bq[i])), greatest(red, list_inner_product(v, bv)), picked or pos = bpos, bval
from (select *, first_value(pos) over w as bpos, first_value(v) over w as bv, first_value(q) over w as bq, first_value(now) over w as bval
from (select *, list_sum(list_transform(range(1, len(q) + 1), lambda i: greatest(q[i] - cov[i], 0.0))) - {penalty} * red as now from {name} where step < {steps})
window w as (order by picked, now desc, pos)))"""


@query("minmax_normalize", f"select p_partkey, {_r(_n('p_retailprice', 'partition by p_brand'))} as x from part")
def _(spark, sf):
    return scoring.normalize(_t(spark, sf, "part"), "p_retailprice", "x", ["p_brand"]).select("p_partkey", r6("x").alias("x"))


@query("l2_normalize", f"with {E} select pos, {_r('v[1]')} as first, {_r('list_sum(v)')} as total from e")
def _(spark, sf):
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return embedded(spark, sf).select("pos", r6(F.col("v")[0]).alias("first"), r6(total).alias("total"))


@query("sigmoid_gate", f"""select p_partkey, {_r('1 / (1 + exp(-greatest(-50.0, least(50.0, (p_size - 25) / 5.0::double))))')} as s,
{_r('1 / (1 + exp(-greatest(-50.0, least(50.0, (p_size / 50.0::double - 0.5) / 0.05::double))))')} as gate from part""")
def _(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", r6(scoring.sigmoid((F.col("p_size") - 25) / F.lit(5.0))).alias("s"), r6(scoring.gate_activation(F.col("p_size") / F.lit(50.0))).alias("gate"))


_ABC = ("p_size / 50.0::double", "p_retailprice / 2000.0::double", "(p_partkey % 7) / 7.0::double")


@query("softmax_temperature", f"""with x as (select p_partkey, {_ABC[0]} as a, {_ABC[1]} as b, {_ABC[2]} as c from part), y as (select p_partkey, exp((a - greatest(a, b, c)) / 0.5::double) as a, exp((b - greatest(a, b, c)) / 0.5::double) as b, exp((c - greatest(a, b, c)) / 0.5::double) as c from x)
select p_partkey, {_r('a / (a + b + c + 1e-12)')} as a, {_r('b / (a + b + c + 1e-12)')} as b, {_r('c / (a + b + c + 1e-12)')} as c from y""")
def _(spark, sf):
    p = _three(spark, sf)
    return p.select("p_partkey", *[r6(s).alias(n) for n, s in zip("abc", scoring.softmax([F.col(n) for n in "abc"], 0.5), strict=True)])


def _three(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", (F.col("p_size") / F.lit(50.0)).alias("a"), (F.col("p_retailprice") / F.lit(2000.0)).alias("b"), ((F.col("p_partkey") % 7) / F.lit(7.0)).alias("c"))


@query("power_gates", f"""with x as (select p_partkey, {', '.join(f'power(greatest({e}, 1e-8), 4)' + f' as {n}' for e, n in zip(_ABC, 'abc', strict=True))} from part)
select p_partkey, {_r('a / (a + b + c + 1e-12)')} as a, {_r('b / (a + b + c + 1e-12)')} as b, {_r('c / (a + b + c + 1e-12)')} as c from x""")
def _(spark, sf):
    return _three(spark, sf).select("p_partkey", *[r6(s).alias(n) for n, s in zip("abc", scoring.power_gates([F.col(n) for n in "abc"]), strict=True)])


@query("acquisition_weights", f"with {SLICES} select pos, {_r(_n('(unc * fg)') + ' + 0.5 * ' + _n('li') + ' + 0.15 * ' + _n('cons'))} as weight from ss")
def _(spark, sf):
    return subjects.acquisition_weights(slice_scores(spark, sf), "unc", "fg", "li", "cons").select("pos", r6("weight").alias("weight"))


@query("reliability_utility", f"with {SLICES}, w as (select pos, 0.5::double * unc + 0.3::double * fg + 0.2::double * li as r from ss) select pos, {_r(_n('r'))} as \"R\" from w")
def _(spark, sf):
    return subjects.reliability_utility(slice_scores(spark, sf), {"unc": 0.5, "fg": 0.3, "li": 0.2}).select("pos", r6("R").alias("R"))


@query("slice_and_subject_importance", f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_r('l_tax + 0.25::double * l_discount')} as ranking, {_r('(1 - l_tax) / (l_tax + 1e-8) * l_discount')} as slice_importance,
{_r('(1 - greatest(1e-6, least(1 - 1e-6, l_tax))) / greatest(1e-6, least(1 - 1e-6, l_tax)) * greatest(l_discount, 1e-8)')} as importance from lineitem""")
def _(spark, sf):
    x = _t(spark, sf, "lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(subjects.slice_ranking("l_tax", "l_discount")).alias("ranking"), r6(subjects.slice_importance("l_tax", "l_discount")).alias("slice_importance"), r6(subjects.importance("l_tax", "l_discount")).alias("importance"))


@query("class_entropy", f"""with c as (select l_partkey as pos, sum((l_returnflag = 'A')::int)::double / count(*) as a, sum((l_returnflag = 'N')::int)::double / count(*) as n, sum((l_returnflag = 'R')::int)::double / count(*) as r from lineitem group by 1)
select pos, {_r('0.0 - a * ln(a + 1e-8) - n * ln(n + 1e-8) - r * ln(r + 1e-8)')} as entropy from c""")
def _(spark, sf):
    return class_shares(spark, sf).select("pos", r6(subjects.entropy_of("probs")).alias("entropy"))


def class_shares(spark, sf):
    share = lambda c: F.sum((F.col("l_returnflag") == c).cast("int")).cast("double") / F.count(F.lit(1))
    return _t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("pos")).agg(F.array(share("A"), share("N"), share("R")).alias("probs"))


@query("schedule_and_views", f"""select p_partkey, {_r('0.7::double * (2.0 / (1.0 + exp(-10.0 * (p_size / 50.0::double))) - 1.0)')} as alpha,
(case p_partkey % 6 when 0 then 0.9 when 1 then 1.1 when 2 then 1.0 when 3 then 1.0 when 4 then 1.05 else 0.95 end)::double as factor from part""")
def _(spark, sf):
    p = _t(spark, sf, "part").withColumn("p", F.col("p_size") / F.lit(50.0)).withColumn("view", F.col("p_partkey") % 6)
    return p.select("p_partkey", r6(subjects.schedule("p", 0.7)).alias("alpha"), r6(subjects.view_factor("view", 0.1)).alias("factor"))


@query("stable_topk", """select c_custkey, c_nationkey, (row_number() over (order by floor(c_acctbal / 500) desc, c_custkey))::int as rank from customer qualify rank <= 50""")
def _(spark, sf):
    return ranking.top_k(_t(spark, sf, "customer").withColumn("s", F.floor(F.col("c_acctbal") / 500)), "s", 50, pos="c_custkey").select("c_custkey", "c_nationkey", "rank")


@query("grouped_topk", """select c_custkey, c_nationkey, (row_number() over (partition by c_nationkey order by floor(c_acctbal / 500) desc, c_custkey))::int as rank from customer qualify rank <= 5""")
def _(spark, sf):
    return ranking.top_k(_t(spark, sf, "customer").withColumn("s", F.floor(F.col("c_acctbal") / 500)), "s", 5, ["c_nationkey"], pos="c_custkey").select("c_custkey", "c_nationkey", "rank")


@query("tail_topk_ascending", """select c_custkey, (51 - row_number() over (order by floor(c_acctbal / 500) desc, c_custkey desc))::int as rank from customer qualify row_number() over (order by floor(c_acctbal / 500) desc, c_custkey desc) <= 50""")
def _(spark, sf):
    return ranking.tail_k(_t(spark, sf, "customer").withColumn("s", F.floor(F.col("c_acctbal") / 500)), "s", 50, pos="c_custkey").select("c_custkey", "rank")


@query("per_row_topk", f"with {SRC}, {MATCH} select i, j, {_r('sim')} as sim, rn::int as rank from qs where rn <= 8")
def _(spark, sf):
    return similarity.top_similar(source(spark, sf), support(spark, sf), 8).select("i", "j", r6("sim").alias("sim"), "rank")


_FLAGS = f"""{SLICES}, fl as (select pos, unc, fg, li, row_number() over (order by unc desc, pos) <= 60 as a, row_number() over (order by fg desc, pos) <= 60 as b, row_number() over (order by li desc, pos) <= 60 as c from ss)"""
_VOTES = "a::int + b::int + c::int"


@query("set_overlap", f"""with {_FLAGS} select {_r('sum((a and b)::int) / greatest(1, least(sum(a::int), sum(b::int)))::double')} as overlap,
{_r(f'sum(({_VOTES} >= 2)::int) / sum(({_VOTES} >= 1)::int)::double')} as agreement from fl""")
def _(spark, sf):
    flags = ranking.membership(slice_scores(spark, sf), {"a": ("unc", 60), "b": ("fg", 60), "c": ("li", 60)})
    return flags.agg(r6(ranking.overlap_fraction("a", "b")).alias("overlap"), r6(ranking.agreement("a", "b", "c")).alias("agreement"))


_CORR = lambda x, y: f"greatest(-1.0, least(1.0, (sum({x} * {y}) - sum({x}) * sum({y}) / count(*)) / sqrt((sum({x} * {x}) - sum({x}) * sum({x}) / count(*)) * (sum({y} * {y}) - sum({y}) * sum({y}) / count(*)))))"


@query("safe_correlation", f"with {SLICES} select {_r(_CORR('unc', 'li'))} as r, 0.0::double as flat from ss")
def _(spark, sf):
    return slice_scores(spark, sf).withColumn("one", F.lit(1.0)).agg(r6(ranking.safe_correlation("unc", "li")).alias("r"), r6(ranking.safe_correlation("unc", "one")).alias("flat"))


@query("top_overlap", f"with {_FLAGS} select {_r('sum((a and b)::int) / 60.0::double')} as overlap from fl")
def _(spark, sf):
    return ranking.top_overlap(slice_scores(spark, sf), "unc", "fg", 60).select(r6("overlap").alias("overlap"))


@query("stability_score", f"with {_FLAGS} select {_r('(0.5 * (' + _CORR('unc', 'fg') + ' + 1) + sum((a and b)::int) / 60.0::double + 0.5 * (' + _CORR('unc', 'li') + ' + 1) + sum((a and c)::int) / 60.0::double) / 4')} as stability from fl")
def _(spark, sf):
    return ranking.stability(slice_scores(spark, sf), "unc", ["fg", "li"], 60).select(r6("stability").alias("stability"))


@query("adaptive_weights", f"""with {SLICES}, s as (select 0.5 + 0.5 * stddev_pop(unc) as a, 0.5 * ({_CORR('unc', 'fg')} + 1) as b, 0.5 * ({_CORR('unc', 'li')} + 1) as c from ss), x as (select exp(a - greatest(a, b, c)) as a, exp(b - greatest(a, b, c)) as b, exp(c - greatest(a, b, c)) as c from s)
select {_r('a / (a + b + c + 1e-12)')} as w_p, {_r('b / (a + b + c + 1e-12)')} as w_g, {_r('c / (a + b + c + 1e-12)')} as w_m from x""")
def _(spark, sf):
    s = slice_scores(spark, sf).agg((0.5 + 0.5 * F.stddev_pop("unc")).alias("a"), (0.5 * (ranking.safe_correlation("unc", "fg") + 1)).alias("b"), (0.5 * (ranking.safe_correlation("unc", "li") + 1)).alias("c"))
    return s.select(*[r6(w).alias(n) for n, w in zip(("w_p", "w_g", "w_m"), scoring.softmax([F.col(c) for c in "abc"]), strict=True)])


_VARIANTS = f"""{SRC}, {SLICES}, sc as (select s.pos, s.v, unc, fg, li, cons from src s join ss using (pos)), dr as (select d, pos from sup, range(0, 8) x(d) qualify row_number() over (partition by d order by md5('2025:' || d || ':' || pos), pos) <= round(0.8 * (select count(*) from sup))),
vs as (select -1 as d, pos from sup union all select d, pos from dr), qv as (select vs.d, a.pos, b.weight as w, {SIM} as sim, row_number() over (partition by vs.d, a.pos order by {SIM} desc, b.pos) as rn from sc a, vs join sup b on b.pos = vs.pos),
raw as (select 'm' as s, d, pos, sum(sim * greatest(w, 1e-6)) / (sum(greatest(w, 1e-6)) + 1e-12) as x from qv where rn <= 8 group by all union all select 'g', -1, pos, (fg + li + cons) / 3.0::double from sc union all select 'g', 0, pos, fg from sc union all select 'g', 1, pos, li from sc union all select 'g', 2, pos, cons from sc),
nv as (select s, d, pos, (x - min(x) over (partition by s, d)) / (max(x) over (partition by s, d) - min(x) over (partition by s, d)) as x from raw), tv as (select *, row_number() over (partition by s, d order by x desc, pos) <= 15 as t from nv),
ag as (select a.s, b.d, 0.5 * ({_CORR('a.x', 'b.x')} + 1) as r, sum((a.t and b.t)::int) / least(15, count(*))::double as o from tv a join tv b on a.s = b.s and a.pos = b.pos and a.d = -1 and b.d >= 0 group by all), st as (select s, avg((r + o) / 2) as y from ag group by 1),
rl as (select (0.5 + 0.5 * (select stddev_pop(unc) from sc)) / 0.5 as p, (select y from st where s = 'g') / 0.5 as g, (select y from st where s = 'm') / 0.5 as m), ex as (select exp(p - greatest(p, g, m)) as p, exp(g - greatest(p, g, m)) as g, exp(m - greatest(p, g, m)) as m from rl)"""


@query("adaptive_reliability_weights", f"with {_VARIANTS} select {_r('p / (p + g + m + 1e-12)')} as w_p, {_r('g / (p + g + m + 1e-12)')} as w_g, {_r('m / (p + g + m + 1e-12)')} as w_m from ex")
def _(spark, sf):
    got = reliability.adaptive_reliability_weights(slice_scores(spark, sf), source(spark, sf), support(spark, sf), "unc", ["fg", "li", "cons"], top=15, temperature=0.5)
    return _rounded(got, "w_p", "w_g", "w_m")


_RANKED = """rk as (select l_partkey as subject, l_discount, l_tax, l_quantity, row_number() over (partition by l_partkey order by l_tax + 0.25::double * l_discount desc, l_orderkey, l_linenumber, l_suppkey) as r, count(*) over (partition by l_partkey) as n from lineitem)"""


@query("subject_topfrac_agg", f"with {_RANKED} select subject, {_r('avg(l_discount)')} as l_discount, {_r('avg(l_quantity)')} as l_quantity, count(*) as k from rk where r <= least(greatest(ceil(0.3::double * n), 1), n) group by 1")
def _(spark, sf):
    x = _t(spark, sf, "lineitem").withColumn("ranking", subjects.slice_ranking("l_tax", "l_discount")).withColumnRenamed("l_partkey", "subject")
    return _rounded(subjects.top_fraction(x, "subject", ["l_orderkey", "l_linenumber", "l_suppkey"], "ranking", ["l_discount", "l_quantity"]), "l_discount", "l_quantity")


@query("subject_vector_topfrac_agg", f"""with {E}, rk as (select label, v, row_number() over (partition by label order by v[1] desc, pos) as r, count(*) over (partition by label) as n from e), k as (select * from rk where r <= least(greatest(ceil(0.3::double * n), 1), n))
select label, {_r('avg(v[1])')} as first, {_r('avg(v[64])')} as last from k group by 1""")
def _(spark, sf):
    got = subjects.top_fraction_vectors(embedded(spark, sf).withColumn("ranking", F.col("v")[0]), "label", ["pos"], "ranking", "v")
    return got.select("label", r6(F.col("v")[0]).alias("first"), r6(F.element_at("v", -1)).alias("last"))


_PIX = """px as (select user_id, case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 else 3 end as c from events),
mo as (select user_id, count(*) as total, sum((c > 0)::int)::bigint as whole, sum((c in (1, 3))::int)::bigint as core, sum((c = 3)::int)::bigint as enhancing, sum((c > 0)::int)::double / count(*) as whole_ratio, sum((c in (1, 3))::int)::double / count(*) as core_ratio, sum((c = 3)::int)::double / count(*) as enhancing_ratio, (sum((c = 3)::int) > 0)::int::double as has_enhancing from px group by 1)"""


def morphology(spark, sf):
    c = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return subjects.morphology_stats(_t(spark, sf, "events").withColumn("c", c), "user_id", "c")


@query("morphology_stats", f"with {_PIX} select user_id, total, whole, core, enhancing, {_r('whole_ratio')} as whole_ratio, {_r('core_ratio')} as core_ratio, {_r('enhancing_ratio')} as enhancing_ratio, has_enhancing from mo")
def _(spark, sf):
    return _rounded(morphology(spark, sf), "whole_ratio", "core_ratio", "enhancing_ratio")


_MS = " + ".join(f"{w} * greatest(0.0, least(1.0, ({c} - (select min({c}) from mo where user_id % 3 = 0)) / ((select max({c}) from mo where user_id % 3 = 0) - (select min({c}) from mo where user_id % 3 = 0) + 1e-8)))" for c, w in zip(subjects.MORPHOLOGY, subjects.MORPHOLOGY_WEIGHTS, strict=True))
_SCORED = f"{_PIX}, ms as (select user_id, {_MS} as morphology from mo)"


@query("morphology_score", f"with {_SCORED} select user_id, {_r('morphology')} as morphology from ms")
def _(spark, sf):
    m = morphology(spark, sf)
    return subjects.morphology_score(m, m.where("user_id % 3 = 0")).select("user_id", r6("morphology").alias("morphology"))


@query("tercile_bins", f"""with {_SCORED}, q as (select quantile_cont(morphology, 1/3::double) as a, quantile_cont(morphology, 2/3::double) as b from ms where user_id % 3 = 0) select user_id, (case when morphology < a then 0 when morphology < b then 1 else 2 end)::int as bin from ms, q""")
def _(spark, sf):
    m = morphology(spark, sf)
    s = subjects.morphology_score(m, m.where("user_id % 3 = 0"))
    return similarity.tercile_bins(s, s.where("user_id % 3 = 0"), "morphology").select("user_id", F.col("bin").cast("int").alias("bin"))


_UNNEST = "select {by}, i, avg(x) as x from (select {by}, unnest(v) as x, unnest(range(1, len(v) + 1)) as i from {t}) group by {by}, i"


@query("prototype_margin", f"""with {SRC}, tb as (select pos, v, pos % 3 as bin from tgt), sb as (select pos, v, pos % 3 as bin from src), pm as (select bin, list(x order by i) as m from ({_UNNEST.format(by='bin', t='tb')}) group by 1),
pp as (select bin, list_transform(m, lambda x: x / (sqrt(list_inner_product(m, m)) + 1e-8)) as v from pm),
sc as (select a.pos, max(case when a.bin = b.bin then {SIM} end) - max(case when a.bin <> b.bin then {SIM} end) as raw from sb a, pp b group by 1)
select pos, {_r('raw')} as margin_raw, {_r(_n('raw'))} as margin from sc""")
def _(spark, sf):
    binned = lambda df: df.withColumn("bin", F.col("pos") % 3)
    return _rounded(similarity.prototype_margin(binned(source(spark, sf)), binned(target(spark, sf))), "margin_raw", "margin")


@query("influence", f"""with m as (select l_partkey as pos, year(l_shipdate) as step, avg(l_discount) as score from lineitem group by 1, 2), s as (select pos, avg(score) as i, avg(case when step > (select max(step) from m) - 3 then score end) as l from m group by 1)
select pos, {_r(_n('i'))} as influence, {_r(_n('l'))} as late from s""")
def _(spark, sf):
    steps = _t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("pos"), F.year("l_shipdate").alias("step")).agg(F.avg("l_discount").alias("score"))
    return _rounded(subjects.influence(steps), "influence", "late")


@query("gradient_scores", f"""with {SRC}, tg as (select v, pos % 2 as step from tgt), gm as (select step, list(x order by i) as m from ({_UNNEST.format(by='step', t='tg')}) group by 1),
gu as (select step, list_transform(m, lambda x: x / (sqrt(list_inner_product(m, m)) + 1e-8)) as v from gm) select a.pos, b.step, {_r(SIM)} as score from src a, gu b""")
def _(spark, sf):
    both = source(spark, sf).withColumn("step", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    return _rounded(subjects.gradient_scores(both, target(spark, sf).withColumn("step", F.col("pos") % 2)), "score")


@query("source_density", f"with {SRC}, {NEAR} select pos, {_r('density_raw')} as density_raw, {_r(_n('density_raw'))} as density from dens")
def _(spark, sf):
    return _rounded(similarity.source_density(source(spark, sf)), "density_raw", "density")


@query("low_density_flag", f"with {SRC}, {NEAR} select pos, density_raw <= (select quantile_cont(density_raw, 0.1) from dens) as low_density from dens")
def _(spark, sf):
    return similarity.low_density_flag(similarity.source_density(source(spark, sf))).select("pos", "low_density")


@query("query_match", f'with {SRC}, {MATCH} select pos, {_r("match_raw")} as match_raw, {_r(chr(34) + "match" + chr(34))} as "match" from mt')
def _(spark, sf):
    return _rounded(similarity.query_match(source(spark, sf), support(spark, sf)), "match_raw", "match")


@query("coverage_trust", f"with {SRC}, m as (select a.pos, max({SIM}) as s from src a, sup b group by 1) select {_r('avg(s)')} as trust from m")
def _(spark, sf):
    return similarity.coverage_trust(source(spark, sf), support(spark, sf)).select(r6("trust").alias("trust"))


@query("local_inconsistency", f"""with {SRC}, pr as (select pos, v, list_transform(v[1:4], lambda x: abs(x)) as p from tgt), nn as (select i, j, sim from (select a.pos as i, b.pos as j, {SIM} as sim, row_number() over (partition by a.pos order by {SIM} desc, b.pos) as rn from pr a join pr b on a.pos <> b.pos) where rn <= 10),
w as (select i, j, sim / (sum(sim) over (partition by i) + 1e-8) as w from nn), o as (select w.i, 1 - sum(w * list_inner_product(x.p, y.p)) as o from w join pr x on x.pos = i join pr y on y.pos = j group by 1)
select w.i as pos, {_r('any_value(a.o)')} as own, {_r('any_value(a.o) + sum(w.w * b.o)')} as inconsistency from w join o a on a.i = w.i join o b on b.i = w.j group by 1""")
def _(spark, sf):
    rows = target(spark, sf).withColumn("probs", F.transform(F.slice("v", 1, 4), F.abs))
    return _rounded(similarity.local_inconsistency(rows), "own", "inconsistency")


@query("kcenter_greedy", f"""with recursive {SRC}, kc(step, pick, pos, v, mind, picked) as (select 0, -1::bigint, pos, v, 0.0::double, false from src
union all select step + 1, bpos, pos, v, case when step = 0 then 1 - greatest(list_inner_product(v, bv), -1.0) else least(mind, 1 - greatest(list_inner_product(v, bv), -1.0)) end, picked or pos = bpos
from (select *, first_value(pos) over w as bpos, first_value(v) over w as bv from kc where step < {K_CENTER} window w as (order by picked, mind desc, pos)))
select distinct step::int as rank, pick as pos from kc where step > 0""")
def _(spark, sf):
    return greedy.k_center(source(spark, sf), K_CENTER).select("rank", "pos")


def _coverage(spark, sf):
    return curation.with_query(source(spark, sf), support(spark, sf))


@query("coverage_greedy", f"with recursive {SRC}, {_cover('src', COVER)} select distinct step::int as rank, pick as pos, {_r('val')} as value from fac where step > 0")
def _(spark, sf):
    return _rounded(greedy.coverage_greedy(_coverage(spark, sf), COVER), "value")


@query("facility_rank_score", f"with recursive {SRC}, {_cover('src', COVER)}, o as (select distinct step, pick from fac where step > 0) select s.pos, {_r(f'coalesce(1 - (step - 1) / {COVER - 1}.0::double, 0.0)')} as facility from src s left join o on o.pick = s.pos")
def _(spark, sf):
    return _rounded(greedy.rank_scores(greedy.coverage_greedy(_coverage(spark, sf), COVER), source(spark, sf)), "facility")


@query("centroid_alignment", f"""with {SRC}, sm as (select list(x order by i) as m from (select i, sum(x) as x from (select unnest(v) as x, unnest(range(1, len(v) + 1)) as i from sup) group by i)), c as (select list_transform(m, lambda x: x / (sqrt(list_inner_product(m, m)) + 1e-8)) as v from sm), al as (select a.pos, {SIM} as x from src a, c b) select pos, {_r(_n('x'))} as alignment from al""")
def _(spark, sf):
    return _rounded(similarity.centroid_alignment(source(spark, sf), support(spark, sf)), "alignment")


def _mutual_information(steps: int) -> str:
    """Each pick as tables of its own: gains over the pairs, the best of them, what each row has then."""
    sql = f"""with {SRC}, m0 as materialized (select a.pos, any_value(a.v) as v, max({SIM}) as cap, 0.0::double as now, -1::bigint as pick, 0.0::double as val from src a, sup b group by a.pos),
pair as materialized (select a.pos as i, b.pos as j, {SIM} as s from m0 a, m0 b)"""
    for k in range(steps):
        taken = " and ".join(f"p.j <> (select any_value(pick) from m{i})" for i in range(1, k + 1)) or "true"
        sql += f""", g{k} as materialized (select p.j, round(sum(least(greatest(p.s, m.now), m.cap) - least(m.now, m.cap)), 9) as gain from pair p join m{k} m on m.pos = p.i where {taken} group by 1 order by gain desc, p.j limit 1),
m{k + 1} as materialized (select m.pos, m.cap, greatest(m.now, p.s) as now, g.j as pick, g.gain as val from m{k} m, g{k} g, pair p where p.i = m.pos and p.j = g.j)"""
    picks = " union all ".join(f"select {k}::int as rank, any_value(pick) as pos, {_r('any_value(val)')} as value from m{k}" for k in range(1, steps + 1))
    return f"{sql} {picks}"


@query("mutual_information_greedy", _mutual_information(10))
def _(spark, sf):
    return _rounded(greedy.mutual_information(_coverage(spark, sf), 10), "value")


@query("source_clusters")
def _(spark, sf):
    return clustering.source_clusters(source(spark, sf), 8)


def _weighted(spark, sf):
    return target(spark, sf).join(subjects.acquisition_weights(cut(slice_scores(spark, sf)), "unc", "fg", "li", "cons").select("pos", "weight"), "pos")


@query("weighted_kmeans_support")
def _(spark, sf):
    return clustering.weighted_support(_weighted(spark, sf), 6)


@query("clue_select")
def _(spark, sf):
    return clustering.uncertainty_clusters(_weighted(spark, sf), 6)


@query("lada_select")
def _(spark, sf):
    return clustering.inconsistent_clusters(_weighted(spark, sf), 6, 4)


@query("domain_classifier")
def _(spark, sf):
    return _rounded(clustering.domain_selection(source(spark, sf), _weighted(spark, sf), 10), "score")


_C = CONFIG
_N = {x: _n(x) for x in ("fg", "late")}
SIGNALS = f"""{SRC.replace('src as (select pos, v from e where label < 8)', 'src as (select pos, v from e where label < 8 and pos in (select l_partkey from lineitem))')}, {SLICES}, rs as (select ss.* from ss join src using (pos)),
rr as (select pos, 0.5 * unc + 0.5 * li as r0, fg, late from rs), ril as (select pos, {_n('r0')} as R, {_N['fg']} as I, {_N['late']} as L from rr), {NEAR}, dn as (select pos, density_raw, {_n('density_raw')} as D from dens), {MATCH},
{_cover('src', _C.top_facility_pool)}, fo as (select distinct step, pick from fac where step > 0), fr as (select s.pos, coalesce(1 - (step - 1) / greatest(1, (select max(step) from fo) - 1)::double, 0.0) as F from src s left join fo on fo.pick = s.pos),
fv as (select src.pos, v from src join fo on fo.pick = src.pos), fm as (select list(x order by i) as m from (select i, sum(x) as x from (select unnest(v) as x, unnest(range(1, len(v) + 1)) as i from fv) group by i)), fc as (select list_transform(m, lambda x: x / (sqrt(list_inner_product(m, m)) + 1e-8)) as v from fm),
al0 as (select a.pos, {SIM} as x from src a, fc b), al as (select pos, {_n('x')} as A from al0),
wide as (select pos, R, I, L, D, density_raw, "match" as M, F, A from ril join dn using (pos) join mt using (pos) join fr using (pos) join al using (pos))"""
_TOP = lambda c, k: f"row_number() over (order by {c} desc, pos) <= {k}"
TOPS = f"""{SIGNALS}, t0 as (select *, {_TOP('R', _C.top_signal_pool)} as r_top, {_TOP('I', _C.top_signal_pool)} as i_top, {_TOP('L', _C.top_signal_pool)} as l_top, {_TOP('F', _C.top_facility_pool)} as f_top, {_TOP('R', _C.top_utility_pool)} as u_top from wide),
ld as (select 1 - sum((i_top and l_top)::int) / greatest(1, least(sum(i_top::int), sum(l_top::int)))::double as dl from t0), tp as (select t0.*, dl, case when dl > 0.08::double then L else I end as H, case when dl > 0.08::double then l_top else i_top end as h_top from t0, ld)"""
_OV = lambda a, b: f"sum(({a} and {b})::int) / greatest(1, least(sum({a}::int), sum({b}::int)))::double"
_V3 = "r_top::int + h_top::int + f_top::int"
_SIG = lambda x: f"(1 / (1 + exp(-greatest(-50.0, least(50.0, {x})))))"
DIAG = f"""{TOPS}, tru as (select avg(s) as trust from (select a.pos, max({SIM}) as s from src a, sup b group by 1)), g0 as (select max(dl) as dl, ({_OV('r_top', 'f_top')} + {_OV('h_top', 'f_top')}) / 2 as al, sum(({_V3} >= 2)::int) / sum(({_V3} >= 1)::int)::double as ag from tp),
g1 as (select dl, al, ag, trust, {_SIG('(0.60::double - trust) / 0.08::double')} as s1 from g0, tru), g2 as (select *, (1 - s1) * {_SIG('(al - 0.28::double) / 0.04::double')} as s2 from g1), g3 as (select *, (1 - s1) * (1 - s2) * ag as s3 from g2),
g4 as (select *, power(greatest(s1, 1e-8), 4) as p1, power(greatest(s2, 1e-8), 4) as p2, power(greatest(s3, 1e-8), 4) as p3 from g3),
dg as (select trust, dl as late_distinctness, al as alignment, s1, s2, s3, p1 / (p1 + p2 + p3 + 1e-12) as g1, p2 / (p1 + p2 + p3 + 1e-12) as g2, p3 / (p1 + p2 + p3 + 1e-12) as g3 from g4)"""
CONS = f"""{TOPS}, cs as (select pos, {_V3} >= 2 as multi, (0.20 + 0.05 * dl) * R + (0.15 + 0.05 * dl) * H + 0.15 * D + 0.20 * A + (0.20 - 0.05 * dl) * f_top::int + (0.10 - 0.05 * dl) * ({_V3} >= 2)::int as consensus,
case when {_V3} >= 2 then 'multi' when f_top then 'facility_only' when r_top then 'reliability_only' when h_top then 'influence_only' end as grp from tp)"""


def _flagged(spark, sf):
    return curation.tops(curation.signals(*scored(spark, sf), CONFIG), CONFIG)


@query("target_signals", f"with recursive {SIGNALS} select pos, {', '.join(f'{_r(c)} as {chr(34)}{c}{chr(34)}' for c in ('R', 'I', 'L', 'M', 'D', 'F', 'A'))} from wide")
def _(spark, sf):
    return _rounded(curation.signals(*scored(spark, sf), CONFIG).select("pos", "R", "I", "L", "M", "D", "F", "A"), "R", "I", "L", "M", "D", "F", "A")


@query("top_memberships", f"with recursive {TOPS} select pos, r_top, i_top, l_top, f_top, u_top, h_top, {_r('dl')} as late_distinctness from tp")
def _(spark, sf):
    return _rounded(_flagged(spark, sf).select("pos", "r_top", "i_top", "l_top", "f_top", "u_top", "h_top", "late_distinctness"), "late_distinctness")


@query("diagnostics_gates", f"with recursive {DIAG} select {', '.join(f'{_r(a)} as {b}' for a, b in (('trust', 'trust'), ('late_distinctness', 'late_distinctness'), ('alignment', 'alignment'), ('s1', 's_sparse'), ('s2', 's_coverage'), ('s3', 's_consensus'), ('g1', 'gate_sparse'), ('g2', 'gate_coverage'), ('g3', 'gate_consensus')))} from dg")
def _(spark, sf):
    names = ("trust", "late_distinctness", "alignment", "s_sparse", "s_coverage", "s_consensus", "gate_sparse", "gate_coverage", "gate_consensus")
    src, sup, scores = scored(spark, sf)
    flagged = curation.tops(curation.signals(src, sup, scores, CONFIG), CONFIG)
    return _rounded(curation.diagnostics(flagged, similarity.coverage_trust(src, sup), CONFIG).select(*names), *names)


@query("consensus_score", f'with recursive {CONS} select pos, multi, {_r("consensus")} as consensus, grp as "group" from cs')
def _(spark, sf):
    return _rounded(curation.consensus(_flagged(spark, sf)).select("pos", "multi", "consensus", "group"), "consensus")


@query("quota_groups", f"""with recursive {CONS} select grp as "group", count(*) as n, {_r('sum(consensus)')} as mass from cs where grp is not null group by 1""")
def _(spark, sf):
    return _rounded(curation.consensus(_flagged(spark, sf)).where(F.col("group").isNotNull()).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("consensus").alias("mass")), "mass")


def _select(spark, sf):
    return curation.select_sources(*scored(spark, sf), CONFIG)


@query("quota_seed")
def _(spark, sf):
    flagged = _flagged(spark, sf)
    late = flagged.agg(F.max("late_distinctness")).first()[0]
    return _rounded(curation.quota_seeds(curation.consensus(flagged), curation.group_quotas(late, CONFIG)), "score")


@query("seeded_greedy_select")
def _(spark, sf):
    return _rounded(_select(spark, sf).picks.select("rank", "pos", "score"), "score")


@query("signal_means")
def _(spark, sf):
    means = curation.signal_means(_select(spark, sf).picks)
    return _rounded(means, *means.columns)


@query("selected_counts")
def _(spark, sf):
    return curation.selected_counts(_select(spark, sf).picks)


@query("random_subset", "select c_custkey, (row_number() over (order by md5('7:' || c_custkey::varchar), c_custkey))::int as rank from customer qualify rank <= 50")
def _(spark, sf):
    return ranking.random_subset(_t(spark, sf, "customer").select("c_custkey"), "c_custkey", 50, 7)


def _list(values) -> str:
    return "(values " + ", ".join(f"('{v}')" if isinstance(v, str) else f"({v})" for v in values) + ")"


_ALLOWED = "case when s = 'anchored' then t = 'anchored' when s = 'orient' and t = 'anchored' then false when s = 'target_only' then t <> 'none' when s = 'full_source' then true else t <> 'none' end"
GRID = f"""gr as (select b as budget, g as target, s as source_method, t as target_method, 'B' || b || '_' || g || '_S' || s || '_T' || t as run_id from {_list(BUDGETS)} x(b), (select 'T' || s_suppkey from supplier) y(g), {_list(grid.SOURCE_METHODS)} z(s), {_list((grid.NONE, *grid.TARGET_METHODS))} w(t) where {_ALLOWED})"""


def targets(spark, sf):
    return _t(spark, sf, "supplier").select(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("target"))


def _grid(spark, sf):
    return grid.method_grid(spark, targets(spark, sf), BUDGETS)


@query("method_grid", f"""with {GRID} select budget::int as budget, target, source_method, target_method, run_id, case when source_method = 'target_only' then null when source_method = 'full_source' then 'full_source' when source_method = 'orient' then 'orient_' || target_method || '_' || budget else source_method || '_' || budget end as source_split,
case when target_method = 'none' then null when target_method = 'ada_clue' then 'clue_10' else target_method || '_10' end as target_split, ((source_method <> 'target_only')::int + (target_method <> 'none')::int)::int as n_domains from gr""")
def _(spark, sf):
    return _grid(spark, sf)


@query("pair_predicate", f"select g as target, s as source_method, t as target_method, {_ALLOWED} as allowed from (select 'T' || s_suppkey from supplier) y(g), {_list(grid.SOURCE_METHODS)} z(s), {_list((grid.NONE, *grid.TARGET_METHODS))} w(t)")
def _(spark, sf):
    rows = targets(spark, sf).withColumn("source_method", F.explode(F.array(*map(F.lit, grid.SOURCE_METHODS)))).withColumn("target_method", F.explode(F.array(*map(F.lit, grid.pair_methods()))))
    return rows.select("target", "source_method", "target_method", grid.pair_allowed("source_method", "target_method").alias("allowed"))


@query("config_records", f"""with {GRID} select run_id, 'results/' || run_id as save_dir, 'data/target_splits/' || target || '/eval' as eval_split, ((source_method <> 'target_only')::int + (target_method <> 'none')::int)::int as n_domains from gr""")
def _(spark, sf):
    return grid.config_records(_grid(spark, sf)).select("run_id", "save_dir", "eval_split", F.size("domains").alias("n_domains"))


@query("manifest_filter", f"with {GRID} select run_id from gr where target = 'T2' and source_method in ('orient', 'coreset') and target_method = 'lada'")
def _(spark, sf):
    return grid.filter_manifest(_grid(spark, sf), {"target": ["T2"], "source_method": ["orient", "coreset"]}, ["lada"]).select("run_id")


@query("duplicate_ids", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def _(spark, sf):
    return constraints.duplicate_ids(_t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("split_cardinality", "select source, lang, count(*) as n, count(distinct doc_id) as n_distinct, max(30)::bigint as expected from documents group by 1, 2 having count(*) <> 30 or count(distinct doc_id) <> 30")
def _(spark, sf):
    return constraints.split_cardinality(_t(spark, sf, "documents").withColumn("want", F.lit(30).cast("long")), ["source", "lang"], "want", "doc_id")


@query("set_difference_groups", "select vec_id as k, 'left' as side from embeddings where vec_id not in (select l_partkey from lineitem) union all select distinct l_partkey, 'right' from lineitem where l_partkey not in (select vec_id from embeddings)")
def _(spark, sf):
    return constraints.set_difference(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("k")), _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")), "k")


@query("reorder_subjects", "select vec_id, (row_number() over (order by vec_id desc))::int as pos, label from embeddings")
def _(spark, sf):
    e = _t(spark, sf, "embeddings")
    order = ranking.number_rows(e.select("vec_id"), F.desc("vec_id"), first=1)
    return constraints.reorder(e.select("vec_id", "label"), order, "vec_id").select("vec_id", "pos", "label")


@query("manifest_violations", f"with {GRID} select 'row_count' as \"check\", count(*)::varchar as detail from gr having count(*) <> 900")
def _(spark, sf):
    return constraints.manifest_violations(grid.config_records(_grid(spark, sf)), 900)


from . import experiment  # noqa: E402, F401  (its queries use the tables above)
