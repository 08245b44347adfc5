"""Queries of splits, package checks and run files over the test tables; part of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, splits, subjects, validation
from ..sources import runs
from .catalog import GRID, SRC, TARGETS, E, _cover, _grid, _r, _t, embedded, query, r6, slice_scores, source, support, target, targets


@query("target_filter", "select doc_id, lang from documents where lang in (select min(lang) from documents)")
def _(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "lang")
    first = docs.agg(F.min("lang")).first()[0]
    return splits.for_targets(splits.for_targets(docs, "all", "lang"), first, "lang")


@query("skip_empty_slices", "select l_partkey, count(*) as n from lineitem where l_tax > 0 group by 1")
def _(spark, sf):
    return splits.present_slices(_t(spark, sf, "lineitem"), "l_tax").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("subject_rows", """with x as (select user_id, (row_number() over (order by event_id)) - 1 as r from events)
select user_id, count(*) as n, min(r)::bigint as first, max(r)::bigint as last, sum(r)::bigint as total from x group by 1""")
def _(spark, sf):
    found = splits.subject_rows(_t(spark, sf, "events"), "user_id", "event_id")
    return found.select("user_id", F.size("rows").cast("long").alias("n"), F.get("rows", F.lit(0)).alias("first"), F.element_at("rows", -1).alias("last"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("subject_gradient", f"""with {E}, p as (select label, pos % 3 + 1 as n, unnest(v) as x, unnest(range(1, len(v) + 1)) as i from e), m as (select label, i, sum(x * n) / sum(n) as m from p group by 1, 2),
g as (select label, list(m order by i) as g from m group by 1) select label, {_r('g[1] / (sqrt(list_inner_product(g, g)) + 1e-8)')} as first, {_r('list_sum(g) / (sqrt(list_inner_product(g, g)) + 1e-8)')} as total from g""")
def _(spark, sf):
    slices = embedded(spark, sf).withColumn("n", F.col("pos") % 3 + 1)
    got = splits.subject_gradient(slices, ["label"])
    return got.select("label", r6(F.get("gradient", F.lit(0))).alias("first"), r6(F.aggregate("gradient", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("mean_probabilities", """with c as (select l_partkey as pos, count(*)::double as n, sum((l_returnflag = 'A')::int) as a, sum((l_returnflag = 'N')::int) as b, sum((l_returnflag = 'R')::int) as c from lineitem group by 1)
select pos, round(a / n, 6) + 0 as a, round(b / n, 6) + 0 as b, round(c / n, 6) + 0 as c, round((b + c) / n, 6) + 0 as fg, (case when a >= b and a >= c then 0 when b >= c then 1 else 2 end)::int as top from c""")
def _(spark, sf):
    flags = F.array(*[(F.col("l_returnflag") == x).cast("double") for x in "ANR"])
    probs = subjects.mean_probabilities(_t(spark, sf, "lineitem").select(F.col("l_partkey").alias("pos"), flags.alias("p")), ["pos"], "p")
    return probs.select("pos", *[r6(F.get("p", F.lit(i))).alias(n) for i, n in enumerate("abc")], r6(subjects.foreground_score("p")).alias("fg"), subjects.top_class("p").alias("top"))


@query("support_subsets", f"with {SRC}, x as (select d, pos, row_number() over (partition by d order by md5('2025:' || d || ':' || pos), pos) as r from sup, range(0, 8) y(d)) select d::int as d, pos from x where r <= round(0.8 * (select count(*) from sup))")
def _(spark, sf):
    from ..operators import reliability

    parts = [p.select(F.lit(i).alias("d"), "pos") for i, p in enumerate(reliability.support_subsets(support(spark, sf)))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole


@query("full_source", f"with {SRC} select pos, (row_number() over (order by pos))::int as rank from src")
def _(spark, sf):
    return splits.full_source(source(spark, sf))


def _state(spark, sf):
    scores = slice_scores(spark, sf).select("pos", F.col("unc").alias("uncertainty"), F.col("fg").alias("foreground"), F.col("li").alias("inconsistency"), F.col("cons").alias("consistency"))
    return target(spark, sf).join(scores, "pos")


_TEN = "sup as (select pos, v from tgt where pos in (select l_partkey from lineitem) order by md5('7:' || pos), pos limit 10)"


@query("orient_split", f"with recursive {SRC.replace('sup as', 'sup0 as', 1)}, {_TEN}, {_cover('src', 12)} select distinct step::int as rank, pick as pos from fac where step > 0")
def _(spark, sf):
    from ..operators.ranking import random_subset

    state = _state(spark, sf)
    return splits.orient(source(spark, sf), state, random_subset(state.select("pos"), "pos", 10, 7), 12)


@query("split_dispatch")
def _(spark, sf):
    return splits.all_splits(source(spark, sf), _state(spark, sf), "T1", (8,))


@query("eval_splits", "select lang as target, case when doc_id % 5 = 0 then 'test' else 'val' end as kind, doc_id as rank, source as subject_id from documents where doc_id % 5 < 2")
def _(spark, sf):
    kind = F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "val").otherwise("train")
    return splits.eval_splits(_t(spark, sf, "documents").select(F.col("lang").alias("target"), kind.alias("kind"), F.col("doc_id").alias("rank"), F.col("source").alias("subject_id")))


@query("relative_paths", "select url, case when url like 'https://example.com/%' then substr(url, 21) else url end as path from pages")
def _(spark, sf):
    return _t(spark, sf, "pages").select("url", runs.relative_path("url", "https://example.com").alias("path"))


_SOURCES = "(select source as target, count(*) as n from documents group by 1)"


@query("state_violations", f"""with s as {_SOURCES}, t as (select distinct source as target from documents)
select 'missing_part' as "check", target || '/M' as item, null::varchar as found, null::varchar as expected from t
union all select 'length', target || '/G', (n - 1)::varchar, n::varchar from s union all select 'pool_size', target, n::varchar, '200' from s where n < 200""")
def _(spark, sf):
    pools = _t(spark, sf, "documents").where("source is not null").groupBy(F.col("source").alias("target")).agg(F.count(F.lit(1)).alias("rows"))
    kept = [p for p in validation.STATE_PARTS if p != "M"]
    parts = pools.select("target", F.explode(F.array(*map(F.lit, kept))).alias("part"), "rows").withColumn("rows", F.when(F.col("part") == "G", F.col("rows") - 1).otherwise(F.col("rows")))
    return validation.state_violations(parts, 200, [r[0] for r in pools.select("target").collect()])


@query("training_violations", """select 'row_count' as "check", 'manifest' as item, '5' as found, '4' as expected union all select 'missing_target', 'T4', null, null union all select 'unknown_target', x, null, null from (values ('ASIA'), ('EUROPE')) v(x)
union all select 'budget', 'EUROPE', '40', '50' union all select 'config_path', 'c/EUROPE', null, null""")
def _(spark, sf):
    rows = _t(spark, sf, "region").where("r_name in ('ASIA', 'EUROPE')").select(F.col("r_name").alias("target")).union(spark.createDataFrame([(t,) for t in TARGETS[:3]], "target string"))
    manifest = rows.select("target", F.when(F.col("target") == "EUROPE", 40).otherwise(50).alias("budget"), F.concat(F.lit("c/"), "target").alias("config_path"))
    return validation.training_violations(manifest, TARGETS, 50, manifest.where("target <> 'EUROPE'").select("config_path"))


def _counts(spark, sf):
    """Sizes of all splits of the grid, one of them wrong."""
    domains = grid.config_records(_grid(spark, sf)).select(F.explode("domains").alias("d")).select("d.split", F.col("d.count").alias("n"))
    full = F.when(F.col("split").endswith("/full_source"), 500).otherwise(F.col("n"))
    return domains.groupBy("split").agg(F.max(full).cast("long").alias("n")).withColumn("n", F.when(F.col("split").endswith("T2/coreset_50"), F.col("n") - 1).otherwise(F.col("n")))


@query("grid_violations", f"""with {GRID} select 'row_count' as "check", 'manifest' as item, count(*)::varchar as found, '900' as expected from gr union all select 'split_count', run_id || '/source', '49', '50' from gr where target = 'T2' and budget = 50 and source_method = 'coreset'
union all select 'save_dir', run_id, 'elsewhere/' || run_id, 'results' from gr where target = 'T3' and source_method = 'orient' and target_method = 'lada' union all select 'skipped', 'skipped_count', null, null""")
def _(spark, sf):
    manifest = grid.config_records(_grid(spark, sf), keep=["target", "budget", "source_method", "target_method"])
    odd = (F.col("target") == "T3") & (F.col("source_method") == "orient") & (F.col("target_method") == "lada")
    manifest = manifest.withColumn("save_dir", F.when(odd, F.concat(F.lit("elsewhere/"), "run_id")).otherwise(F.col("save_dir")))
    pools = targets(spark, sf).withColumn("pool", F.lit(500).cast("long"))
    return validation.grid_violations(manifest, 900, _counts(spark, sf), pools, keys=("budget", "rows", "skipped_count"))


@query("domain_violations", f"""with {GRID}, x as (select * from gr where source_method = 'anchored' and budget = 100) select 'domains' as "check", run_id as item, 'target,source' as found, 'source,target' as expected from x where target = 'T1'
union all select 'source_split', run_id, 'data/target_splits/T1/anchored_10', 'data/source_splits/T1/anchored_100' from x where target = 'T1' union all select 'target_split', run_id, 'data/source_splits/T1/anchored_100', 'data/target_splits/T1/anchored_10' from x where target = 'T1'
union all select 'source_count', run_id, '10', '100' from x where target = 'T1' union all select 'target_count', run_id, '100', '10' from x where target = 'T1' union all select 'test_list', run_id, 'data/target_splits/T4/eval', null from x where target = 'T4'""")
def _(spark, sf):
    chosen = _grid(spark, sf).where("source_method = 'anchored' and budget = 100")
    configs = grid.config_records(chosen).join(chosen.select("run_id", "target"), "run_id").withColumns({"val_split": F.col("eval_split"), "test_split": F.col("eval_split")})
    turned = configs.withColumn("domains", F.when(F.col("target") == "T1", F.reverse("domains")).otherwise(F.col("domains")))
    path = lambda kind, name: F.concat_ws("/", F.lit("data"), F.lit(kind), F.col("target"), F.col(name))
    expected = chosen.select("run_id", path("source_splits", "source_split").alias("source_split"), path("target_splits", "target_split").alias("target_split"), F.lit(100).alias("source_count"), F.lit(10).alias("target_count"))
    train = configs.select(F.explode("domains").alias("d")).select("d.split", F.lit("train").alias("part"), F.col("d.count").cast("long").alias("n")).distinct()
    lists = configs.select(F.col("eval_split").alias("split"), "target", F.explode(F.array(F.lit("val"), F.lit("test"))).alias("part")).where("not (target = 'T4' and part = 'test')").select("split", "part", F.lit(5).cast("long").alias("n"))
    return validation.domain_violations(turned, expected, train.union(lists))


@query("split_row_counts", """with d as (select source || '/' || lang as split, count(distinct doc_id) as n from documents where source is not null and lang is not null group by 1)
select 'B50_' || r_name as run_id, 'source' as name, coalesce(split, 'none') as split, coalesce(n, 0)::bigint as n from region left join d on split = (select min(split) from d)""")
def _(spark, sf):
    rows = _t(spark, sf, "documents").where("source is not null and lang is not null").select(F.concat_ws("/", "source", "lang").alias("split"), F.col("doc_id").alias("subject_id"))
    first = rows.agg(F.min("split")).first()[0]
    manifest = _t(spark, sf, "region").select(F.concat(F.lit("B50_"), "r_name").alias("run_id"), F.array(F.struct(F.lit("source").alias("name"), F.lit(first).alias("split"))).alias("domains"))
    return validation.split_row_counts(manifest, rows)


@query("run_configs", f"""with {GRID} select run_id, 'efficientvit_l1' as model, 512 as img_size, 20 as t_max, 20 as epochs, 'results/' || run_id as save_dir, ((source_method <> 'target_only')::int + (target_method <> 'none')::int)::int as n_domains, 'data/target_splits/' || target || '/eval' as val_split
from gr where not (source_method = 'coreset' and target = 'T2' and budget = 50)""")
def _(spark, sf):
    lists = targets(spark, sf).select(F.concat(F.lit("data/target_splits/"), "target", F.lit("/eval")).alias("split"), F.lit(5).cast("long").alias("n"))
    got = grid.run_configs(_grid(spark, sf), _counts(spark, sf).union(lists))
    return got.select("run_id", F.col("model.name").alias("model"), "data.img_size", F.col("scheduler.T_max").alias("t_max"), "training.epochs", "training.save_dir", F.size("data.domains").alias("n_domains"), F.col("data.val.split_txt").alias("val_split"))



def _maps(spark, sf):
    """Each embedding as scores of four classes at sixteen places."""
    from ..operators import tensors

    scores = _t(spark, sf, "embeddings").select("vec_id", "label", tensors.tensor("embedding", 4, 4, 4).alias("scores"))
    return scores.withColumn("probs", tensors.softmax_maps("scores"))


_MAPS = """x as (select vec_id, label, p, list_transform(range(4), lambda c: exp(embedding[c * 16 + p + 1]::double)) as z from embeddings, range(16) t(p)),
q as (select vec_id, label, p, list_transform(z, lambda a: a / list_sum(z)) as q from x)"""


@query("slice_tensors", f"""with {_MAPS} select vec_id, {_r('avg(0.0 - list_sum(list_transform(q, lambda a: a * ln(a + 1e-8))))')} as entropy, {_r('avg(q[2] + q[3] + q[4])')} as foreground,
{_r('avg(q[1])')} as p0, {_r('avg(q[4])')} as p3 from q group by 1""")
def _(spark, sf):
    from ..operators import tensors

    got = _maps(spark, sf).select("vec_id", tensors.probability_summary("probs").alias("s"))
    return got.select("vec_id", r6("s.entropy").alias("entropy"), r6("s.foreground").alias("foreground"), r6(F.get("s.mean_probs", F.lit(0))).alias("p0"), r6(F.get("s.mean_probs", F.lit(3))).alias("p3"))


@query("tensor_morphology", f"""with {_MAPS}, c as (select label, list_position(q, list_max(q)) - 1 as c from q)
select label as subject_id, count(*) as total, sum((c > 0)::int)::bigint as whole, sum((c in (1, 3))::int)::bigint as core, sum((c = 3)::int)::bigint as enhancing, {_r('avg((c > 0)::int)')} as whole_ratio from c group by 1""")
def _(spark, sf):
    from ..operators import tensors

    slices = _maps(spark, sf).select(F.col("label").alias("subject_id"), tensors.class_map("probs").alias("tensor"))
    return tensors.subject_morphology(slices).select("subject_id", "total", "whole", "core", "enhancing", r6("whole_ratio").alias("whole_ratio"))
