"""The whole selection against a plain version in one process, from the signals and clusters on."""

import math
from dataclasses import replace

import numpy as np
import pytest

from covelight.operators import curation
from covelight.plans import catalog


def sig(x):
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def top(x, k):
    return set(np.argsort(-x, kind="mergesort")[:k].tolist())


def overlap(a, b):
    return len(a & b) / max(1, min(len(a), len(b)))


def plain_quota_seed(members, cluster, score, budget):
    if budget <= 0 or not members:
        return []
    labels = sorted({cluster[i] for i in members})
    mass = {c: sum(max(score[i], 0.0) for i in members if cluster[i] == c) + 1e-8 for c in labels}
    total = sum(mass.values())
    quota = {c: max(1, math.floor(budget * mass[c] / total)) for c in labels}
    while sum(quota.values()) > budget and max(quota.values()) > 1:
        c = max(quota, key=quota.get)
        quota[c] -= 1
    while sum(quota.values()) < min(budget, len(members)):
        c = max(labels, key=lambda c: budget * mass[c] / total - quota[c])
        quota[c] += 1
    kept = [i for c in labels for i in sorted((i for i in members if cluster[i] == c), key=lambda i: -score[i])[: quota[c]]]
    return sorted(kept, key=lambda i: (-score[i], i))[:budget]


def plain_selection(g, v, trust, cfg):
    """Seeds by group, then the picks with their scores."""
    col = {c: g[c].to_numpy(float) for c in ("R", "I", "L", "M", "D", "F", "A", "density_raw")}
    n, k = len(g), cfg.top_signal_pool
    r_top, i_top, l_top, f_top, u_top = top(col["R"], k), top(col["I"], k), top(col["L"], k), top(col["F"], cfg.top_facility_pool), top(col["R"], cfg.top_utility_pool)
    late = 1 - overlap(i_top, l_top)
    h, h_top = (col["L"], l_top) if late > 0.08 else (col["I"], i_top)
    s1 = sig((cfg.sparse_rho0 - trust) / cfg.sparse_tau)
    align = (overlap(r_top, f_top) + overlap(h_top, f_top)) / 2
    s2 = (1 - s1) * sig((align - cfg.coverage_alignment0) / cfg.coverage_alignment_tau)
    votes = np.array([(i in r_top) + (i in h_top) + (i in f_top) for i in range(n)])
    s3 = (1 - s1) * (1 - s2) * ((votes >= 2).sum() / max(1, (votes >= 1).sum()))
    powers = [max(s, 1e-8) ** cfg.gate_power for s in (s1, s2, s3)]
    a1, a2, a3 = (sig((p / (sum(powers) + 1e-12) - 0.5) / cfg.gate_temperature) for p in powers)
    member = lambda s: np.array([i in s for i in range(n)], float)
    score = (0.20 + 0.05 * late) * col["R"] + (0.15 + 0.05 * late) * h + 0.15 * col["D"] + 0.20 * col["A"] + (0.20 - 0.05 * late) * member(f_top) + (0.10 - 0.05 * late) * (votes >= 2)
    signal = max(0, round(cfg.consensus_signal_intercept + cfg.consensus_signal_late_slope * late))
    quotas = {"multi": cfg.consensus_multi_quota, "facility_only": max(0, round(cfg.consensus_facility_intercept - cfg.consensus_facility_late_slope * late)), "reliability_only": signal, "influence_only": signal}
    groups = {"multi": {i for i in range(n) if votes[i] >= 2}, "facility_only": f_top - r_top - h_top, "reliability_only": r_top - f_top - h_top, "influence_only": h_top - f_top - r_top}
    cluster = g["cluster"].tolist()
    full = {name: plain_quota_seed(sorted(groups[name]), cluster, score, quotas[name]) for name in groups}
    seeds = {i for name in groups for i in plain_quota_seed(sorted(groups[name]), cluster, score, round(a3 * quotas[name]))}
    low = member({i for i in range(n) if col["density_raw"][i] <= np.percentile(col["density_raw"], 10)})
    sparse = col["R"] + cfg.sparse_match_weight * col["M"] + cfg.sparse_low_density_weight * low
    base = a1 * (sparse - cfg.barrier_weight * (1 - member(u_top))) + a2 * (col["R"] - cfg.barrier_weight * (1 - member(f_top))) + a3 * score
    allowed = u_top | r_top | h_top | f_top
    chosen = sorted(seeds, key=lambda i: (-score[i], i))[: cfg.budget]
    while len(chosen) < cfg.budget:
        near = np.maximum((v @ v[chosen].T).max(1), 0) if chosen else np.zeros(n)
        value = base - cfg.redundancy_lambda * near
        value[[i for i in range(n) if i not in allowed or i in chosen]] = -np.inf
        if not np.isfinite(value.max()):
            break
        chosen.append(int(value.argmax()))
    counts = [len(set(chosen) & s) for s in (r_top, h_top, f_top, groups["multi"])]
    return full, chosen, base, counts, col


@pytest.fixture(scope="module")
def inputs(spark, sf):
    source, support, scores = catalog.scored_source(spark, sf), catalog.support(spark, sf), catalog.source_scores(spark, sf)
    v = np.array([r["v"] for r in source.orderBy("pos").collect()])
    s = np.array([r["v"] for r in support.collect()])
    return source, support, scores, v, float(np.maximum(v @ s.T, 0).max(1).mean())


SETTINGS = [
    {}, {"sparse_rho0": 2.0}, {"sparse_rho0": -1.0, "coverage_alignment0": -1.0}, {"sparse_rho0": -1.0, "coverage_alignment0": 2.0, "consensus_multi_quota": 12, "budget": 55}, {"top_signal_pool": 25, "clusters": 3, "budget": 20, "redundancy_lambda": 0.5},
]


@pytest.mark.parametrize("settings", SETTINGS)
def test_selection_is_the_plain_one(inputs, settings):
    source, support, scores, v, trust = inputs
    cfg = replace(catalog.CONFIG, **settings)
    found = curation.select_sources(source, support, scores, cfg)
    g = found.grouped.orderBy("pos").toPandas()
    seeds, chosen, base, counts, col = plain_selection(g, v, trust, cfg)
    pos = g["pos"].tolist()
    picks = found.picks.orderBy("rank").collect()
    assert [r["pos"] for r in picks] == [pos[i] for i in chosen] and len(chosen) == cfg.budget
    assert [r["score"] for r in picks] == pytest.approx([base[i] for i in chosen], abs=1e-9)
    late = found.diagnostics.first()["late_distinctness"]
    quotas = curation.quota_seeds(curation.consensus(found.grouped.drop("multi", "consensus", "group")), curation.group_quotas(late, cfg)).collect()
    assert {(r["group"], r["pos"]) for r in quotas} == {(name, pos[i]) for name, own in seeds.items() for i in own}
    means = curation.signal_means(found.picks).first()
    assert [means[f"mean_{c}"] for c in "RILMDFA"] == pytest.approx([col[c][chosen].mean() for c in "RILMDFA"])
    n = curation.selected_counts(found.picks).first()
    assert [n["n_r_top"], n["n_h_top"], n["n_f_top"], n["n_multi"], n["n"]] == [*counts, cfg.budget]
