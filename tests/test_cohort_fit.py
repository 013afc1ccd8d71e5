"""Tumours of different sizes in one plan against the group form, preset by preset."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clonal_spark.config import CONFIGS, CloneConfig, InferenceEngine
from clonal_spark.plans import engines as en
from clonal_spark.plans.cohort import fit_large
from clonal_spark.plans.model import GenerativeModel
from clonal_spark.sources.observations import from_arrays


def cells(seed, sizes, samples=2):
    rng = np.random.default_rng(seed)
    p = np.repeat(np.array([[0.45, 0.4], [0.2, 0.005], [0.005, 0.25], [0.03, 0.04]])[:, :samples], sizes, 0)
    depth = rng.integers(60, 140, p.shape).astype(float)
    return rng.binomial(depth.astype(int), p).astype(float), depth, np.where(rng.random(p.shape) < 0.8, 2.0, 3.0)


TUMOURS = {3: cells(11, [60, 40, 40, 20]), 7: cells(12, [30, 0, 20, 9], 1), 9: cells(13, [20, 20, 5, 5])}


def cohort(spark):
    out = None
    for t, (alt, depth, cn) in TUMOURS.items():
        one = from_arrays(spark, alt, depth, None, cn, tumour_id=t)
        out = one if out is None else out.unionByName(one)
    return out


@pytest.mark.parametrize("name", ["quantumclone_v1", "mobster", "decifer_style", "conipher_style", "calder_style", "wes_clinical", "wgs_cohort_phylo", "multiregion_phylo"])
def test_frontier_equals_groups(spark, name, monkeypatch):
    """With few iterations, as each is a pass; blocks of 50 cells, so that the largest tumour has several."""
    em, mfvi = en.em, en.mfvi
    monkeypatch.setattr(en, "HYBRID_EM", 2)
    monkeypatch.setattr(en, "mfvi", lambda *a: mfvi(*a, max_iter=2))
    monkeypatch.setitem(en.ENGINES, InferenceEngine.EM, lambda *a: em(*a, max_iter=3))
    monkeypatch.setitem(en.ENGINES, InferenceEngine.MFVI, en.mfvi)
    config = CONFIGS[name]
    got = fit_large(cohort(spark), config, name, block=50, max_iter=3 if config.inference is InferenceEngine.EM else 2)
    summary = {r.tumour_id: r for r in got.fit_summary.collect()}
    centers, edges, resp = got.centers.toPandas(), got.tree_edges.toPandas(), got.responsibilities.toPandas()
    assigned = got.assignments.toPandas().sort_values(["tumour_id", "mut_id"])
    assert set(summary) == set(TUMOURS)
    for t, (alt, depth, cn) in TUMOURS.items():
        a = en.fit_arrays(config, alt, depth, None, cn)
        r = summary[t]
        assert (r.config, r.K, r.n_iter) == (name, a.k, a.n_iter) and r.ll == pytest.approx(a.ll, rel=1e-6) and r.bic == pytest.approx(a.bic, rel=1e-6)
        c = centers[centers.tumour_id == t].pivot(index="k", columns="sample_id", values="center").to_numpy()
        assert c == pytest.approx(a.centers, abs=1e-4)
        tree = edges[edges.tumour_id == t].sort_values("k")
        assert (a.parents is None) == tree.empty and (a.parents is None or tree.parent.tolist() == list(a.parents))
        rows = assigned[assigned.tumour_id == t]
        assert rows.k.tolist() == a.assignments.tolist() and rows.kept.tolist() == (np.ones(len(alt), bool) if a.mask is None else a.mask).tolist()
        r = resp[resp.tumour_id == t].pivot(index="mut_id", columns="k", values="r").to_numpy()
        assert r == pytest.approx(a.resp, abs=1e-4)


def test_one_call_for_all_sizes(spark, monkeypatch):
    """Small tumours are as groups give them, large ones as the frontier does, in one set of tables."""
    from clonal_spark.plans import cohort as plans

    config = CloneConfig(emission=CONFIGS["quantumclone_v1"].emission, inference=InferenceEngine.EM, k_prior=CONFIGS["calder_style"].k_prior, phylo=CONFIGS["quantumclone_v1"].phylo, noise=CONFIGS["quantumclone_v1"].noise, n_clones=3)
    model, obs = GenerativeModel(config), cohort(spark)
    monkeypatch.setattr(plans, "fit_large", lambda obs, config, name, block: fit_large(obs, config, name, block, max_iter=4))
    mixed, grouped, large = model.fit_cohort(obs, 120), model.fit(obs), fit_large(obs.where("tumour_id = 3"), config, block=60, max_iter=4)
    for table, keys in (("fit_summary", ["tumour_id"]), ("centers", ["tumour_id", "k", "sample_id"]), ("assignments", ["tumour_id", "mut_id"]), ("tree_edges", ["tumour_id", "k"])):
        got = getattr(mixed, table).toPandas().sort_values(keys)
        for alone, own in ((grouped, got.tumour_id != 3), (large, got.tumour_id == 3)):
            want = getattr(alone, table).toPandas().sort_values(keys)
            want = want[want.tumour_id.isin(got[own].tumour_id)]
            pd.testing.assert_frame_equal(got[own].reset_index(drop=True), want[got.columns].drop(columns="config", errors="ignore").assign(**({"config": "custom"} if "config" in got else {}))[got.columns].reset_index(drop=True), check_dtype=False, rtol=1e-6)


def test_missing_cells_and_an_empty_cohort(spark):
    config = CloneConfig(emission=CONFIGS["quantumclone_v1"].emission, inference=InferenceEngine.EM, k_prior=CONFIGS["calder_style"].k_prior, phylo=CONFIGS["pyclone_vi"].phylo, noise=CONFIGS["quantumclone_v1"].noise, n_clones=2)
    obs = cohort(spark).where("NOT (mut_id % 5 = 0 AND sample_id = '001')")
    got = fit_large(obs, config, block=70, max_iter=2)
    assert got.assignments.count() == obs.select("tumour_id", "mut_id").distinct().count() and got.centers.where(F.col("center").isNull()).isEmpty()
    assert fit_large(obs.limit(0), config).fit_summary.isEmpty()
