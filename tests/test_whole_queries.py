"""Queries over whole inputs, against pandas and NumPy."""

import numpy as np
import pandas as pd
import pytest

from clonal_spark.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_cohort_features_see_all_samples(spark):
    rows = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_suppkey", "l_partkey", "l_returnflag"])
    groups = rows.groupby("l_suppkey")
    muts, samples = groups["l_partkey"].nunique(), groups["l_returnflag"].nunique()
    got = {r.tumour_id: r for r in QUERIES["meta_features_all_samples"](spark, SF).collect()}
    assert {t: r.n_samples for t, r in got.items()} == samples.to_dict() and max(samples) == 3
    assert {t: r.n_mutations for t, r in got.items()} == muts.to_dict()
    assert {r.tumour_id for r in QUERIES["head_mean_select"](spark, SF).select("tumour_id").distinct().collect()} == set(got)


def test_head_sums_use_whole_embeddings(spark):
    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    z, reward = np.stack(rows["embedding"]).astype(float), (rows["vec_id"] % 100 / 100.0).to_numpy()
    zz = {(r.arm, r.i, r.j): r.zz for r in QUERIES["head_suffstats_whole"](spark, SF).collect()}
    zy = {(r.arm, r.i): (r.zy, r.n) for r in QUERIES["head_vectors_whole"](spark, SF).collect()}
    arms = sorted(set(rows["label"]))
    assert len(zz) == len(arms) * 64 * 64 and len(zy) == len(arms) * 64
    for arm in arms:
        m = (rows["label"] == arm).to_numpy()
        assert np.array([[zz[arm, i, j] for j in range(64)] for i in range(64)]) == pytest.approx(z[m].T @ z[m], abs=1e-6)
        assert np.array([zy[arm, i] for i in range(64)]) == pytest.approx(np.stack([z[m].T @ reward[m], np.full(64, m.sum())], 1), abs=1e-6)


def test_simulated_tumours_are_whole(spark):
    from clonal_spark.sources.simulate import params_table

    asked = sorted(r.n_mutations for r in params_table(spark, 20).select("n_mutations").collect())
    made = sorted(r["count"] for r in QUERIES["simulate_cohort"](spark, SF).select("tumour_id", "mut_id").distinct().groupBy("tumour_id").count().collect())
    assert len(made) == 20 and all(m >= a for m, a in zip(made, asked, strict=True)) and asked[-1] > 1000  # a tail comes on top
