"""The sweep over K against NumPy, and what it shuffles."""

import re

import numpy as np
import pytest

from clonal_spark.functions import mathx as mx
from clonal_spark.functions.emission import Binomial
from clonal_spark.operators import mixture as mo
from clonal_spark.plans import engines as en
from clonal_spark.sources.observations import from_arrays


def test_sweep(spark):
    rng = np.random.default_rng(5)
    depth = rng.integers(20, 90, (90, 3)).astype(float)
    alt, adj = rng.binomial(depth.astype(int), rng.choice([0.1, 0.4], (90, 1))).astype(float), rng.choice([0.7, 1.0, 1.4], (90, 3))
    found = mo.bic_sweep(from_arrays(spark, alt, depth, adj), [1, 2, 5], Binomial())
    rows = {r.K: r for r in found.collect()}
    for k in (1, 2, 5):
        log_r = en.log_resp(np.full(k, -np.log(k)), alt, depth, adj, en.initial_centers(alt, depth, k), Binomial(), Binomial().np_fixed(alt, depth))
        ll = mx.np_logsumexp(log_r, 1).sum()
        assert rows[k].log_lik == pytest.approx(ll, rel=1e-9) and rows[k].bic == pytest.approx(en.bic(ll, k, 3, 90), rel=1e-9)
    # mutations are shuffled, and not mutations times clones
    keys = re.findall(r"hashpartitioning\((.*?)\)", found._jdf.queryExecution().executedPlan().toString())
    assert any("mut_id" in k for k in keys) and not any("mut_id" in k and ("n_clones" in k or "k#" in k) for k in keys)
