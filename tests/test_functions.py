"""Special functions and emissions: Column forms, NumPy forms and exact values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonal_spark.config import CONFIGS, CloneConfig, EmissionModel, InferenceEngine, KPrior, PhyloMode, SubChallenge, set_backend
from clonal_spark.functions import mathx as mx
from clonal_spark.functions.emission import EMISSIONS, BetaBinomial, BetaBinomialPareto, Binomial

CASES = [(10, 50, 0.3), (25, 50, 0.5), (0, 50, 0.3), (50, 50, 0.9), (1, 100, 0.01), (99, 100, 0.99), (30, 100, 0.3), (5, 200, 0.025), (100, 200, 0.5)]


def log_binomial(k, n, p):
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n - k else 0)


def test_lgamma_and_digamma(spark):
    x = [1e-9, 1e-3, 0.5, 1.0, 2.0, 7.3, 50.0, 1e3, 1e5]
    got = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(mx.lgamma(F.col("x")).alias("y")).collect()]
    want = [math.lgamma(v) for v in x]
    assert got == pytest.approx(want, rel=1e-11, abs=1e-11) and mx.np_lgamma(x) == pytest.approx(want, rel=1e-11, abs=1e-11)
    h = 1e-5
    assert mx.np_digamma([0.5, 3.0, 40.0]) == pytest.approx([(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in (0.5, 3.0, 40.0)], rel=1e-6)
    assert mx.np_digamma(1.0) == pytest.approx(-0.5772156649015329, rel=1e-10)


@pytest.mark.parametrize("model", list(EmissionModel))
def test_twins_agree(spark, model):
    e = EMISSIONS[model]()
    df = spark.createDataFrame([(float(k), float(n), p) for k, n, p in CASES], "alt double, depth double, mu double")
    got = [r.y for r in df.select(e.log_prob(F.col("alt"), F.col("depth"), F.col("mu")).alias("y")).collect()]
    a = np.array(CASES, float)
    assert got == pytest.approx(e.np_log_prob(a[:, 0], a[:, 1], a[:, 2]).tolist(), rel=1e-9, abs=1e-9)


def test_binomial_is_exact():
    assert [Binomial().np_log_prob(k, n, p).item() for k, n, p in CASES] == pytest.approx([log_binomial(*c) for c in CASES], rel=1e-9)


def test_limits_and_edges():
    a = np.array(CASES, float)
    tight = BetaBinomial(CloneConfig(phi=1e6))
    assert tight.np_log_prob(a[:, 0], a[:, 1], a[:, 2]) == pytest.approx(Binomial().np_log_prob(a[:, 0], a[:, 1], a[:, 2]), rel=5e-3)
    bare = BetaBinomialPareto(CloneConfig(tail_weight=1e-9))
    b = a[a[:, 0] > 0]  # at frequency 0 the tail's density is at its bound, whatever its weight
    assert bare.np_log_prob(b[:, 0], b[:, 1], b[:, 2]) == pytest.approx(BetaBinomial().np_log_prob(b[:, 0], b[:, 1], b[:, 2]), rel=1e-4)
    for e in (x() for x in EMISSIONS.values()):
        for mu in (0.0, 1e-12, 1.0):
            assert np.isfinite(e.np_log_prob(np.array([0.0, 50.0]), np.array([50.0, 50.0]), mu)).all()


def test_beta_binomial_sums_to_one():
    k = np.arange(0, 61.0)
    assert np.exp(BetaBinomial().np_log_prob(k, 60.0, 0.3)).sum() == pytest.approx(1, rel=1e-9)


def test_config_rules():
    assert len(CONFIGS) == 12 and SubChallenge.parse("sc2b") is SubChallenge.SC2B
    for broken in (
        {"k_prior": KPrior.FIXED}, {"phylo": PhyloMode.LONGITUDINAL}, {"phylo": PhyloMode.JOINT_MCMC, "inference": InferenceEngine.EM}, {"phi": 0.0}, {"tail_weight": 1.0},
        {"n_samples": 0}, {"depth_median": 0}, {"tail_threshold": 0.0}, {"artefact_absence_threshold": 1.5}, {"purity": 0.0},
    ):
        with pytest.raises(ValueError):
            CloneConfig(**broken)
    with pytest.raises(ValueError):
        set_backend("abacus")
    with pytest.raises(ValueError):
        SubChallenge.parse("sc9")
