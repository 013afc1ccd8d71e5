"""The sampler over blocks: draws that do not depend on the blocks, means as the group form has them, diagnostics."""

import numpy as np
import pytest

from clonal_spark.config import CloneConfig, EmissionModel, InferenceEngine, KPrior, NoiseModel, PhyloMode
from clonal_spark.plans import engines as en
from clonal_spark.plans import sampler
from clonal_spark.plans.cohort import fit_large
from clonal_spark.sources.observations import from_arrays

CONFIG = CloneConfig(EmissionModel.BINOMIAL, InferenceEngine.MCMC, KPrior.FIXED, PhyloMode.NONE, NoiseModel.NONE, n_clones=2)


def cells(seed=5, n=60):
    rng = np.random.default_rng(seed)
    p = np.repeat([[0.45, 0.3], [0.15, 0.6]], n, 0)
    return rng.binomial(200, p).astype(float), np.full(p.shape, 200.0)


def test_uniforms():
    muts = np.arange(-50_000, 50_000)
    u = sampler.uniforms(muts, 1, 2, 3, 4)
    assert u.min() >= 0 and u.max() < 1 and abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002
    assert len(np.unique(u)) == len(u) and np.array_equal(u[100:200], sampler.uniforms(muts[100:200], 1, 2, 3, 4))
    for other in ((1, 2, 3, 5), (1, 2, 4, 4), (1, 3, 3, 4), (0, 2, 3, 4)):
        assert abs(np.corrcoef(u, sampler.uniforms(muts, *other))[0, 1]) < 0.02


def run_local(alt, depth, tune, draws, chains, seed=0):
    """The same rows and steps without Spark."""
    start = en.initial_centers(alt, depth, 2)
    rows = []
    for chain in range(chains):
        n = start.size
        r = {"tumour_id": 3, "chain": chain, "K": 2, "s": alt.shape[1], "t": 0, "x": np.log(start / (1 - start)).ravel().tolist(), "scale": [0.1] * n, "pi": [0.5, 0.5], "sum_pi": [0.0] * 2, "sum_c": [0.0] * n, "sum_cc": [0.0] * n, "splits": [0.0] * n * sampler.SPLITS, "accepted": 0.0}
        emission = en.Binomial()
        fixed = emission.np_fixed(alt, depth)
        for _ in range(tune + draws):
            c, d = (sampler._centers(x).reshape(2, -1) for x in (r["x"], sampler.proposed(r, seed)))
            log_r = en.log_resp(np.log(np.maximum(r["pi"], en.EPS)), alt, depth, 1.0, c, emission, fixed)
            z = np.minimum((en.softmax(log_r).cumsum(1) < sampler.uniforms(np.arange(len(alt)), seed, 3, chain, r["t"])[:, None]).sum(1), 1)
            lls = [np.stack([emission.np_log_prob(alt[z == k], depth[z == k], np.broadcast_to(x[k], alt[z == k].shape), fixed[z == k]).sum(0) for k in range(2)]).ravel() for x in (c, d)]
            r = sampler.moved(r | {"total": np.concatenate([np.bincount(z, minlength=2), *lls]).tolist()}, seed, tune, draws)
        rows.append(r)
    return sampler.diagnosis(rows, draws)


def test_means_and_diagnostics_of_long_chains():
    """The sampler's steps alone: posterior means as engines.mcmc has them, within Monte Carlo error, and chains that agree."""
    alt, depth = cells()
    got = run_local(alt, depth, 300, 1000, 3)
    want = en.mcmc(CONFIG, alt, depth, np.ones_like(alt), en.initial_centers(alt, depth, 2), 1500, 500)
    order = np.argsort(-want.centers.mean(1), kind="stable")
    assert np.array(got["centers"]).reshape(2, 2) == pytest.approx(want.centers[order], abs=0.002)
    assert max(got["r_hat"]) < 1.05 and min(got["ess"]) > 100 and 0.2 < got["accepted"] < 0.7


def test_stuck_chains_show():
    rows = [{"tumour_id": 1, "K": 1, "s": 1, "sum_pi": [100.0], "sum_c": [100 * m], "sum_cc": [100 * (m * m + 1e-4)], "splits": [10 * m + (0.05 if i % 2 else -0.05) for i in range(sampler.SPLITS)], "accepted": 40.0} for m in (0.2, 0.6)]
    assert sampler.diagnosis(rows, 100)["r_hat"][0] > 5


def test_blocks_give_the_draws_of_one_group(spark):
    """Short chains in several blocks against the same steps without Spark: equal draws, whatever the blocks."""
    alt, depth = cells(n=30)
    want = run_local(alt, depth, 4, 8, 2, seed=9)
    obs = from_arrays(spark, alt, depth, tumour_id=3)
    for block in (25, 10**6):
        got = fit_large(obs, CONFIG, block=block, tune=4, draws=8, chains=2, seed=9)
        rows = {(r.k, r.sample_id): r for r in got.diagnostics.collect()}
        flat = [rows[k, s] for k in range(2) for s in ("000", "001")]
        assert [r["mean"] for r in flat] == pytest.approx(want["centers"], rel=1e-9) and [r.r_hat for r in flat] == pytest.approx(want["r_hat"], rel=1e-6)
        assert got.assignments.count() == len(alt) and got.fit_summary.first().K == 2
        assert [r.center for r in got.centers.orderBy("k", "sample_id").collect()] == pytest.approx(want["centers"], rel=1e-9)
