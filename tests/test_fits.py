"""Engines, selection, noise and whole fits on seeded mixtures."""

import numpy as np
import pytest

from clonal_spark.config import CONFIGS, CloneConfig, EmissionModel, InferenceEngine, KPrior, NoiseModel, PhyloMode
from clonal_spark.functions import mathx as mx
from clonal_spark.functions.emission import Binomial
from clonal_spark.operators import mixture as mo
from clonal_spark.operators import noise as no
from clonal_spark.plans import engines as en
from clonal_spark.plans.model import GenerativeModel, distributed_fit
from clonal_spark.sources.observations import from_arrays

EM = CloneConfig(emission=EmissionModel.BINOMIAL, inference=InferenceEngine.EM, k_prior=KPrior.BIC, phylo=PhyloMode.NONE, noise=NoiseModel.NONE)


def mixture(sizes, centers, depth=100, seed=42):
    rng = np.random.default_rng(seed)
    p = np.repeat(np.atleast_2d(np.array(centers, float).reshape(len(sizes), -1)), sizes, 0)
    return rng.binomial(depth, p).astype(float), np.full(p.shape, float(depth))


TWO = mixture((200, 200), (0.2, 0.5))


def test_em_recovers_two_clones():
    alt, depth = TWO
    fit = en.em(EM, alt, depth, np.ones_like(alt), en.initial_centers(alt, depth, 2))
    assert np.sort(fit.centers[:, 0]) == pytest.approx([0.2, 0.5], abs=0.05) and fit.converged
    assert fit.resp.sum(1) == pytest.approx(np.ones(len(alt)), abs=1e-10)
    assert all(b >= a - 1e-6 for a, b in zip(fit.trace, fit.trace[1:]))  # EM never lowers the likelihood


def test_bic_selects_two():
    alt, depth = TWO
    assert en.fit_arrays(EM, alt, depth).k == 2


def test_variational_matches_em_under_a_strong_prior():
    alt, depth = TWO
    one = np.ones_like(alt)
    start = en.initial_centers(alt, depth, 2)
    a, b = en.em(EM, alt, depth, one, start), en.mfvi(EM, alt, depth, one, start, alpha0=1e6)
    assert np.sort(a.centers, 0) == pytest.approx(np.sort(b.centers, 0), abs=0.02)


def test_elbo_rises():
    alt, depth = TWO
    trace = en.mfvi(EM, alt, depth, np.ones_like(alt), en.initial_centers(alt, depth, 5)).trace
    assert all(b >= a - 1e-4 for a, b in zip(trace[1:], trace[2:]))


def test_hybrid_counts_its_em_steps_and_prunes():
    alt, depth = TWO
    fit = en.fit_arrays(CONFIGS["pyclone_vi"], alt, depth)
    assert fit.k <= 4 and fit.resp.sum(1) == pytest.approx(np.ones(len(alt)), abs=1e-9)
    assert en.hybrid(EM, alt, depth, np.ones_like(alt), en.initial_centers(alt, depth, 2)).n_iter > en.HYBRID_EM


def test_sampler_finds_the_mean():
    alt, depth = mixture((50,), (0.5,))
    fit = en.mcmc(EM, alt, depth, np.ones_like(alt), en.initial_centers(alt, depth, 1), draws=200, tune=200)
    assert fit.centers[0, 0] == pytest.approx(0.5, abs=0.1) and fit.converged


def test_merge_compares_with_representatives_only():
    c = np.array([[0.30], [0.305], [0.313], [0.6]])
    assert en.merge_map(c).tolist() == [0, 0, 2, 3]


def test_prune_keeps_only_weighty_clones():
    resp = np.full((400, 10), 1e-5)
    resp[:200, 2] = resp[200:, 7] = 1
    resp /= resp.sum(1, keepdims=True)
    fit = en._fit(np.linspace(0.05, 0.95, 10)[:, None], resp, -1.0, 400, 1, True)
    assert en.merge_and_prune(fit, 400, 0.01).k == 2


def test_tail_filter_cases():
    clonal = mixture((50,), (0.5,))
    keep = lambda data, **more: en.tail_mask(CloneConfig(noise=NoiseModel.TAIL_FILTER, **more), *data).sum()
    assert keep(clonal, phi=50.0, tail_weight=0.1) >= 40
    assert keep(mixture((80, 20), (0.4, 0.01)), phi=50.0, tail_weight=0.5, tail_threshold=0.3) < 100
    assert keep((np.array([[1.0], [2.0], [1.0]]), np.full((3, 1), 100.0)), phi=50.0, tail_weight=0.99, tail_threshold=0.001) >= 2


def test_multiplicity_cases(spark):
    for alt, cn, want in ((30.0, 2.0, 0.5), (50.0, 4.0, 0.5)):
        a, d = np.array([[alt]]), np.array([[100.0]])
        assert en.multiplicity_adj(a, d, np.ones((1, 1)), np.array([cn]), 1.0)[0, 0] == pytest.approx(want)
        assert no.multiplicity_adj(from_arrays(spark, a, d, None, np.array([[cn]]))).first().adj == pytest.approx(want)


def test_artefact_cases():
    def run(centers, resp):
        resp = np.array(resp, float)
        return en.drop_artefacts(CloneConfig(), en._fit(np.array(centers, float), resp, 0.0, len(resp), 1, True))

    resp = [[0.5, 0.3, 0.2], [0.3, 0.5, 0.2], [0.1, 0.3, 0.6]]
    assert (run([(0.6, 0.5), (0.3, 0.01), (0.01, 0.3)], resp).centers > 0).all()
    out = run([(0.3, 0.3, 0.01), (0.2, 0.01, 0.01), (0.01, 0.2, 0.2)], resp)
    assert (out.centers[2] == 0).all() and out.assignments.tolist() == [0, 1, 1]
    assert (run([(0.3, 0.01), (0.01, 0.3)], [[1, 0], [0, 1]]).centers > 0).all()


def test_plan_step_equals_numpy_step(spark):
    alt, depth = mixture((60, 60), ((0.3, 0.1), (0.6, 0.4)))
    adj = np.linspace(0.8, 1.2, alt.size).reshape(alt.shape)
    obs = from_arrays(spark, alt, depth, adj)
    params = mo.quantile_init(obs, 3)
    start = en.initial_centers(alt, depth, 3)
    assert {(r.k, r.sample_id): r.center for r in params.collect()} == pytest.approx({(k, f"{s:03d}"): start[k, s] for k in range(3) for s in range(2)}, rel=1e-9)
    resp = mo.e_step(mo.log_likelihoods(obs, params, Binomial()), mo.uniform_weights(params))
    log_r = en.log_resp(np.full(3, -np.log(3)), alt, depth, adj, start, Binomial(), Binomial().np_fixed(alt, depth))
    want = en.softmax(log_r)
    assert {(r.mut_id, r.k): r.r for r in resp.collect()} == pytest.approx({(i, k): want[i, k] for i in range(120) for k in range(3)}, rel=1e-7, abs=1e-12)
    centers = en.m_step(want, alt, depth)
    assert {(r.k, r.sample_id): r.center for r in mo.m_step(obs, resp).collect()} == pytest.approx({(k, f"{s:03d}"): centers[k, s] for k in range(3) for s in range(2)}, rel=1e-7)
    total = mo.marginal_fit(resp, mo.F.lit(2)).first()
    assert total.log_lik == pytest.approx(mx.np_logsumexp(log_r, 1).sum(), rel=1e-9)


@pytest.mark.parametrize("name", [n for n in CONFIGS if n != "phyloclone_style"])
def test_presets_fit_a_cohort(spark, name):
    alt, depth = mixture((40, 40, 40), ((0.7, 0.6, 0.5), (0.4, 0.3, 0.2), (0.2, 0.1, 0.05)))
    obs = from_arrays(spark, alt, depth, None, np.full(alt.shape, 2.0), 1).unionByName(from_arrays(spark, alt[:, :1], depth[:, :1], None, None, 2))
    out = GenerativeModel(name).fit(obs)
    fits = {r.tumour_id: r for r in out.fits.collect()}
    assert set(fits) == {1, 2}
    for r in fits.values():
        assert len(r.centers) == r.K and len(r.assignments) == 120 and np.isfinite(r.ll) and np.isfinite(r.bic)
        assert set(r.assignments) <= {-1, *range(r.K)}
    assert out.assignments.count() == 240 and out.centers.where("tumour_id = 1").count() == 3 * fits[1].K
    if CONFIGS[name].phylo is not PhyloMode.NONE:
        assert all(list(r.parents).count(-1) == 1 for r in fits.values())


def test_distributed_fit_equals_grouped(spark):
    alt, depth = TWO
    a = distributed_fit(from_arrays(spark, alt, depth), EM, max_iter=30)
    fits = [en.em(EM, alt, depth, np.ones_like(alt), en.initial_centers(alt, depth, k), 30) for k in range(1, 11)]
    b = min(fits, key=lambda f: f.bic)
    assert (a["K"], a["n_iter"]) == (b.k, b.n_iter) and a["ll"] == pytest.approx(b.ll, rel=1e-9)
    assert a["centers"] == pytest.approx(b.centers, rel=1e-7)


def test_large_tumours_go_the_distributed_way(spark):
    alt, depth = TWO
    obs = from_arrays(spark, alt, depth, tumour_id=1).unionByName(from_arrays(spark, alt[:50], depth[:50], tumour_id=2))
    small, large = GenerativeModel(EM).fit_auto(obs, 100)
    assert [r.tumour_id for r in small.fits.collect()] == [2] and list(large) == [1] and large[1]["K"] == 2
