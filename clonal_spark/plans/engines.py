"""Inference on one tumour's dense arrays, as group functions run it: EM, variational, hybrid and sampling.

alt, depth, adj are (mutations, samples). Expectations use adj * center; centers are re-estimated from counts
alone. Log-likelihood and responsibilities belong to the parameters before the last update."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np

from clonal_spark.config import CloneConfig, InferenceEngine, KPrior, NoiseModel, PhyloMode
from clonal_spark.functions import mathx as mx
from clonal_spark.functions.emission import EMISSIONS, EPS, Binomial, emission_of
from clonal_spark.operators import phylo_np as ph

MAX_ITER, TOL, ALPHA0, HYBRID_EM = 200, 1e-6, 1.0, 20
LOW, HIGH = 1e-6, 1 - 1e-6
MERGE, PRUNE, TSSB_PRUNE, K_MAX, TSSB_MAX = 0.01, 0.01, 0.005, 10, 15
VAF_FLOOR = 1e-8


@dataclass
class Fit:
    centers: np.ndarray
    resp: np.ndarray
    assignments: np.ndarray
    ll: float
    bic: float
    k: int
    n_iter: int
    converged: bool
    parents: np.ndarray | None = None
    mask: np.ndarray | None = None
    pairs: np.ndarray | None = None
    trace: list[float] = field(default_factory=list)
    #: Centers and log weights that the responsibilities belong to.
    e_step: tuple[np.ndarray, np.ndarray] | None = None


def vaf(alt: np.ndarray, depth: np.ndarray) -> np.ndarray:
    return alt / np.maximum(depth, 1.0)


def initial_centers(alt: np.ndarray, depth: np.ndarray, k: int) -> np.ndarray:
    """K interior quantiles of the observed frequency, per sample."""
    return np.clip(np.quantile(vaf(alt, depth), np.arange(1, k + 1) / (k + 1), axis=0), LOW, HIGH)


@dataclass
class Distinct:
    """Distinct (sample, value, adj), and which one each mutation has in each sample (samples, mutations)."""

    sample: np.ndarray
    value: np.ndarray
    adj: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, value: np.ndarray, adj: np.ndarray) -> Distinct:
        n, s = value.shape
        key = np.tile(np.arange(s), n)
        for a in (value, adj):
            values, code = np.unique(a.ravel(), return_inverse=True)
            _, key = np.unique(key * len(values) + code, return_inverse=True)
        first = np.empty(key.max() + 1, np.int64)
        first[key] = np.arange(len(key))
        return cls(first % s, value.ravel()[first], adj.ravel()[first], np.ascontiguousarray(key.reshape(n, s).T))


@dataclass
class Tables:
    """A tumour's (or block's) fixed terms, and its distinct counts with their adjustment factors. Counts are small whole numbers
    and factors few, so terms of a clone are made once for each distinct count, however many mutations have it."""

    fixed: np.ndarray
    alt: Distinct
    rest: Distinct
    factor: Distinct

    def log_prob(self, emission, alt, depth, c: np.ndarray) -> np.ndarray:
        """emission.np_log_prob at adj * c, summed over samples: the same terms in the same order."""
        one, two = (emission.np_table(d.value, d.adj * c[d.sample], rest) for d, rest in ((self.alt, False), (self.rest, True)))
        less = emission.np_less(self.factor.adj * c[self.factor.sample])
        out = None
        for s in range(len(c)):
            body = self.fixed[s] + one[self.alt.at[s]]
            body += two[self.rest.at[s]]
            for term in less:
                body -= term[self.factor.at[s]]
            body = emission.np_mixed(body, alt[:, s], depth[:, s])
            out = body if out is None else out + body
        return out


def tables(emission, alt, depth, adj) -> Tables | np.ndarray:
    """What log_resp takes as `fixed`: tables, or the fixed terms alone for emissions of one's own and where most counts are
    distinct. Samples from 8 on are summed in another order by NumPy, so these have no tables either."""
    fixed = emission.np_fixed(alt, depth)
    if type(emission) not in EMISSIONS.values() or not alt.size or alt.shape[1] > 7:
        return fixed
    one, two = Distinct.of(alt, adj), Distinct.of(depth - alt, adj)
    if len(one.value) + len(two.value) > alt.size:
        return fixed
    return Tables(np.ascontiguousarray(fixed.T), one, two, Distinct.of(np.zeros_like(adj), adj))


def log_resp(log_pi: np.ndarray, alt, depth, adj, centers, emission, fixed, order: str = "C") -> np.ndarray:
    out = np.empty((len(alt), len(centers)), order=order)
    for j, c in enumerate(centers):
        out[:, j] = log_pi[j] + (fixed.log_prob(emission, alt, depth, c) if isinstance(fixed, Tables) else emission.np_log_prob(alt, depth, adj * c, fixed).sum(1))
    return out


def softmax(log_r: np.ndarray) -> np.ndarray:
    return softmax_ll(log_r)[0]


def softmax_ll(log_r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities, and the log-likelihood of each mutation."""
    top = log_r.max(1, keepdims=True)
    r = np.exp(log_r - top)
    total = r.sum(1, keepdims=True)
    return r / total, (top + np.log(total))[:, 0]


def m_step(resp: np.ndarray, alt: np.ndarray, depth: np.ndarray) -> np.ndarray:
    return np.clip(resp.T @ alt / np.maximum(resp.T @ depth, 1e-10), LOW, HIGH)


def bic(ll: float, k: int, n_samples: int, n_mut: int) -> float:
    return -2 * ll + k * n_samples * np.log(max(n_mut, 1))


def constrain(config: CloneConfig, centers: np.ndarray) -> np.ndarray:
    if config.phylo not in (PhyloMode.CONSTRAINED, PhyloMode.JOINT_MCMC):
        return centers
    return np.clip(centers, LOW, HIGH) if len(centers) <= 1 else ph.clamp_chain(centers)


def _fit(centers, resp, ll, n_mut, n_iter, converged, trace=(), e_step=None) -> Fit:
    k, s = centers.shape
    return Fit(centers, resp, resp.argmax(1), float(ll), float(bic(ll, k, s, n_mut)), k, n_iter, converged, trace=list(trace), e_step=e_step)


def em(config: CloneConfig, alt, depth, adj, centers, max_iter: int = MAX_ITER, tol: float = TOL) -> Fit:
    emission = emission_of(config)
    fixed, k = tables(emission, alt, depth, adj), len(centers)
    log_pi, before, trace, converged, n = np.full(k, -np.log(k)), -np.inf, [], False, 0
    for n in range(1, max_iter + 1):
        used = centers, log_pi
        log_r = log_resp(log_pi, alt, depth, adj, centers, emission, fixed)
        resp, lls = softmax_ll(log_r)
        centers = constrain(config, m_step(resp, alt, depth))
        log_pi = np.log(np.maximum(resp.mean(0), 1e-10))
        ll = lls.sum()
        trace.append(float(ll))
        if abs(ll - before) < tol:
            converged = True
            break
        before = ll
    return _fit(centers, resp, ll, len(alt), n, converged, trace, used)


def _kl_dirichlet(alpha: np.ndarray, alpha0: float) -> float:
    k, total = len(alpha), alpha.sum()
    return float(mx.np_lgamma(total) - mx.np_lgamma(k * alpha0) - mx.np_lgamma(alpha).sum() + k * mx.np_lgamma(alpha0) + ((alpha - alpha0) * (mx.np_digamma(alpha) - mx.np_digamma(total))).sum())


def mfvi(config: CloneConfig, alt, depth, adj, centers, max_iter: int = MAX_ITER, tol: float = TOL, alpha0: float = ALPHA0) -> Fit:
    emission = emission_of(config)
    fixed, k = tables(emission, alt, depth, adj), len(centers)
    alpha, before, trace, converged, n = np.full(k, float(alpha0)), -np.inf, [], False, 0
    for n in range(1, max_iter + 1):
        used = centers, mx.np_digamma(alpha) - mx.np_digamma(alpha.sum())
        log_r = log_resp(used[1], alt, depth, adj, centers, emission, fixed)
        resp = softmax(log_r)
        alpha = alpha0 + resp.sum(0)
        centers = constrain(config, m_step(resp, alt, depth))
        elbo = float((resp * log_r).sum() - (resp * np.log(np.maximum(resp, 1e-300))).sum()) - _kl_dirichlet(alpha, alpha0)
        trace.append(elbo)
        if abs(elbo - before) < tol:
            converged = True
            break
        before = elbo
    ll = mx.np_logsumexp(log_resp(np.log(np.maximum(alpha / alpha.sum(), 1e-10)), alt, depth, adj, centers, emission, fixed), 1).sum()
    return _fit(centers, resp, ll, len(alt), n, converged, trace, used)


def hybrid(config: CloneConfig, alt, depth, adj, centers) -> Fit:
    first = em(config, alt, depth, adj, centers, HYBRID_EM)
    out = mfvi(config, alt, depth, adj, first.centers)
    out.n_iter += HYBRID_EM
    out.trace = first.trace + out.trace
    return out


def mcmc(config: CloneConfig, alt, depth, adj, centers, draws: int = 2000, tune: int = 1000, seed: int = 0) -> Fit:
    """Gibbs with Metropolis steps in place of a gradient sampler: labels given weights and centers, weights from
    their Dirichlet, centers by random walks on the logit scale with step sizes adapted while tuning. The
    likelihood is binomial whatever the emission; posterior means go through one expectation step of the
    configured emission. Equal to the named sampler in distribution only."""
    rng = np.random.default_rng(seed)
    emission, sampler = emission_of(config), Binomial()
    k, n = len(centers), len(alt)
    fixed, counts = sampler.np_fixed(alt, depth), tables(sampler, alt, depth, adj)
    x, scale = np.log(centers / (1 - centers)), np.full(centers.shape, 0.1)
    pi, sum_pi, sum_c = np.full(k, 1 / k), np.zeros(k), np.zeros_like(centers)

    def center_ll(c, z):
        terms = sampler.np_log_prob(alt, depth, adj * c[z], fixed)
        out = np.zeros_like(c)
        np.add.at(out, z, terms)
        return out

    def summed_ll(c, a, d):
        """center_ll but for the fixed terms, which a ratio does without, from the sums of each clone's counts by factor."""
        mu = np.clip(counts.factor.adj * c[:, counts.factor.sample], EPS, 1 - EPS)
        terms = a * np.log(mu) + d * np.log(1 - mu)
        return np.stack([terms[:, counts.factor.sample == s].sum(1) for s in range(c.shape[1])], 1)

    def by_factor(z):
        size, out = len(counts.factor.adj), []
        keys = [z * size + at for at in counts.factor.at]
        for values in (alt, depth - alt):
            out.append(sum(np.bincount(key, values[:, s], k * size) for s, key in enumerate(keys)).reshape(k, size))
        return out

    for t in range(tune + draws):
        c = np.clip(1 / (1 + np.exp(-x)), LOW, HIGH)
        log_r = log_resp(np.log(np.maximum(pi, EPS)), alt, depth, adj, c, sampler, counts, "F").T
        log_r -= log_r.max(0)
        upto = np.exp(log_r, out=log_r).cumsum(0)
        z = np.minimum((upto < rng.random(n) * upto[-1]).sum(0, dtype=np.uint8).astype(np.int64), k - 1)
        pi = rng.dirichlet(1 + np.bincount(z, minlength=k))
        y = x + scale * rng.standard_normal(x.shape)
        d = np.clip(1 / (1 + np.exp(-y)), LOW, HIGH)
        if isinstance(counts, Tables):
            sums = by_factor(z)
            gain = summed_ll(d, *sums) - summed_ll(c, *sums)
        else:
            gain = center_ll(d, z) - center_ll(c, z)
        ratio = gain + np.log(d * (1 - d)) - np.log(c * (1 - c))
        take = np.log(rng.random(x.shape)) < ratio
        x = np.where(take, y, x)
        if t < tune:
            scale *= np.exp((take - 0.44) / np.sqrt(t + 1.0))
        else:
            sum_pi += pi
            sum_c += np.clip(1 / (1 + np.exp(-x)), LOW, HIGH)
    c, pi = sum_c / draws, sum_pi / draws
    used = c, np.log(np.maximum(pi, EPS))
    log_r = log_resp(used[1], alt, depth, adj, c, emission, emission.np_fixed(alt, depth))
    return _fit(c, softmax(log_r), mx.np_logsumexp(log_r, 1).sum(), n, draws, True, e_step=used)


ENGINES = {InferenceEngine.EM: em, InferenceEngine.MFVI: mfvi, InferenceEngine.HYBRID: hybrid, InferenceEngine.MCMC: mcmc}


def k_schedule(config: CloneConfig) -> list[int]:
    if not isinstance(config.k_prior, KPrior):
        return config.k_prior.schedule(config)
    if config.k_prior is KPrior.BIC:
        return list(range(1, 11))
    if config.k_prior is KPrior.FIXED:
        return [config.n_clones]
    return [config.n_clones or (TSSB_MAX if config.k_prior is KPrior.TSSB else K_MAX)]


def merge_map(centers: np.ndarray, tol: float = MERGE) -> np.ndarray:
    """Each clone's representative: the first clone, itself a representative, that is within tol in every sample."""
    out = np.arange(len(centers))
    for j in range(len(centers)):
        for i in range(j):
            if out[i] == i and np.abs(centers[i] - centers[j]).max() < tol:
                out[j] = i
                break
    return out


def merged(centers: np.ndarray, mass: np.ndarray, n_mut: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each clone's place after merging, the places that stay after pruning, and their centers."""
    names, place = np.unique(merge_map(centers), return_inverse=True)
    out = np.stack([np.average(centers[place == i], axis=0, weights=np.maximum(mass[place == i], 1e-300)) for i in range(len(names))])
    total = np.bincount(place, mass, len(names))
    keep = np.flatnonzero(total / n_mut >= least)
    if not len(keep):
        keep = np.array([int(total.argmax())])
    return place, keep, np.clip(out[keep], LOW, HIGH)


def merged_resp(resp: np.ndarray, place: np.ndarray, keep: np.ndarray) -> np.ndarray:
    resp = np.stack([resp[:, place == i].sum(1) for i in keep], 1)
    return resp / np.maximum(resp.sum(1, keepdims=True), 1e-300)


def merge_and_prune(fit: Fit, n_mut: int, least: float) -> Fit:
    place, keep, centers = merged(fit.centers, fit.resp.sum(0), n_mut, least)
    return _fit(centers, merged_resp(fit.resp, place, keep), fit.ll, n_mut, fit.n_iter, fit.converged, fit.trace)


def select(config: CloneConfig, fits: list[Fit], n_mut: int) -> Fit:
    if not isinstance(config.k_prior, KPrior):
        return config.k_prior.select(config, fits, n_mut)
    if config.k_prior is KPrior.BIC:
        return min(fits, key=lambda f: f.bic)
    if config.k_prior is KPrior.FIXED:
        return fits[0]
    return merge_and_prune(fits[0], n_mut, TSSB_PRUNE if config.k_prior is KPrior.TSSB else PRUNE)


def tail_probability(v: np.ndarray, phi: float | None, tau: float | None) -> np.ndarray:
    """Posterior of the 1/f tail against a Beta around the median, for one sample's frequencies."""
    v = np.clip(v, VAF_FLOOR, 1 - VAF_FLOOR)
    tail = -np.log(v) - np.log(-np.log(VAF_FLOOR))
    if phi is None:
        mu, var = np.clip(v.mean(), 0.01, 0.99), v.var()
        phi = 50.0 if var <= 0 or var >= mu * (1 - mu) else float(np.clip(mu * (1 - mu) / var - 1, 1, 1000))
    mu = np.clip(np.median(v), 0.05, 0.95)
    a, b = mu * phi, (1 - mu) * phi
    body = (a - 1) * np.log(v) + (b - 1) * np.log(1 - v) - (mx.np_lgamma(a) + mx.np_lgamma(b) - mx.np_lgamma(phi))

    def posterior(t: float) -> np.ndarray:
        one = np.log(t) + tail
        return np.exp(one - np.logaddexp(one, np.log(1 - t) + body))

    if tau is None:
        tau = 0.1
        for _ in range(50):
            new = float(np.clip(posterior(tau).mean(), 1e-6, 1 - 1e-6))
            if abs(new - tau) < 1e-4:
                break  # the value before this one is kept
            tau = new
    return posterior(float(np.clip(tau, 1e-6, 1 - 1e-6)))


def tail_mask(config: CloneConfig, alt: np.ndarray, depth: np.ndarray) -> np.ndarray:
    v = vaf(alt, depth)
    p = np.stack([tail_probability(v[:, s], config.phi, config.tail_weight) for s in range(v.shape[1])], 1)
    mask = ~(p > config.tail_threshold).any(1)
    return mask if mask.sum() >= 2 else np.ones(len(mask), bool)


def multiplicity_adj(alt, depth, adj, total_cn, purity: float) -> np.ndarray:
    """For each cell the factor m / (cn * purity + 2 (1 - purity)), m in 1..cn, whose implied fraction is nearest to 1."""
    cn = np.broadcast_to(np.asarray(total_cn, float).reshape(len(alt), -1), alt.shape)
    v, out, best = vaf(alt, depth), np.array(adj, float), np.full(alt.shape, np.inf)
    for m in range(1, int(np.nanmax(cn, initial=0)) + 1):
        factor = m / (cn * purity + 2 * (1 - purity))
        off = np.where(m <= np.floor(cn), np.abs(v / np.maximum(factor, 1e-300) - 1), np.inf)
        out = np.where(off < best, factor, out)
        best = np.minimum(best, off)
    return out


def expand(fit: Fit, mask: np.ndarray) -> Fit:
    resp, assigned = np.zeros((len(mask), fit.k)), np.full(len(mask), -1)
    resp[mask], assigned[mask] = fit.resp, fit.assignments
    fit.resp, fit.assignments, fit.mask = resp, assigned, mask
    return fit


def artefacts(config: CloneConfig, centers: np.ndarray) -> np.ndarray:
    """Clusters whose presence pattern is no subset or superset of another's; none where that holds for all."""
    there = centers > config.artefact_absence_threshold
    below = (~there[:, None, :] | there[None, :, :]).all(2)
    partner = below | below.T
    np.fill_diagonal(partner, False)
    bad = ~partner.any(1)
    return bad & (centers.shape[1] > 1) & ~bad.all()


def drop_artefacts(config: CloneConfig, fit: Fit) -> Fit:
    """Artefacts lose their mutations and centers; the tree, K and responsibilities stay as they were."""
    bad = artefacts(config, fit.centers)
    if not bad.any():
        return fit
    valid = np.flatnonzero(~bad)
    centers, assigned = fit.centers.copy(), fit.assignments.copy()
    for k in np.flatnonzero(bad):
        rows = assigned == k
        if rows.any():
            assigned[rows] = valid[fit.resp[np.ix_(rows, valid)].argmax(1)]
            centers[k] = 0.0
    fit.centers, fit.assignments = centers, assigned
    return fit


def grow_tree(config: CloneConfig, fit: Fit) -> Fit:
    mode = config.phylo
    if not isinstance(mode, PhyloMode):
        fit.parents = np.asarray(mode.parents(fit.centers))
    elif mode is PhyloMode.PAIRWISE:
        fit.parents, fit.pairs = ph.pairwise_parents(fit.centers), ph.pairs_tensor(fit.centers)
    elif mode is PhyloMode.LONGITUDINAL:
        fit.parents = ph.longitudinal_parents(fit.centers)
    elif mode is not PhyloMode.NONE:
        fit.parents = ph.greedy_parents(fit.centers)
    return fit


def warn_of(config: CloneConfig) -> None:
    if config.k_prior is KPrior.TSSB:
        warnings.warn("the stick-breaking prior is a flat approximation", UserWarning, stacklevel=3)
    if config.phylo is PhyloMode.JOINT_MCMC:
        warnings.warn("joint tree sampling is experimental: it projects and builds the tree afterwards", UserWarning, stacklevel=3)


@dataclass
class Prepared:
    """One tumour's arrays after the noise steps that come first. mask: mutations that take part."""

    alt: np.ndarray
    depth: np.ndarray
    adj: np.ndarray
    mask: np.ndarray


def prepare(config: CloneConfig, alt, depth, adj=None, total_cn=None) -> Prepared:
    alt, depth = (np.asarray(x, float).reshape(len(x), -1) for x in (alt, depth))
    adj = np.ones_like(alt) if adj is None else np.asarray(adj, float).reshape(alt.shape)
    mask = np.ones(len(alt), bool)
    if not isinstance(config.noise, NoiseModel):
        mask = np.asarray(config.noise.mask(config, alt, depth), bool)
    elif config.noise is NoiseModel.TAIL_FILTER:
        mask = tail_mask(config, alt, depth)
    elif config.noise is NoiseModel.MULTIPLICITY and total_cn is not None:
        adj = multiplicity_adj(alt, depth, adj, total_cn, config.purity)
    return Prepared(alt[mask], depth[mask], adj[mask], mask)


def fit_k(config: CloneConfig, data: Prepared, k: int, seed: int = 0) -> Fit:
    run = ENGINES.get(config.inference, config.inference)
    more = {"seed": seed} if run is mcmc else {}
    return run(config, data.alt, data.depth, data.adj, initial_centers(data.alt, data.depth, k), **more)


def responsibilities(config: CloneConfig, data: Prepared, e_step: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    emission = emission_of(config)
    return softmax(log_resp(e_step[1], data.alt, data.depth, data.adj, e_step[0], emission, emission.np_fixed(data.alt, data.depth)))


def finish(config: CloneConfig, fit: Fit, mask: np.ndarray) -> Fit:
    """Tree and the noise steps that come last."""
    fit = grow_tree(config, fit)
    if config.noise is NoiseModel.TAIL_FILTER or not isinstance(config.noise, NoiseModel):
        return expand(fit, mask)
    return drop_artefacts(config, fit) if config.noise is NoiseModel.ARTEFACT else fit


def fit_arrays(config: CloneConfig, alt, depth, adj=None, total_cn=None, seed: int = 0) -> Fit:
    """Noise, all K of the schedule, selection, tree, noise again."""
    data = prepare(config, alt, depth, adj, total_cn)
    fits = [fit_k(config, data, k, seed) for k in k_schedule(config)]
    return finish(config, select(config, fits, len(data.alt)), data.mask)
