"""Fits over observation tables. Small tumours run whole inside one group each; a tumour of many cells runs as one
job per iteration, with K-sized parameters on the driver and sufficient statistics summed by Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonal_spark.config import CONFIGS, CloneConfig, InferenceEngine, KPrior, NoiseModel
from clonal_spark.functions import mathx as mx
from clonal_spark.functions.emission import emission_of
from clonal_spark.operators import mixture as mo
from clonal_spark.operators import noise as no
from clonal_spark.plans import engines as en
from clonal_spark.session import Scratch

#: Cells (mutations * samples) of a tumour up to which it is fitted in one group.
GROUPED_CELLS = 500_000

FIT = (
    "tumour_id long, config string, K int, ll double, bic double, n_iter int, converged boolean, sample_ids array<string>, centers array<array<double>>, "
    "parents array<int>, mut_ids array<long>, assignments array<int>, kept array<boolean>, resp array<array<double>>, trace array<double>"
)
#: One K of one tumour: what selection needs, and the parameters that its responsibilities belong to.
FIT_K = "tumour_id long, K int, ll double, bic double, n_iter int, converged boolean, centers array<array<double>>, e_centers array<array<double>>, e_log_pi array<double>, trace array<double>"


@dataclass
class CohortFit:
    """Results as tables. `fits` has one row per tumour; the others derive from it."""

    fits: DataFrame

    @property
    def fit_summary(self) -> DataFrame:
        return self.fits.select("tumour_id", "config", "K", "ll", "bic", "n_iter", "converged")

    @property
    def centers(self) -> DataFrame:
        rows = self.fits.select("tumour_id", "sample_ids", F.posexplode("centers").alias("k", "c"))
        return rows.select("tumour_id", "k", F.explode(F.arrays_zip("sample_ids", "c")).alias("z")).select("tumour_id", "k", F.col("z.sample_ids").alias("sample_id"), F.col("z.c").alias("center"))

    @property
    def assignments(self) -> DataFrame:
        zipped = F.explode(F.arrays_zip("mut_ids", "assignments", "kept")).alias("z")
        return self.fits.select("tumour_id", zipped).select("tumour_id", F.col("z.mut_ids").alias("mut_id"), F.col("z.assignments").alias("k"), F.col("z.kept").alias("kept"))

    @property
    def responsibilities(self) -> DataFrame:
        rows = self.fits.select("tumour_id", F.explode(F.arrays_zip("mut_ids", "resp")).alias("z"))
        return rows.select("tumour_id", F.col("z.mut_ids").alias("mut_id"), F.posexplode("z.resp").alias("k", "r"))

    @property
    def convergence(self) -> DataFrame:
        """The selected fit's objective after each iteration, from 1 on."""
        rows = self.fits.select("tumour_id", F.posexplode("trace").alias("i", "value"))
        return rows.select("tumour_id", (F.col("i") + 1).alias("iteration"), "value")

    @property
    def tree_edges(self) -> DataFrame:
        """One row per clone with its parent (-1: root); none without a tree."""
        return self.fits.where("parents IS NOT NULL").select("tumour_id", F.posexplode("parents").alias("k", "parent"))


def dense(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[str], dict[str, np.ndarray]]:
    """Sorted mutation and sample ids, and (mutations, samples) arrays; missing cells have depth 0."""
    muts, i = np.unique(rows["mut_id"].to_numpy(), return_inverse=True)
    names, j = np.unique(rows["sample_id"].to_numpy().astype(str), return_inverse=True)
    out = {}
    for c, empty in (("alt", 0.0), ("depth", 0.0), ("adj", 1.0), ("total_cn", np.nan)):
        a = np.full((len(muts), len(names)), empty)
        if c in rows:
            values = rows[c].to_numpy(dtype=float, na_value=np.nan)
            a[i, j] = np.where(np.isnan(values), empty, values)
        out[c] = a
    return muts, j, names.tolist(), out


def _prepared(rows: pd.DataFrame, config: CloneConfig) -> tuple[np.ndarray, list[str], en.Prepared]:
    muts, _, names, a = dense(rows)
    return muts, names, en.prepare(config, a["alt"], a["depth"], a["adj"], None if np.isnan(a["total_cn"]).all() else a["total_cn"])


def _row(tumour: int, name: str, muts: np.ndarray, names: list[str], fit: en.Fit) -> pd.DataFrame:
    kept = np.ones(len(muts), bool) if fit.mask is None else fit.mask
    return pd.DataFrame(
        {
            "tumour_id": [tumour], "config": [name], "K": [fit.k], "ll": [fit.ll], "bic": [fit.bic], "n_iter": [fit.n_iter], "converged": [bool(fit.converged)],
            "sample_ids": [names], "centers": [fit.centers.tolist()], "parents": [None if fit.parents is None else fit.parents.tolist()], "mut_ids": [muts.tolist()],
            "assignments": [fit.assignments.tolist()], "kept": [kept.tolist()], "resp": [fit.resp.tolist()], "trace": [list(map(float, fit.trace))],
        }
    )


def fit_group(rows: pd.DataFrame, config: CloneConfig, name: str, seed: int = 0) -> pd.DataFrame:
    """All K of one tumour in turn."""
    muts, names, data = _prepared(rows, config)
    fits = [en.fit_k(config, data, k, seed) for k in en.k_schedule(config)]
    return _row(rows["tumour_id"].iloc[0], name, muts, names, en.finish(config, en.select(config, fits, len(data.alt)), data.mask))


def fit_one_k(rows: pd.DataFrame, config: CloneConfig, k: int, seed: int = 0) -> pd.DataFrame:
    _, _, data = _prepared(rows, config)
    fit = en.fit_k(config, data, k, seed)
    values = (rows["tumour_id"].iloc[0], fit.k, fit.ll, fit.bic, fit.n_iter, bool(fit.converged), fit.centers.tolist(), fit.e_step[0].tolist(), fit.e_step[1].tolist(), list(map(float, fit.trace)))
    return pd.DataFrame([values], columns=["tumour_id", "K", "ll", "bic", "n_iter", "converged", "centers", "e_centers", "e_log_pi", "trace"])


def fit_selected(rows: pd.DataFrame, fits: pd.DataFrame, config: CloneConfig, name: str) -> pd.DataFrame:
    """The fit of the least BIC among one tumour's, with responsibilities, tree and noise."""
    muts, names, data = _prepared(rows, config)
    best = fits.sort_values(["bic", "K"]).iloc[0]
    array = lambda c: np.array([np.asarray(x, float) for x in best[c]])
    resp = en.responsibilities(config, data, (array("e_centers"), np.asarray(best["e_log_pi"], float)))
    fit = en.Fit(array("centers"), resp, resp.argmax(1), float(best["ll"]), float(best["bic"]), int(best["K"]), int(best["n_iter"]), bool(best["converged"]), trace=list(best["trace"]))
    return _row(rows["tumour_id"].iloc[0], name, muts, names, en.finish(config, fit, data.mask))


class GenerativeModel:
    """The fit of one configuration: a preset's name or a CloneConfig."""

    def __init__(self, config: CloneConfig | str = "wes_clinical", seed: int = 0):
        self.name = config if isinstance(config, str) else "custom"
        self.config = CONFIGS[config] if isinstance(config, str) else config
        self.seed = seed
        en.warn_of(self.config)

    def fit(self, obs: DataFrame) -> CohortFit:
        """Every tumour in its own group; a cohort's tumours run in parallel, and so do the K of a schedule. Partitions are
        asked for by number, as few bytes are much work here and must not be put together by their size."""
        config, name, seed = self.config, self.name, self.seed
        spark = obs.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        ks = en.k_schedule(config)
        if config.k_prior is not KPrior.BIC:
            return CohortFit(obs.repartition(parts, "tumour_id").groupBy("tumour_id").applyInPandas(lambda rows: fit_group(rows, config, name, seed), FIT))
        # large K take longest, so each K has its own group
        keyed = obs.withColumn("fit_k", F.explode(F.array(*map(F.lit, reversed(ks))))).repartition(4 * parts, "tumour_id", "fit_k")
        fits = keyed.groupBy("tumour_id", "fit_k").applyInPandas(lambda key, rows: fit_one_k(rows, config, int(key[1]), seed), FIT_K)
        both = obs.repartition(parts, "tumour_id").groupBy("tumour_id").cogroup(fits.groupBy("tumour_id"))
        return CohortFit(both.applyInPandas(lambda rows, found: fit_selected(rows, found, config, name), FIT))

    def fit_auto(self, obs: DataFrame, most: int = GROUPED_CELLS) -> tuple[CohortFit, dict[int, dict]]:
        """Tumours of up to `most` cells in groups, larger ones one by one in distributed form. Only the ids of larger ones
        come to the driver."""
        large = [r.tumour_id for r in obs.groupBy("tumour_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("tumour_id").orderBy("tumour_id").collect()]
        return self.fit(obs.where(~F.col("tumour_id").isin(large)) if large else obs), {t: self.fit_one(obs.where(F.col("tumour_id") == t)) for t in large}

    def fit_cohort(self, obs: DataFrame, block: int = GROUPED_CELLS):
        """Tumours of any sizes as one set of long tables (plans.cohort.LongFit): those of up to `block` cells in groups, all
        larger ones advancing together."""
        from clonal_spark.plans.cohort import fit_cohort

        return fit_cohort(self, obs, block)

    def fit_one(self, obs: DataFrame) -> dict:
        """One large tumour by distributed EM (or its variational form): the selected K as `fit` gives it, see distributed_fit."""
        return distributed_fit(obs, self.config)


def _matrix(rows: pa.ListArray) -> np.ndarray:
    """Arrays of equal length as a matrix, from their buffer."""
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _stats(emission, params: dict[int, tuple[np.ndarray, np.ndarray]], samples: list[str]):
    """Per partition: for each K, sums of responsibilities and weighted counts, log-likelihood, entropy and expectation."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            alt, depth, adj = (_matrix(batch.column(c)) for c in ("alt", "depth", "adj"))
            fixed = emission.np_fixed(alt, depth)
            for k, (centers, log_pi) in params.items():
                log_r = en.log_resp(log_pi, alt, depth, adj, centers, emission, fixed)
                r = en.softmax(log_r)
                row = np.concatenate([r.sum(0), (r.T @ alt).ravel(), (r.T @ depth).ravel(), [mx.np_logsumexp(log_r, 1).sum(), (r * log_r).sum() - (r * np.log(np.maximum(r, 1e-300))).sum(), len(alt)]])
                total[k] = total.get(k, 0) + row
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], names=["K", "stats"])

    return run


def wide(obs: DataFrame, samples: list[str]) -> DataFrame:
    """One row per mutation with arrays over samples, kept for all iterations."""
    cell = lambda c, empty: F.transform(F.array(*map(F.lit, samples)), lambda s: F.coalesce(F.element_at(F.col(c), s), F.lit(empty))).alias(c)
    maps = obs.groupBy("mut_id").agg(*[F.map_from_entries(F.collect_list(F.struct("sample_id", c))).alias(c) for c in ("alt", "depth", "adj")])
    return maps.select("mut_id", cell("alt", 0.0), cell("depth", 0.0), cell("adj", 1.0))


def _assigned(emission, e_step: tuple[np.ndarray, np.ndarray], merge: tuple[np.ndarray, np.ndarray] | None, bad: np.ndarray):
    """Responsibilities of each mutation, and its clone; those of `bad` clones go to the best other one."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            alt, depth, adj = (_matrix(batch.column(c)) for c in ("alt", "depth", "adj"))
            r = en.softmax(en.log_resp(e_step[1], alt, depth, adj, e_step[0], emission, emission.np_fixed(alt, depth)))
            r = r if merge is None else en.merged_resp(r, *merge)
            k = r.argmax(1)
            if bad.any():
                valid = np.flatnonzero(~bad)
                k = np.where(bad[k], valid[r[:, valid].argmax(1)], k)
            yield pa.RecordBatch.from_arrays([batch.column("mut_id"), pa.array(k, pa.int32()), pa.array([True] * len(k)), pa.array(r.tolist(), pa.list_(pa.float64()))], names=["mut_id", "k", "kept", "resp"])

    return run


def _tail_kept(obs: DataFrame, config: CloneConfig) -> DataFrame:
    """(tumour_id, mut_id, kept) with each sample's tail weight estimated where none is given, as engines.tail_probability does."""
    if config.tail_weight is not None:
        return no.tail_mask(obs, config.tail_threshold, config.phi, config.tail_weight)
    # the log odds of the tail at equal weights; a weight adds its own
    odds = Scratch(obs.sparkSession, "tail").write(no.tail_log_odds(obs, config.phi).select("tumour_id", "mut_id", "sample_id", "odds"), "odds")
    weights = {r.sample_id: 0.1 for r in odds.select("sample_id").distinct().collect()}
    posterior = lambda: 1 / (1 + F.exp(-(F.col("odds") + F.element_at(F.create_map(*(F.lit(x) for s, t in weights.items() for x in (s, float(np.log(t / (1 - t)))))), F.col("sample_id")))))
    running = set(weights)
    for _ in range(50):
        means = {r.sample_id: float(np.clip(r.p, 1e-6, 1 - 1e-6)) for r in odds.where(F.col("sample_id").isin(list(running))).groupBy("sample_id").agg(F.avg(posterior()).alias("p")).collect()}
        running = {s for s in running if abs(means[s] - weights[s]) >= 1e-4}  # else the value before this one is kept
        weights |= {s: means[s] for s in running}
        if not running:
            break
    return no.mask_of(odds.withColumn("p_tail", posterior()), config.tail_threshold)


def distributed_fit(obs: DataFrame, config: CloneConfig, max_iter: int = en.MAX_ITER, tol: float = en.TOL, rel_tol: float = 0.0) -> dict:
    """All K of the schedule advance together, one pass over the data per iteration; converged ones drop out.
    What comes to the driver per iteration are K-sized sums of each partition, added up by Spark. Selection, merging, tree
    and noise are those of engines.fit_arrays; `assigned` is a table of mut_id, k, kept and resp. The sampler has no such
    form."""
    if config.inference is InferenceEngine.MCMC:
        raise NotImplementedError("the sampler has no distributed form; fit the tumour in one group")
    own = [x for x, kind in ((config.inference, InferenceEngine), (config.k_prior, KPrior), (config.noise, NoiseModel)) if not isinstance(x, kind)]
    if own:
        raise NotImplementedError(f"no distributed form of {own}; fit the tumour in one group")
    spark: SparkSession = obs.sparkSession
    if config.noise is NoiseModel.MULTIPLICITY and "total_cn" in obs.columns and obs.where("total_cn IS NOT NULL").limit(1).count():
        obs = no.multiplicity_adj(obs, config.purity)
    samples = [r.sample_id for r in obs.select("sample_id").distinct().orderBy("sample_id").collect()]
    scratch = Scratch(spark, "distributed-fit")
    data = scratch.write(wide(obs, samples), "wide")
    # with the missing cells, as in dense arrays
    zipped = F.explode(F.arrays_zip(F.array(*map(F.lit, samples)).alias("sample_id"), "alt", "depth")).alias("z")
    cells = data.select(F.lit(0).cast("long").alias("tumour_id"), "mut_id", zipped).select("tumour_id", "mut_id", F.col("z.sample_id"), F.col("z.alt"), F.col("z.depth"))
    out = None
    if config.noise is NoiseModel.TAIL_FILTER:
        mask = scratch.write(_tail_kept(cells, config), "mask")
        kept, out = mask.where("kept").select("mut_id"), mask.where("NOT kept").select("mut_id")
        data, cells = scratch.write(data.join(kept, "mut_id", "left_semi"), "kept"), cells.join(kept, "mut_id", "left_semi")
    emission, s = emission_of(config), len(samples)
    ks = en.k_schedule(config)
    levels = sorted({i / (k + 1) for k in ks for i in range(1, k + 1)})
    rows = cells.groupBy("sample_id").agg(F.percentile(mo.vaf(), F.array(*map(F.lit, levels))).alias("q")).collect()
    at = {r.sample_id: dict(zip(levels, r.q, strict=True)) for r in rows}
    params = {k: (np.clip([[at[x][i / (k + 1)] for x in samples] for i in range(1, k + 1)], en.LOW, en.HIGH), np.full(k, -np.log(k))) for k in ks}
    alphas = {k: np.full(k, en.ALPHA0) for k in params}
    # each K's phase, and its iterations in it
    first = {InferenceEngine.EM: "em", InferenceEngine.MFVI: "vi", InferenceEngine.HYBRID: "start"}[config.inference]
    phase, steps, before = dict.fromkeys(params, first), dict.fromkeys(params, 0), dict.fromkeys(params, -np.inf)
    done, n_iter, trace = {}, 0, []

    def totals_of(use: dict) -> dict:
        sums = data.select("alt", "depth", "adj").mapInArrow(_stats(emission, use, samples), "K int, stats array<double>")
        rows = sums.select("K", F.posexplode("stats").alias("i", "v")).groupBy("K", "i").agg(F.sum("v").alias("v")).groupBy("K").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("x")).select("K", F.col("x.v").alias("total")).collect()
        return {r.K: np.array(r.total) for r in rows}

    while params:
        n_iter += 1
        use = {k: (c, mx.np_digamma(alphas[k]) - mx.np_digamma(alphas[k].sum()) if phase[k] == "vi" else w) for k, (c, w) in params.items()}
        totals = totals_of(use)
        for k in list(params):
            row = totals[k]
            assert len(row) == k + 2 * k * s + 3
            mass, a, d, (ll, elbo, n) = row[:k], row[k : k + k * s].reshape(k, s), row[k + k * s : k + 2 * k * s].reshape(k, s), row[-3:]
            centers = en.constrain(config, np.clip(a / np.maximum(d, 1e-10), en.LOW, en.HIGH))
            if phase[k] == "vi":
                alphas[k] = en.ALPHA0 + mass
                value = elbo - en._kl_dirichlet(alphas[k], en.ALPHA0)
            else:
                value = ll
            params[k] = (centers, np.log(np.maximum(mass / n, 1e-10)))
            trace.append({"K": k, "iteration": n_iter, "value": float(value)})
            steps[k] += 1
            converged = bool(abs(value - before[k]) < max(tol, rel_tol * abs(value)))
            before[k] = value
            if phase[k] == "start":
                if converged or steps[k] == en.HYBRID_EM:
                    phase[k], steps[k], before[k] = "vi", 0, -np.inf
            elif converged or steps[k] == max_iter:
                more = en.HYBRID_EM if first == "start" else 0
                done[k] = {"K": k, "centers": centers, "mass": mass, "ll": float(ll), "n_mut": int(n), "n_iter": steps[k] + more, "converged": converged, "e_step": use[k]}
                del params[k]
    if first != "em":  # the likelihood at the last weights and centers
        last = totals_of({k: (f["centers"], np.log(np.maximum(alphas[k] / alphas[k].sum(), 1e-10))) for k, f in done.items()})
        for k, f in done.items():
            f["ll"] = float(last[k][-3])
    for f in done.values():
        f["bic"] = float(en.bic(f["ll"], f["K"], s, f["n_mut"]))
    best = min(done.values(), key=lambda f: (f["bic"], f["K"])) if config.k_prior is KPrior.BIC else done[ks[0]]
    merge = None
    if config.k_prior not in (KPrior.BIC, KPrior.FIXED):
        place, keep, centers = en.merged(best["centers"], best["mass"], best["n_mut"], en.TSSB_PRUNE if config.k_prior is KPrior.TSSB else en.PRUNE)
        merge = place, keep
        best |= {"K": len(keep), "centers": centers, "mass": np.bincount(place, best["mass"])[keep], "bic": float(en.bic(best["ll"], len(keep), s, best["n_mut"]))}
    tree = en.grow_tree(config, en.Fit(best["centers"], np.zeros((0, best["K"])), np.zeros(0, int), best["ll"], best["bic"], best["K"], best["n_iter"], best["converged"]))
    best["parents"], best["pairs"] = tree.parents, tree.pairs
    table = lambda bad: data.select("mut_id", "alt", "depth", "adj").mapInArrow(_assigned(emission, best["e_step"], merge, bad), "mut_id long, k int, kept boolean, resp array<double>")
    bad = np.zeros(best["K"], bool)
    if config.noise is NoiseModel.ARTEFACT and (bad := en.artefacts(config, best["centers"])).any():
        held = [r.k for r in table(np.zeros(best["K"], bool)).select("k").distinct().collect()]
        best["centers"] = best["centers"].copy()
        best["centers"][[k for k in held if bad[k]]] = 0.0
    best["assigned"] = table(bad)
    if out is not None:
        best["assigned"] = best["assigned"].unionByName(out.select("mut_id", F.lit(-1).alias("k"), F.lit(False).alias("kept"), F.array_repeat(F.lit(0.0), best["K"]).alias("resp")))
    best["samples"], best["trace"], best["spark"] = samples, trace, spark.version
    return best
