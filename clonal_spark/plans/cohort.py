"""Fits of tumours of any size in one plan.

A tumour of up to `block` cells is a group of its own (plans.model). Larger ones advance together: their mutations are dealt
to blocks of about that many cells, written once and bucketed by (tumour, block), and the parameters of every (tumour, K) are
rows of a state table. One iteration is one pass over the blocks of the tumours that still have an unconverged K:

* the active parameters of a tumour, all its K together, meet its blocks (the blocks are not shuffled);
* each block gives K-sized sums, which Spark adds up per (tumour, K);
* each state row takes its step and is written anew, which cuts the lineage; converged rows drop out of the frontier.

Selection, merging, trees and artefacts are those of plans.engines, on K-sized rows in tasks. No row holds a tumour of more
than a block, and nothing of a tumour comes to the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonal_spark.config import CloneConfig, InferenceEngine, KPrior, NoiseModel, PhyloMode
from clonal_spark.functions import mathx as mx
from clonal_spark.functions.emission import emission_of
from clonal_spark.operators import mixture as mo
from clonal_spark.operators import noise as no
from clonal_spark.operators.selection import exact_quantiles
from clonal_spark.plans import engines as en
from clonal_spark.plans.sampler import sample
from clonal_spark.session import Scratch

TUMOUR_K = ["tumour_id", "K"]
STATE = (
    "tumour_id long, K int, s int, active boolean, phase string, steps int, n_iter int, before double, centers array<double>, log_pi array<double>, alpha array<double>, "
    "e_centers array<double>, e_log_pi array<double>, mass array<double>, ll double, n_mut long, converged boolean, trace array<double>"
)
CHOSEN = (
    "tumour_id long, K int, s int, ll double, bic double, n_iter int, converged boolean, centers array<double>, parents array<int>, e_k int, e_centers array<double>, e_log_pi array<double>, "
    "place array<int>, keep array<int>, bad array<boolean>, trace array<double>"
)
ASSIGNED = "tumour_id long, mut_id long, k int, first int, kept boolean, resp array<double>"
#: Clones of a block up to which tables of its counts are not worth making anew.
TABLED = 8
FIRST = {InferenceEngine.EM: "em", InferenceEngine.MFVI: "vi", InferenceEngine.HYBRID: "start"}


@dataclass
class LongFit:
    """A cohort's results as long tables."""

    fit_summary: DataFrame
    centers: DataFrame
    assignments: DataFrame
    responsibilities: DataFrame
    convergence: DataFrame
    tree_edges: DataFrame
    #: Of sampled fits: R-hat and effective draws of each center.
    diagnostics: DataFrame | None = None

    def with_(self, other) -> LongFit:
        """Both cohorts' results. other: this or a CohortFit."""
        return LongFit(*[getattr(self, c).unionByName(getattr(other, c)) for c in TABLES], getattr(other, "diagnostics", None))


TABLES = ("fit_summary", "centers", "assignments", "responsibilities", "convergence", "tree_edges")


def _rows(run: Callable[[dict], dict | list[dict]], schema: str, spark) -> Callable:
    """A function of K-sized rows as one of batches."""
    kind = pa.schema([pa.field(f.name, _arrow(f.dataType.simpleString())) for f in spark.createDataFrame([], schema).schema])

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            out = [run(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in kind.names} for r in out], kind)

    return batches


def _arrow(name: str) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.list_(_arrow(name[6:-1])) if name.startswith("array<") else plain[name]


def _arrays(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """alt, depth, adj (mutations, samples) of a block."""
    n = len(batch.column("muts")[i])
    return tuple(batch.column(c)[i].values.to_numpy().reshape(n, -1) for c in ("alt", "depth", "adj"))


def _stats(config: CloneConfig):
    """Of each block and K: sums of responsibilities and weighted counts, log-likelihood, expectation plus entropy, mutations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emission = emission_of(config)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                alt, depth, adj = _arrays(batch, i)
                fits = batch.column("fits")[i].as_py()
                fixed = en.tables(emission, alt, depth, adj) if sum(f["K"] for f in fits) > TABLED else emission.np_fixed(alt, depth)
                for f in fits:
                    log_r = en.log_resp(np.array(f["log_w"]), alt, depth, adj, np.array(f["centers"]).reshape(f["K"], -1), emission, fixed)
                    r, lls = en.softmax_ll(log_r)
                    ends = [lls.sum(), (r * log_r).sum() - (r * np.log(np.maximum(r, 1e-300))).sum(), len(alt)]
                    out.append((batch.column("tumour_id")[i].as_py(), f["K"], np.concatenate([r.sum(0), (r.T @ alt).ravel(), (r.T @ depth).ravel(), ends]).tolist()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.float64()))], names=["tumour_id", "K", "stats"])

    return run


def _weights(r: dict) -> np.ndarray:
    """Log weights of the next expectation step."""
    if r["phase"] != "vi":
        return np.array(r["log_pi"])
    alpha = np.array(r["alpha"])
    return mx.np_digamma(alpha) - mx.np_digamma(alpha.sum())


def step(config: CloneConfig, r: dict, max_iter: int, tol: float, start: int) -> dict:
    """A state row after its sums, as engines.em and engines.mfvi go; start: the most EM steps before variational ones."""
    k, s, row = r["K"], r["s"], np.array(r["total"])
    mass, a, d, (ll, elbo, n) = row[:k], row[k : k + k * s].reshape(k, s), row[k + k * s : k + 2 * k * s].reshape(k, s), row[-3:]
    out = r | {"e_centers": r["centers"], "e_log_pi": _weights(r).tolist(), "mass": mass.tolist(), "ll": float(ll), "n_mut": int(n), "steps": r["steps"] + 1, "n_iter": r["n_iter"] + 1}
    out["centers"] = en.constrain(config, np.clip(a / np.maximum(d, 1e-10), en.LOW, en.HIGH)).ravel().tolist()
    value = float(ll)
    if r["phase"] == "vi":
        alpha = en.ALPHA0 + mass
        out["alpha"], value = alpha.tolist(), float(elbo - en._kl_dirichlet(alpha, en.ALPHA0))
    else:
        out["log_pi"] = np.log(np.maximum(mass / n, 1e-10)).tolist()
    out["trace"] = [*r["trace"], value]
    converged = abs(value - r["before"]) < tol
    out["before"] = value
    if r["phase"] == "start":
        if converged or out["steps"] == start:
            out |= {"phase": "vi", "steps": 0, "n_iter": start, "before": -float("inf")}
    elif converged or out["steps"] == max_iter:
        out |= {"active": False, "converged": bool(converged)}
    return out


def _posterior(r: dict, sampling: dict) -> dict:
    """A state row of posterior means and their sums."""
    k, row = r["K"], np.array(r["total"])
    return r | {"active": False, "phase": "sampled", "steps": 0, "n_iter": sampling.get("draws", 2000), "before": 0.0, "alpha": [1.0] * k, "e_centers": r["centers"], "e_log_pi": r["log_pi"], "mass": row[:k].tolist(), "ll": float(row[-3]), "n_mut": int(row[-1]), "converged": True, "trace": []}


def _final(r: dict) -> dict:
    return r | {"ll": float(r["total"][-3])}


def _finished(config: CloneConfig, r: dict) -> dict:
    """A selected row with merging, tree and artefacts."""
    centers = np.array(r["centers"]).reshape(r["K"], -1)
    out = r | {"e_k": r["K"], "place": None, "keep": None}
    if config.k_prior not in (KPrior.BIC, KPrior.FIXED):
        place, keep, centers = en.merged(centers, np.array(r["mass"]), r["n_mut"], en.TSSB_PRUNE if config.k_prior is KPrior.TSSB else en.PRUNE)
        out |= {"K": len(keep), "place": place.tolist(), "keep": keep.tolist(), "bic": float(en.bic(r["ll"], len(keep), r["s"], r["n_mut"]))}
    tree = en.grow_tree(config, en.Fit(centers, np.zeros((0, len(centers))), np.zeros(0, int), r["ll"], out["bic"], len(centers), r["n_iter"], r["converged"]))
    bad = en.artefacts(config, centers) if config.noise is NoiseModel.ARTEFACT else np.zeros(len(centers), bool)
    return out | {"centers": centers.ravel().tolist(), "parents": None if tree.parents is None else [int(p) for p in tree.parents], "bad": bad.tolist()}


def _assigned(config: CloneConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emission = emission_of(config)
        for batch in batches:
            for i in range(batch.num_rows):
                alt, depth, adj = _arrays(batch, i)
                f = batch.column("fit")[i].as_py()
                r = en.softmax(en.log_resp(np.array(f["e_log_pi"]), alt, depth, adj, np.array(f["e_centers"]).reshape(f["e_k"], -1), emission, emission.np_fixed(alt, depth)))
                r = r if f["place"] is None else en.merged_resp(r, np.array(f["place"]), np.array(f["keep"]))
                first, bad = r.argmax(1), np.array(f["bad"])
                valid = np.flatnonzero(~bad)
                k = np.where(bad[first], valid[r[:, valid].argmax(1)], first)
                n = len(k)
                resp = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * r.shape[1]), pa.array(r.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column("tumour_id")[i].as_py())), batch.column("muts")[i].values, pa.array(k, pa.int32()), pa.array(first, pa.int32()), pa.array(np.ones(n, bool)), resp], names=["tumour_id", "mut_id", "k", "first", "kept", "resp"])

    return run


def tail_kept(cells: DataFrame, config: CloneConfig, scratch: Scratch) -> DataFrame:
    """(tumour_id, mut_id, kept). Without a given tail weight, those of all (tumour, sample) are estimated together, each
    until it stands as engines.tail_probability has it; only the running ones go on."""
    if config.tail_weight is not None:
        return no.tail_mask(cells, config.tail_threshold, config.phi, config.tail_weight)
    key = ["tumour_id", "sample_id"]
    odds = scratch.write(no.tail_log_odds(cells, config.phi).select(*mo.MUT, "sample_id", "odds"), "tail-odds")
    posterior = 1 / (1 + F.exp(-(F.col("odds") + F.log(F.col("tau") / (1 - F.col("tau"))))))
    weights = scratch.write(odds.select(*key).distinct().select(*key, F.lit(0.1).alias("tau"), F.lit(True).alias("running")), "tail-0")
    for i in range(1, 51):
        means = odds.join(weights.where("running"), key).groupBy(*key).agg(mx.clip(F.avg(posterior), 1e-6, 1 - 1e-6).alias("mean"))
        moves = F.col("running") & (F.abs(F.col("mean") - F.col("tau")) >= 1e-4)
        weights = scratch.write(weights.join(means, key, "left").select(*key, F.when(moves, F.col("mean")).otherwise(F.col("tau")).alias("tau"), moves.alias("running")), f"tail-{i}")
        scratch.drop(f"tail-{i - 1}")
        if weights.where("running").isEmpty():
            break
    return no.mask_of(odds.join(weights, key).withColumn("p_tail", posterior), config.tail_threshold)


def fit_large(obs: DataFrame, config: CloneConfig, name: str = "custom", block: int = 500_000, max_iter: int = en.MAX_ITER, tol: float = en.TOL, **sampling: int) -> LongFit:
    """All tumours of obs by the frontier, whatever their sizes. sampling: draws, tune, chains and seed of the sampler."""
    own = [x for x, kind in ((config.inference, InferenceEngine), (config.k_prior, KPrior), (config.noise, NoiseModel), (config.phylo, PhyloMode)) if not isinstance(x, kind)]
    if own:
        raise NotImplementedError(f"no distributed form of {own}; fit the tumour in one group")
    spark, scratch = obs.sparkSession, Scratch(obs.sparkSession, "cohort")
    if config.noise is NoiseModel.MULTIPLICITY and "total_cn" in obs.columns:
        obs = no.multiplicity_adj(obs, config.purity)
    samples = scratch.write(obs.groupBy("tumour_id").agg(F.array_sort(F.collect_set("sample_id")).alias("samples"), F.count_distinct("mut_id").alias("n")), "samples")
    maps = obs.groupBy(*mo.MUT).agg(*[F.map_from_entries(F.collect_list(F.struct("sample_id", c))).alias(f"{c}_of") for c in ("alt", "depth", "adj")])
    cell = lambda c, empty: F.transform("samples", lambda s: F.coalesce(F.element_at(f"{c}_of", s), F.lit(empty))).alias(c)
    wide = scratch.write(maps.join(samples, "tumour_id").select(*mo.MUT, "samples", "n", cell("alt", 0.0), cell("depth", 0.0), cell("adj", 1.0)), "wide")
    cells = wide.select(*mo.MUT, F.explode(F.arrays_zip("samples", "alt", "depth")).alias("z")).select(*mo.MUT, F.col("z.samples").alias("sample_id"), "z.alt", "z.depth")
    out = None
    if config.noise is NoiseModel.TAIL_FILTER:
        mask = scratch.write(tail_kept(cells, config, scratch), "mask")
        kept, out = mask.where("kept").select(*mo.MUT), mask.where("NOT kept").select(*mo.MUT)
        wide, cells = wide.join(kept, mo.MUT, "left_semi"), cells.join(kept, mo.MUT, "left_semi")

    # blocks of about `block` cells, bucketed so that no iteration shuffles them
    count = F.ceil(F.col("n") * F.size("samples") / F.lit(float(block)))
    dealt = wide.withColumn("block", F.pmod(F.xxhash64("mut_id"), count)).groupBy("tumour_id", "block").agg(F.collect_list(F.struct("mut_id", "alt", "depth", "adj")).alias("them"))
    flat = lambda c: F.flatten(F.transform("them", lambda x: x[c])).alias(c)
    parts, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"cohort_{uuid.uuid4().hex}"
    packed = dealt.select("tumour_id", "block", F.transform("them", lambda x: x["mut_id"]).alias("muts"), *map(flat, ("alt", "depth", "adj")))
    packed.repartition(parts, "tumour_id", "block").write.bucketBy(parts, "tumour_id", "block").option("path", scratch.path("blocks")).saveAsTable(table)
    try:
        return _fit_blocks(spark.table(table), cells, samples, out, config, name, scratch, max_iter, tol, sampling)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # the files stay


def _fit_blocks(blocks: DataFrame, cells: DataFrame, samples: DataFrame, out: DataFrame | None, config: CloneConfig, name: str, scratch: Scratch, max_iter: int, tol: float, sampling: dict) -> LongFit:
    spark = blocks.sparkSession
    ids = scratch.write(blocks.select("tumour_id", "block"), "ids")
    ks = en.k_schedule(config)
    levels = sorted({i / (k + 1) for k in ks for i in range(1, k + 1)})
    at = {x: i for i, x in enumerate(levels)}
    quantiles = exact_quantiles(cells.withColumn("v", mo.vaf()), ["tumour_id", "sample_id"], "v", levels)
    rows = quantiles.groupBy("tumour_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "q"))), lambda x: x["q"]).alias("qs"))
    first = FIRST.get(config.inference, "sampled")

    def begin(r: dict) -> dict:
        k = r["K"]
        centers = np.clip([[q[at[i / (k + 1)]] for q in r["qs"]] for i in range(1, k + 1)], en.LOW, en.HIGH)
        return r | {"s": len(r["qs"]), "active": True, "phase": first, "steps": 0, "n_iter": 0, "before": -float("inf"), "centers": centers.ravel().tolist(), "log_pi": [-float(np.log(k))] * k, "alpha": [en.ALPHA0] * k, "trace": []}

    per_k = rows.select("tumour_id", "qs", F.explode(F.array(*map(F.lit, ks))).alias("K"))
    state = scratch.write(per_k.mapInArrow(_rows(begin, STATE, spark), STATE), "state-0")

    def totals(params: DataFrame) -> DataFrame:
        """Sums of each (tumour, K) of params (K, centers, log_w)."""
        use = params.groupBy("tumour_id").agg(F.collect_list(F.struct("K", "centers", "log_w")).alias("fits"))
        sums = blocks.join(ids.join(use, "tumour_id"), ["tumour_id", "block"]).mapInArrow(_stats(config), "tumour_id long, K int, stats array<double>")
        one = sums.select(*TUMOUR_K, F.posexplode("stats").alias("i", "v")).groupBy(*TUMOUR_K, "i").agg(F.sum("v").alias("v"))
        return one.groupBy(*TUMOUR_K).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("total"))

    weighed = _rows(lambda r: r | {"log_w": _weights(r).tolist()}, "tumour_id long, K int, centers array<double>, log_w array<double>", spark)
    i, start, means = 0, en.HYBRID_EM, None
    if first == "sampled":  # one expectation step of the emission at the posterior means
        means = sample(blocks, ids, state, config, scratch, _rows, **sampling)
        params = means.select("tumour_id", "K", "centers", F.col("log_pi").alias("log_w"))
        told = _rows(lambda r: _posterior(r, sampling), STATE, spark)
        state = scratch.write(means.select("tumour_id", "K", "s", "centers", "log_pi").join(totals(params), TUMOUR_K).mapInArrow(told, STATE), "state-sampled")
    while not (active := state.where("active")).isEmpty():
        i += 1
        sums = totals(active.mapInArrow(weighed, "tumour_id long, K int, centers array<double>, log_w array<double>"))
        moved = active.join(sums, TUMOUR_K).mapInArrow(_rows(lambda r: step(config, r, max_iter, tol, start), STATE, spark), STATE)
        state = scratch.write(state.where("NOT active").unionByName(moved), f"state-{i}")
        scratch.drop(f"state-{i - 1}")
    if first in ("vi", "start"):  # the likelihood at the last weights and centers
        last = _rows(lambda r: r | {"log_w": np.log(np.maximum(np.array(r["alpha"]) / sum(r["alpha"]), 1e-10)).tolist()}, "tumour_id long, K int, centers array<double>, log_w array<double>", spark)
        sums = totals(state.mapInArrow(last, "tumour_id long, K int, centers array<double>, log_w array<double>"))
        state = state.join(sums, TUMOUR_K).mapInArrow(_rows(_final, STATE, spark), STATE)
    state = state.withColumn("bic", -2 * F.col("ll") + F.col("K") * F.col("s") * F.log(F.greatest("n_mut", F.lit(1)).cast("double")))
    best = F.row_number().over(Window.partitionBy("tumour_id").orderBy("bic", "K"))
    chosen = scratch.write(state.withColumn("best", best).where("best = 1").mapInArrow(_rows(lambda r: _finished(config, r), CHOSEN, spark), CHOSEN), "chosen")
    fit = chosen.select("tumour_id", F.struct("e_k", "e_centers", "e_log_pi", "place", "keep", "bad").alias("fit"))
    assigned = blocks.join(ids.join(fit, "tumour_id"), ["tumour_id", "block"]).mapInArrow(_assigned(config), ASSIGNED)
    if out is not None:
        filtered = out.join(chosen.select("tumour_id", "K"), "tumour_id")
        minus = F.lit(-1)
        assigned = assigned.unionByName(filtered.select(*mo.MUT, minus.alias("k"), minus.alias("first"), F.lit(False).alias("kept"), F.array_repeat(F.lit(0.0), F.col("K")).alias("resp")))
    assigned = scratch.write(assigned, "assigned")
    held = assigned.select("tumour_id", F.col("first").alias("k")).distinct().withColumn("held", F.lit(True))
    per = chosen.join(samples.select("tumour_id", "samples"), "tumour_id").select("tumour_id", "s", "samples", "bad", F.posexplode("centers").alias("at", "center"))
    per = per.select("tumour_id", F.floor(F.col("at") / F.col("s")).cast("int").alias("k"), F.get("samples", F.col("at") % F.col("s")).alias("sample_id"), "center", "bad")
    centers = per.join(held, ["tumour_id", "k"], "left").select("tumour_id", "k", "sample_id", F.when(F.get("bad", F.col("k")) & F.col("held"), 0.0).otherwise(F.col("center")).alias("center"))
    diagnostics = None
    if means is not None:
        cells_of = F.posexplode(F.arrays_zip("centers", "r_hat", "ess")).alias("at", "z")
        one = means.join(samples.select("tumour_id", "samples"), "tumour_id").select("tumour_id", "s", "samples", "accepted", cells_of)
        diagnostics = one.select("tumour_id", F.floor(F.col("at") / F.col("s")).cast("int").alias("k"), F.get("samples", F.col("at") % F.col("s")).alias("sample_id"), "z.centers", "z.r_hat", "z.ess", "accepted").withColumnRenamed("centers", "mean")
    return LongFit(
        chosen.select("tumour_id", F.lit(name).alias("config"), "K", "ll", "bic", "n_iter", "converged"),
        centers,
        assigned.select(*mo.MUT, "k", "kept"),
        assigned.select(*mo.MUT, F.posexplode("resp").alias("k", "r")),
        chosen.select("tumour_id", F.posexplode("trace").alias("i", "value")).select("tumour_id", (F.col("i") + 1).alias("iteration"), "value"),
        chosen.where("parents IS NOT NULL").select("tumour_id", F.posexplode("parents").alias("k", "parent")),
        diagnostics,
    )


def fit_cohort(model, obs: DataFrame, block: int) -> LongFit:
    """Every tumour of obs: those of up to `block` cells in groups, all larger ones by one frontier."""
    sizes = Scratch(obs.sparkSession, "cohort").write(obs.groupBy("tumour_id").agg((F.count_distinct("mut_id") * F.count_distinct("sample_id")).alias("cells")), "sizes")
    of = lambda large: obs.join(sizes.where((F.col("cells") > block) == large).select("tumour_id"), "tumour_id", "left_semi")
    small = model.fit(of(False))
    grouped = LongFit(*[getattr(small, c) for c in TABLES])
    if sizes.where(F.col("cells") > block).isEmpty():
        return grouped
    return grouped.with_(fit_large(of(True), model.config, model.name, block))
