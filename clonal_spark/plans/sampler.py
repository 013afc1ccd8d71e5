"""Gibbs sampling of large tumours over blocks, several chains at once.

Labels are drawn where their mutations are, from uniform numbers that are a hash of (seed, tumour, chain, iteration, mutation):
so draws do not depend on how mutations are dealt to blocks and tasks, and a task that runs again draws the same. What a block sends
are conjugate counts: mutations of each clone, and the binomial log-likelihood of each clone and sample at the present and
the proposed centers. Weights come from their Dirichlet, centers by Metropolis steps on the logit scale with step sizes
adapted while tuning, as in engines.mcmc; each state row seeds its own generator by its place in the run.

Each (tumour, chain) is a row of the state, which keeps sums of the draws and of SPLITS stretches of them. Chains give R-hat (the
pooled variance over the variance within chains), and the stretches' means the effective number of draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonal_spark.config import CloneConfig
from clonal_spark.functions.emission import EPS, Binomial
from clonal_spark.plans import engines as en
from clonal_spark.session import Scratch

SPLITS = 10
CHAIN = (
    "tumour_id long, chain int, K int, s int, t int, x array<double>, scale array<double>, pi array<double>, sum_pi array<double>, sum_c array<double>, sum_cc array<double>, splits array<double>, accepted double"
)
DRAW = "tumour_id long, chain int, K int, t int, centers array<double>, proposed array<double>, pi array<double>"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(muts: np.ndarray, *place: int) -> np.ndarray:
    """A number in [0, 1) for each mutation at a place of the run."""
    h = np.zeros(len(muts), np.uint64)
    for p in place:
        h = _mixed(h + _GOLD + np.uint64(p & (2**64 - 1)))
    return (_mixed(h ^ _mixed(muts.astype(np.int64).view(np.uint64) + _GOLD)) >> np.uint64(11)) * 2.0**-53


def _generator(seed: int, r: dict, kind: int) -> np.random.Generator:
    return np.random.default_rng([seed, r["tumour_id"] & (2**63 - 1), r["chain"], r["t"], kind])


def _centers(x) -> np.ndarray:
    return np.clip(1 / (1 + np.exp(-np.asarray(x))), en.LOW, en.HIGH)


def proposed(r: dict, seed: int) -> np.ndarray:
    return np.array(r["x"]) + np.array(r["scale"]) * _generator(seed, r, 0).standard_normal(len(r["x"]))


def _counted(seed: int):
    """Of each block and chain: mutations of each clone, and log-likelihoods by clone and sample at present and proposed centers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Binomial()
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                muts = batch.column("muts")[i].values.to_numpy()
                alt, depth, adj = (batch.column(c)[i].values.to_numpy().reshape(len(muts), -1) for c in ("alt", "depth", "adj"))
                fixed, tumour = sampler.np_fixed(alt, depth), batch.column("tumour_id")[i].as_py()
                for f in batch.column("fits")[i].as_py():
                    k = f["K"]
                    c, d = (np.array(f[name]).reshape(k, -1) for name in ("centers", "proposed"))
                    log_r = en.log_resp(np.log(np.maximum(f["pi"], EPS)), alt, depth, adj, c, sampler, fixed)
                    z = np.minimum((en.softmax(log_r).cumsum(1) < uniforms(muts, seed, tumour, f["chain"], f["t"])[:, None]).sum(1), k - 1)
                    lls = []
                    for centers in (c, d):
                        total = np.zeros_like(centers)
                        np.add.at(total, z, sampler.np_log_prob(alt, depth, adj * centers[z], fixed))
                        lls.append(total.ravel())
                    out.append((tumour, f["chain"], np.concatenate([np.bincount(z, minlength=k), *lls]).tolist()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.float64()))], names=["tumour_id", "chain", "stats"])

    return run


def moved(r: dict, seed: int, tune: int, draws: int) -> dict:
    """A chain's row after the counts of its iteration."""
    k, n, total = r["K"], len(r["x"]), np.array(r["total"])
    counts, now, then = total[:k], total[k : k + n], total[k + n :]
    rng = _generator(seed, r, 1)
    x, y, scale = np.array(r["x"]), proposed(r, seed), np.array(r["scale"])
    pi = rng.dirichlet(1 + counts)
    c, d = _centers(x), _centers(y)
    ratio = then - now + np.log(d * (1 - d)) - np.log(c * (1 - c))
    take = np.log(rng.random(n)) < ratio
    x = np.where(take, y, x)
    out = r | {"t": r["t"] + 1, "x": x.tolist(), "pi": pi.tolist()}
    if r["t"] < tune:
        out["scale"] = (scale * np.exp((take - 0.44) / np.sqrt(r["t"] + 1.0))).tolist()
        return out
    c = _centers(x)
    splits = np.array(r["splits"]).reshape(SPLITS, n)
    splits[min((r["t"] - tune) * SPLITS // draws, SPLITS - 1)] += c
    return out | {"sum_pi": (np.array(r["sum_pi"]) + pi).tolist(), "sum_c": (np.array(r["sum_c"]) + c).tolist(), "sum_cc": (np.array(r["sum_cc"]) + c * c).tolist(), "splits": splits.ravel().tolist(), "accepted": r["accepted"] + float(take.mean())}


def diagnosis(rows: list[dict], draws: int) -> dict:
    """Posterior means over chains, R-hat and effective draws of each center. Chains are put in the order of their clones' mean
    centers first, as labels are their own."""
    k, s = rows[0]["K"], rows[0]["s"]
    means, variances, pis, splits = [], [], [], []
    for r in rows:
        mean = np.array(r["sum_c"]).reshape(k, s) / draws
        order = np.argsort(-mean.mean(1), kind="stable") if len(rows) > 1 else np.arange(k)
        variance = np.maximum(np.array(r["sum_cc"]).reshape(k, s) / draws - mean**2, 0) * draws / max(draws - 1, 1)
        sizes = np.bincount(np.minimum(np.arange(draws) * SPLITS // draws, SPLITS - 1), minlength=SPLITS)
        stretch = np.array(r["splits"]).reshape(SPLITS, k, s)[sizes > 0] / sizes[sizes > 0][:, None, None]
        means.append(mean[order]), variances.append(variance[order]), pis.append(np.array(r["sum_pi"])[order] / draws), splits.append(stretch[:, order])
    within, between = np.mean(variances, 0), np.var(means, 0, ddof=1) if len(rows) > 1 else np.zeros((k, s))
    r_hat = np.sqrt((within * (draws - 1) / draws + between) / np.maximum(within, 1e-300))
    of_means = np.mean([np.var(x, 0, ddof=1) if len(x) > 1 else np.zeros((k, s)) for x in splits], 0)
    ess = np.minimum(len(rows) * len(splits[0]) * within / np.maximum(of_means, 1e-300), len(rows) * draws)
    pi = np.mean(pis, 0)
    flat = lambda x: x.ravel().tolist()
    return {"tumour_id": rows[0]["tumour_id"], "K": k, "s": s, "centers": flat(np.mean(means, 0)), "log_pi": np.log(np.maximum(pi, EPS)).tolist(), "r_hat": flat(r_hat), "ess": flat(ess), "accepted": float(np.mean([r["accepted"] for r in rows])) / draws}


MEANS = "tumour_id long, K int, s int, centers array<double>, log_pi array<double>, r_hat array<double>, ess array<double>, accepted double"


def sample(blocks: DataFrame, ids: DataFrame, begun: DataFrame, config: CloneConfig, scratch: Scratch, rows_of, draws: int = 2000, tune: int = 1000, chains: int = 2, seed: int = 0) -> DataFrame:
    """MEANS of (tumour_id, K, s, centers): the start of every chain. rows_of makes a function of K-sized rows one of batches."""
    spark = blocks.sparkSession

    def start(r: dict) -> dict:
        c, n = np.array(r["centers"]), len(r["centers"])
        zero = [0.0] * n
        return r | {"t": 0, "x": np.log(c / (1 - c)).tolist(), "scale": [0.1] * n, "pi": [1 / r["K"]] * r["K"], "sum_pi": [0.0] * r["K"], "sum_c": zero, "sum_cc": zero, "splits": zero * SPLITS, "accepted": 0.0}

    spread = begun.select("tumour_id", "K", "s", "centers", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("chain"))
    state = scratch.write(spread.mapInArrow(rows_of(start, CHAIN, spark), CHAIN), "chain-0")
    drawn = rows_of(lambda r: r | {"centers": _centers(r["x"]).tolist(), "proposed": _centers(proposed(r, seed)).tolist()}, DRAW, spark)
    for t in range(1, tune + draws + 1):
        use = state.mapInArrow(drawn, DRAW).groupBy("tumour_id").agg(F.collect_list(F.struct("K", "chain", "t", "centers", "proposed", "pi")).alias("fits"))
        sums = blocks.join(ids.join(use, "tumour_id"), ["tumour_id", "block"]).mapInArrow(_counted(seed), "tumour_id long, chain int, stats array<double>")
        one = sums.select("tumour_id", "chain", F.posexplode("stats").alias("i", "v")).groupBy("tumour_id", "chain", "i").agg(F.sum("v").alias("v"))
        total = one.groupBy("tumour_id", "chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("total"))
        state = scratch.write(state.join(total, ["tumour_id", "chain"]).mapInArrow(rows_of(lambda r: moved(r, seed, tune, draws), CHAIN, spark), CHAIN), f"chain-{t}")
        scratch.drop(f"chain-{t - 1}")
    every = state.groupBy("tumour_id").agg(F.array_sort(F.collect_list(F.struct("chain", "K", "s", "tumour_id", "sum_pi", "sum_c", "sum_cc", "splits", "accepted"))).alias("chains"))
    return scratch.write(every.mapInArrow(rows_of(lambda r: diagnosis(r["chains"], draws), MEANS, spark), MEANS), "posterior")
