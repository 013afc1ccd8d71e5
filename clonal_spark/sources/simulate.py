"""Synthetic tumours with truth: parameters from empirical priors, counts from a noisy read model.

Randomness is drawn inside each tumour's group from SeedSequence([seed, tumour_id, round]), so cohorts are
reproducible whatever their partitioning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The priors of tumour parameters.
K_VALUES = (1, 2, 3, 4, 5, 6, 7)
K_PROBS = (0.18, 0.34, 0.25, 0.13, 0.06, 0.03, 0.01)
LOG10_MUT, MUT_RANGE = (3.3, 0.55), (50, 30_000)
PURITY_BETA, PURITY_LEAST = (3.5, 1.8), 0.1
LOG_DEPTH, DEPTH_RANGE = (math.log(60), 0.6), (10, 1000)
GAP_BETA, CNA_BETA = (2.0, 3.0), (2.0, 5.0)
PLOIDIES = ((0.60, 2.0, 0.2), (0.20, 3.8, 0.3), (0.20, 2.8, 0.5))
TAIL_RANGE, VAF_RANGE, ADJ_RANGE = (0.01, 0.25), (0.001, 0.999), (0.05, 10.0)

NOISE = ["overdispersion", "gc_bias", "strand_prob", "strand_size", "tail_frac", "tail_shape", "cn_noise"]
PARAMS = "tumour_id long, n_clones int, n_mutations int, n_samples int, purity double, depth int, seed long, " + ", ".join(f"{n} double" for n in NOISE)
SIMULATED = "tumour_id long, mut_id long, sample_id string, alt double, depth double, adj double, total_cn double, true_k int, true_center double"


def _rng(*words: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence([int(w) & 0xFFFFFFFFFFFF for w in words]))


def draw_params(tumour_id: int, seed: int, noise: bool = True) -> dict:
    rng = _rng(seed, tumour_id, 0)
    out = {
        "tumour_id": tumour_id,
        "n_clones": int(rng.choice(K_VALUES, p=K_PROBS)),
        "n_mutations": int(np.clip(10 ** rng.normal(*LOG10_MUT), *MUT_RANGE)),
        "n_samples": int(rng.choice([1, 2, 3], p=[0.5, 0.3, 0.2])),
        "purity": max(float(rng.beta(*PURITY_BETA)), PURITY_LEAST),
        "depth": int(np.clip(np.exp(rng.normal(*LOG_DEPTH)), *DEPTH_RANGE)),
        "seed": int(rng.integers(0, 2**31)),
    }
    ranges = {"overdispersion": (0.005, 0.05), "gc_bias": (0.1, 0.5), "strand_prob": (0.01, 0.10), "strand_size": (0.1, 0.5), "tail_shape": (0.8, 1.5), "cn_noise": (0.01, 0.05)}
    drawn = {k: float(rng.uniform(*v)) for k, v in ranges.items()}
    drawn["tail_frac"] = float(rng.choice([0.0, 0.1, 0.2, 0.3], p=[0.40, 0.25, 0.20, 0.15]))
    return out | {k: drawn[k] if noise else 0.0 for k in NOISE}


def params_table(spark: SparkSession, n: int, seed: int = 42, noise: bool = True) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pd.DataFrame([draw_params(int(i), seed, noise) for i in b["id"]])

    return spark.range(n).mapInPandas(run, PARAMS)


def cellularities(k: int, s: int, purity: float, rng: np.random.Generator) -> np.ndarray:
    """Clone 0 at the purity; the others below it by normalised gaps; other samples jittered."""
    first = np.full(k, purity)
    if k > 1:
        gaps = rng.beta(*GAP_BETA, size=k - 1)
        first[1:] = np.maximum(purity - np.cumsum(gaps / gaps.sum()) * purity * 0.85, 0.01)
    out = np.clip(first[:, None] + np.concatenate([np.zeros((k, 1)), rng.normal(0, 0.05, (k, s - 1))], 1), 0.01, purity)
    out[0] = purity
    return out


def clone_sizes(fractions: np.ndarray, total: int) -> np.ndarray:
    exact = fractions * total
    sizes = np.floor(exact).astype(int)
    sizes[np.argsort(-(exact - sizes), kind="stable")[: total - sizes.sum()]] += 1
    return sizes


def beta_binomial(n: np.ndarray, p: np.ndarray, rho: float, rng: np.random.Generator) -> np.ndarray:
    rho = float(np.clip(rho, 1e-6, 0.999))
    q = rng.beta(np.maximum(p * (1 - rho) / rho, 0.01), np.maximum((1 - p) * (1 - rho) / rho, 0.01))
    return rng.binomial(n.astype(int), np.clip(q, 0, 1)).astype(float)


def simulate_one(p: dict, fractions: np.ndarray | None = None, cn_profile: np.ndarray | None = None) -> pd.DataFrame:
    rng = _rng(p["seed"], p["tumour_id"], 1)
    k, n, s, purity = int(p["n_clones"]), int(p["n_mutations"]), int(p["n_samples"]), float(p["purity"])
    if fractions is not None and len(fractions) != k:
        raise ValueError("one fraction per clone is needed")
    if cn_profile is not None and len(cn_profile) != n:
        raise ValueError("one copy number per mutation is needed")
    centers = cellularities(k, s, purity, rng)
    fractions = rng.dirichlet(np.full(k, 2.0)) if fractions is None else np.asarray(fractions, float)
    label = np.repeat(np.arange(k), clone_sizes(fractions, n))
    cn = np.full(n, 2.0)
    if cn_profile is not None:
        cn = np.asarray(cn_profile, float).reshape(n, -1)[:, 0]
    else:
        where = rng.choice(n, max(1, int(rng.beta(*CNA_BETA) * n)), replace=False)
        _, mean, sd = PLOIDIES[rng.choice(len(PLOIDIES), p=[x[0] for x in PLOIDIES])]
        cn[where] = np.clip(np.round(rng.normal(mean, sd, len(where))), 1, 8)
    adj = np.repeat((2 / (purity * cn + (1 - purity) * 2))[:, None], s, 1)
    depth = rng.poisson(p["depth"], (n, s)).astype(float)
    if p["gc_bias"] > 0:
        wave = np.sin(np.linspace(0, rng.integers(2, 8) * np.pi, n))
        depth *= np.clip(1 + p["gc_bias"] * wave, 0.2, 3.0)[:, None]
    depth = np.maximum(np.round(depth), 1)
    if p["cn_noise"] > 0:
        adj = np.clip(adj + rng.normal(0, p["cn_noise"], adj.shape), *ADJ_RANGE)
    mu = np.clip(adj * centers[label], *VAF_RANGE)
    alt = beta_binomial(depth, mu, p["overdispersion"], rng) if p["overdispersion"] > 0 else rng.binomial(depth.astype(int), mu).astype(float)
    biased = rng.choice(n, int(p["strand_prob"] * n), replace=False)
    if len(biased):
        bias = rng.uniform(1 - p["strand_size"], 1 + p["strand_size"], (len(biased), s))
        alt[biased] = np.clip(np.round(alt[biased] * bias), 0, depth[biased])
    center = centers[label]
    if p["tail_frac"] > 0:
        m = max(1, int(p["tail_frac"] * n))
        low, high = TAIL_RANGE
        v = low * (high / low) ** (rng.random((m, 1)) ** (1 / p["tail_shape"]))
        d = np.maximum(rng.poisson(p["depth"], (m, s)), 1).astype(float)
        alt, depth, adj = np.concatenate([alt, rng.binomial(d.astype(int), np.repeat(v, s, 1))]), np.concatenate([depth, d]), np.concatenate([adj, np.ones((m, s))])
        label, cn, center = np.append(label, np.full(m, k)), np.append(cn, np.full(m, 2.0)), np.concatenate([center, np.full((m, s), np.nan)])
    return long(p["tumour_id"], alt, depth, adj, cn, label, center)


def long(tumour_id: int, alt, depth, adj, cn, label, center) -> pd.DataFrame:
    n, s = alt.shape
    each = lambda x: np.repeat(x, s)
    return pd.DataFrame({"tumour_id": tumour_id, "mut_id": each(np.arange(n)), "sample_id": np.tile([f"{i:03d}" for i in range(s)], n), "alt": alt.ravel(), "depth": depth.ravel(), "adj": adj.ravel(), "total_cn": each(cn), "true_k": each(label).astype(np.int32), "true_center": center.ravel()})


def simulate(params: DataFrame) -> DataFrame:
    """Observations with truth columns, one tumour per row of params."""

    def run(batches):
        for b in batches:
            for p in b.to_dict("records"):
                yield simulate_one(p)

    return params.mapInPandas(run, SIMULATED)


def true_tree(params: DataFrame) -> DataFrame:
    """A chain 0 -> 1 -> ...; none for one clone."""
    return params.where("n_clones > 1").select("tumour_id", F.explode(F.sequence(F.lit(0), F.col("n_clones") - 1)).alias("k")).select("tumour_id", "k", (F.col("k") - 1).alias("parent"))


def augment(simulated: DataFrame, rounds: int, seed: int = 42) -> DataFrame:
    """`rounds` variants of each tumour: depth rescaled, fractions jittered, counts drawn again, every fifth subsampled.
    Ids are tumour_id * (rounds + 1) + round; round 0 is the tumour itself."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mut_id", "sample_id"])
        n, s = rows["mut_id"].nunique(), rows["sample_id"].nunique()
        t = int(rows["tumour_id"].iloc[0])
        wide = lambda c: rows[c].to_numpy(float).reshape(n, s)
        adj, center = wide("adj"), wide("true_center")
        cn, label = wide("total_cn")[:, 0], rows["true_k"].to_numpy().reshape(n, s)[:, 0]
        tail = np.isnan(center[:, 0])
        purity = float(np.nanmax(center, initial=0.01))
        mean_depth = rows["depth"].mean()
        out = [rows.assign(tumour_id=t * (rounds + 1))]
        for r in range(1, rounds + 1):
            rng = _rng(seed, t, 100 + r)
            wave = 1 + rng.uniform(0.1, 0.5) * np.sin(np.linspace(0, rng.uniform(2, 8) * np.pi, n))
            depth = np.maximum(np.round(rng.poisson(np.clip(mean_depth * rng.uniform(0.5, 2.0), *DEPTH_RANGE), (n, s)) * wave[:, None]), 1)
            new_purity = float(np.clip(purity + rng.normal(0, 0.05), 0.10, 0.99))
            moved = np.clip(center * (new_purity / max(purity, 0.01)), 0.01, new_purity)
            factor = np.clip(adj + rng.normal(0, 0.03, adj.shape), *ADJ_RANGE)
            mu = np.clip(np.where(tail[:, None], 0.01, moved) * factor, *VAF_RANGE)
            alt = beta_binomial(depth, mu, rng.uniform(0.005, 0.05), rng)
            keep = np.arange(n)
            if rng.random() < 0.2:  # as from an exome
                keep = np.sort(rng.choice(n, min(n, max(50, int(n * rng.uniform(0.05, 0.3)))), replace=False))
            # clones that lost all mutations go; the tail stays behind the last clone
            own = np.where(tail, label.max() + 1, label)[keep]
            _, again = np.unique(own, return_inverse=True)
            out.append(long(t * (rounds + 1) + r, alt[keep], depth[keep], factor[keep], cn[keep], again, np.where(tail[:, None], np.nan, moved)[keep]))
        return pd.concat(out)

    return simulated.groupBy("tumour_id").applyInPandas(run, SIMULATED)


def generate_tumours(spark: SparkSession, path: str, n_tumours: int = 10_000, n_augmentations: int = 3, seed: int = 42) -> dict:
    """Writes params, tumours and a manifest; a manifest that is there already is returned as it is."""
    from clonal_spark.sources import observations as ob

    try:
        return ob.read_manifest(spark, f"{path}/manifest")
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    params = params_table(spark, n_tumours, seed)
    params.write.mode("overwrite").parquet(f"{path}/params")
    rows = simulate(spark.read.parquet(f"{path}/params"))
    ob.write_tumours(augment(rows, n_augmentations, seed) if n_augmentations else rows, f"{path}/tumours")
    facts = {"n_base": n_tumours, "n_augmentations": n_augmentations, "n_total": n_tumours * (n_augmentations + 1), "seed": seed, "simulator": "built-in"}
    ob.write_manifest(spark, f"{path}/manifest", **facts)
    return facts
