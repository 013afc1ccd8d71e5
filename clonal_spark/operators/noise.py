"""Noise operators over long tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonal_spark.functions import mathx as mx
from clonal_spark.operators.mixture import MUT, vaf
from clonal_spark.plans.engines import VAF_FLOOR


def beta_logpdf(v: Column, a: Column, b: Column) -> Column:
    return (a - 1) * F.log(v) + (b - 1) * F.log(1 - v) - (mx.lgamma(a) + mx.lgamma(b) - mx.lgamma(a + b))


def _tail_terms(obs: DataFrame, phi: float | None) -> DataFrame:
    """Adds v, mu and phi (None: by moments), per tumour and sample. One aggregate per (tumour, sample), joined back."""
    rows = obs.withColumn("v", mx.clip(vaf(), VAF_FLOOR, 1 - VAF_FLOOR))
    groups = rows.groupBy("tumour_id", "sample_id").agg(F.percentile("v", 0.5).alias("median"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    mean = mx.clip(F.col("mean"), 0.01, 0.99)
    spread = mean * (1 - mean)
    moments = F.when((F.col("var") <= 0) | (F.col("var") >= spread), F.lit(50.0)).otherwise(mx.clip(spread / F.col("var") - 1, 1.0, 1000.0))
    groups = groups.select("tumour_id", "sample_id", mx.clip(F.col("median"), 0.05, 0.95).alias("mu"), (moments if phi is None else F.lit(float(phi))).alias("phi"))
    return rows.join(groups, ["tumour_id", "sample_id"])


def tail_log_odds(obs: DataFrame, phi: float | None = None) -> DataFrame:
    """Adds odds: the logarithm of tail over body at equal weights."""
    tail = -F.log("v") - math.log(-math.log(VAF_FLOOR))
    return _tail_terms(obs, phi).withColumn("odds", tail - beta_logpdf(F.col("v"), F.col("mu") * F.col("phi"), (1 - F.col("mu")) * F.col("phi"))).drop("v", "mu", "phi")


def tail_probability(obs: DataFrame, phi: float | None = None, tau: float = 0.1) -> DataFrame:
    """Adds p_tail. phi None: by moments, per tumour and sample."""
    met = _tail_terms(obs, phi)
    tail = -F.log("v") - math.log(-math.log(VAF_FLOOR)) + math.log(tau)
    body = beta_logpdf(F.col("v"), F.col("mu") * F.col("phi"), (1 - F.col("mu")) * F.col("phi")) + math.log(1 - tau)
    return met.withColumn("p_tail", F.exp(tail - mx.logaddexp(tail, body))).drop("v", "mu", "phi")


def tail_weights(obs: DataFrame, steps: int, phi: float | None = None, tau: float = 0.1) -> DataFrame:
    """(tumour_id, sample_id, tau) after some expectation steps of the tail's weight, from tau on."""
    odds = tail_log_odds(obs, phi).select("tumour_id", "sample_id", "odds")
    weights = odds.select("tumour_id", "sample_id").distinct().withColumn("tau", F.lit(float(tau)))
    for _ in range(steps):
        posterior = 1 / (1 + F.exp(-(F.col("odds") + F.log(F.col("tau") / (1 - F.col("tau"))))))
        weights = odds.join(weights, ["tumour_id", "sample_id"]).groupBy("tumour_id", "sample_id").agg(mx.clip(F.avg(posterior), 1e-6, 1 - 1e-6).alias("tau"))
    return weights


def tail_mask(obs: DataFrame, threshold: float = 0.5, phi: float | None = None, tau: float = 0.1) -> DataFrame:
    """(tumour_id, mut_id, kept): out if any sample's p_tail exceeds the threshold, unless fewer than two would stay."""
    return mask_of(tail_probability(obs, phi, tau), threshold)


def mask_of(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tail_mask of cells with p_tail."""
    muts = cells.groupBy(*MUT).agg(F.bool_and(F.col("p_tail") <= threshold).alias("stays"))
    kept = F.sum(F.col("stays").cast("int")).over(Window.partitionBy("tumour_id"))
    return muts.select(*MUT, (F.col("stays") | (kept < 2)).alias("kept"))


def expand(muts: DataFrame, assigned: DataFrame) -> DataFrame:
    """Filtered mutations come back with clone -1."""
    return muts.select(*MUT).join(assigned, MUT, "left").withColumn("k", F.coalesce("k", F.lit(-1)))


def multiplicity_adj(obs: DataFrame, purity: float = 1.0) -> DataFrame:
    """adj by the multiplicity m in 1..total_cn whose implied fraction is nearest to 1; no shuffle."""
    bottom = F.col("total_cn") * purity + 2 * (1 - purity)
    options = F.transform(F.sequence(F.lit(1), F.greatest(F.floor("total_cn").cast("int"), F.lit(1))), lambda m: F.struct(F.abs(vaf() / (m / bottom) - 1).alias("off"), m.alias("m"), (m / bottom).alias("adj")))
    return obs.withColumn("adj", F.when(F.col("total_cn") >= 1, F.array_min(options)["adj"]).otherwise(F.col("adj")))


def presence_partners(centers: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(tumour_id, k, nestable): whether another clone's presence pattern holds or is held by this one's.
    Pairs are of clones of one tumour, K * K rows each."""
    there = centers.select("tumour_id", "k", "sample_id", (F.col("center") > threshold).alias("here"))
    pairs = there.join(there.select("tumour_id", F.col("k").alias("other"), "sample_id", F.col("here").alias("there")), ["tumour_id", "sample_id"])
    fits = pairs.groupBy("tumour_id", "k", "other").agg((F.bool_and(~F.col("here") | F.col("there")) | F.bool_and(~F.col("there") | F.col("here"))).alias("fits"))
    return fits.groupBy("tumour_id", "k").agg(F.coalesce(F.bool_or(F.when(F.col("k") != F.col("other"), F.col("fits"))), F.lit(False)).alias("nestable"))


def reassign(resp: DataFrame, partners: DataFrame) -> DataFrame:
    """Assignments over nestable clones only; if there is none, over all."""
    some = F.bool_or("nestable").over(Window.partitionBy("tumour_id"))
    valid = partners.withColumn("some", some).where("nestable OR NOT some").select("tumour_id", "k")
    best = F.max(F.struct("r", (-F.col("k")).alias("minus"))).alias("best")
    return resp.join(valid, ["tumour_id", "k"]).groupBy(*MUT).agg(best).select(*MUT, (-F.col("best.minus")).cast("int").alias("k"))


