"""Single steps of a mixture fit over long tables. Observations are (tumour_id, mut_id, sample_id, alt, depth, adj)
and parameters (tumour_id, k, sample_id, center) with weights (tumour_id, k, log_pi).

Parameters are K rows per tumour and sample. One tumour's parameters are small; those of a cohort grow with it,
so the join is left to Catalyst, which broadcasts by size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonal_spark.functions import mathx as mx
from clonal_spark.operators.selection import exact_quantiles
from clonal_spark.plans.engines import HIGH, LOW, MERGE, PRUNE
from clonal_spark.session import Scratch

MUT = ["tumour_id", "mut_id"]


def vaf(alt: str = "alt", depth: str = "depth") -> Column:
    return F.col(alt) / F.greatest(F.col(depth), F.lit(1.0))


def ccf(v: Column, adj: Column) -> Column:
    return mx.clip(v / F.greatest(adj * 0.5, F.lit(1e-9)), 0.0, 2.0)


def quantile_init(obs: DataFrame, k: int) -> DataFrame:
    """Centers at the K interior quantiles of the observed frequency, per tumour and sample."""
    levels = F.array(*[F.lit(i / (k + 1)) for i in range(1, k + 1)])
    rows = obs.groupBy("tumour_id", "sample_id").agg(F.percentile(vaf(), levels).alias("q"))
    return rows.select("tumour_id", "sample_id", F.posexplode("q").alias("k", "center")).withColumn("center", mx.clip(F.col("center"), LOW, HIGH))


def log_likelihoods(obs: DataFrame, params: DataFrame, emission) -> DataFrame:
    """(tumour_id, mut_id, k, log_lik), summed over samples in their order. What a clone does not change is made before the join,
    in which a mutation is one row that meets all clones of its tumour."""
    clones = params.groupBy("tumour_id", "k").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", "center"))).alias("centers"))
    clones = clones.groupBy("tumour_id").agg(F.collect_list(F.struct("k", "centers")).alias("clones"))
    liks = F.transform(_met_clones(), lambda c: F.struct(c["k"].alias("k"), _log_lik(emission, c["centers"]).alias("log_lik")))
    return cells_of_mutations(obs, emission).join(clones, "tumour_id").select(*MUT, F.explode(liks).alias("l")).select(*MUT, "l.k", "l.log_lik")


def e_step(log_liks: DataFrame, weights: DataFrame) -> DataFrame:
    """(tumour_id, mut_id, k, log_r, r, ll): responsibilities by a softmax over k, and the mutation's log-likelihood."""
    own = Window.partitionBy(*MUT)
    rows = log_liks.join(weights, ["tumour_id", "k"]).withColumn("log_r", F.col("log_pi") + F.col("log_lik")).drop("log_pi", "log_lik")
    rows = rows.withColumn("top", F.max("log_r").over(own)).withColumn("e", F.exp(F.col("log_r") - F.col("top")))
    rows = rows.withColumn("total", F.sum("e").over(own))
    return rows.select(*MUT, "k", "log_r", (F.col("e") / F.col("total")).alias("r"), (F.col("top") + F.log("total")).alias("ll"))


def hard_assign(resp: DataFrame) -> DataFrame:
    """The clone of the largest responsibility; the first of equals."""
    best = F.max(F.struct("r", (-F.col("k")).alias("minus"))).alias("best")
    return resp.groupBy(*MUT).agg(best).select(*MUT, (-F.col("best.minus")).cast("int").alias("k"), F.col("best.r").alias("r"))


def m_step(obs: DataFrame, resp: DataFrame) -> DataFrame:
    """Centers from weighted counts; the adjustment factor takes no part."""
    met = obs.join(resp.select(*MUT, "k", "r"), MUT)
    sums = met.groupBy("tumour_id", "k", "sample_id").agg(F.sum(F.col("r") * F.col("alt")).alias("a"), F.sum(F.col("r") * F.col("depth")).alias("d"))
    return sums.select("tumour_id", "k", "sample_id", mx.clip(F.col("a") / F.greatest(F.col("d"), F.lit(1e-10)), LOW, HIGH).alias("center"))


def mixing_weights(resp: DataFrame) -> DataFrame:
    return resp.groupBy("tumour_id", "k").agg(F.log(F.greatest(F.avg("r"), F.lit(1e-10))).alias("log_pi"))


def uniform_weights(params: DataFrame) -> DataFrame:
    own = Window.partitionBy("tumour_id")
    return params.select("tumour_id", "k").distinct().withColumn("log_pi", -F.log(F.count("*").over(own).cast("double")))


def marginal_fit(resp: DataFrame, n_samples: Column) -> DataFrame:
    """(tumour_id, n_mut, n_clones, log_lik, bic) of one expectation step."""
    first = resp.groupBy(*MUT).agg(F.first("ll").alias("ll"), F.count("*").alias("n"))
    rows = first.groupBy("tumour_id").agg(F.count("*").alias("n_mut"), F.max("n").alias("n_clones"), F.sum("ll").alias("log_lik"))
    return rows.withColumn("bic", -2 * F.col("log_lik") + F.col("n_clones") * n_samples * F.log(F.greatest(F.col("n_mut"), F.lit(1)).cast("double")))


def elbo_terms(resp: DataFrame) -> DataFrame:
    """Expected log-joint and entropy of the responsibilities; the Dirichlet term needs K numbers and stays outside."""
    return resp.groupBy("tumour_id").agg(F.sum(F.col("r") * F.col("log_r")).alias("expected"), F.sum(-F.col("r") * F.log(F.greatest(F.col("r"), F.lit(1e-300)))).alias("entropy"))


def em_steps(obs: DataFrame, params: DataFrame, emission, steps: int) -> tuple[DataFrame, DataFrame]:
    """A few EM steps at a fixed K: (tumour_id, k, sample_id, center, log_pi) and the last responsibilities. A mutation is one row, written
    once, that meets all clones of its tumour; a step leaves sums for each clone and sample, which are written as the next step's start, so that
    no step is made twice (dense tables: a clone's mean responsibility is the same in each sample)."""
    scratch = Scratch(obs.sparkSession, "steps")
    cells = scratch.write(cells_of_mutations(obs, emission), "cells")
    state = scratch.write(params.join(uniform_weights(params), ["tumour_id", "k"]).select("tumour_id", "k", "sample_id", "center", "log_pi"), "state-0")
    resp = None
    for i in range(steps):
        clones = state.groupBy("tumour_id", "k").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", "center"))).alias("centers"), F.first("log_pi").alias("log_pi"))
        clones = clones.groupBy("tumour_id").agg(F.collect_list(F.struct("k", "centers", "log_pi")).alias("clones"))
        logs = F.transform(_met_clones(), lambda c: F.struct(c["k"].alias("k"), (_log_lik(emission, c["centers"]) + c["log_pi"]).alias("log_r")))
        rows = cells.join(clones, "tumour_id").select(*MUT, "cells", _bound(logs, _shares).alias("s"))
        resp = rows.select(*MUT, F.col("s.ll").alias("ll"), F.explode("s.rs").alias("c")).select(*MUT, "c.k", "c.log_r", "c.r", "ll")
        parts = rows.select("tumour_id", "cells", F.explode("s.rs").alias("c")).select("tumour_id", "c.k", "c.r", F.explode("cells").alias("x"))
        sums = parts.groupBy("tumour_id", "k", "x.sample_id").agg(F.sum(F.col("r") * F.col("x.alt")).alias("a"), F.sum(F.col("r") * F.col("x.depth")).alias("d"), F.avg("r").alias("share"))
        state = sums.select("tumour_id", "k", "sample_id", mx.clip(F.col("a") / F.greatest(F.col("d"), F.lit(1e-10)), LOW, HIGH).alias("center"), F.log(F.greatest(F.col("share"), F.lit(1e-10))).alias("log_pi"))
        state = scratch.write(state, f"state-{i + 1}")
    return state, resp


def _met_clones() -> Column:
    """The clones of a row that have a center in any of its samples."""
    return F.filter("clones", lambda c: F.exists("cells", lambda x: F.map_contains_key(c["centers"], x["sample_id"])))


def _shares(logs: Column) -> Column:
    """Responsibilities and log-likelihood of a mutation's clones (k, log_r)."""

    def divided(es: Column, top: Column) -> Column:
        total = F.aggregate(es, F.lit(0.0), lambda s, e: s + e)
        return _bound(total, lambda t: F.struct(F.zip_with(logs, es, lambda c, e: F.struct(c["k"].alias("k"), c["log_r"].alias("log_r"), (e / t).alias("r"))).alias("rs"), (top + F.log(t)).alias("ll")))

    return _bound(F.array_max(F.transform(logs, lambda c: c["log_r"])), lambda top: _bound(F.transform(logs, lambda c: F.exp(c["log_r"] - top)), lambda es: divided(es, top)))


def cells_of_mutations(obs: DataFrame, emission) -> DataFrame:
    """(tumour_id, mut_id, cells): a mutation's samples as one row, in their order. It is the only shuffle of observations that
    likelihoods need, however many clones there are."""
    cell = F.struct("sample_id", "alt", "depth", "adj", emission.fixed(F.col("alt"), F.col("depth")).alias("fixed"))
    spark = obs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # by number: few bytes are much work
    return obs.repartition(parts, *MUT).groupBy(*MUT).agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x made once: in functions of arrays, an expression is made anew wherever it stands."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _sum_by(key: str, value: str) -> Column:
    """The sum of a group's few values in the order of their keys, so that it is the same to the last bit in any order of rows."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(key, value))), F.lit(0.0), lambda s, x: s + x[value])


def _logsumexp(values: Column) -> Column:
    return _bound(values, lambda v: _bound(F.array_max(v), lambda top: top + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top)))))


def _log_lik(emission, centers: Column) -> Column:
    """A mutation's log-likelihood at a clone's centers (a map by sample), summed in the order of samples: equal clones stay equal to
    the last bit, so that ties go by the clone's number alone. Samples without a center take no part."""

    def add(total: Column, x: Column) -> Column:
        mean = x["adj"] * F.element_at(centers, x["sample_id"])
        return total + F.coalesce(_bound(mean, lambda mu: emission.log_prob(x["alt"], x["depth"], mu, x["fixed"])), F.lit(0.0))

    return F.aggregate("cells", F.lit(0.0), add)


def bic_sweep(obs: DataFrame, ks: list[int], emission) -> DataFrame:
    """(tumour_id, K, log_lik, bic) of one expectation step at uniform weights, all K in one plan. A mutation is one row that meets
    all clones of its tumour at once, and leaves one value for each K, so nothing of the size of mutations times clones is kept."""
    levels = sorted({i / (k + 1) for k in ks for i in range(1, k + 1)})
    at = {x: i for i, x in enumerate(levels)}
    quantiles = exact_quantiles(obs.withColumn("v", vaf()), ["tumour_id", "sample_id"], "v", levels)
    clone = lambda k: F.array(*[F.map_from_entries(F.transform("qs", lambda x: F.struct(x["sample_id"], mx.clip(F.get(x["q"], F.lit(at[i / (k + 1)])), LOW, HIGH)))) for i in range(1, k + 1)])
    found = quantiles.groupBy("tumour_id").agg(F.collect_list(F.struct("sample_id", "q")).alias("qs"))
    clones = found.select("tumour_id", F.size("qs").alias("n_samples"), F.array(*map(clone, ks)).alias("sweeps"))
    lls = F.transform("sweeps", lambda cs: _logsumexp(F.transform(cs, lambda c: _log_lik(emission, c))) - F.log(F.size(cs).cast("double")))
    met = cells_of_mutations(obs, emission).join(clones, "tumour_id").select("tumour_id", "n_samples", lls.alias("lls"))
    sums = [F.sum(F.get("lls", F.lit(i))).alias(f"ll{i}") for i in range(len(ks))]
    rows = met.groupBy("tumour_id", "n_samples").agg(F.count("*").alias("n"), *sums)
    rows = rows.select("tumour_id", "n_samples", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("K"), F.col(f"ll{i}").alias("log_lik")) for i, k in enumerate(ks)])).alias("f"))
    return rows.select("tumour_id", "f.K", "f.log_lik", (-2 * F.col("f.log_lik") + F.col("f.K") * F.col("n_samples") * F.log(F.col("n").cast("double"))).alias("bic"))


def least_bic(fits: DataFrame) -> DataFrame:
    """The fit of the least BIC of each tumour; the least K of equals."""
    others = [F.col(c) for c in fits.columns if c not in ("tumour_id", "K", "bic")]
    best = fits.groupBy("tumour_id").agg(F.min(F.struct("bic", "K", *others)).alias("b"))
    return best.select("tumour_id", *[F.col(f"b.{c}").alias(c) for c in fits.columns if c != "tumour_id"])


def merge_places(centers: DataFrame, tol: float = MERGE) -> DataFrame:
    """(tumour_id, k, place): each clone's representative, the first one, itself a representative, that is within tol in
    every sample. Clones 0..K-1 of a tumour are one row; the data take no part."""
    vectors = centers.groupBy("tumour_id", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample_id", "center"))), lambda c: c["center"]).alias("c"))
    rows = vectors.groupBy("tumour_id").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("v"))
    far = lambda i, j: F.array_max(F.zip_with(F.col("v")[i]["c"], F.col("v")[j]["c"], lambda a, b: F.abs(a - b)))
    first = lambda places, j: F.get(F.array_compact(F.transform(places, lambda p, i: F.when((p == i) & (far(i, j) < tol), p))), F.lit(0))
    places = F.aggregate(F.sequence(F.lit(0), F.size("v") - 1), F.array().cast("array<int>"), lambda acc, j: F.concat(acc, F.array(F.coalesce(first(acc, j), j))))
    return rows.select("tumour_id", "v", F.posexplode(places).alias("j", "p")).select("tumour_id", F.col("v")[F.col("j")]["k"].alias("k"), F.col("v")[F.col("p")]["k"].alias("place"))


def merge_and_prune(centers: DataFrame, resp: DataFrame, least: float = PRUNE, tol: float = MERGE) -> tuple[DataFrame, DataFrame]:
    """Clones after merging and pruning (tumour_id, sample_id, k, place, share, center), numbered anew, and responsibilities
    over them (tumour_id, mut_id, k, r). A merged center is weighed by mass; clones below the share `least` go, unless all
    are, then the largest stays."""
    places = merge_places(centers, tol)
    mass = resp.groupBy("tumour_id", "k").agg(F.sum("r").alias("mass"))
    members = places.join(mass, ["tumour_id", "k"], "left").withColumn("mass", F.greatest(F.coalesce("mass", F.lit(0.0)), F.lit(1e-300)))
    own = Window.partitionBy("tumour_id")
    totals = members.groupBy("tumour_id", "place").agg(F.sum("mass").alias("total")).withColumn("share", F.col("total") / F.sum("total").over(own))
    rank = F.row_number().over(own.orderBy(F.desc("share"), "place"))
    kept = totals.withColumn("rank", rank).where((F.col("share") >= least) | (F.col("rank") == 1))
    # the largest always passes where any does
    kept = kept.withColumn("new", (F.row_number().over(own.orderBy("place")) - 1).cast("int")).select("tumour_id", "place", "share", "new")
    weighed = members.join(centers, ["tumour_id", "k"]).groupBy("tumour_id", "place", "sample_id").agg((F.sum(F.col("mass") * F.col("center")) / F.sum("mass")).alias("center"))
    clones = weighed.join(kept, ["tumour_id", "place"]).select("tumour_id", "sample_id", F.col("new").alias("k"), "place", "share", mx.clip(F.col("center"), LOW, HIGH).alias("center"))
    moved = resp.select(*MUT, "k", "r").join(places, ["tumour_id", "k"]).join(kept.select("tumour_id", "place", "new"), ["tumour_id", "place"]).groupBy(*MUT, F.col("new").alias("k")).agg(_sum_by("k", "r").alias("r"))
    return clones, moved.withColumn("r", F.col("r") / F.greatest(F.sum("r").over(Window.partitionBy(*MUT)), F.lit(1e-300)))


def dirichlet_update(resp: DataFrame, alpha0: float = 1.0) -> DataFrame:
    """(tumour_id, k, alpha, expected_log_pi) after a variational step."""
    rows = resp.groupBy("tumour_id", "k").agg((F.sum("r") + alpha0).alias("alpha"))
    total = F.sum("alpha").over(Window.partitionBy("tumour_id"))
    return rows.withColumn("total", total).select("tumour_id", "k", "alpha", (mx.digamma(F.col("alpha")) - mx.digamma(F.col("total"))).alias("expected_log_pi"))


def dirichlet_kl(alphas: DataFrame, alpha0: float = 1.0) -> DataFrame:
    """(tumour_id, kl) of (tumour_id, k, alpha) against a symmetric Dirichlet prior."""
    total = F.sum("alpha").over(Window.partitionBy("tumour_id"))
    prior = mx.lgamma(F.lit(float(alpha0)))
    term = (F.col("alpha") - alpha0) * (mx.digamma(F.col("alpha")) - mx.digamma(F.col("total"))) - mx.lgamma(F.col("alpha")) + prior
    rows = alphas.withColumn("total", total).groupBy("tumour_id").agg(F.first("total").alias("total"), F.count("*").alias("n"), F.sum(term).alias("terms"))
    return rows.select("tumour_id", (mx.lgamma(F.col("total")) - mx.lgamma(F.col("n") * float(alpha0)) + F.col("terms")).alias("kl"))


def stick_weights(sticks: DataFrame) -> DataFrame:
    """(tumour_id, k, v) to normalised weights v_k * prod_{j < k} (1 - v_j), in the order of k."""
    before = Window.partitionBy("tumour_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    raw = sticks.withColumn("w", F.col("v") * F.exp(F.coalesce(F.sum(F.log1p(-F.col("v"))).over(before), F.lit(0.0))))
    return raw.select("tumour_id", "k", (F.col("w") / F.sum("w").over(Window.partitionBy("tumour_id"))).alias("weight"))
