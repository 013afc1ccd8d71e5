"""Scores of fits against truth, and evaluation of routing. Labels are (tumour_id, mut_id, true_k, est_k); clones of
truth are 0..n_true - 1, larger labels are tail, an estimate of -1 is filtered. Scores lie in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonal_spark.operators.scan import final_average, running_sum

KEY = ["tumour_id"]


def valid_pairs(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("est_k") >= 0) & (F.col("true_k") < F.col("n_true")))


def contingency(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*KEY, "true_k", "est_k").agg(F.count("*").alias("n"))


def _xlogx(p: Column) -> Column:
    return p * F.log(p + 1e-15)


def v_measure(labels: DataFrame) -> DataFrame:
    """(tumour_id, v_measure): harmonic mean of homogeneity and completeness, from the contingency counts."""
    cells = contingency(labels)
    true = cells.groupBy(*KEY, "true_k").agg(F.sum("n").alias("n_true_k"))
    est = cells.groupBy(*KEY, "est_k").agg(F.sum("n").alias("n_est_k"))
    total = cells.groupBy(*KEY).agg(F.sum("n").alias("total"))
    met = cells.join(true, [*KEY, "true_k"]).join(est, [*KEY, "est_k"]).join(total, KEY)
    given = met.groupBy(*KEY).agg(
        F.sum(-F.col("n_est_k") / F.col("total") * _xlogx(F.col("n") / F.col("n_est_k"))).alias("h_true_est"),
        F.sum(-F.col("n_true_k") / F.col("total") * _xlogx(F.col("n") / F.col("n_true_k"))).alias("h_est_true"),
    )
    entropy = lambda t, c, name: t.join(total, KEY).groupBy(*KEY).agg(F.sum(-_xlogx(F.col(c) / F.col("total"))).alias(name), F.count("*").alias(f"n_{name}"))
    rows = given.join(entropy(true, "n_true_k", "h_true"), KEY).join(entropy(est, "n_est_k", "h_est"), KEY)
    hom = 1 - F.col("h_true_est") / F.when(F.col("n_h_true") > 1, F.col("h_true"))
    com = F.coalesce(1 - F.col("h_est_true") / F.when(F.col("n_h_est") > 1, F.col("h_est")), F.lit(1.0))
    v = F.when(F.col("n_h_true") <= 1, F.lit(1.0)).when(hom + com == 0, F.lit(0.0)).otherwise(2 * hom * com / F.when(hom + com != 0, hom + com))
    return rows.select(*KEY, v.alias("v_measure"))


def sc1a(centers: DataFrame, truth: DataFrame) -> DataFrame:
    """Purity: distance of the largest center."""
    return centers.groupBy(*KEY).agg(F.max("center").alias("top")).join(truth, KEY).select(*KEY, F.greatest(F.lit(0.0), 1 - F.abs(F.col("top") - F.col("purity"))).alias("score"))


def sc1b(labels: DataFrame, true_centers: DataFrame, est_centers: DataFrame) -> DataFrame:
    """Fractions: per sample 1 - RMSE of the centers that valid mutations are assigned to, averaged."""
    true = true_centers.select(*KEY, F.col("k").alias("true_k"), "sample_id", F.col("center").alias("c"))
    est = est_centers.select(*KEY, F.col("k").alias("est_k"), "sample_id", F.col("center").alias("e"))
    # mutations count by label pair, so the joins are with pairs of clones, not with mutations
    met = contingency(valid_pairs(labels)).join(true, [*KEY, "true_k"]).join(est, [*KEY, "est_k", "sample_id"])
    one = met.groupBy(*KEY, "sample_id").agg(F.greatest(F.lit(0.0), 1 - F.sqrt(F.sum(F.col("n") * F.pow(F.col("c") - F.col("e"), F.lit(2))) / F.sum("n"))).alias("s"))
    return one.groupBy(*KEY).agg(F.avg("s").alias("score"))


def sc2a(true_k: Column, est_k: Column) -> Column:
    """Clone number; 0 without clones."""
    return F.when(est_k <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(true_k - est_k) / F.greatest(true_k, est_k)))


def sc3(true_tree: DataFrame, est_tree: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges found. sizes: (tumour_id, true_k, est_k, has_true, has_est). Without an estimated tree, or with another
    number of clones, half the clone-number score."""
    hits = true_tree.where("parent >= 0").join(est_tree.where("parent >= 0").select(*KEY, "k", F.col("parent").alias("est_parent")), [*KEY, "k"], "left")
    found = hits.groupBy(*KEY).agg(F.count("*").alias("edges"), F.sum((F.col("parent") == F.col("est_parent")).cast("int")).alias("right"))
    part = F.greatest(F.lit(0.0), 0.5 * (1 - F.abs(F.col("true_k") - F.col("est_k")) / F.greatest("true_k", "est_k", F.lit(1))))
    score = (
        F.when(~F.col("has_est") & ~F.col("has_true"), F.lit(1.0))
        .when(~F.col("has_est"), part)
        .when(~F.col("has_true"), F.lit(0.0))
        .when(F.col("true_k") != F.col("est_k"), part)
        .otherwise(F.coalesce("right", F.lit(0)) / F.greatest(F.coalesce("edges", F.lit(0)), F.lit(1)))
    )
    return sizes.join(found, KEY, "left").select(*KEY, score.cast("double").alias("score"))


# --- routing: corpus rows are (tumour_id, sc, config, config_idx, score) ---


def oracle_regret(corpus: DataFrame, selected: DataFrame) -> DataFrame:
    """Mean of best minus selected score; a selection that was never scored counts 0."""
    group = [*KEY, "sc"]
    best = corpus.groupBy(*group).agg(F.max("score").alias("best"))
    got = corpus.select(*group, F.col("config").alias("selected"), "score")
    rows = best.join(selected, group, "left").join(got, [*group, "selected"], "left")
    return rows.agg(F.avg(F.col("best") - F.coalesce("score", F.lit(0.0))).alias("regret"), F.count("*").alias("n"))


def routing_gain(corpus: DataFrame, selected: DataFrame, baseline: str) -> DataFrame:
    group = [*KEY, "sc"]
    got = corpus.select(*group, F.col("config").alias("selected"), "score")
    base = corpus.where(F.col("config") == baseline).select(*group, F.col("score").alias("base"))
    rows = corpus.select(*group).distinct().join(selected, group, "left").join(got, [*group, "selected"], "left").join(base, group, "left")
    return rows.agg(F.avg(F.coalesce("score", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))).alias("gain"), F.count("*").alias("n"))


def best_config(corpus: DataFrame) -> DataFrame:
    """The best configuration of each (tumour, sc); the first of equals."""
    top = F.max(F.struct("score", (-F.col("config_idx")).alias("minus"), "config")).alias("t")
    return corpus.groupBy(*KEY, "sc").agg(top).select(*KEY, "sc", F.col("t.config").alias("config"), F.col("t.score").alias("score"))


def eliminated(pilot: DataFrame, margin: float = 0.25, n_sc: int = 5) -> DataFrame:
    """Tumours whose best pilot score exceeds 0.5 + margin in every subchallenge: their other configurations are skipped."""
    best = pilot.groupBy(*KEY, "sc").agg(F.max("score").alias("best"))
    return best.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("best").alias("least")).where((F.col("n") == n_sc) & (F.col("least") > 0.5 + margin)).select(*KEY, "least")


def selection_counts(selected: DataFrame, names: list[str]) -> DataFrame:
    """Counts of each (sc, config), zeros included. names: the configurations, a short list."""
    every = selected.select("sc").distinct().select("sc", F.explode(F.array(*map(F.lit, names))).alias("config"))
    counts = selected.groupBy("sc", F.col("selected").alias("config")).agg(F.count("*").alias("n"))
    return every.join(counts, ["sc", "config"], "left").select("sc", "config", F.coalesce("n", F.lit(0)).alias("n"))


def score_distribution(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n"))


def uncertainty_quartiles(rows: DataFrame, by: list[str], uncertainty: str = "uncertainty", score: str = "score", tie: str = "tumour_id") -> DataFrame:
    """Mean score by quarter of the rising uncertainty; quarters end at q * n // 4. Groups of fewer than 4 rows give none.
    Quarters are of one evaluation group (a report over one subchallenge)."""
    own = Window.partitionBy(*by)
    at = F.row_number().over(own.orderBy(uncertainty, tie)) - 1
    ranked = rows.withColumn("at", at).withColumn("n", F.count("*").over(own)).where("n >= 4")
    quarter = sum((F.col("at") >= F.floor(F.lit(q) * F.col("n") / 4)).cast("int") for q in (1, 2, 3))
    return ranked.withColumn("quarter", quarter).groupBy(*by, "quarter").agg(F.avg(score).alias("mean_score"), F.avg(uncertainty).alias("mean_uncertainty"), F.count("*").alias("n"))


def running_regret(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Cumulative sums of `regret` in the order of a stream (one stream per group), by a scan over ranges of it."""
    return running_sum(rows, by, order, "regret", "cumulative")


def reward_average(rows: DataFrame, by: list[str], order: list[str], keep: float = 0.99) -> DataFrame:
    """(by, average, n): the exponential average that a stream of `reward` ends with, from 0 on, by a scan over ranges of it."""
    return final_average(rows, by, order, "reward", keep)


def allocate(sizes: DataFrame) -> DataFrame:
    """(tumour_id, k, fraction, total) to whole clone sizes: floors, then one more each to the largest remainders."""
    own = Window.partitionBy(*KEY)
    exact = F.col("fraction") * F.col("total")
    rows = sizes.withColumn("whole", F.floor(exact).cast("long")).withColumn("rest", exact - F.floor(exact))
    left = F.col("total") - F.sum("whole").over(own)
    place = F.row_number().over(own.orderBy(F.desc("rest"), "k"))
    return rows.withColumn("left", left).withColumn("place", place).select(*KEY, "k", (F.col("whole") + (F.col("place") <= F.col("left")).cast("long")).alias("size"))
