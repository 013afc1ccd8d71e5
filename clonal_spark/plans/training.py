"""Corpora for the router: fits of (tumour, configuration) tasks, their scores, pilots and elimination."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonal_spark.config import CONFIG_NAMES, CONFIGS
from clonal_spark.operators import features as fe
from clonal_spark.operators import scoring as sg
from clonal_spark.plans import engines as en
from clonal_spark.plans.model import dense
from clonal_spark.plans.router import SC_NAMES, active_configs
from clonal_spark.session import Scratch
from clonal_spark.sources.observations import todo

SCORES = "tumour_id long, config string, sc string, score double"
PILOTS = ("quantumclone_v1", "pyclone_vi", "mobster")


def np_v_measure(true: np.ndarray, est: np.ndarray) -> float:
    if not len(true):
        return 0.0
    t, e = (np.unique(x, return_inverse=True)[1] for x in (true, est))
    table = np.zeros((t.max() + 1, e.max() + 1))
    np.add.at(table, (t, e), 1)
    if table.shape[0] == 1:
        return 1.0
    joint, n = table / table.sum(), len(true)
    rows, cols = joint.sum(1), joint.sum(0)
    h = lambda p: float(-(p * np.log(p + 1e-15)).sum())
    given = lambda tab, weights: sum(w * h(x / x.sum()) for x, w in zip(tab, weights, strict=True))
    hom = 1 - given(joint.T, cols) / h(rows)
    com = 1 - given(joint, rows) / h(cols) if len(cols) > 1 else 1.0
    return 0.0 if hom + com == 0 or not n else 2 * hom * com / (hom + com)


def score_fit(fit: en.Fit, true_k: np.ndarray, true_centers: np.ndarray, purity: float) -> dict[str, float]:
    """All five scores. true_k: labels (clones, then tail); true_centers: (clones, samples); the true tree is a chain."""
    n_true = len(true_centers)
    valid = (fit.assignments >= 0) & (true_k < n_true)
    t, e = true_k[valid], fit.assignments[valid]
    k_score = 1 - abs(n_true - fit.k) / max(n_true, fit.k, 1)
    out = {"SC1A": max(0.0, 1 - abs(float(fit.centers.max()) - purity)), "SC2A": max(0.0, k_score) if fit.k > 0 else 0.0, "SC1B": 0.0, "SC2B": 0.0}
    if len(t):
        rmse = np.sqrt(((true_centers[t] - fit.centers[e]) ** 2).mean(0))
        out["SC1B"], out["SC2B"] = float(np.maximum(0, 1 - rmse).mean()), np_v_measure(t, e)
    if fit.parents is None:
        out["SC3"] = 1.0 if n_true == 1 else max(0.0, 0.5 * k_score)
    elif n_true == 1:
        out["SC3"] = 0.0
    elif n_true != fit.k:
        out["SC3"] = max(0.0, 0.5 * k_score)
    else:
        out["SC3"] = float((fit.parents[1:] == np.arange(n_true - 1)).sum()) / (n_true - 1)
    return out


def score_tasks(obs: DataFrame, tasks: DataFrame, seed: int = 0) -> DataFrame:
    """tasks: (tumour_id, config). One group per task: a fit and five scores; a fit that fails scores 0 and leaves its message in `error`."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        t, name = int(rows["tumour_id"].iloc[0]), rows["config"].iloc[0]
        _, j, names, a = dense(rows)
        one = rows.sort_values(["mut_id", "sample_id"]).drop_duplicates("mut_id")
        label = one["true_k"].to_numpy()
        clones = rows.dropna(subset=["true_center"]).pivot_table(index="true_k", columns="sample_id", values="true_center").to_numpy()
        try:
            fit = en.fit_arrays(CONFIGS[name], a["alt"], a["depth"], a["adj"], a["total_cn"], seed)
            found, error = score_fit(fit, label, clones, float(clones.max())), None
        except Exception as e:  # noqa: BLE001  one failed fit must not end a cohort's run
            found, error = dict.fromkeys(SC_NAMES, 0.0), f"{type(e).__name__}: {e}"
        return pd.DataFrame({"tumour_id": t, "config": name, "sc": list(found), "score": list(found.values()), "error": error})

    return obs.join(tasks, "tumour_id").groupBy("tumour_id", "config").applyInPandas(run, f"{SCORES}, error string")


def tasks_of(obs: DataFrame, configs: list[str]) -> DataFrame:
    return obs.select("tumour_id").distinct().select("tumour_id", F.explode(F.array(*map(F.lit, configs))).alias("config"))


def score_tumours(obs: DataFrame, done: DataFrame | None = None, margin: float | None = 0.25, pilots=PILOTS, exclude=None) -> DataFrame:
    """Scores of all active configurations (tumour_id, config, sc, score, eliminated). Pilots run first; where they do
    well in every subchallenge the others are skipped and marked. done: scores to resume from."""
    names = active_configs() if exclude is None else active_configs(exclude)
    pilot_names = [c for c in names if c in pilots]
    fresh = lambda tasks: tasks if done is None else todo(tasks, done)
    pilot = score_tasks(obs, fresh(tasks_of(obs, pilot_names)))
    if done is not None:
        pilot = pilot.unionByName(done.where(F.col("config").isin(pilot_names)).select("tumour_id", "config", "sc", "score"), allowMissingColumns=True)
    pilot = Scratch(obs.sparkSession, "pilots").write(pilot, "scores")
    others = tasks_of(obs, [c for c in names if c not in pilot_names])
    out = sg.eliminated(pilot, margin).select("tumour_id") if margin is not None else None
    rest = others if out is None else others.join(out, "tumour_id", "left_anti")
    scored = score_tasks(obs, fresh(rest))
    if done is not None:
        scored = scored.unionByName(done.where(~F.col("config").isin(pilot_names)).select("tumour_id", "config", "sc", "score"), allowMissingColumns=True)
    rows = pilot.unionByName(scored).withColumn("eliminated", F.lit(False))
    if out is not None:
        skipped = others.join(out, "tumour_id", "left_semi").select("tumour_id", "config", F.explode(F.array(*map(F.lit, SC_NAMES))).alias("sc")).withColumns({"score": F.lit(0.0), "eliminated": F.lit(True)})
        rows = rows.unionByName(skipped, allowMissingColumns=True)
    return rows


SCORE_KEY = ["tumour_id", "config", "sc"]


def stored_scores(spark: SparkSession, path: str) -> DataFrame:
    """The scores of a log, one of each key: one that was skipped at first and scored later counts as scored."""
    rows = spark.read.schema(f"{SCORES}, error string, eliminated boolean").parquet(path)
    best = F.min(F.struct("eliminated", "score", "error")).alias("b")
    return rows.groupBy(*SCORE_KEY).agg(best).select(*SCORE_KEY, "b.score", "b.error", "b.eliminated")


def score_logged(obs: DataFrame, path: str, margin: float | None = 0.25, tumours: int = 500) -> DataFrame:
    """Scores all tumours into a log at path, about `tumours` of them at a time. Each batch appends its new scores in one
    write, so a run that is killed and started again goes on behind the last batch; scores that are stored are not made
    again, and running twice adds nothing."""
    spark = obs.sparkSession
    batches = max(1, -(-obs.select("tumour_id").distinct().count() // tumours))
    empty = spark.createDataFrame([], f"{SCORES}, error string, eliminated boolean")
    empty.write.mode("append").parquet(path)  # so that the log can be read from the first batch on
    for b in range(batches):
        part = obs.where(F.pmod(F.xxhash64("tumour_id"), F.lit(batches)) == b)
        stored = stored_scores(spark, path)
        made = score_tumours(part, stored.where("NOT eliminated").join(part.select("tumour_id").distinct(), "tumour_id", "left_semi").select(*SCORE_KEY, "score"), margin)
        new = made.join(stored.select(*SCORE_KEY, "eliminated"), [*SCORE_KEY, "eliminated"], "left_anti")
        new.select(*SCORE_KEY, "score", "error", "eliminated").write.mode("append").parquet(path)
    return stored_scores(spark, path)


def assemble_corpus(obs: DataFrame, scores: DataFrame) -> DataFrame:
    """(tumour_id, features, sc, config, score): tumours with scores; unknown and skipped configurations are left out."""
    kept = scores.where(F.col("config").isin(CONFIG_NAMES))
    if "eliminated" in scores.columns:
        kept = kept.where("NOT eliminated")
    return fe.as_vector(fe.meta_features(obs)).join(kept, "tumour_id").select("tumour_id", "features", "sc", "config", F.coalesce("score", F.lit(0.0)).alias("score"))


def split(ids: DataFrame, share: float, seed: int) -> DataFrame:
    """Adds `first`: a seeded share of tumours, by hash, so that a split needs no sort."""
    return ids.withColumn("first", F.pmod(F.xxhash64(F.lit(seed), "tumour_id"), F.lit(1_000_000)) < int(share * 1_000_000))
