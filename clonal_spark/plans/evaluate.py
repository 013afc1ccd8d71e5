"""Evaluation of a router: regret, gain, distributions, calibration, attributions, and a report of them."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonal_spark.config import CONFIG_NAMES
from clonal_spark.operators import plots as pl
from clonal_spark.operators import scoring as sg
from clonal_spark.plans.auto import explain_table
from clonal_spark.plans.router import SC_NAMES, MetaRouter


def selections(router: MetaRouter, corpus: DataFrame) -> DataFrame:
    return router.select_table(corpus.select("tumour_id", "features").dropDuplicates(["tumour_id"]))


def cumulative_regret(router: MetaRouter, corpus: DataFrame) -> list[float]:
    """Regret of an exploring router that learns between rows of the stream (tumour_id, sc in order). The posterior of one
    row depends on all before it, so rows pass the driver one group at a time; only the heads are kept."""
    scores = F.map_from_entries(F.collect_list(F.struct("config", "score")))
    groups = corpus.groupBy("tumour_id", "sc").agg(F.first("features").alias("features"), scores.alias("scores")).orderBy("tumour_id", "sc")
    out, total = [], 0.0
    for r in groups.toLocalIterator():
        x = np.asarray(r.features)
        chosen = router.predict(x, r.sc, explore=True)
        seen = r.scores.get(chosen, 0.0)
        router.update(x, chosen, r.sc, seen)
        total += max(r.scores.values()) - seen
        out.append(total)
    return out


def report(router: MetaRouter, corpus: DataFrame, baseline: str = "quantumclone_v1") -> dict:
    """All tables of an evaluation, as small aggregates."""
    chosen = selections(router, corpus).persist()
    picked = chosen.select("tumour_id", "sc", "selected")
    best = sg.best_config(corpus.withColumn("config_idx", F.array_position(F.array(*map(F.lit, CONFIG_NAMES)), F.col("config")) - 1))
    got = picked.join(corpus.select("tumour_id", "sc", F.col("config").alias("selected"), "score"), ["tumour_id", "sc", "selected"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    quarters = sg.uncertainty_quartiles(got.join(chosen.select("tumour_id", "sc", "uncertainty"), ["tumour_id", "sc"]), ["sc"])
    rows = lambda df: [r.asDict() for r in df.collect()]
    out = {
        "regret": rows(sg.oracle_regret(corpus, picked))[0],
        "gain": rows(sg.routing_gain(corpus, picked, baseline))[0],
        "selection_counts": rows(sg.selection_counts(picked, CONFIG_NAMES).orderBy("sc", "config")),
        "router_scores": rows(sg.score_distribution(got, ["sc"]).orderBy("sc")),
        "oracle_scores": rows(sg.score_distribution(best, ["sc"]).orderBy("sc")),
        "uncertainty_quartiles": rows(quarters.orderBy("sc", "quarter")),
        "attributions": {s: rows(attributions(router, corpus, s)) for s in SC_NAMES},
    }
    chosen.unpersist()
    return out


def attributions(router: MetaRouter, corpus: DataFrame, sc: str, n: int = 10) -> DataFrame:
    """The n features of the largest mean absolute attribution, by 20 steps at their right ends."""
    table = explain_table(router, corpus.select("tumour_id", "features").dropDuplicates(["tumour_id"]), sc, 20, True)
    return pl.top_attributions(table.groupBy(F.col("feature").alias("name")).agg(F.avg(F.abs("attribution")).alias("value")), n)


def as_text(found: dict) -> str:
    lines = [f"regret {found['regret']['regret']:.4f} over {found['regret']['n']} rows", f"gain over the baseline {found['gain']['gain']:.4f}"]
    for name in ("router_scores", "oracle_scores", "uncertainty_quartiles"):
        if found[name]:
            lines += ["", name, pd.DataFrame(found[name]).to_string(index=False)]
    for sc, top in found["attributions"].items():
        lines += ["", f"attributions {sc}", *(f"  {r['name']}: {r['value']:.4f}" for r in top)]
    return "\n".join(lines)


def write_report(found: dict, path: str) -> None:
    """report.json and report.txt in a folder of the driver."""
    with open(f"{path}/report.json", "w") as f:
        json.dump(found, f, indent=1, sort_keys=True)
    with open(f"{path}/report.txt", "w") as f:
        f.write(as_text(found) + "\n")
