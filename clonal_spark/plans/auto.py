"""Fits whose configuration the router picks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonal_spark.config import CONFIGS, SubChallenge
from clonal_spark.operators import features as fe
from clonal_spark.plans.model import FIT, CohortFit, fit_group
from clonal_spark.plans.router import MetaRouter, SC_NAMES


class RoutedModel:
    """One fit per tumour with the configuration that the router's mean scores favour for a subchallenge."""

    def __init__(self, router: MetaRouter | None = None, subchallenge: SubChallenge | str = SubChallenge.SC2B):
        self.router, self.sc = router or MetaRouter(), SubChallenge.parse(subchallenge).value

    def choose(self, obs: DataFrame) -> DataFrame:
        return self.router.select_table(fe.as_vector(fe.meta_features(obs)))

    def fit(self, obs: DataFrame) -> CohortFit:
        chosen = self.choose(obs).where(F.col("sc") == self.sc).select("tumour_id", "selected")
        return CohortFit(_fit_selected(obs, chosen))

    def fit_all(self, obs: DataFrame) -> tuple[DataFrame, CohortFit]:
        """The selection per (tumour, sc), and one fit per distinct (tumour, configuration)."""
        chosen = self.choose(obs).where(F.col("sc").isin(SC_NAMES)).select("tumour_id", "sc", "selected")
        return chosen, CohortFit(_fit_selected(obs, chosen.select("tumour_id", "selected").distinct()))


def _fit_selected(obs: DataFrame, chosen: DataFrame) -> DataFrame:
    def run(rows):
        name = rows["selected"].iloc[0]
        return fit_group(rows.drop(columns="selected"), CONFIGS[name], name)

    return obs.join(chosen, "tumour_id").groupBy("tumour_id", "selected").applyInPandas(run, FIT)


def explain_table(router: MetaRouter, features: DataFrame, sc: str, n_steps: int = 50, right_ends: bool = False) -> DataFrame:
    """(tumour_id, feature, attribution) of each tumour's selected configuration."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [(t, n, v) for t, x in zip(b["tumour_id"], b["features"], strict=True) for n, v in router.explain(np.asarray(x), sc, n_steps=n_steps, right_ends=right_ends).items()]
            yield pd.DataFrame(rows, columns=["tumour_id", "feature", "attribution"])

    return features.select("tumour_id", "features").mapInPandas(run, "tumour_id long, feature string, attribution double")
