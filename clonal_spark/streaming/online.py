"""Online training of the router as a stream of tumours: each micro-batch is selected by Thompson sampling with
the heads so far, fitted, scored and added to the heads. A batch of one tumour is the sequential bandit; larger
ones are the same with delayed feedback. Scores and heads carry the batch id, so a batch that runs again after a
failure finds its own scores and adds nothing twice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonal_spark.operators import features as fe
from clonal_spark.plans.router import MetaRouter, active_configs, fill_heads
from clonal_spark.plans.training import score_tasks
from clonal_spark.sources.simulate import SIMULATED


class OnlineTrainer:
    def __init__(self, router: MetaRouter, path: str, exclude=None):
        self.router, self.path = router, path
        self.configs = active_configs() if exclude is None else active_configs(exclude)

    def stored(self, spark: SparkSession) -> DataFrame | None:
        """Scores written so far."""
        try:
            return spark.read.parquet(f"{self.path}/scores")
        except Exception as missing:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
                return None
            raise

    def resume(self, spark: SparkSession) -> None:
        """Adds all stored scores to the heads."""
        if (done := self.stored(spark)) is not None:
            fill_heads(self.router, done)

    def batch(self, obs: DataFrame, batch_id: int) -> None:
        spark = obs.sparkSession
        obs = obs.persist()
        if (done := self.stored(spark)) is not None:
            obs = obs.join(done.select("tumour_id").distinct(), "tumour_id", "left_anti")
        vectors = fe.as_vector(fe.meta_features(obs))
        # A micro-batch's tumours: their number is bounded by the source's rate.
        rows = vectors.orderBy("tumour_id").collect()
        if rows:
            picked = [(r.tumour_id, self.router.thompson_total(np.array(r.features), self.configs)) for r in rows]
            tasks = spark.createDataFrame(picked, "tumour_id long, config string")
            scores = score_tasks(obs, tasks).join(vectors, "tumour_id").withColumn("batch_id", F.lit(batch_id).cast("long"))
            target = f"{self.path}/scores/batch={batch_id}"
            scores.write.mode("overwrite").parquet(target)
            made = spark.read.parquet(target)
            fill_heads(self.router, made)
            self.router.save(spark, f"{self.path}/router", batch_id)
            self.router.save(spark, f"{self.path}/checkpoints/{batch_id}", batch_id)  # a version of each batch
            facts = made.agg(F.count("*").alias("scores"), F.countDistinct("tumour_id").alias("tumours"), F.avg("score").alias("mean_score"), F.count("error").alias("failed"))
            facts.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/metrics/batch={batch_id}")
        obs.unpersist()

    def start(self, tumours: DataFrame, checkpoint: str, available_now: bool = True):
        """tumours: a streaming table of simulated observations, whole tumours in each file."""
        writer = tumours.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def tumour_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(SIMULATED).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running_stats(events: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Mean reward per configuration and time window of a stream (ts, config, reward), late rows up to delay."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "config").agg(F.avg("reward").alias("mean_reward"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "config", "mean_reward", "n")


def reward_average(events: DataFrame, keep: float = 0.99) -> DataFrame:
    """Exponential average of rewards per configuration in a stream (config, seq, reward), with state across batches."""

    def run(key, batches, state):
        value, n = state.get if state.exists else (0.0, 0)
        for b in batches:
            for r in b.sort_values("seq")["reward"]:
                value, n = keep * value + (1 - keep) * float(r), n + 1
        state.update((value, n))
        yield pd.DataFrame({"config": [key[0]], "average": [value], "n": [n]})

    return events.groupBy("config").applyInPandasWithState(run, "config string, average double, n long", "average double, n long", "update", "NoTimeout")
