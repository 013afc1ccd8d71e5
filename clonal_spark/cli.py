"""Command lines: python -m clonal_spark.cli {generate,score,train,train-online,evaluate,run}."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clonal_spark.config import CONFIG_NAMES, FEATURE_NAMES
from clonal_spark.plans import evaluate as ev
from clonal_spark.plans import router as ro
from clonal_spark.plans import training as tr
from clonal_spark.session import ship_package
from clonal_spark.sources import observations as ob
from clonal_spark.sources import simulate as si
from clonal_spark.streaming.online import OnlineTrainer, tumour_stream

#: Sizes of whole runs.
RUNS = {"debug": {"tumours": 50, "augmentations": 2, "epochs": 10}, "full": {"tumours": 10_000, "augmentations": 3, "epochs": 50}}


def generate(spark: SparkSession, path: str, tumours: int, augmentations: int, seed: int) -> dict:
    return si.generate_tumours(spark, path, tumours, augmentations, seed)


def score(spark: SparkSession, path: str, margin: float | None) -> None:
    """Resumes: scores that are stored are not made again, and each batch of tumours is stored when it is done."""
    tr.score_logged(ob.read_tumours(spark, f"{path}/tumours"), f"{path}/scores", margin)


def corpus(spark: SparkSession, path: str):
    """The stored corpus of the stored scores; made where there is none of just these."""
    scores = tr.stored_scores(spark, f"{path}/scores")
    facts = scores.agg(F.count("*").alias("scores"), F.countDistinct("tumour_id").alias("tumours"), F.sum(F.xxhash64("tumour_id", "config", "sc", "score").cast("decimal(38,0)")).cast("string").alias("digest")).first().asDict()
    try:
        kept = ob.read_manifest(spark, f"{path}/corpus-manifest")
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        kept = {}
    if any(kept.get(k) != v for k, v in facts.items()):
        tr.assemble_corpus(ob.read_tumours(spark, f"{path}/tumours"), scores).write.mode("overwrite").parquet(f"{path}/corpus")
        ob.write_manifest(spark, f"{path}/corpus-manifest", **facts, features=list(FEATURE_NAMES), configs=list(CONFIG_NAMES))
    return spark.read.parquet(f"{path}/corpus")


def train(spark: SparkSession, path: str, epochs: int, seed: int) -> ro.TrainResult:
    rows = tr.split(corpus(spark, path), 0.8, seed)
    result = ro.train_router(rows.where("first"), rows.where("NOT first"), epochs, seed)
    result.router.save(spark, f"{path}/router")
    spark.createDataFrame([(i, float(x)) for i, x in enumerate(result.train_losses)], "epoch int, loss double").coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")
    return result


def train_online(spark: SparkSession, path: str, pilot: float, seed: int) -> None:
    """A seeded pilot share is scored in full, and its router goes on with the other tumours as a stream."""
    obs = tr.split(ob.read_tumours(spark, f"{path}/tumours"), pilot, seed)
    first = obs.where("first").drop("first")
    scores = tr.score_tumours(first, margin=None)
    scores.write.mode("overwrite").parquet(f"{path}/pilot-scores")
    router = ro.train_router(tr.assemble_corpus(first, spark.read.parquet(f"{path}/pilot-scores")), seed=seed).router
    rest = obs.where("NOT first").select("tumour_id", *[c for c in obs.columns if c not in ("tumour_id", "first")])
    rest.repartition("tumour_id").write.mode("overwrite").parquet(f"{path}/online-tumours")
    trainer = OnlineTrainer(router, f"{path}/online")
    trainer.resume(spark)
    trainer.start(tumour_stream(spark, f"{path}/online-tumours"), f"{path}/online-checkpoint").awaitTermination()


def evaluate(spark: SparkSession, path: str, out: str) -> dict:
    found = ev.report(ro.MetaRouter.load(spark, f"{path}/router"), corpus(spark, path))
    os.makedirs(out, exist_ok=True)
    ev.write_report(found, out)
    return found


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["generate", "score", "train", "train-online", "evaluate", "run"])
    p.add_argument("path")
    p.add_argument("--tumours", type=int, default=1000)
    p.add_argument("--augmentations", type=int, default=3)
    p.add_argument("--epochs", type=int, default=50)
    p.add_argument("--margin", type=float, default=0.25)
    p.add_argument("--pilot", type=float, default=0.02)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--size", choices=list(RUNS), default="debug")
    p.add_argument("--out", default="report")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("clonal-spark").getOrCreate()
    ship_package(spark)
    if a.command == "generate":
        print(json.dumps(generate(spark, a.path, a.tumours, a.augmentations, a.seed)))
    elif a.command == "score":
        score(spark, a.path, a.margin)
    elif a.command == "train":
        print(train(spark, a.path, a.epochs, a.seed).n_train)
    elif a.command == "train-online":
        train_online(spark, a.path, a.pilot, a.seed)
    elif a.command == "evaluate":
        print(ev.as_text(evaluate(spark, a.path, a.out)))
    else:
        run = RUNS[a.size]
        generate(spark, a.path, run["tumours"], run["augmentations"], a.seed)
        score(spark, a.path, a.margin)
        train(spark, a.path, run["epochs"], a.seed)
        print(ev.as_text(evaluate(spark, a.path, a.out)))


if __name__ == "__main__":
    main()
