"""Keeps the meta-features of a growing cohort up to date: python -m jobs.cohort_features --help.

Line items arrive as files. A file stream takes the new ones only (its checkpoint knows the others). Each micro-batch

1. sums its reads by tumour, mutation and sample and writes these counts into a partition of its own, counts/batch=N/folder=F;
2. reads the counts of the folders that it touched, of all batches, and writes the features of their tumours over
   features/folder=F (dynamic partition overwrite), so other folders stay as they are.

A batch that runs again after a failure has its old number, so it replaces its own counts and adds nothing twice. A run
without new files writes nothing. Tumours are dealt to FOLDERS folders, so no list grows with the cohort.

Rows without a tumour, mutation or sample are not counted; an empty table gives empty features."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonal_spark.config import FEATURE_NAMES
from clonal_spark.operators import features as fe
from clonal_spark.sources import observations as ob
from jobs.common import LOG, configuration, session

DEFAULTS = {"files_per_batch": 64, "folders": ob.FOLDERS, "sample": "l_returnflag", "subclonal": True}
FEATURES = "tumour_id long, " + ", ".join(f"{n} double" for n in FEATURE_NAMES) + ", folder int"


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that df has rows of."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _folder(folders: int) -> Column:
    return F.pmod("tumour_id", F.lit(folders)).cast("int").alias("folder")


def update(batch: DataFrame, batch_id: int, part: DataFrame, output: str, config: dict) -> None:
    """One micro-batch of line items."""
    spark = batch.sparkSession
    known = batch.where(F.col("l_suppkey").isNotNull() & F.col("l_partkey").isNotNull() & F.col(config["sample"]).isNotNull())
    counts = ob.read_counts(known, F.col("l_suppkey").cast("long"), F.col(config["sample"]))
    _replace(counts.select("*", F.lit(batch_id).cast("long").alias("batch"), _folder(config["folders"])), f"{output}/counts", "batch", "folder")
    every = spark.read.schema("tumour_id long, mut_id long, sample_id string, depth double, alt double, batch long, folder int").parquet(f"{output}/counts")
    touched = [r.folder for r in every.where(F.col("batch") == batch_id).select("folder").distinct().collect()]  # at most `folders`
    obs = every.where(F.col("folder").isin(touched)).groupBy("tumour_id", "mut_id", "sample_id").agg(F.sum("depth").alias("depth"), F.sum("alt").alias("alt"))
    features = fe.meta_features(ob.with_copy_numbers(obs, part, config["subclonal"]))
    _replace(features.select("*", _folder(config["folders"])), f"{output}/features", "folder")
    LOG.info("batch %d: %d folders of tumours brought up to date in %s", batch_id, len(touched), output)


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(FEATURES).parquet(f"{output}/features")


def run(spark: SparkSession, lineitem: str, part: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes what is new of lineitem and returns the features as they then stand."""
    config = DEFAULTS | (config or {})
    stream = spark.readStream.schema(spark.read.parquet(lineitem).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(lineitem)
    parts = spark.read.parquet(part)
    taken = stream.writeStream.foreachBatch(lambda df, i: update(df, i, parts, output, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    taken.awaitTermination()
    LOG.info("read %d new rows of %s in %d batches", sum(p["numInputRows"] for p in taken.recentProgress), lineitem, sum(p["numInputRows"] > 0 for p in taken.recentProgress))
    found = read(spark, output)
    LOG.info("%s/features holds %d tumours", output, found.count())
    return found


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--lineitem", required=True, help="folder of line item files (Parquet) that grows")
    p.add_argument("--part", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--config", help="JSON file over the defaults")
    a = p.parse_args(argv)
    spark = session("cohort-features")
    try:
        run(spark, a.lineitem, a.part, a.output, a.checkpoint, configuration(spark, a.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
