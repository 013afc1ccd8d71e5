"""What the jobs share: configuration files read by Spark, and their log."""

from __future__ import annotations

import json
import logging

from pyspark.sql import SparkSession

LOG = logging.getLogger("jobs")


def configuration(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """A JSON file over the defaults; an unknown name is an error. The path may be remote."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return defaults | given


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()
