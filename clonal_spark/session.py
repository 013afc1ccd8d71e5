"""Session helpers: shipping the package to executors and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, whatever their PYTHONPATH is (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "clonal_spark_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(d, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Only a local master, where all run on one machine, gets a temporary folder instead."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="clonal-spark-")
        atexit.register(shutil.rmtree, top, True)
        spark.conf.set("spark.checkpoint.dir", f"file://{top}")
        spark.sparkContext.setCheckpointDir(f"file://{top}")
        top = f"file://{top}"
    return top


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
