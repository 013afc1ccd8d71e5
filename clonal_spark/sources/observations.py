"""Observation tables: (tumour_id, mut_id, sample_id, alt, depth, adj, total_cn), adapters and stores."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATIONS = "tumour_id long, mut_id long, sample_id string, alt double, depth double, adj double, total_cn double"


def from_arrays(spark: SparkSession, alt, depth, adj=None, total_cn=None, tumour_id: int = 0) -> DataFrame:
    """Dense arrays (mutations, samples), or vectors for one sample."""
    alt, depth = (np.asarray(x, float).reshape(len(x), -1) for x in (alt, depth))
    n, s = alt.shape
    fill = lambda x: np.ones((n, s)) if x is None else np.broadcast_to(np.asarray(x, float).reshape(n, -1), (n, s))
    rows = pd.DataFrame({"tumour_id": tumour_id, "mut_id": np.repeat(np.arange(n), s), "sample_id": [f"{i:03d}" for i in range(s)] * n, "alt": alt.ravel(), "depth": depth.ravel(), "adj": fill(adj).ravel(), "total_cn": np.nan if total_cn is None else fill(total_cn).ravel()})
    return spark.createDataFrame(rows, OBSERVATIONS).withColumn("total_cn", F.when(F.isnan("total_cn"), None).otherwise(F.col("total_cn")))


def from_lineitem(spark: SparkSession, sf_dir: str, tumour: str = "none", sample: str = "l_returnflag", subclonal: bool = False) -> DataFrame:
    """Observations of the star schema: a mutation is a part, a sample a return flag (or a year), depth the summed
    quantity and alt that of discounts from 0.05 on. tumour: "none" (one) or "supplier" (one each). With one
    tumour, mutations that lack a sample are left out, so that its table is dense; suppliers keep all samples.
    subclonal: odd parts have another copy number in the samples of odd first letters."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tumour_id = F.lit(0).cast("long") if tumour == "none" else F.col("l_suppkey").cast("long")
    sample_id = F.year("l_shipdate").cast("string") if sample == "year" else F.col(sample)
    obs = read_counts(rows, tumour_id, sample_id)
    if tumour == "none":
        samples = F.broadcast(rows.agg(F.countDistinct(sample_id).alias("n_samples")))  # one row
        whole = obs.groupBy("mut_id").agg(F.count("*").alias("n")).crossJoin(samples).where("n = n_samples").select("mut_id")
        obs = obs.join(whole, "mut_id", "left_semi")
    return with_copy_numbers(obs, spark.read.parquet(f"{sf_dir}/part.parquet"), subclonal)


def read_counts(rows: DataFrame, tumour_id: Column, sample_id: Column) -> DataFrame:
    """Depth and alt of line items by tumour, mutation and sample. Counts of several tables add up to those of their union."""
    reads = rows.select(tumour_id.alias("tumour_id"), F.col("l_partkey").alias("mut_id"), sample_id.alias("sample_id"), "l_quantity", "l_discount")
    return reads.groupBy("tumour_id", "mut_id", "sample_id").agg(F.sum("l_quantity").alias("depth"), F.sum(F.when(F.col("l_discount") >= 0.05, F.col("l_quantity")).otherwise(0.0)).alias("alt"))


def with_copy_numbers(obs: DataFrame, part: DataFrame, subclonal: bool = False) -> DataFrame:
    """Observations of counts: a part's size gives its copy number, and that the adjustment factor."""
    part = part.select(F.col("p_partkey").alias("mut_id"), "p_size")
    other = (F.ascii("sample_id") % 2) * (F.col("mut_id") % 2) if subclonal else F.lit(0)
    cn = (F.col("p_size") + other) % 4 + 1
    return obs.join(part, "mut_id").select("tumour_id", "mut_id", "sample_id", "alt", "depth", (F.lit(2.0) / (cn * F.lit(0.8) + F.lit(0.4))).alias("adj"), cn.cast("double").alias("total_cn"))


#: Folders that tumours are dealt to, however many they are.
FOLDERS = 64


def write_tumours(obs: DataFrame, path: str) -> None:
    """FOLDERS folders by tumour_id, each sorted by it: readers prune folders, and row groups by their bounds."""
    dealt = obs.withColumn("folder", F.pmod("tumour_id", F.lit(FOLDERS)).cast("int"))
    dealt.repartition("folder").sortWithinPartitions("folder", "tumour_id").write.mode("overwrite").partitionBy("folder").parquet(path)


def read_tumours(spark: SparkSession, path: str, tumours: list[int] | None = None) -> DataFrame:
    """All tumours, or some of them from their folders only."""
    rows = spark.read.parquet(path)
    if tumours is not None:
        rows = rows.where(F.col("folder").isin(sorted({t % FOLDERS for t in tumours})) & F.col("tumour_id").isin(tumours))
    return rows.drop("folder")


def write_manifest(spark: SparkSession, path: str, **facts) -> None:
    """A one-row JSON text beside the tumours: how they were made."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def todo(tasks: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("tumour_id", "config")) -> DataFrame:
    """Resume: tasks without a stored score."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """A FASTA index's autosomes and lengths."""
    rows = spark.read.csv(path, sep="\t", schema="name string, length long, offset long, line_bases int, line_width int")
    return rows.where(F.regexp_replace("name", "^chr", "").rlike("^([1-9]|1[0-9]|2[0-2])$")).select("name", "length")


def sample_positions(spark: SparkSession, index: DataFrame, n: int, seed: int, margin: int = 10_000) -> DataFrame:
    """n positions drawn by chromosome length, margin from both ends. At most 22 rows come to the driver."""
    chroms = [(r["name"], r["length"]) for r in index.where(F.col("length") > 2 * margin).orderBy("name").collect()]
    rng = np.random.default_rng(seed)
    weights = np.array([x for _, x in chroms], float)
    which = rng.choice(len(chroms), n, p=weights / weights.sum())
    rows = [(i, chroms[k][0], int(rng.integers(margin, chroms[k][1] - margin))) for i, k in enumerate(which.tolist())]
    return spark.createDataFrame(rows, "mut_id long, chrom string, pos long")


def write_variants(variants: DataFrame, path: str) -> None:
    variants.select("chrom", "pos", "pos", "vaf").toDF("chrom", "start", "end", "vaf").write.mode("overwrite").option("sep", "\t").csv(path)


def count_alleles(reads: DataFrame, alts: DataFrame) -> DataFrame:
    """Pileup counts from reads (chrom, pos, base; deletions and skips have a null base) and alts (chrom, pos, alt_base)."""
    return alts.join(reads.where("base IS NOT NULL"), ["chrom", "pos"], "left").groupBy("chrom", "pos", "alt_base").agg(F.sum(F.when(F.col("base") == F.col("alt_base"), 1).otherwise(0)).alias("alt"), F.count("base").alias("depth"))


def spike_in_available() -> bool:
    """Spike-in simulation needs external programs and read files; none are bundled, so callers fall back to the simulator."""
    return False
