"""Prefix scans over long streams, without a window over a whole key.

Rows are dealt to range partitions by key and order, and written with their partition's number. Within a partition a key's
rows are scanned on their own; the partitions' results, one row per key and partition, are scanned in turn, and what stands
before a partition is added to its rows. So no task holds more than a range of a key, however hot it is. Sums and
exponential averages are such scans: a stretch of n rewards turns an average a into keep ** n * a + b."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonal_spark.session import Scratch

PART = "scan_part"


def dealt(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """The rows with the number of their range. Written, since ranges are cut by a sample and two reads must agree."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return Scratch(spark, "scan").write(rows.repartitionByRange(parts, *by, *order).withColumn(PART, F.spark_partition_id()), "dealt")


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    """Equality of keys; nulls are equal."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds the sum of `value` over a key's rows up to each one, in their order; null values count as none."""
    d = dealt(rows, by, order, parts)
    totals = d.groupBy(*by, PART).agg(F.sum(value).alias("scan_total"))
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row per range of a key
    before = totals.select(*by, PART, F.sum("scan_total").over(earlier).alias("scan_before"))
    own = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("scan_own", F.sum(value).over(own))
    met = local.join(before, _same(local, before, [*by, PART]), "left")
    both = F.when(F.col("scan_own").isNull() & F.col("scan_before").isNull(), None).otherwise(F.coalesce("scan_own", F.lit(0)) + F.coalesce("scan_before", F.lit(0)))
    return met.select(*[local[c] for c in rows.columns], both.alias(name))


def final_average(rows: DataFrame, by: list[str], order: list[str], value: str, keep: float, parts: int | None = None) -> DataFrame:
    """(by, average, n): what the exponential average of each key's stream ends with, from 0 on."""
    d = dealt(rows, by, order, parts)
    behind = F.row_number().over(Window.partitionBy(*by, PART).orderBy(*[F.desc(c) for c in order])) - 1
    stretch = d.withColumn("scan_behind", behind).groupBy(*by, PART).agg(F.sum((1 - keep) * F.pow(F.lit(keep), F.col("scan_behind")) * F.col(value)).alias("b"), F.count("*").alias("n"))
    later = Window.partitionBy(*by).orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)  # one row per range of a key
    rest = stretch.withColumn("scan_later", F.coalesce(F.sum("n").over(later), F.lit(0)))
    return rest.groupBy(*by).agg(F.sum(F.col("b") * F.pow(F.lit(keep), F.col("scan_later"))).alias("average"), F.sum("n").alias("n"))
