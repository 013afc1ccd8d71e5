"""Exact quantiles by distributed selection.

Each wanted rank of a group has an interval of values that holds it, from the group's least to its greatest value. A pass counts
the interval's rows in BUCKETS equal bins, with partial counts before the shuffle, and the interval becomes the least and
greatest value of the rank's bin. An interval is one row with all its ranks. An interval is done when both are equal, or when at most FEW rows are left, which are then sorted.
Every pass takes off at least one value and as a rule all but one in BUCKETS rows, so no task holds a group's values."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonal_spark.session import Scratch

BUCKETS, FEW = 1024, 4096


def exact_quantiles(rows: DataFrame, by: list[str], value: str, levels: list[float], buckets: int | None = None, few: int | None = None) -> DataFrame:
    """(by, q): the array of the levels' quantiles of a group, with linear interpolation. Nulls and NaN take no part; a group
    without a value has no row; null keys are a group."""
    buckets, few = buckets or BUCKETS, few or FEW
    spark, scratch, name = rows.sparkSession, Scratch(rows.sparkSession, "selection"), uuid.uuid4().hex
    keyed = rows.select(F.struct(*by).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    data = scratch.write(keyed.withColumn("h", F.xxhash64(*[F.col(f"g.{c}") for c in by])).withColumn("g", F.to_json("g", {"ignoreNullFields": "false"})), f"values-{name}")
    names = data.groupBy("h", "g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    places = [F.lit(level) * (F.col("n") - 1) for level in levels]
    ranks = F.array_distinct(F.array(*[f(p) for p in places for f in (F.floor, F.ceil)])).alias("ranks")
    state = scratch.write(names.select("h", "g", "lo", "hi", F.lit(0).cast("long").alias("base"), "n", ranks), f"ranks-{name}-0")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # by number: few bytes are many rows
    open_, i = (F.col("lo") < F.col("hi")) & (F.col("n") > few), 0
    key = ["h", "g", "lo", "hi", "base"]
    while not (going := state.where(open_)).isEmpty():
        i += 1
        met = data.join(going.select(*key), ["h", "g"]).where("v >= lo AND v <= hi")
        bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))
        counts = met.groupBy(*key, bin_.alias("bin")).agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most")).repartition(parts, *key)
        counts = counts.withColumn("first", F.col("base") + F.sum("m").over(Window.partitionBy(*key).orderBy("bin")) - F.col("m"))  # at most `buckets` rows
        held = F.filter("ranks", lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("m")))
        moved = going.drop("n").join(counts, key).withColumn("ranks", held).where("size(ranks) > 0").select("h", "g", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("first").alias("base"), F.col("m").alias("n"), "ranks")
        state = scratch.write(state.where(~open_).unionByName(moved), f"ranks-{name}-{i}")
        scratch.drop(f"ranks-{name}-{i - 1}")
    last = state.where("lo < hi").select(*key)
    sorted_ = data.join(last, ["h", "g"]).where("v >= lo AND v <= hi").groupBy(*key).agg(F.array_sort(F.collect_list("v")).alias("vs"))
    found = state.join(sorted_, key, "left").withColumn("rank", F.explode("ranks")).select("h", "g", "rank", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.get("vs", (F.col("rank") - F.col("base")).cast("int"))).alias("x"))
    by_rank = found.groupBy("h", "g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at")).join(names.select("h", "g", "n"), ["h", "g"])

    def quantile(level: float):
        place = F.lit(level) * (F.col("n") - 1)
        low, high = F.element_at("at", F.floor(place)), F.element_at("at", F.ceil(place))
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    schema = rows.select(*by).schema
    return by_rank.select(F.from_json("g", schema).alias("g"), F.array(*map(quantile, levels)).alias("q")).select(*[F.col(f"g.{c}").alias(c) for c in by], "q")
