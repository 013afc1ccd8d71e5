"""Tree operators over centers (tumour_id, k, sample_id, center). Pairs are of clones of one tumour: K * K rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonal_spark.functions import mathx as mx
from clonal_spark.operators.phylo_np import BRANCH_SCORE, LEAST, SAME_SHIFT, TEMPERATURE, TOL
from clonal_spark.session import Scratch


def means(centers: DataFrame) -> DataFrame:
    return centers.groupBy("tumour_id", "k").agg(F.avg("center").alias("mean"))


def nesting_order(centers: DataFrame) -> DataFrame:
    """(tumour_id, k, mean, place), by falling mean, then index."""
    return means(centers).withColumn("place", F.row_number().over(Window.partitionBy("tumour_id").orderBy(F.desc("mean"), "k")) - 1)


def _pairs(centers: DataFrame) -> DataFrame:
    other = centers.select("tumour_id", "sample_id", F.col("k").alias("other"), F.col("center").alias("other_center"))
    return centers.join(other, ["tumour_id", "sample_id"]).where("k <> other")


def nesting_matrix(centers: DataFrame, tol: float = TOL) -> DataFrame:
    """(tumour_id, k, other, nested): k fits below other in every sample."""
    return _pairs(centers).groupBy("tumour_id", "k", "other").agg(F.bool_and(F.col("center") <= F.col("other_center") + tol).alias("nested"))


def greedy_tree(centers: DataFrame) -> DataFrame:
    """(tumour_id, k, parent): the nesting clone of the least mean above the own; else the top clone; -1 for that one."""
    m = means(centers)
    order = nesting_order(centers).where("place = 0").select("tumour_id", F.col("k").alias("root"))
    up = nesting_matrix(centers).where("nested").join(m, ["tumour_id", "k"]).join(m.select("tumour_id", F.col("k").alias("other"), F.col("mean").alias("other_mean")), ["tumour_id", "other"])
    best = up.where("other_mean > mean").groupBy("tumour_id", "k").agg(F.min(F.struct("other_mean", "other")).alias("b"))
    rows = m.join(best, ["tumour_id", "k"], "left").join(order, "tumour_id")
    return rows.select("tumour_id", "k", F.when(F.col("k") == F.col("root"), F.lit(-1)).otherwise(F.coalesce("b.other", "root")).cast("int").alias("parent"))


def clamp_chain(centers: DataFrame) -> DataFrame:
    """Centers at least TOL below the one before in the nesting order: a running minimum in closed form."""
    rows = centers.join(nesting_order(centers).select("tumour_id", "k", "place"), ["tumour_id", "k"])
    run = Window.partitionBy("tumour_id", "sample_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    value = F.min(F.col("center") + F.col("place") * TOL).over(run) - F.col("place") * TOL
    return rows.select("tumour_id", "k", "sample_id", mx.clip(value, LEAST, 1 - LEAST).alias("center"))


def pairs_tensor(centers: DataFrame) -> DataFrame:
    """(tumour_id, k, other, ancestor, descendant, branching, same), each row of sum 1."""
    diff = F.col("center") - F.col("other_center")
    raw = _pairs(centers).groupBy("tumour_id", "k", "other").agg(
        F.greatest(F.avg(mx.sigmoid(diff / TEMPERATURE)), F.lit(1e-10)).alias("a"),
        F.greatest(F.avg(mx.sigmoid(-diff / TEMPERATURE)), F.lit(1e-10)).alias("d"),
        F.greatest(F.avg(mx.sigmoid(SAME_SHIFT - F.abs(diff) / TEMPERATURE)), F.lit(1e-10)).alias("s"),
    )
    total: Column = F.col("a") + F.col("d") + F.col("s") + BRANCH_SCORE
    return raw.select("tumour_id", "k", "other", (F.col("a") / total).alias("ancestor"), (F.col("d") / total).alias("descendant"), (F.lit(BRANCH_SCORE) / total).alias("branching"), (F.col("s") / total).alias("same"))


def depths(tree: DataFrame) -> DataFrame:
    """(tumour_id, k, parent, depth) by doubling: each round a node's link goes on to where its target's leads, so rounds
    grow with the logarithm of the clones of a tumour. A round is written, as the next one reads it twice. A node whose
    links leave the table has no row; a cycle raises."""
    scratch = Scratch(tree.sparkSession, "depths")
    most = tree.groupBy("tumour_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 1
    links = tree.select("tumour_id", "k", "parent", F.col("parent").cast("long").alias("up"), F.when(F.col("parent") == -1, 0).otherwise(1).cast("long").alias("depth"))
    for i in range(int(most).bit_length()):
        links = scratch.write(links, f"links-{i}")
        target = links.select("tumour_id", F.col("k").cast("long").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        met = links.join(target, ["tumour_id", "up"], "left").where("up = -1 OR next IS NOT NULL")
        links = met.select("tumour_id", "k", "parent", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.when(F.col("up") == -1, 0).otherwise(F.col("more"))).alias("depth"))
    return links.select("tumour_id", "k", "parent", F.when(F.col("up") == -1, F.col("depth")).otherwise(F.raise_error(F.lit("the edges have a cycle")).cast("long")).cast("int").alias("depth"))


def layout(tree: DataFrame) -> DataFrame:
    """Node positions: layers by depth, places within a layer by index."""
    own = Window.partitionBy("tumour_id", "depth")
    place = F.row_number().over(own.orderBy("k"))
    return depths(tree).select("tumour_id", "k", "parent", "depth", ((place - 0.5) / F.count("*").over(own)).alias("x"), (-F.col("depth")).cast("double").alias("y"))
