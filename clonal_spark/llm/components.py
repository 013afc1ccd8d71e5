"""Connected components of an edge table by alternating large and small stars.

Every round is one aggregation and one join over edges; rounds grow with the logarithm of the number of
nodes. Rounds are written to the shared folder, so lineage stays short and a lost executor costs one
round at most. Minima are aggregated before the shuffle, and the join's hot keys can be split by AQE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonal_spark.session import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Edges (a, b) to rows (node, component): component is the least node reachable. Nodes that are
    their component's least, and nodes without edges, have no row."""
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, i = scratch.write(start, f"{name}-0"), 0
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        i += 1
        now = scratch.write(small, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with an upward edge has one only, to a node without one: components are then read off."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()


def joined_components(known: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Components (node, component) of `known` ones and further links (a, b): only links between different components
    are worked on, as edges between these."""
    if known is None:
        return connected_components(links, scratch, name)
    at = lambda c: known.toDF(c, f"{c}_component")
    met = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b")).where("a <> b").distinct()
    met = scratch.write(met, f"{name}-edges")
    if met.isEmpty():
        return known
    top = scratch.write(connected_components(met, scratch, name), f"{name}-top")
    moved = known.join(top.toDF("component", "now"), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return scratch.write(moved.unionByName(top), f"{name}-all")
