"""The data behind each plot; a renderer needs nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonal_spark.operators.mixture import vaf
from clonal_spark.operators.phylo import nesting_order

# The colours of clones, in their order (blue, vermillion, green, purple, orange, sky, yellow, black, indigo, cyan, teal, wine).
CLONE_PALETTE = ["#0072B2", "#D55E00", "#009E73", "#CC79A7", "#E69F00", "#56B4E9", "#F0E442", "#000000", "#332288", "#88CCEE", "#44AA99", "#882255"]


def clone_colours(clones: DataFrame, k: str = "k") -> DataFrame:
    """Rows with the colour of their clone; clones beyond the palette begin it anew. A null or negative (unassigned)
    clone has none."""
    place = F.pmod(F.col(k), F.lit(len(CLONE_PALETTE))).cast("int")
    return clones.withColumn("colour", F.when(F.col(k) >= 0, F.element_at(F.array(*map(F.lit, CLONE_PALETTE)), place + 1)))


def vaf_histogram(obs: DataFrame, assigned: DataFrame, bins: int = 50) -> DataFrame:
    """Counts by clone and bin over [0, 1]; 1 itself is in the last bin."""
    b = F.least(F.floor(vaf() * bins), F.lit(bins - 1)).cast("int")
    return obs.join(assigned.select("tumour_id", "mut_id", "k"), ["tumour_id", "mut_id"]).groupBy("tumour_id", "sample_id", "k", b.alias("bin")).agg(F.count("*").alias("n"))


def cellularity_scatter(obs: DataFrame, assigned: DataFrame) -> DataFrame:
    return obs.join(assigned.select("tumour_id", "mut_id", "k"), ["tumour_id", "mut_id"]).select("tumour_id", "mut_id", "sample_id", "k", vaf().alias("vaf"))


def sample_comparison(centers: DataFrame, samples: list[str]) -> DataFrame:
    """Centers with a column per sample."""
    return centers.groupBy("tumour_id", "k").pivot("sample_id", samples).agg(F.first("center"))


def responsibility_rows(resp: DataFrame, assigned: DataFrame) -> DataFrame:
    """Heat-map cells with each mutation's row: by clone, then mutation."""
    row = F.row_number().over(Window.partitionBy("tumour_id").orderBy("assigned", "mut_id"))
    order = assigned.select("tumour_id", "mut_id", F.col("k").alias("assigned")).withColumn("row", row)
    return resp.join(order, ["tumour_id", "mut_id"]).select("tumour_id", "row", "mut_id", "assigned", "k", "r")


def fish(centers: DataFrame) -> DataFrame:
    """Centers stacked by the nesting order: (tumour_id, sample_id, k, place, center, low, high)."""
    rows = centers.join(nesting_order(centers).select("tumour_id", "k", "place"), ["tumour_id", "k"])
    high = F.sum("center").over(Window.partitionBy("tumour_id", "sample_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("high", high).withColumn("low", F.col("high") - F.col("center")).select("tumour_id", "sample_id", "k", "place", "center", "low", "high")


def bic_curve(fits: DataFrame) -> DataFrame:
    """(tumour_id, K, bic) with the least one marked."""
    own = Window.partitionBy("tumour_id")
    return fits.withColumn("best", F.row_number().over(own.orderBy("bic", "K")) == 1).select("tumour_id", "K", "bic", "best")


def top_attributions(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n largest by absolute value: a report's top list."""
    return rows.orderBy(F.desc(F.abs("value")), "name").limit(n)


def top_responsibility(resp: DataFrame) -> DataFrame:
    """Quartiles of each mutation's largest responsibility, by its clone."""
    best = resp.groupBy("tumour_id", "mut_id").agg(F.max(F.struct("r", (-F.col("k")).alias("minus"))).alias("b")).select("tumour_id", (-F.col("b.minus")).alias("k"), F.col("b.r").alias("r"))
    return best.groupBy("tumour_id", "k").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.percentile("r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max("r").alias("most")).select("tumour_id", "k", "n", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "most")
