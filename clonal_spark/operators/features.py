"""Meta-features of tumours, for a whole cohort in one plan. Shapes come from each tumour's first sample."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonal_spark.config import FEATURE_NAMES
from clonal_spark.operators.mixture import ccf, vaf

KEY = ["tumour_id"]


def first_sample(obs: DataFrame) -> DataFrame:
    first = F.min("sample_id").over(Window.partitionBy("tumour_id"))
    return obs.withColumn("first_sample", first).where("sample_id = first_sample").drop("first_sample")


def shaped(obs: DataFrame) -> DataFrame:
    """The first sample's rows with vaf and ccf."""
    return first_sample(obs).withColumn("vaf", vaf()).withColumn("ccf", ccf(F.col("vaf"), F.col("adj")))


def depth_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(
        F.percentile("depth", 0.5).alias("depth_median"),
        (F.stddev_pop("depth") / F.greatest(F.avg("depth"), F.lit(1e-9))).alias("depth_cv"),
        F.avg((F.col("depth") < 20).cast("double")).alias("frac_low_depth"),
    )


def cn_landscape(obs: DataFrame) -> DataFrame:
    first = first_sample(obs).groupBy(*KEY).agg(
        F.avg((F.abs(F.col("adj") - 1) > 0.05).cast("double")).alias("frac_cna"),
        (F.lit(2.0) / F.greatest(F.avg("adj"), F.lit(0.1))).alias("ploidy"),
        F.countDistinct(F.bround("adj", 2)).cast("double").alias("n_cn_states"),
        F.avg((F.col("adj") > 1.2).cast("double")).alias("frac_loh"),
    )
    spread = obs.groupBy(*KEY, "mut_id").agg(F.stddev_pop("adj").alias("sd"), F.count("*").alias("n"))
    across = spread.groupBy(*KEY).agg(F.avg(((F.col("sd") > 0.05) & (F.col("n") > 1)).cast("double")).alias("subclonal_cn"))
    return first.join(across, KEY).withColumn("wgd", (F.col("ploidy") > 3).cast("double"))


def shape_stats(rows: DataFrame) -> DataFrame:
    """Population skewness and excess kurtosis of the fractions, and the width of the clonal peak."""
    near = F.when((F.col("ccf") > 0.5) & (F.col("ccf") < 1.5), F.col("ccf"))
    n = F.count("*")
    return rows.groupBy(*KEY).agg(
        F.when(n > 2, F.coalesce(F.skewness("ccf"), F.lit(0.0))).otherwise(0.0).alias("skewness"),
        F.when(n > 2, F.coalesce(F.kurtosis("ccf"), F.lit(0.0))).otherwise(0.0).alias("kurtosis"),
        F.when((n < 10) | (F.count(near) < 5), 0.5).otherwise(2.355 * F.stddev_pop(near)).alias("clonal_peak_width"),
        F.when(n < 20, 0.0).otherwise((F.avg(((F.col("vaf") > 0.01) & (F.col("vaf") < 0.15)).cast("double")) > 0.3).cast("double")).alias("has_pareto_tail"),
    )


#: Bins of a bandwidth, and terms of the series within a bin.
PER_BANDWIDTH, TERMS = 4, 24


def _density(rows: DataFrame, low: float, high: float, factor: float, start: float, stop: float, points: int, least: int) -> DataFrame:
    """Gaussian kernel sums of ccf in (low, high) on a grid, per tumour with at least `least` rows there, not all equal:
    (tumour_id, i, x, density). Bandwidth h: factor times the sample deviation.

    Fractions are gathered in bins of h / PER_BANDWIDTH from the least one on, so the bins alone meet the grid, and their number
    depends on the range over the bandwidth and not on the rows. A bin of one value has that value's kernel. Others keep the sums
    of u ** m * exp(-u * u / 2) / m!, u being a fraction's distance from the bin's middle in bandwidths: a kernel at distance z of
    the middle is exp(-z * z / 2) times the sum over m of z ** m times these. The terms from TERMS on leave out, relative to
    the kernel, less than e ** (z / 4) * (z / 8) ** 24 / 24!: 2e-15 at z = 16, and 6e-4 at z = 38.6, where kernels vanish in double
    precision. So tops are told apart far from all fractions too, where a grid is coarse. Sums of bins of several tables add up.

    A deviation of values that differ in their last bits is lost in rounding or not by the order of the rows; it is never less than
    the range over sqrt(2 * (n - 1)), which holds for any values, so only equal values have none."""
    some = rows.where((F.col("ccf") > low) & (F.col("ccf") < high))
    stats = some.groupBy(*KEY).agg(F.stddev_samp("ccf").alias("sd"), F.min("ccf").alias("least"), F.max("ccf").alias("most"), F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("least") < F.col("most")))
    h = F.greatest("sd", (F.col("most") - F.col("least")) / F.sqrt(2.0 * (F.col("n") - 1))) * factor
    met = some.join(stats.select(*KEY, h.alias("h"), "least"), KEY).withColumn("place", (F.col("ccf") - F.col("least")) / (F.col("h") / PER_BANDWIDTH))
    met = met.select(*KEY, "h", "least", "ccf", F.floor("place").alias("bin"), ((F.col("place") - F.floor("place") - 0.5) / PER_BANDWIDTH).alias("u"))
    sums = [F.sum(F.pow("u", F.lit(m)) * F.exp(-0.5 * F.col("u") * F.col("u")) / float(math.factorial(m))).alias(f"m{m}") for m in range(TERMS)]
    bins = met.groupBy(*KEY, "h", "least", "bin").agg(F.min("ccf").alias("lo"), F.max("ccf").alias("hi"), F.count("*").alias("n"), *sums)
    step = (stop - start) / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.alias("i"), (i * step + start).alias("x")))
    spread = bins.select(*KEY, F.explode(grid).alias("g"), "h", "least", "bin", "lo", "hi", "n", *[f"m{m}" for m in range(TERMS)])
    spread = spread.withColumn("z", (F.col("g.x") - F.col("least")) / F.col("h") - (F.col("bin") + 0.5) / PER_BANDWIDTH)
    z, series = F.col("z"), F.col(f"m{TERMS - 1}")
    for m in range(TERMS - 2, -1, -1):
        series = series * z + F.col(f"m{m}")
    own = (F.col("g.x") - F.col("lo")) / F.col("h")
    kernels = F.when(F.col("lo") == F.col("hi"), F.col("n") * F.exp(-0.5 * own * own)).otherwise(F.exp(-0.5 * z * z) * series)
    return spread.groupBy(*KEY, F.col("g.i").alias("i")).agg(F.first("g.x").alias("x"), F.sum(kernels).alias("density"))


def kde_peaks(rows: DataFrame) -> DataFrame:
    """Local maxima of the density above a tenth of its top; 1 if there are fewer than 10 fractions to go by."""
    d = _density(rows, 0.01, 1.99, 0.1, 0.01, 1.5, 200, 10)
    line, own = Window.partitionBy(*KEY).orderBy("i"), Window.partitionBy(*KEY)
    around = d.select(*KEY, "density", F.lag("density").over(line).alias("before"), F.lead("density").over(line).alias("after"), F.max("density").over(own).alias("top"))
    peaks = around.groupBy(*KEY).agg(F.sum(((F.col("density") > F.col("before")) & (F.col("density") > F.col("after")) & (F.col("density") > 0.1 * F.col("top"))).cast("double")).alias("peaks"))
    every = rows.select(*KEY).distinct()
    return every.join(peaks, KEY, "left").select(*KEY, F.greatest(F.coalesce("peaks", F.lit(1.0)), F.lit(1.0)).alias("n_peaks"))


def kde_purity(rows: DataFrame) -> DataFrame:
    """The density's first highest grid point; 0.5 with fewer than 5 fractions, and of equal ones their value."""
    d = _density(rows, 0.3, 1.5, 0.15, 0.3, 1.5, 100, 5)
    best = d.groupBy(*KEY).agg(F.max(F.struct("density", (-F.col("i")).alias("minus"), "x")).alias("b"))
    near = F.when((F.col("ccf") > 0.3) & (F.col("ccf") < 1.5), F.col("ccf"))
    equal = F.when((F.count(near) >= 5) & (F.min(near) == F.max(near)), F.min(near)).alias("equal")
    return rows.groupBy(*KEY).agg(equal).join(best, KEY, "left").select(*KEY, F.coalesce("b.x", "equal", F.lit(0.5)).alias("purity_estimate"))


def meta_features(obs: DataFrame, mappability: Column | None = None, longitudinal: float = 0.0) -> DataFrame:
    """One row per tumour with all features, in the fixed order. mappability: a Column of obs to average."""
    rows = shaped(obs)
    sizes = obs.groupBy(*KEY).agg(F.countDistinct("mut_id").alias("n"), F.countDistinct("sample_id").cast("double").alias("n_samples"), (F.lit(1.0) if mappability is None else F.avg(mappability)).alias("mappability"))
    joined = depth_stats(rows).join(cn_landscape(obs), KEY).join(shape_stats(rows), KEY).join(kde_peaks(rows), KEY).join(kde_purity(rows), KEY).join(sizes, KEY)
    joined = joined.withColumns(
        {
            "is_longitudinal": F.lit(longitudinal),
            "n_mutations": F.col("n").cast("double"),
            "sequencing_type": (F.col("n") > 1000).cast("double"),
            "nrpcc": F.col("depth_median") * F.col("n") / F.greatest(F.col("n_peaks"), F.lit(1.0)),
        }
    )
    return joined.select(*KEY, *FEATURE_NAMES)


def as_vector(features: DataFrame) -> DataFrame:
    return features.select(*KEY, F.array(*FEATURE_NAMES).alias("features"))
