"""Kernel sums by bins against sums over all fractions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonal_spark.operators import features as fe


@pytest.mark.parametrize("seed", [1, 2])
def test_binned_density(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {1: rng.normal(1.0, 0.2, 4000), 2: np.concatenate([rng.normal(0.4, 0.05, 200), rng.normal(1.0, 0.1, 300)]), 3: rng.uniform(0.02, 1.9, 30), 4: np.repeat([0.25, 1.25], 20), 5: np.full(40, 0.5), 6: rng.uniform(0, 2, 4)}
    df = spark.createDataFrame([(t, float(x)) for t, xs in groups.items() for x in xs], "tumour_id long, ccf double").repartition(3)
    got = {(r.tumour_id, r.i): (r.x, r.density) for r in fe._density(df, 0.01, 1.99, 0.1, 0.01, 1.5, 200, 10).collect()}
    assert {t for t, _ in got} == {1, 2, 3, 4}  # equal or few fractions have none
    for t in (1, 2, 3, 4):
        xs = groups[t][(groups[t] > 0.01) & (groups[t] < 1.99)]
        h, grid = 0.1 * xs.std(ddof=1), np.linspace(0.01, 1.5, 200)
        exact = np.exp(-0.5 * ((grid[:, None] - xs) / h) ** 2).sum(1)
        for i in range(200):
            assert got[t, i][0] == pytest.approx(grid[i]) and abs(got[t, i][1] - exact[i]) < 2e-7 * len(xs)


def test_rows_that_meet_the_grid_do_not_grow(spark):
    """Ten times the fractions fill the same bins."""
    bins = []
    for n in (5_000, 50_000):
        df = spark.range(n).select(F.lit(1).cast("long").alias("tumour_id"), (F.lit(0.3) + F.randn(3) * 0.1).alias("ccf"))
        assert fe._density(df, 0.01, 1.99, 0.1, 0.01, 1.5, 200, 10).count() == 200
        sd = df.where("ccf > 0.01 AND ccf < 1.99").agg(F.stddev_samp("ccf")).first()[0]
        bins.append(df.where("ccf > 0.01 AND ccf < 1.99").select(F.floor(F.col("ccf") / (0.1 * sd / fe.PER_BANDWIDTH))).distinct().count())
    assert bins[1] < 1.5 * bins[0]


def test_tops_far_from_all_fractions(spark):
    """A grid coarser than the kernel: the nearest point has the top, however small it is."""
    values = [1.2000000000000002] * 22 + [1.205128205128205]
    df = spark.createDataFrame([(1, x) for x in values], "tumour_id long, ccf double")
    h, grid = 0.15 * np.std(values, ddof=1), np.arange(100) * (1.2 / 99) + 0.3
    exact = np.exp(-0.5 * ((grid[:, None] - np.array(values)) / h) ** 2).sum(1)
    assert 0 < exact.max() < 1e-70
    assert fe.kde_purity(df).first().purity_estimate == pytest.approx(grid[exact.argmax()], abs=1e-12)
    near = np.concatenate([np.linspace(1.2029, 1.2031, 40), np.linspace(0.9, 0.9002, 60)])  # several values a bin, all points within tails
    got = {r.i: r.density for r in fe._density(spark.createDataFrame([(1, float(x)) for x in near], "tumour_id long, ccf double"), 0.3, 1.5, 0.02, 0.3, 1.5, 100, 5).collect()}
    exact = np.exp(-0.5 * ((grid[:, None] - near) / (0.02 * near.std(ddof=1))) ** 2).sum(1)
    for i in np.flatnonzero(exact > 1e-120):
        assert got[int(i)] == pytest.approx(exact[i], rel=1e-6)


def test_fractions_that_differ_in_the_last_bit(spark):
    """Their deviation is not lost in rounding, in whatever order they come."""
    found = set()
    for at in (0, 1, 11, 21):
        values = [1.2000000000000002] * 22
        values[at] = 1.2
        rows = spark.createDataFrame([(1, x) for x in values], "tumour_id long, ccf double").coalesce(1)
        found.add(fe.kde_purity(rows).first().purity_estimate)
    assert found == {0.3}
