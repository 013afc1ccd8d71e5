"""Prefix scans and exact quantiles against plain forms, with hot keys, ties, nulls and few rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonal_spark.operators import scoring as sg
from clonal_spark.operators.scan import PART, dealt, final_average, running_sum
from clonal_spark.operators.selection import exact_quantiles


def stream(n, seed):
    """Nine of ten rows are of one key; orders are distinct within a key."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.9 else rng.choice(["a", None, "b"]), i, rng.choice([None, *[rng.uniform(-1, 3) for _ in range(9)]])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sum(spark, parts):
    rows = stream(600, parts)
    df = spark.createDataFrame(rows, "k string, at long, x double").repartition(5)
    got = {(r.k, r.at): r.total for r in running_sum(df, ["k"], ["at"], "x", "total", parts).collect()}
    want = {}
    for k in {k for k, *_ in rows}:
        total = None
        for _, at, x in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            total = total if x is None else x + (total or 0.0)
            want[k, at] = total
    assert set(got) == set(want) and all(got[i] == (None if want[i] is None else pytest.approx(want[i])) for i in want)


def test_no_task_holds_the_hot_key(spark):
    sizes = dealt(spark.createDataFrame(stream(2000, 3), "k string, at long, x double"), ["k"], ["at"], 8).groupBy(PART).count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 800


@pytest.mark.parametrize("parts", [1, 6])
def test_final_average(spark, parts):
    rows = [(k, at, x or 0.0) for k, at, x in stream(500, 10 + parts)]
    got = {r.k: (r.average, r.n) for r in final_average(spark.createDataFrame(rows, "k string, at long, x double"), ["k"], ["at"], "x", 0.9, parts).collect()}
    for k in {k for k, *_ in rows}:
        value, own = 0.0, sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for *_, x in own:
            value = 0.9 * value + 0.1 * x
        assert got[k] == (pytest.approx(value), len(own))


def test_scores_use_the_scans(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.25), ("b", 1, 1.0)], "sc string, t long, regret double")
    assert sorted(tuple(r) for r in sg.running_regret(df, ["sc"], ["t"]).collect()) == [("a", 1, 0.5, 0.5), ("a", 2, 0.25, 0.75), ("b", 1, 1.0, 1.0)]
    assert sg.running_regret(df.limit(0), ["sc"], ["t"]).count() == 0


LEVELS = [0.0, 0.1, 1 / 3, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize(("buckets", "few"), [(2, 1), (16, 3), (1024, 4096)])
def test_exact_quantiles(spark, buckets, few):
    rng = np.random.default_rng(buckets)
    groups = {
        ("many", 1): rng.normal(size=900), ("ties", 1): rng.integers(0, 4, 500).astype(float), ("one", None): np.array([2.5]), (None, 2): np.array([1.0, 7.0]), ("equal", 0): np.full(300, 0.25),
        ("wide", 3): np.concatenate([10.0 ** rng.uniform(-8, 8, 200), -(10.0 ** rng.uniform(-8, 8, 50))]), ('odd "name', 4): np.array([math.pi, math.pi, 0.1 + 0.2, 0.3]),
    }
    rows = [(a, b, float(x)) for (a, b), xs in groups.items() for x in xs] + [("many", 1, None), ("many", 1, float("nan")), ("none", 1, None)]
    df = spark.createDataFrame(rows, "a string, b long, x double").repartition(4)
    got = {(r.a, r.b): r.q for r in exact_quantiles(df, ["a", "b"], "x", LEVELS, buckets, few).collect()}
    assert set(got) == set(groups)
    for key, xs in groups.items():
        assert got[key] == pytest.approx(np.quantile(xs, LEVELS).tolist(), rel=1e-12, abs=1e-15)
    exact = df.where("x IS NOT NULL AND NOT isnan(x)").groupBy("a", "b").agg(F.percentile("x", F.array(*map(F.lit, LEVELS))).alias("q")).collect()
    assert all(got[r.a, r.b] == pytest.approx(r.q, rel=1e-12, abs=1e-15) for r in exact)
    assert exact_quantiles(df.limit(0), ["a", "b"], "x", LEVELS).count() == 0
