"""Steps of a fit in one call: none is made twice."""

from clonal_spark.functions.emission import Binomial
from clonal_spark.operators import mixture as mo


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_do_not_grow_with_the_steps(spark):
    rows = [(t, m, s, float((7 * m + t) % 11), 12.0, 1.0) for t in (0, 1) for m in range(30) for s in "AB"]
    obs = spark.createDataFrame(rows, "tumour_id long, mut_id long, sample_id string, alt double, depth double, adj double")
    fits = [mo.em_steps(obs, mo.quantile_init(obs, 3), Binomial(), steps) for steps in (1, 3)]
    assert all("Join" not in plan(state) for state, _ in fits)  # written
    assert len({plan(resp).count("Join") for _, resp in fits}) == 1
    shares = fits[1][1].groupBy(*mo.MUT).agg({"r": "sum", "k": "count"}).collect()
    assert len(shares) == 60 and all(abs(r["sum(r)"] - 1) < 1e-12 and r["count(k)"] == 3 for r in shares)
