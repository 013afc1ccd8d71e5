"""Ties between clones: sums are the same to the last bit in any order of rows."""

import random

from clonal_spark.functions.emission import Binomial
from clonal_spark.operators import mixture as mo

PARAMS = [(0, k, s, c) for k, cs in enumerate([(0.61, 0.72, 0.83), (0.95, 0.75, 0.64), (0.1, 0.2, 0.3)]) for s, c in zip("ANR", cs, strict=True)]


def observed(spark, seed):
    """Clones 0 and 1 expect all reads of a mutation at this factor, so they are equal; rows stand in an order of the seed."""
    draw = random.Random(1)
    rows = [(0, m, s, float(draw.randint(1, 500)), 500.0, 5 / 3) for m in range(400) for s in "ANR"]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "tumour_id long, mut_id long, sample_id string, alt double, depth double, adj double").coalesce(1)


def test_any_order_of_rows_gives_the_same_bits(spark):
    params = spark.createDataFrame(PARAMS, "tumour_id long, k int, sample_id string, center double").coalesce(1)
    found = [{(r.mut_id, r.k): r.log_lik for r in mo.log_likelihoods(observed(spark, seed), params, Binomial()).collect()} for seed in (1, 2, 3)]
    assert len(found[0]) == 1200 and found[0] == found[1] == found[2]
    assert all(found[0][m, 0] == found[0][m, 1] for m in range(400))


def test_merged_shares_add_up_in_the_order_of_clones(spark):
    centers = spark.createDataFrame([(0, k, "A", 0.3 * (k // 3 + 1)) for k in range(6)], "tumour_id long, k int, sample_id string, center double")
    draw, found = random.Random(2), []
    shares = {m: [draw.random() for _ in range(6)] for m in range(300)}
    for seed in (1, 2, 3):
        rows = [(0, m, k, r / sum(rs)) for m, rs in shares.items() for k, r in enumerate(rs)]
        random.Random(seed).shuffle(rows)
        resp = spark.createDataFrame(rows, "tumour_id long, mut_id long, k int, r double").coalesce(1)
        found.append({(r.mut_id, r.k): r.r for r in mo.merge_and_prune(centers, resp)[1].collect()})
    assert len(found[0]) == 600 and found[0] == found[1] == found[2]


def test_a_clone_without_a_sample_is_not_met(spark):
    obs = spark.createDataFrame([(0, 1, "A", 3.0, 9.0, 1.0), (0, 2, "B", 3.0, 9.0, 1.0)], "tumour_id long, mut_id long, sample_id string, alt double, depth double, adj double")
    params = spark.createDataFrame([(0, 0, "A", 0.5), (0, 1, "A", 0.2), (0, 1, "B", 0.2)], "tumour_id long, k int, sample_id string, center double")
    assert sorted((r.mut_id, r.k) for r in mo.log_likelihoods(obs, params, Binomial()).collect()) == [(1, 0), (1, 1), (2, 1)]
