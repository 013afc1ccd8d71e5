"""Fits whose emissions are made once for each distinct count, against all cells in turn."""

import numpy as np
import pytest

from clonal_spark.config import CONFIGS
from clonal_spark.functions.emission import emission_of
from clonal_spark.plans import engines as en


def _cells(n=6000):
    rng = np.random.default_rng(3)
    depth = rng.integers(0, 60, (n, 3)).astype(float)
    adj = rng.choice([0.5, 0.8, 1.25], (n, 1)) * np.ones((1, 3))
    return rng.binomial(depth.astype(int), np.clip(rng.choice([0.2, 0.5], (n, 1)) * adj, 0, 1)).astype(float), depth, adj


@pytest.mark.parametrize("name", ["quantumclone_v1", "longitudinal_clinical", "mobster", "decifer_style"])
def test_distinct_counts_give_the_same(name):
    config, (alt, depth, adj) = CONFIGS[name], _cells()
    emission = emission_of(config)
    centers = en.initial_centers(alt, depth, 4)
    log_pi = np.log([0.1, 0.2, 0.3, 0.4])
    want = en.log_resp(log_pi, alt, depth, adj, centers, emission, emission.np_fixed(alt, depth))
    got = en.log_resp(log_pi, alt, depth, adj, centers, emission, en.tables(emission, alt, depth, adj))
    assert (got == want).all()
    twice = [np.tile(x, (2, 1)) for x in (alt, depth, adj)]  # twice the mutations: no more counts to work on
    assert len(en.tables(emission, *twice).alt.value) == len(en.tables(emission, alt, depth, adj).alt.value)


def test_many_samples_or_distinct_counts_have_no_tables():
    rng = np.random.default_rng(4)
    emission = emission_of(CONFIGS["quantumclone_v1"])
    alt, adj = rng.random((50, 2)) * 9, np.ones((50, 2))
    assert isinstance(en.tables(emission, alt, alt + rng.random((50, 2)), adj), np.ndarray)
    wide = np.ones((500, 9))
    assert isinstance(en.tables(emission, wide, 2 * wide, wide), np.ndarray)
