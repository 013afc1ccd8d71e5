"""Every preset fitted in one group and in distributed form."""

import numpy as np
import pytest

from clonal_spark.config import CONFIGS, InferenceEngine
from clonal_spark.plans import engines as en
from clonal_spark.plans.model import GenerativeModel, distributed_fit
from clonal_spark.sources.observations import from_arrays


def cells():
    rng = np.random.default_rng(11)
    p = np.repeat([[0.45, 0.4], [0.2, 0.005], [0.005, 0.25], [0.03, 0.04]], [60, 40, 40, 20], 0)
    depth = rng.integers(60, 140, p.shape).astype(float)
    return rng.binomial(depth.astype(int), p).astype(float), depth, np.where(rng.random(p.shape) < 0.8, 2.0, 3.0)


@pytest.mark.parametrize("name", [n for n in CONFIGS if n != "phyloclone_style"])
def test_both_forms_are_equal(spark, name, monkeypatch):
    """Both with few iterations, as each is a job."""
    em, mfvi = en.em, en.mfvi
    monkeypatch.setattr(en, "HYBRID_EM", 3)
    monkeypatch.setattr(en, "mfvi", lambda *a: mfvi(*a, max_iter=6))
    monkeypatch.setitem(en.ENGINES, InferenceEngine.EM, lambda *a: em(*a, max_iter=6))
    monkeypatch.setitem(en.ENGINES, InferenceEngine.MFVI, en.mfvi)
    alt, depth, cn = cells()
    config = CONFIGS[name]
    a = en.fit_arrays(config, alt, depth, None, cn)
    b = distributed_fit(from_arrays(spark, alt, depth, None, cn), config, max_iter=6)
    assert b["K"] == a.k and b["ll"] == pytest.approx(a.ll, rel=1e-6) and b["bic"] == pytest.approx(a.bic, rel=1e-6)
    assert b["centers"] == pytest.approx(a.centers, abs=1e-4)
    assert (a.parents is None) == (b["parents"] is None) and (a.parents is None or list(a.parents) == list(b["parents"]))
    rows = b["assigned"].orderBy("mut_id").collect()
    assert [r.k for r in rows] == a.assignments.tolist()
    assert [r.kept for r in rows] == (np.ones(len(alt), bool) if a.mask is None else a.mask).tolist()
    assert np.array([r.resp for r in rows]) == pytest.approx(a.resp, abs=1e-4)


def test_the_sampler_is_refused(spark):
    alt, depth, _ = cells()
    with pytest.raises(NotImplementedError):
        GenerativeModel("phyloclone_style").fit_one(from_arrays(spark, alt, depth))
