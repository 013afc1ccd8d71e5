"""The encoder trained over a table against the driver's form."""

import numpy as np
import pytest

from clonal_spark.config import CONFIG_NAMES, FEATURE_NAMES
from clonal_spark.plans import router as ro


def corpus(spark, tumours=40, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(tumours):
        x = rng.normal(size=len(FEATURE_NAMES)).tolist()
        for sc in ro.SC_NAMES:
            rows += [(t, x, sc, c, float(rng.random() + (1.0 if (x[0] > 0) == (i % 2 == 0) else 0.0))) for i, c in enumerate(CONFIG_NAMES[:4])]
    return spark.createDataFrame(rows, "tumour_id long, features array<double>, sc string, config string, score double")


def test_same_losses_and_weights_as_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(ro, "DROPOUT", 0.0)
    c = corpus(spark)
    x, y = ro.labelled(c)
    want, losses, _ = ro.train_encoder(x, y, epochs=5, batch=len(x), rate=0.01)
    got, own = ro.train_encoder_on(ro.best_of(c).repartition(3), epochs=5, rate=0.01, dropout=0.0)
    assert own == pytest.approx(losses, rel=1e-9) and own[-1] < own[0]
    for (a, b), (u, v) in zip(got.layers, want.layers, strict=True):
        assert a == pytest.approx(u, abs=1e-9) and b == pytest.approx(v, abs=1e-9)


def test_dropout_does_not_depend_on_partitions(spark):
    rows = ro.best_of(corpus(spark, 20))
    one, two = (ro.train_encoder_on(rows.repartition(n), epochs=3, batches=2, seed=4) for n in (1, 5))
    assert one[1] == pytest.approx(two[1], rel=1e-9) and one[0].layers[0][0] == pytest.approx(two[0].layers[0][0], abs=1e-9)
    kept = ro._kept(np.arange(2000), 1, 3, 0, 16, 0.1)
    assert abs((kept > 0).mean() - 0.9) < 0.01 and kept.max() == pytest.approx(1 / 0.9)


def test_gradient():
    rng = np.random.default_rng(3)
    params = [rng.normal(size=s) * 0.3 for s in ((21, 8), (8,), (8, 8), (8,), (8, 5), (5,), (5, 12), (12,))]
    x, y, d1, d2 = rng.normal(size=(7, 21)), rng.integers(0, 12, 7), (rng.random((7, 8)) > 0.3) / 0.7, (rng.random((7, 8)) > 0.3) / 0.7
    _, grads = ro.loss_and_gradient(params, x, y, d1, d2)
    for i, p in enumerate(params):
        at = tuple(rng.integers(0, n) for n in p.shape)
        up, down = [q.copy() for q in params], [q.copy() for q in params]
        up[i][at] += 1e-6
        down[i][at] -= 1e-6
        slope = (ro.loss_and_gradient(up, x, y, d1, d2)[0] - ro.loss_and_gradient(down, x, y, d1, d2)[0]) / 2e-6
        assert grads[i][at] == pytest.approx(slope, rel=1e-4, abs=1e-6)


def test_whole_router(spark):
    c = corpus(spark, 10)
    out = ro.train_router_on(c, epochs=2)
    assert out.n_train == 50 and len(out.train_losses) == 2 and out.router.counts.sum() == c.count()
    assert ro.train_router_on(c.limit(0), epochs=2).n_train == 0
