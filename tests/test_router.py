"""Scores, simulation, routing and the online loop."""

import numpy as np
import pytest

from clonal_spark.config import CONFIG_NAMES, FEATURE_NAMES
from clonal_spark.operators import features as fe
from clonal_spark.operators import scoring as sg
from clonal_spark.plans import engines as en
from clonal_spark.plans import router as ro
from clonal_spark.plans import training as tr
from clonal_spark.plans.auto import RoutedModel
from clonal_spark.sources import observations as ob
from clonal_spark.sources import simulate as si
from clonal_spark.streaming.online import OnlineTrainer, reward_average, tumour_stream


def fit_of(centers, assigned, parents=None):
    c = np.array(centers, float).reshape(len(centers), -1)
    return en.Fit(c, np.zeros((len(assigned), len(c))), np.array(assigned), 0.0, 0.0, len(c), 1, True, parents)


def test_score_formulas():
    truth = np.repeat([0, 1], 50)
    one = tr.score_fit(fit_of([[0.6]], [0] * 100), truth, np.array([[0.8], [0.4]]), 0.8)
    assert one["SC1B"] == pytest.approx(0.8) and one["SC2A"] == 0.5 and one["SC3"] == 0.25 and one["SC1A"] == pytest.approx(0.8)
    perfect = tr.score_fit(fit_of([[0.8], [0.4]], truth, np.array([-1, 0])), truth, np.array([[0.8], [0.4]]), 0.8)
    assert all(v == pytest.approx(1) for v in perfect.values())
    tail = np.append(np.repeat([0, 1], 40), [2] * 20)
    assert tr.score_fit(fit_of([[0.8], [0.4]], np.append(np.repeat([0, 1], 40), [0] * 20)), tail, np.array([[0.8], [0.4]]), 0.8)["SC2B"] == pytest.approx(1)


def test_v_measure_forms_agree(spark):
    rng = np.random.default_rng(0)
    t, e = rng.integers(0, 4, 300), rng.integers(0, 3, 300)
    df = spark.createDataFrame([(0, i, int(a), int(b), 4) for i, (a, b) in enumerate(zip(t, e))], "tumour_id long, mut_id long, true_k int, est_k int, n_true int")
    assert sg.v_measure(df).first().v_measure == pytest.approx(tr.np_v_measure(t, e), rel=1e-9)


def test_simulator(spark):
    p = dict(tumour_id=1, n_clones=3, n_mutations=300, n_samples=2, purity=0.8, depth=100, seed=9, **dict.fromkeys(si.NOISE, 0.0))
    a, b = (si.simulate_one(p, np.array([0.5, 0.3, 0.2])) for _ in range(2))
    assert a.equals(b) and len(a) == 600
    assert (a.drop_duplicates("mut_id")["true_k"].value_counts().sort_index() == [150, 90, 60]).all()
    assert a[a["true_k"] == 0]["true_center"].unique() == pytest.approx([0.8]) and (a["alt"] <= a["depth"]).all()
    tail = si.simulate_one(p | {"tail_frac": 0.3, "tail_shape": 1.0})
    assert set(tail["true_k"]) == {0, 1, 2, 3} and (tail["true_k"] == 3).sum() == 180
    with pytest.raises(ValueError):
        si.simulate_one(p, np.array([0.5, 0.5]))
    params = si.params_table(spark, 6)
    assert sorted(map(tuple, params.collect())) == sorted(map(tuple, si.params_table(spark, 6).repartition(3).collect()))
    assert si.true_tree(params).where("parent = -1").count() == params.where("n_clones > 1").count()


@pytest.fixture(scope="module")
def cohort(spark):
    rows = [si.draw_params(i, 5) | {"n_mutations": 80, "n_samples": 1} for i in range(4)]
    names = ("tumour_id", "n_clones", "n_mutations", "n_samples", "purity", "depth", "seed", *si.NOISE)
    return si.simulate(spark.createDataFrame([tuple(r[k] for k in names) for r in rows], si.PARAMS))


def test_features(spark):
    alt = np.full((500, 1), 30.0)
    adj = np.ones((500, 1))
    adj[:50], adj[50:80] = 0.7, 1.3
    rng = np.random.default_rng(1)
    f = fe.meta_features(ob.from_arrays(spark, rng.binomial(100, 0.3, (500, 1)), np.full((500, 1), 100.0), adj)).first()
    assert f.depth_median == 100 and f.frac_cna == pytest.approx(0.16) and f.n_mutations == 500 and list(f.asDict())[1:] == FEATURE_NAMES
    same = fe.meta_features(ob.from_arrays(spark, alt, np.full((500, 1), 100.0))).first()
    assert all(v is not None for v in same)


def test_resume_and_elimination(spark, cohort):
    done = spark.createDataFrame([(0, "mobster", "SC1A", 0.3)], tr.SCORES)
    tasks = tr.tasks_of(cohort, ["mobster", "pyclone_vi"])
    assert ob.todo(tasks, done).count() == 7
    good = spark.createDataFrame([(t, "mobster", s, 0.9 if t else 0.7) for t in (0, 1) for s in ro.SC_NAMES], tr.SCORES)
    assert [r.tumour_id for r in sg.eliminated(good).collect()] == [1]


def test_heads_and_encoder():
    rng = np.random.default_rng(2)
    router = ro.MetaRouter(seed=3)
    assert router.n_heads == 60 and router.predict(np.zeros(21), "SC1A") == "quantumclone_v1"
    x = rng.standard_normal((40, 21))
    before = router.uncertainty(x[0], "SC2B")["mobster"]
    for row in x:
        router.update(row, "mobster", "SC2B", 1.0)
    assert router.uncertainty(x[0], "SC2B")["mobster"] < before and router.predict(x[0], "SC2B") == "mobster"
    # integrated gradients sum to f(x) - f(0)
    mu = router.posterior()[0][CONFIG_NAMES.index("mobster"), 3]
    f = lambda v: float(router.encoder.forward(v[None])[0] @ mu)
    assert sum(router.explain(x[1], "SC2B", n_steps=2000).values()) == pytest.approx(f(x[1]) - f(np.zeros(21)), abs=2e-2)
    labels = (x[:, 0] > 0).astype(int)
    _, losses, _ = ro.train_encoder(x, labels, epochs=60, rate=5e-3)
    assert losses[-1] < 0.6 * losses[0]


def test_training_and_regret(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for t in range(20):
        x = rng.standard_normal(21).tolist()
        for s in ro.SC_NAMES:
            rows += [(t, x, s, c, 1.0 if c == "mobster" else 0.1) for c in CONFIG_NAMES]
    corpus = spark.createDataFrame(rows, "tumour_id long, features array<double>, sc string, config string, score double")
    result = ro.train_router(corpus, epochs=5)
    assert result.n_train == 100 and result.router.counts.sum() == 1200
    one = ro.MetaRouter(result.router.encoder)
    for t, x, s, c, y in rows:
        one.update(x, c, s, y)
    assert one.precision == pytest.approx(result.router.precision) and one.zy == pytest.approx(result.router.zy)
    chosen = result.router.select_table(corpus.select("tumour_id", "features").distinct())
    assert sg.oracle_regret(corpus, chosen.select("tumour_id", "sc", "selected")).first().regret == pytest.approx(0)
    result.router.save(spark, str(tmp_path / "router"))
    again = ro.MetaRouter.load(spark, str(tmp_path / "router"))
    assert again.predict(rows[0][1], "SC3") == "mobster" and again.zy == pytest.approx(one.zy)


def test_routed_fit(spark, cohort):
    out = RoutedModel().fit(cohort)
    assert {r.config for r in out.fits.collect()} == {"quantumclone_v1"}


def test_online_loop_resumes(spark, cohort, tmp_path):
    source = str(tmp_path / "tumours")
    for t in range(3):
        cohort.where(f"tumour_id = {t}").coalesce(1).write.mode("append").parquet(source)
    allowed = set(CONFIG_NAMES) - {"quantumclone_v1", "mobster"}
    for _ in range(2):
        trainer = OnlineTrainer(ro.MetaRouter(seed=1), str(tmp_path / "out"), exclude=allowed)
        trainer.resume(spark)
        query = trainer.start(tumour_stream(spark, source), str(tmp_path / "checkpoint"))
        query.awaitTermination(240)
        assert query.exception() is None
        scores = spark.read.parquet(str(tmp_path / "out/scores"))
        assert scores.count() == 15 and scores.groupBy("tumour_id").agg({"config": "count"}).count() == 3
    assert trainer.router.counts.sum() == 15


def test_reward_average(spark, tmp_path):
    rows = [("a", i, float(i % 2)) for i in range(20)]
    spark.createDataFrame(rows, "config string, seq long, reward double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("config string, seq long, reward double").parquet(str(tmp_path / "in"))
    query = reward_average(stream).writeStream.outputMode("update").format("memory").queryName("averages").trigger(availableNow=True).start()
    query.awaitTermination(120)
    value = 0.0
    for _, _, r in rows:
        value = 0.99 * value + 0.01 * r
    assert spark.table("averages").first().average == pytest.approx(value)


def test_stores(spark, cohort, tmp_path):
    facts = si.generate_tumours(spark, str(tmp_path / "g"), 2, 1, seed=3)
    assert facts["n_total"] == 4 and si.generate_tumours(spark, str(tmp_path / "g"), 9) == facts
    assert ob.read_tumours(spark, str(tmp_path / "g/tumours")).select("tumour_id").distinct().count() == 4
    index = spark.createDataFrame([("chr1", 10**6), ("chr2", 2 * 10**6)], "name string, length long")
    drawn = ob.sample_positions(spark, index, 50, 1).collect()
    assert len(drawn) == 50 and all(10_000 <= r.pos < 2 * 10**6 - 10_000 for r in drawn)
    assert not ob.spike_in_available()
