"""A whole small run through the command line's functions."""

import os

from clonal_spark import cli
from clonal_spark.plans import evaluate as ev
from clonal_spark.plans import router as ro
from clonal_spark.plans import training as tr
from clonal_spark.sources import observations as ob
from clonal_spark.sources import simulate as si


def test_run(spark, tmp_path, monkeypatch):
    small = lambda s, n, seed=42, noise=True: s.createDataFrame([tuple((si.draw_params(i, seed) | {"n_mutations": 60, "n_samples": 1})[k] for k in [c.split()[0] for c in si.PARAMS.split(", ")]) for i in range(n)], si.PARAMS)
    monkeypatch.setattr(si, "params_table", small)
    monkeypatch.setattr(tr, "active_configs", lambda *_: ["quantumclone_v1", "mobster", "decifer_style"])
    path = str(tmp_path / "run")
    cli.generate(spark, path, 4, 0, 1)
    cli.score(spark, path, 0.25)
    first = spark.read.parquet(f"{path}/scores").count()
    assert first == 4 * 3 * 5
    cli.score(spark, path, 0.25)  # nothing is left to do
    assert spark.read.parquet(f"{path}/scores").count() == first
    assert cli.train(spark, path, 3, 1).n_train > 0
    found = cli.evaluate(spark, path, str(tmp_path / "report"))
    assert os.path.exists(tmp_path / "report/report.json") and found["regret"]["n"] == 20 and found["regret"]["regret"] >= 0
    assert len(found["selection_counts"]) == 60 and len(found["attributions"]["SC1A"]) == 10
    line = ev.cumulative_regret(ro.MetaRouter(seed=2), tr.assemble_corpus(ob.read_tumours(spark, f"{path}/tumours"), spark.read.parquet(f"{path}/scores")))
    assert len(line) == 20 and all(b >= a - 1e-12 for a, b in zip(line, line[1:]))
