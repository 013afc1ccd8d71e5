"""A scoring run that is killed half-way goes on behind the batches it has stored."""

import pytest

from clonal_spark.plans import training as tr
from clonal_spark.sources import simulate as si


@pytest.fixture
def obs(spark, monkeypatch):
    monkeypatch.setattr(tr, "active_configs", lambda *_: ["quantumclone_v1", "mobster", "decifer_style"])
    keys = [c.split()[0] for c in si.PARAMS.split(", ")]
    params = spark.createDataFrame([tuple((si.draw_params(i, 42) | {"n_mutations": 40, "n_samples": 1})[k] for k in keys) for i in range(6)], si.PARAMS)
    from clonal_spark.session import Scratch

    return Scratch(spark, "test-log").write(si.simulate(params), "obs")


def test_killed_and_restarted(spark, obs, tmp_path, monkeypatch):
    path, score = str(tmp_path / "scores"), tr.score_tumours
    asked = []

    def dies(part, *more):
        asked.append({r.tumour_id for r in part.select("tumour_id").distinct().collect()})
        if sum(map(bool, asked)) > 2:
            raise KeyboardInterrupt
        return score(part, *more)

    monkeypatch.setattr(tr, "score_tumours", dies)
    with pytest.raises(KeyboardInterrupt):
        tr.score_logged(obs, path, None, tumours=1)
    stored = {(r.tumour_id, r.config, r.sc): r.score for r in tr.stored_scores(spark, path).collect()}
    finished = set().union(*asked[:-1])
    assert {t for t, *_ in stored} == finished and len(stored) == 15 * len(finished) and 0 < len(finished) < 6

    fits = []
    tasks = tr.score_tasks
    monkeypatch.setattr(tr, "score_tumours", score)
    monkeypatch.setattr(tr, "score_tasks", lambda o, t, *a: fits.extend((r.tumour_id, r.config) for r in t.collect()) or tasks(o, t, *a))
    whole = tr.score_logged(obs, path, None, tumours=1)
    assert {t for t, _ in fits} == set(range(6)) - finished and len(fits) == len(set(fits)) == 3 * (6 - len(finished))
    got = {(r.tumour_id, r.config, r.sc): r.score for r in whole.collect()}
    assert len(got) == whole.count() == 6 * 15 and all(got[k] == v for k, v in stored.items())
    rows = spark.read.parquet(path).count()
    fits.clear()
    assert tr.score_logged(obs, path, None, tumours=2).count() == 90 and spark.read.parquet(path).count() == rows and not fits


def test_skipped_scores_give_way_to_real_ones(spark, obs, tmp_path):
    """With a margin that skips every other configuration, then without one."""
    path = str(tmp_path / "scores")
    first = tr.score_logged(obs, path, -0.5, tumours=3)
    assert first.count() == 90 and first.where("eliminated").count() > 0
    again = tr.score_logged(obs, path, None, tumours=3)
    assert again.count() == 90 and again.where("eliminated").isEmpty()
