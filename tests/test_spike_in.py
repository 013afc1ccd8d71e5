"""Spiked tumours with a program that draws counts."""

import numpy as np
import pytest

from clonal_spark.sources import spike_in as sp


def test_params_keep_to_the_prior(spark):
    rows = sp.params_table(spark, 300).collect()
    assert {r.n_clones for r in rows} == set(sp.CLONES) and {r.n_mutations for r in rows} == set(sp.MUTATIONS) and {r.n_samples for r in rows} == {1, 2, 3}
    assert all(20 <= r.depth <= 1000 and 0 < r.purity < 1 for r in rows) and np.mean([r.purity for r in rows]) == pytest.approx(5 / 7, abs=0.05)
    assert rows == sp.params_table(spark, 300).collect()


def test_spiked_counts_follow_the_plan(spark):
    params = spark.createDataFrame([(1, 3, 120, 2, 0.8, 90, 5), (2, 1, 40, 1, 0.6, 60, 6)], sp.PARAMS)
    positions = spark.createDataFrame([(i, f"chr{i % 22 + 1}", 1000 + i) for i in range(200)], "mut_id long, chrom string, pos long")

    def program(variants):
        assert list(variants.columns) == ["chrom", "pos", "vaf"] and (variants["pos"] - 1000 == np.arange(len(variants))).all()
        return np.round(variants["vaf"] * 200), np.full(len(variants), 200)

    got = sp.spike(params, positions, program).toPandas()
    assert got.groupby("tumour_id").size().to_dict() == {1: 240, 2: 40}
    want = (got["true_center"] * got["adj"]).clip(*sp.VAF_RANGE) * 200
    assert np.abs(got["alt"] - want).max() <= 0.5 and (got["depth"] == 200).all()
    assert (got[got["tumour_id"] == 2]["true_k"] == 0).all() and got["total_cn"].isin([1, 2, 3, 4]).all()


def test_command_needs_its_files(tmp_path):
    tools = sp.Tools("no-such-script", str(tmp_path / "reads"), str(tmp_path / "reference"))
    with pytest.raises(RuntimeError, match="no-such-script"):
        sp.command_program(tools, lambda *_: None)
    script = tmp_path / "script"
    script.write_text("#!/bin/sh\ncp \"$2\" \"$8\"\n")
    script.chmod(0o755)
    for name in ("reads", "reference"):
        (tmp_path / name).write_text("x")
    import pandas as pd

    run = sp.command_program(sp.Tools(str(script), str(tmp_path / "reads"), str(tmp_path / "reference")), lambda path, v: (open(path).read().split("\t")[3].strip(), len(v)))
    assert run(pd.DataFrame({"chrom": ["chr1"], "pos": [5], "vaf": [0.25]})) == ("0.25", 1)
