"""Queries that fit a tumour in one group do the same by blocks once it is large."""

import pytest
from pyspark.sql.group import GroupedData

from clonal_spark import queries, whole_queries

SF = "/root/testdata/sf0.001"


def test_large_tumours_are_in_no_group(spark, monkeypatch):
    want = sorted((r.k, r.sample_id, r.center) for r in whole_queries.em_grouped_3(spark, SF).collect())
    got = sorted((r.k, r.sample_id, r.center) for r in whole_queries.em_grouped_3(spark, SF, most=150).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-6)

    fit = queries.QUERIES["fit_mobster"]
    want = {r.tumour_id: r for r in fit(spark, SF).collect()}
    monkeypatch.setattr(queries, "BLOCK_CELLS", 40)
    in_groups, run = [], GroupedData.applyInPandas

    def seen(self, *args):
        out = run(self, *args)
        in_groups.append(out)
        return out

    monkeypatch.setattr(GroupedData, "applyInPandas", seen)
    got = {r.tumour_id: r for r in fit(spark, SF).collect()}
    assert set(got) == set(want) and sum(f.count() for f in in_groups) == 0
    assert all((got[t].K, got[t].config) == (want[t].K, want[t].config) and got[t].ll == pytest.approx(want[t].ll, rel=1e-6) for t in want)
