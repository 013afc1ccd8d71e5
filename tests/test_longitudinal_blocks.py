"""fit_longitudinal_clinical holds no tumour of over a million cells in one group, and blocks give what groups do."""

from test_cohort_fit import test_frontier_equals_groups as frontier_equals_groups

from clonal_spark import queries
from clonal_spark.plans.model import GenerativeModel


def test_longitudinal_clinical_goes_by_blocks(spark, monkeypatch):
    asked, fit_cohort = [], GenerativeModel.fit_cohort

    def seen(self, obs, block):
        asked.append(block)
        return fit_cohort(self, obs, block)

    monkeypatch.setattr(GenerativeModel, "fit_cohort", seen)
    rows = queries.QUERIES["fit_longitudinal_clinical"](spark, "/root/testdata/sf0.001").collect()
    assert asked == [queries.LARGER_BLOCKS["longitudinal_clinical"]] and len(rows) == 5


def test_its_blocks_equal_groups(spark, monkeypatch):
    frontier_equals_groups(spark, "longitudinal_clinical", monkeypatch)
