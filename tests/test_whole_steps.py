"""Steps over whole cohorts against NumPy and their SQL, trees with cycles, own axes, traces and stores."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from clonal_spark import whole_queries as wq
from clonal_spark.config import CloneConfig, EmissionModel, InferenceEngine, KPrior, NoiseModel, PhyloMode
from clonal_spark.functions.emission import Binomial
from clonal_spark.operators import features as fe
from clonal_spark.operators import mixture as mo
from clonal_spark.operators import phylo as ph
from clonal_spark.plans import engines as en
from clonal_spark.plans.model import GenerativeModel
from clonal_spark.plans.training import score_tasks
from clonal_spark.sources import observations as ob

SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(wq.ORACLE_SQL.keys() & wq.QUERIES.keys()))
def test_query_equals_its_sql(spark, name):
    with duckdb.connect() as con:
        con.execute("SET timezone = 'UTC'")
        for table in ("nation", "supplier", "part", "lineitem", "events", "embeddings"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        got = wq.QUERIES[name](spark, SF)
        want = con.execute(wq.ORACLE_SQL[name]).df().to_dict("records")
    columns = sorted(got.columns)
    assert columns == sorted(want[0])
    assert plain([r.asDict() for r in got.collect()], columns) == plain(want, columns)


def test_merging_is_that_of_arrays(spark):
    rng = np.random.default_rng(4)
    centers = np.repeat(rng.random((4, 2)), [3, 1, 2, 2], 0) + rng.normal(0, 0.002, (8, 2))
    resp = rng.dirichlet(np.array([5, 4, 3, 0.02, 6, 2, 4, 1]), 200)
    fit = en.merge_and_prune(en.Fit(centers, resp, resp.argmax(1), 0.0, 0.0, 8, 1, True), 200, 0.01)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    cells = frame([(1, k, f"s{i}", float(centers[k, i])) for k in range(8) for i in range(2)], "tumour_id long, k int, sample_id string, center double")
    weights = frame([(1, m, k, float(resp[m, k])) for m in range(200) for k in range(8)], "tumour_id long, mut_id long, k int, r double")
    clones, moved = mo.merge_and_prune(cells, weights)
    got = clones.toPandas().pivot_table(index="k", columns="sample_id", values="center").to_numpy()
    assert got == pytest.approx(fit.centers, abs=1e-9)
    assert moved.toPandas().pivot_table(index="mut_id", columns="k", values="r").to_numpy() == pytest.approx(fit.resp, abs=1e-9)


def test_one_clone_stays_where_all_are_small(spark):
    clones, moved = mo.merge_and_prune(
        spark.createDataFrame([(1, k, "s", 0.1 * k) for k in range(1, 4)], "tumour_id long, k long, sample_id string, center double"),
        spark.createDataFrame([(1, m, k, 1 / 3) for m in range(9) for k in range(1, 4)], "tumour_id long, mut_id long, k long, r double"),
        least=0.5,
    )
    assert clones.count() == 1 and {round(r.r, 9) for r in moved.collect()} == {1.0}


def test_depths_of_deep_trees_and_cycles(spark):
    schema = "tumour_id long, k long, parent long"
    chain = [(1, k, k - 1) for k in range(60)] + [(2, 5, -1), (2, 6, 5), (2, 9, 8)]
    got = {(r.tumour_id, r.k): r.depth for r in ph.depths(spark.createDataFrame(chain, schema)).collect()}
    assert got == {**{(1, k): k for k in range(60)}, (2, 5): 0, (2, 6): 1}
    with pytest.raises(Exception, match="cycle"):
        ph.depths(spark.createDataFrame([(1, 0, -1), (1, 1, 2), (1, 2, 1)], schema)).collect()
    assert ph.depths(spark.createDataFrame([], schema)).count() == 0


def test_purity_of_equal_fractions(spark):
    rows = spark.createDataFrame([(1, 0.7)] * 6 + [(2, 0.7)] * 4 + [(3, 0.1)] * 6, "tumour_id long, ccf double")
    assert {r.tumour_id: r.purity_estimate for r in fe.kde_purity(rows).collect()} == {1: 0.7, 2: 0.5, 3: 0.5}


def test_axes_of_ones_own(spark):
    """Classes within the test, as workers cannot import it."""

    class Two:
        """A prior of one's own: always two clones."""

        def schedule(self, config):
            return [2]

        def select(self, config, fits, n_mut):
            return fits[0]

    class Chain:
        def parents(self, centers):
            return np.arange(len(centers)) - 1

    class Deep:
        def mask(self, config, alt, depth):
            return depth[:, 0] >= 50

    class Halved(Binomial):
        pass

    rng = np.random.default_rng(5)
    depth = np.where(np.arange(120) % 10 == 0, 20, 100)
    alt = rng.binomial(depth, np.repeat([0.2, 0.5], 60))
    config = CloneConfig(emission=Halved, inference=en.em, k_prior=Two(), phylo=Chain(), noise=Deep())
    fit = GenerativeModel(config).fit(ob.from_arrays(spark, alt, depth)).fits.first()
    assert fit.K == 2 and fit.parents == [-1, 0] and fit.kept == (depth >= 50).tolist() and sorted(c[0] for c in fit.centers) == pytest.approx([0.2, 0.5], abs=0.03)
    with pytest.raises(NotImplementedError):
        GenerativeModel(config).fit_one(ob.from_arrays(spark, alt, depth))


def test_k_in_own_groups_and_traces(spark):
    rng = np.random.default_rng(6)
    depth = np.full((160, 2), 90)
    alt = rng.binomial(depth, np.repeat([[0.2, 0.3], [0.5, 0.1]], 80, 0))
    config = CloneConfig(emission=EmissionModel.BINOMIAL, inference=InferenceEngine.EM, k_prior=KPrior.BIC, phylo=PhyloMode.POST_HOC, noise=NoiseModel.ARTEFACT)
    want = en.fit_arrays(config, alt, depth)
    found = GenerativeModel(config).fit(ob.from_arrays(spark, alt, depth))
    got = found.fits.first()
    assert (got.K, got.n_iter, got.assignments, got.parents) == (want.k, want.n_iter, want.assignments.tolist(), want.parents.tolist())
    assert np.array(got.resp) == pytest.approx(want.resp, abs=1e-12) and got.bic == pytest.approx(want.bic)
    steps = found.convergence.orderBy("iteration").collect()
    assert [r.iteration for r in steps] == list(range(1, want.n_iter + 1)) and [r.value for r in steps] == pytest.approx(want.trace)


def test_failed_fits_leave_their_message(spark):
    rows = [(1, m, "a", 5.0, 10.0, 1.0, 2.0, 0, None) for m in range(5)]
    obs = spark.createDataFrame(rows, "tumour_id long, mut_id long, sample_id string, alt double, depth double, adj double, total_cn double, true_k int, true_center double")
    got = score_tasks(obs, spark.createDataFrame([(1, "quantumclone_v1")], "tumour_id long, config string")).collect()
    assert len(got) == 5 and all(r.score == 0 and r.error for r in got)


def test_store_reads_some_folders(spark, tmp_path):
    rows = pd.DataFrame({"tumour_id": np.repeat(np.arange(200), 2), "mut_id": np.tile([0, 1], 200), "alt": 1.0})
    ob.write_tumours(spark.createDataFrame(rows), str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("folder=*"))) == ob.FOLDERS
    some = ob.read_tumours(spark, str(tmp_path / "t"), [3, 67, 150])
    assert {r.tumour_id for r in some.collect()} == {3, 67, 150} and "PartitionFilters: [folder" in some._jdf.queryExecution().toString().replace("isnotnull(folder", "folder")
    assert ob.read_tumours(spark, str(tmp_path / "t")).count() == 400


def test_colours_begin_anew(spark):
    from clonal_spark.operators import plots as pl

    got = {r.k: r.colour for r in pl.clone_colours(spark.createDataFrame([(k,) for k in (-1, 0, 11, 12, 25, None)], "k int")).collect()}
    p = pl.CLONE_PALETTE
    assert got == {-1: None, 0: p[0], 11: p[11], 12: p[0], 25: p[1], None: None}
