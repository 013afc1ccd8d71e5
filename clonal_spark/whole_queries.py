"""Queries over whole cohorts, selection, merging, noise and tree steps and stores, each with its DuckDB SQL."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonal_spark.config import CONFIG_NAMES, CONFIGS, DEFAULT_EXCLUDE_CONFIGS, FEATURE_NAMES, CloneConfig, EmissionModel, InferenceEngine, KPrior, NoiseModel, PhyloMode
from clonal_spark.functions import mathx as mx
from clonal_spark.functions.emission import EMISSIONS
from clonal_spark.operators import features as fe
from clonal_spark.operators import mixture as mo
from clonal_spark.operators import noise as no
from clonal_spark.operators import phylo as ph
from clonal_spark.operators import plots as pl
from clonal_spark.operators import scoring as sg
from clonal_spark.operators.selection import exact_quantiles
from clonal_spark.oracle import _BINOMIAL, _CHOOSE, _FEATURES, _MU, _VAF, CTES, _clip, _e_step, _kde, _rounded, sql, unrolled
from clonal_spark.plans import engines as en
from clonal_spark.plans.cohort import fit_large
from clonal_spark.plans.model import dense, distributed_fit
from clonal_spark.plans.router import active_configs
from clonal_spark.plans.training import PILOTS, assemble_corpus, tasks_of
from clonal_spark.queries import BLOCK_CELLS, Query, _centers7, _corpus, _labels, _obs, _round, _table, _whole_encoded
from clonal_spark.sources import observations as ob
from clonal_spark.streaming import online
from clonal_spark.session import Scratch

BINOMIAL = EmissionModel.BINOMIAL
THREE = CloneConfig(emission=BINOMIAL, inference=InferenceEngine.EM, k_prior=KPrior.FIXED, phylo=PhyloMode.NONE, noise=NoiseModel.NONE, n_clones=3)


def _cohort(spark, sf):
    """A tumour a supplier, with all its samples, and copy numbers that differ between them."""
    return ob.from_lineitem(spark, sf, tumour="supplier", subclonal=True)


def _five(spark, sf):
    """The dense table dealt to five tumours."""
    return _obs(spark, sf).withColumn("tumour_id", F.pmod("mut_id", F.lit(5)).cast("long"))


def _resp_of(obs: DataFrame, params: DataFrame) -> DataFrame:
    return mo.e_step(mo.log_likelihoods(obs, params, EMISSIONS[BINOMIAL]()), mo.uniform_weights(params))


def _fifteen(spark, sf) -> tuple[DataFrame, DataFrame]:
    obs = _five(spark, sf)
    params = mo.quantile_init(obs, 15)
    return params, _resp_of(obs, params)


# --- cohorts of several samples ---


def ccf_projection_all_samples(spark, sf):
    rows = _cohort(spark, sf).withColumn("vaf", mo.vaf())
    return _round(rows.select("tumour_id", "mut_id", "sample_id", mo.ccf(F.col("vaf"), F.col("adj")).alias("ccf")), 9, "ccf")


def depth_stats_all_samples(spark, sf):
    return _round(fe.depth_stats(fe.shaped(_cohort(spark, sf))), 6, "depth_median", "depth_cv", "frac_low_depth")


def cn_landscape_all_samples(spark, sf):
    names = ["frac_cna", "ploidy", "n_cn_states", "frac_loh", "subclonal_cn", "wgd"]
    return _round(fe.cn_landscape(_cohort(spark, sf)).select("tumour_id", *names), 6, *names)


def vaf_shape_all_samples(spark, sf):
    names = ["skewness", "kurtosis", "clonal_peak_width"]
    return _round(fe.shape_stats(fe.shaped(_cohort(spark, sf))).select("tumour_id", *names), 6, *names)


def tail_test_all_samples(spark, sf):
    return fe.shape_stats(fe.shaped(_cohort(spark, sf))).select("tumour_id", "has_pareto_tail")


def kde_peaks_all_samples(spark, sf):
    return fe.kde_peaks(fe.shaped(_cohort(spark, sf)))


def kde_purity_all_samples(spark, sf):
    return _round(fe.kde_purity(fe.shaped(_cohort(spark, sf))), 6, "purity_estimate")


def meta_features_whole(spark, sf):
    """All features; mappability is the mean of 0.863 and 1 by parity of the mutation."""
    return _round(fe.meta_features(_cohort(spark, sf), F.lit(1.0) - 0.137 * (F.col("mut_id") % 2)), 6, *FEATURE_NAMES)


def feature_vectors(spark, sf):
    """The features as vectors in the fixed order, one row per component."""
    return _round(fe.as_vector(fe.meta_features(_cohort(spark, sf))).select("tumour_id", F.posexplode("features").alias("i", "value")), 6, "value")


# --- selection, merging and pruning ---


def bic_sweep_cohort(spark, sf):
    return _round(mo.bic_sweep(_five(spark, sf), list(range(1, 11)), EMISSIONS[BINOMIAL]()), 3, "log_lik", "bic")


def min_bic_select(spark, sf):
    return _round(mo.least_bic(mo.bic_sweep(_five(spark, sf), list(range(1, 11)), EMISSIONS[BINOMIAL]())), 3, "log_lik", "bic")


def quantiles_selected(spark, sf):
    """Quantile centers of every tumour and sample by selection over small bins, in place of sorting a group's values."""
    levels = [i / 16 for i in range(1, 16)]
    found = exact_quantiles(_cohort(spark, sf).withColumn("v", mo.vaf()), ["tumour_id", "sample_id"], "v", levels, buckets=16, few=8)
    return _round(found.select("tumour_id", "sample_id", F.posexplode("q").alias("i", "value")), 9, "value")


def depth_quantiles_selected(spark, sf):
    """Depth quantiles of the whole table at a fixed sample, whose groups are as large as the table's third."""
    rows = _table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    found = exact_quantiles(rows, ["l_returnflag"], "l_extendedprice", [0.0, 0.05, 0.5, 0.95, 1.0])
    return _round(found.select(F.col("l_returnflag").alias("sample_id"), F.posexplode("q").alias("i", "value")), 6, "value")


def merge_test(spark, sf):
    """Pairs of clones by their largest distance over samples."""
    params = mo.quantile_init(_five(spark, sf), 15)
    far = ph._pairs(params).groupBy("tumour_id", "k", "other").agg(F.max(F.abs(F.col("center") - F.col("other_center"))).alias("gap"))
    return _round(far.withColumn("merges", F.col("gap") < en.MERGE), 9, "gap")


def merge_places(spark, sf):
    return mo.merge_places(_fifteen(spark, sf)[0], 0.02)


def merge_prune(spark, sf):
    return _round(mo.merge_and_prune(*_fifteen(spark, sf), 0.05, 0.02)[0], 7, "share", "center")


def merge_prune_assign(spark, sf):
    return _round(mo.hard_assign(mo.merge_and_prune(*_fifteen(spark, sf), 0.05, 0.02)[1]), 6, "r")


def dirichlet_update(spark, sf):
    return _round(mo.dirichlet_update(_resp_of(_five(spark, sf), mo.quantile_init(_five(spark, sf), 3))), 6, "alpha", "expected_log_pi")


def dirichlet_kl(spark, sf):
    alphas = mo.dirichlet_update(_resp_of(_five(spark, sf), mo.quantile_init(_five(spark, sf), 3)))
    return _round(mo.dirichlet_kl(alphas), 4, "kl")


def stick_weights(spark, sf):
    return _round(mo.stick_weights(mo.quantile_init(_five(spark, sf), 15).where("sample_id = 'A'").select("tumour_id", "k", F.col("center").alias("v"))), 9, "weight")


def digamma_depth(spark, sf):
    return _obs(spark, sf).select("mut_id", "sample_id", F.round(mx.digamma(F.col("depth") / 10 + 0.05), 9).alias("digamma"))


def logsumexp_alt(spark, sf):
    return _obs(spark, sf).groupBy("mut_id").agg(F.round(mx.logsumexp(F.collect_list(F.col("alt") / 10)), 9).alias("total"))


# --- loops, unrolled in SQL ---


def em_distributed_3(spark, sf):
    """Three rounds of the distributed loop at a fixed K."""
    fit = distributed_fit(_obs(spark, sf), THREE, max_iter=3)
    rows = [(k, s, float(fit["centers"][k][i])) for k in range(3) for i, s in enumerate(fit["samples"])]
    return _round(spark.createDataFrame(rows, "k int, sample_id string, center double"), 7, "center")


def em_trace_3(spark, sf):
    fit = distributed_fit(_obs(spark, sf), THREE, max_iter=3)
    return _round(spark.createDataFrame([(t["iteration"], t["value"]) for t in fit["trace"]], "iteration int, log_lik double"), 3, "log_lik")


def em_grouped_3(spark, sf, most: int = BLOCK_CELLS):
    """Three rounds of the loop in a group each; tumours of more than `most` cells by blocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        _, _, names, a = dense(rows)
        fit = en.em(THREE, a["alt"], a["depth"], a["adj"], en.initial_centers(a["alt"], a["depth"], 3), max_iter=3)
        return pd.DataFrame([(k, s, fit.centers[k, i]) for k in range(3) for i, s in enumerate(names)], columns=["k", "sample_id", "center"])

    obs = _obs(spark, sf)
    large = Scratch(spark, "large").write(obs.groupBy("tumour_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("tumour_id"), "ids")
    rows = obs.join(large, "tumour_id", "left_anti").groupBy("tumour_id").applyInPandas(run, "k int, sample_id string, center double")
    if not large.isEmpty():
        rows = rows.unionByName(fit_large(obs.join(large, "tumour_id", "left_semi"), THREE, block=most, max_iter=3).centers.select("k", "sample_id", "center"))
    return _round(rows, 7, "center")


def mfvi_distributed_2(spark, sf):
    """Two rounds of the variational loop at a fixed K."""
    config = CloneConfig(emission=BINOMIAL, inference=InferenceEngine.MFVI, k_prior=KPrior.FIXED, phylo=PhyloMode.NONE, noise=NoiseModel.NONE, n_clones=3)
    fit = distributed_fit(_obs(spark, sf), config, max_iter=2)
    rows = [(k, s, float(fit["centers"][k][i])) for k in range(3) for i, s in enumerate(fit["samples"])]
    return _round(spark.createDataFrame(rows, "k int, sample_id string, center double"), 7, "center")


def cohort_fit_3(spark, sf):
    """Three rounds of the frontier over five tumours, most of them in several blocks."""
    fit = fit_large(_five(spark, sf), THREE, block=600, max_iter=3)
    rows = fit.centers.join(fit.fit_summary.select("tumour_id", "ll"), "tumour_id")
    return _round(_round(rows, 7, "center"), 3, "ll")


def cohort_fit_assigned_3(spark, sf):
    """What each mutation is assigned to by the same fit, and its largest responsibility."""
    fit = fit_large(_five(spark, sf), THREE, block=600, max_iter=3)
    top = fit.responsibilities.groupBy("tumour_id", "mut_id").agg(F.max("r").alias("r"))
    return _round(fit.assignments.join(top, ["tumour_id", "mut_id"]).select("tumour_id", "mut_id", "k", "r"), 6, "r")


def preset_quantumclone_v1_2(spark, sf):
    """The whole preset at two iterations: K = 1..10, selection by BIC and the greedy tree, five tumours in blocks."""
    fit = fit_large(_five(spark, sf), CONFIGS["quantumclone_v1"], "quantumclone_v1", block=600, max_iter=2)
    chosen = fit.fit_summary.select("tumour_id", F.col("K").alias("n_clones"), "ll", "bic")
    rows = fit.centers.join(chosen, "tumour_id").join(fit.tree_edges, ["tumour_id", "k"])
    return _round(_round(rows, 7, "center"), 3, "ll", "bic")


def fit_tasks_active(spark, sf):
    """Fits of a whole corpus: every tumour with each configuration that is not left out, without those that a pilot has."""
    tasks = tasks_of(_cohort(spark, sf), active_configs())
    return tasks.where(~F.col("config").isin(list(PILOTS)))


def corpus_assembled(spark, sf):
    """Training rows: the features of each tumour with its scores, those of unknown configurations left out."""
    scores = _corpus(spark, sf).select("tumour_id", "sc", F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(sorted({"click", "error", "purchase", "signup"})) for x in (c, CONFIG_NAMES[i]))), F.col("config")).alias("config"), "score")
    rows = assemble_corpus(_cohort(spark, sf), scores.where("config IS NOT NULL"))
    return _round(rows.select("tumour_id", "sc", "config", "score", F.posexplode("features").alias("i", "value")), 6, "score", "value")


# --- noise ---


def tail_weight_em(spark, sf):
    return _round(no.tail_weights(_five(spark, sf), 4), 7, "tau")


def artefact_reassign(spark, sf):
    centers = _centers7(spark, sf)
    return no.reassign(_resp_of(_obs(spark, sf), centers), no.presence_partners(centers, 0.45))


# --- trees ---


def plot_tree_places(spark, sf):
    return _round(ph.layout(ph.greedy_tree(_centers7(spark, sf))), 9, "x", "y")


def tree_depth_chain(spark, sf):
    """Chains of hundreds of nodes: each part below the one before it of the same size."""
    own = Window.partitionBy("tumour_id").orderBy("k")
    nodes = _table(spark, sf, "part").select((F.col("p_size") % 3).cast("long").alias("tumour_id"), F.col("p_partkey").alias("k"))
    return ph.depths(nodes.withColumn("parent", F.coalesce(F.lag("k").over(own), F.lit(-1).cast("long"))))


def tree_enumeration_score(spark, sf):
    from clonal_spark.queries import tree_enumeration_best

    best = tree_enumeration_best(spark, sf)
    return best.select(F.round("score", 6).alias("score"), F.concat_ws(",", F.transform("parents", lambda p: p.cast("string"))).alias("parents"))


# --- routing and streams ---


def head_suffstats_all(spark, sf):
    from clonal_spark.plans.router import head_sums

    return _round(head_sums(_whole_encoded(spark, sf), ["arm"]), 6, "zz")


def head_vectors_all(spark, sf):
    from clonal_spark.plans.router import head_vectors

    return _round(head_vectors(_whole_encoded(spark, sf), ["arm"]), 6, "zy")


def reward_average(spark, sf):
    rows = _table(spark, sf, "events").select(F.col("event_type").alias("config"), F.col("event_id").alias("seq"), (F.col("value") / 500).alias("reward"))
    return _round(sg.reward_average(rows, ["config"], ["seq"]), 9, "average")


def running_window_stats(spark, sf):
    rows = _table(spark, sf, "events").select("ts", F.col("event_type").alias("config"), (F.col("value") / 500).alias("reward"))
    return _round(online.running_stats(rows), 9, "mean_reward").withColumn("start", F.unix_timestamp("start"))


def fit_tasks(spark, sf):
    """Fits that a routed cohort needs: each (tumour, configuration) once, whatever the subchallenges."""
    return sg.best_config(_corpus(spark, sf).withColumn("config_idx", F.ascii("config"))).select("tumour_id", "config").distinct()


def unique_tumours(spark, sf):
    return _corpus(spark, sf).groupBy("tumour_id").agg(F.countDistinct("config").alias("configs"), F.count("*").alias("scores"))


def mean_attributions(spark, sf):
    rows = _table(spark, sf, "part").withColumn("value", F.col("p_retailprice") - 1200).groupBy(F.col("p_type").alias("name")).agg(F.avg(F.abs("value")).alias("value"))
    return _round(pl.top_attributions(rows), 6, "value")


def label_remap(spark, sf):
    """Labels numbered anew without gaps, in their order; filtered ones stay -1."""
    rows = _labels(spark, sf)
    known = rows.where("est_k >= 0").select("tumour_id", "est_k").distinct()
    fresh = known.withColumn("k", (F.row_number().over(Window.partitionBy("tumour_id").orderBy("est_k")) - 1).cast("int"))
    return rows.join(fresh, ["tumour_id", "est_k"], "left").select("tumour_id", "mut_id", F.coalesce("k", F.lit(-1)).alias("k"))


# --- sources ---


def store_roundtrip(spark, sf):
    scratch = Scratch(spark, "store")
    ob.write_tumours(_cohort(spark, sf), scratch.path("tumours"))
    return _round(ob.read_tumours(spark, scratch.path("tumours")).select("tumour_id", "mut_id", "sample_id", "alt", "depth", "adj", "total_cn"), 9, "adj")


def store_pruned(spark, sf):
    """Two tumours read from their folders."""
    scratch = Scratch(spark, "store")
    ob.write_tumours(_cohort(spark, sf), scratch.path("tumours"))
    return ob.read_tumours(spark, scratch.path("tumours"), [1, 3]).groupBy("tumour_id", "sample_id").agg(F.count("*").alias("n"), F.sum("depth").alias("depth"))


def manifest_roundtrip(spark, sf):
    scratch = Scratch(spark, "store")
    ob.write_manifest(spark, scratch.path("manifest"), n_tumours=_table(spark, sf, "supplier").count(), seed=7, kind="quantum")
    found = ob.read_manifest(spark, scratch.path("manifest"))
    return spark.createDataFrame([(int(found["n_tumours"]), int(found["seed"]), found["kind"])], "n_tumours long, seed long, kind string")


def variant_table_roundtrip(spark, sf):
    scratch = Scratch(spark, "store")
    rows = _table(spark, sf, "part").select(F.concat(F.lit("chr"), (F.col("p_size") % 22 + 1).cast("string")).alias("chrom"), F.col("p_partkey").alias("pos"), (F.col("p_size") / 100).alias("vaf"))
    ob.write_variants(rows, scratch.path("variants"))
    return spark.read.csv(scratch.path("variants"), sep="\t", schema="chrom string, start long, end long, vaf double").withColumnRenamed("end", "stop").withColumn("vaf", F.round("vaf", 9))


def fasta_index(spark, sf):
    scratch = Scratch(spark, "store")
    name = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "chr").otherwise(""), F.when(F.col("n_nationkey") == 23, "X").otherwise(F.col("n_nationkey").cast("string")))
    rows = _table(spark, sf, "nation").select(name.alias("name"), (F.col("n_nationkey") * 1000 + 5).alias("length"), F.lit(0).alias("offset"), F.lit(60).alias("line_bases"), F.lit(61).alias("line_width"))
    rows.write.option("sep", "\t").csv(scratch.path("index"))
    return ob.fasta_index(spark, scratch.path("index"))


def plot_colours(spark, sf):
    """Colours of clones numbered -1 to 48, each with its mutations."""
    return pl.clone_colours(_table(spark, sf, "part").groupBy((F.col("p_size") - 2).cast("int").alias("k")).agg(F.count("*").alias("n")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        ccf_projection_all_samples, depth_stats_all_samples, cn_landscape_all_samples, vaf_shape_all_samples, tail_test_all_samples, kde_peaks_all_samples, kde_purity_all_samples,
        meta_features_whole, feature_vectors, bic_sweep_cohort, min_bic_select, quantiles_selected, depth_quantiles_selected, merge_test, merge_places, merge_prune, merge_prune_assign, dirichlet_update, dirichlet_kl, stick_weights,
        digamma_depth, logsumexp_alt, em_distributed_3, em_trace_3, em_grouped_3, cohort_fit_3, cohort_fit_assigned_3, preset_quantumclone_v1_2, fit_tasks_active, corpus_assembled, mfvi_distributed_2, tail_weight_em, artefact_reassign, plot_tree_places, tree_depth_chain,
        tree_enumeration_score, head_suffstats_all, head_vectors_all, reward_average, running_window_stats, fit_tasks, unique_tumours, mean_attributions, label_remap, store_roundtrip,
        store_pruned, manifest_roundtrip, variant_table_roundtrip, fasta_index, plot_colours,
    )
}


# --- SQL ---


def _renamed(body: str, **names: str) -> str:
    """The body of an expression over other tables."""
    for old, new in names.items():
        body = re.sub(rf"\b(FROM|JOIN) {old}\b", rf"\1 {new}", body)
    return body


CTES["all_obs"] = """SELECT tumour_id, mut_id, sample_id, alt, depth, 2.0::DOUBLE / (cn * 0.8::DOUBLE + 0.4::DOUBLE) AS adj, cn::DOUBLE AS total_cn FROM
    (SELECT l_suppkey AS tumour_id, l_partkey AS mut_id, l_returnflag AS sample_id, sum(CASE WHEN l_discount >= 0.05::DOUBLE THEN l_quantity ELSE 0.0::DOUBLE END) AS alt, sum(l_quantity) AS depth,
            1 + (any_value(p_size) + ascii(l_returnflag) % 2 * (l_partkey % 2)) % 4 AS cn FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)"""
CTES["all_first"] = "SELECT * FROM all_obs WHERE (tumour_id, sample_id) IN (SELECT (tumour_id, min(sample_id)) FROM all_obs GROUP BY tumour_id)"
CTES["all_shaped"] = _renamed(CTES["shaped"], cohort="all_first")
CTES["all_depth"] = _renamed(CTES["depth_part"], cohort="all_first")
CTES["all_across"] = """SELECT tumour_id, avg((n > 1 AND sd > 0.05::DOUBLE)::INT) AS subclonal_cn FROM (SELECT tumour_id, mut_id, count(*) AS n, stddev_pop(adj) AS sd FROM all_obs GROUP BY 1, 2) GROUP BY 1"""
CTES["all_cn"] = f"SELECT tumour_id, frac_cna, ploidy, n_cn_states, frac_loh, a.subclonal_cn, wgd FROM (SELECT * EXCLUDE (subclonal_cn) FROM ({_renamed(CTES['cn_part'], cohort='all_first')})) JOIN all_across a USING (tumour_id)"
CTES["all_moments"] = _renamed(CTES["moments"], shaped="all_shaped")
CTES["all_shape"] = _renamed(CTES["shape_part"], shaped="all_shaped", moments="all_moments")
CTES["all_peaks"] = _renamed(CTES["peaks"], shaped="all_shaped")
CTES["all_band"] = "SELECT tumour_id, count(*) AS n, min(ccf) AS low, max(ccf) AS high FROM all_shaped WHERE ccf > 0.3 AND ccf < 1.5 GROUP BY 1"
CTES["all_purities"] = f"""SELECT tumour_id, coalesce(x, CASE WHEN n >= 5 AND low = high THEN low END, 0.5::DOUBLE) AS purity_estimate FROM (SELECT DISTINCT tumour_id FROM all_shaped) LEFT JOIN all_band USING (tumour_id) LEFT JOIN
    (SELECT tumour_id, arg_max(x, struct_pack(a := density, b := -i)) AS x FROM {_renamed(_kde(0.3, 1.5, 0.15, 0.3, 1.5, 100, 5), shaped="all_shaped")} GROUP BY 1) USING (tumour_id)"""
CTES["all_sizes"] = "SELECT tumour_id, count(DISTINCT mut_id) AS n, count(DISTINCT sample_id)::DOUBLE AS n_samples, avg(1.0::DOUBLE - 0.137::DOUBLE * (mut_id % 2)) AS mappability FROM all_obs GROUP BY 1"
CTES["all_features"] = """SELECT * EXCLUDE (n, m), 0.0::DOUBLE AS is_longitudinal, n::DOUBLE AS n_mutations, (n > 1000)::INT::DOUBLE AS sequencing_type, depth_median * n / greatest(n_peaks, 1.0::DOUBLE) AS nrpcc
    FROM all_depth JOIN all_cn USING (tumour_id) JOIN all_shape USING (tumour_id) JOIN all_peaks USING (tumour_id) JOIN all_purities USING (tumour_id) JOIN (SELECT *, 0 AS m FROM all_sizes) USING (tumour_id)"""

CTES["obs5"] = "SELECT mut_id % 5 AS tumour_id, mut_id, sample_id, alt, depth, adj, total_cn FROM obs"
_SWEEP = " UNION ALL ".join(f"SELECT {k} AS n_k, tumour_id, sample_id, i - 1 AS k, {_clip('q[i]', '1e-6::DOUBLE', '1 - 1e-6::DOUBLE')} AS center FROM (SELECT tumour_id, sample_id, quantile_cont({_VAF}, [{', '.join(f'{i}::DOUBLE / {k + 1}' for i in range(1, k + 1))}]) AS q FROM obs5 GROUP BY 1, 2), (SELECT unnest(range(1, {k + 1})) AS i)" for k in range(1, 11))
CTES["sweep5"] = f"""SELECT n_k, tumour_id, mut_id, ln(sum(exp(l - top))) + max(top) - ln(n_k) AS ll FROM (SELECT *, max(l) OVER (PARTITION BY n_k, tumour_id, mut_id) AS top FROM
    (SELECT n_k, tumour_id, mut_id, k, sum({_BINOMIAL}) AS l FROM (SELECT *, {_MU} AS mu FROM obs5 JOIN ({_SWEEP}) USING (tumour_id, sample_id)) GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3"""
CTES["bics5"] = "SELECT tumour_id, n_k AS K, sum(ll) AS log_lik, -2 * sum(ll) + n_k * 3 * ln(count(*)) AS bic FROM sweep5 GROUP BY 1, 2"


def _quantiles(k: int) -> str:
    return f"""SELECT tumour_id, sample_id, i - 1 AS k, {_clip('q[i]', '1e-6::DOUBLE', '1 - 1e-6::DOUBLE')} AS center FROM (SELECT tumour_id, sample_id, quantile_cont({_VAF}, [{', '.join(f'{i}::DOUBLE / {k + 1}' for i in range(1, k + 1))}]) AS q FROM obs5 GROUP BY 1, 2),
        (SELECT unnest(range(1, {k + 1})) AS i)"""


def _liks(obs: str, params: str) -> str:
    return f"SELECT tumour_id, mut_id, k, sum({_BINOMIAL}) AS log_lik FROM (SELECT *, {_MU} AS mu FROM {obs} JOIN {params} USING (tumour_id, sample_id)) GROUP BY 1, 2, 3"


for _k in (3, 15):
    CTES[f"params5_{_k}"] = _quantiles(_k)
    CTES[f"liks5_{_k}"] = _liks("obs5", f"params5_{_k}")
    CTES[f"resp5_{_k}"] = _e_step(f"liks5_{_k}", f"ln(1 / {_k}::DOUBLE)")
CTES["vectors15"] = "SELECT tumour_id, list(c ORDER BY k) AS v FROM (SELECT tumour_id, k, list(center ORDER BY sample_id) AS c FROM params5_15 GROUP BY 1, 2) GROUP BY 1"
CTES["merged15"] = """SELECT tumour_id, k, places[k + 1] AS place FROM (WITH RECURSIVE go(tumour_id, j, places) AS (SELECT tumour_id, 0, []::BIGINT[] FROM vectors15
    UNION ALL SELECT g.tumour_id, j + 1, list_append(places, coalesce(list_filter(range(0, j), lambda i: places[i + 1] = i AND list_max(list_transform(range(1, len(v[1]) + 1), lambda s: abs(v[i + 1][s] - v[j + 1][s]))) < 0.02::DOUBLE)[1], j))
    FROM go g JOIN vectors15 x ON x.tumour_id = g.tumour_id WHERE j < len(v)) SELECT * FROM go WHERE j = 15), (SELECT unnest(range(0, 15)) AS k)"""
CTES["masses15"] = "SELECT p.tumour_id, p.k, place, greatest(sum(r), 1e-300::DOUBLE) AS mass FROM merged15 p JOIN resp5_15 r ON r.tumour_id = p.tumour_id AND r.k = p.k GROUP BY 1, 2, 3"
CTES["shares15"] = "SELECT *, row_number() OVER (PARTITION BY tumour_id ORDER BY share DESC, place) AS size_rank FROM (SELECT tumour_id, place, sum(mass) / sum(sum(mass)) OVER (PARTITION BY tumour_id) AS share FROM masses15 GROUP BY 1, 2)"
CTES["kept15"] = "SELECT tumour_id, place, share, row_number() OVER (PARTITION BY tumour_id ORDER BY place) - 1 AS new_k FROM shares15 WHERE share >= 0.05::DOUBLE OR size_rank = 1"
CTES["moved15"] = "SELECT tumour_id, mut_id, new_k AS k, sum(r) / sum(sum(r)) OVER (PARTITION BY tumour_id, mut_id) AS r FROM resp5_15 JOIN merged15 USING (tumour_id, k) JOIN kept15 USING (tumour_id, place) GROUP BY 1, 2, 3"


def _psi(x: str) -> str:
    """Digamma, shifted up by 12."""
    z = f"({x} + 12)"
    below = " + ".join(f"1 / ({x} + {i})" for i in range(12))
    return f"(ln({z}) - 0.5::DOUBLE / {z} - 1 / (12 * pow({z}, 2)) + 1 / (120 * pow({z}, 4)) - 1 / (252 * pow({z}, 6)) + 1 / (240 * pow({z}, 8)) - ({below}))"


CTES["alphas5"] = "SELECT tumour_id, k, 1 + sum(r) AS alpha, sum(1 + sum(r)) OVER (PARTITION BY tumour_id) AS total FROM resp5_3 GROUP BY 1, 2"
CTES["alphas"] = "SELECT tumour_id, k, 1 + sum(r) AS alpha, sum(1 + sum(r)) OVER (PARTITION BY tumour_id) AS total FROM resp GROUP BY 1, 2"
CTES["resp_vi"] = _e_step("liks_1", f"(SELECT {_psi('alpha')} - {_psi('total')} FROM alphas a WHERE a.k = liks_1.k)")

_TAIL_ODDS = f"""SELECT tumour_id, sample_id, -ln(v) - ln(-ln(1e-8::DOUBLE)) - ((mu * phi - 1) * ln(v) + ((1 - mu) * phi - 1) * ln(1 - v) - (lgamma(mu * phi) + lgamma((1 - mu) * phi) - lgamma(phi))) AS odds
    FROM (SELECT *, {_clip(_VAF, '1e-8::DOUBLE', '1 - 1e-8::DOUBLE')} AS v FROM obs5) JOIN tail_pars5 USING (tumour_id, sample_id)"""
CTES["tail_stats5"] = _renamed(CTES["tail_stats"], obs="obs5")
CTES["tail_pars5"] = _renamed(CTES["tail_pars"], tail_stats="tail_stats5")
CTES["odds5"] = _TAIL_ODDS
CTES["tau_0"] = "SELECT DISTINCT tumour_id, sample_id, 0.1::DOUBLE AS tau FROM odds5"
for _i in range(4):
    CTES[f"tau_{_i + 1}"] = f"SELECT tumour_id, sample_id, {_clip('avg(1 / (1 + exp(-(odds + ln(tau / (1 - tau))))))', '1e-6::DOUBLE', '1 - 1e-6::DOUBLE')} AS tau FROM odds5 JOIN tau_{_i} USING (tumour_id, sample_id) GROUP BY 1, 2"

CTES["liks7"] = _liks("obs", "centers7")
CTES["resp7"] = _e_step("liks7", "ln(1 / 7::DOUBLE)")
CTES["nestable7"] = """SELECT tumour_id, k, coalesce(bool_or(fits), false) AS nestable FROM (SELECT a.tumour_id, a.k, b.k AS other, bool_and(NOT (a.center > 0.45) OR b.center > 0.45) OR bool_and(NOT (b.center > 0.45) OR a.center > 0.45) AS fits
    FROM centers7 a LEFT JOIN centers7 b ON a.tumour_id = b.tumour_id AND a.sample_id = b.sample_id AND a.k <> b.k GROUP BY 1, 2, 3) GROUP BY 1, 2"""
CTES["means7"] = _renamed(CTES["means"], params="centers7")
CTES["places7"] = _renamed(CTES["places"], means="means7")
CTES["pairs7"] = _renamed(CTES["pairs"], params="centers7")
CTES["nested7"] = _renamed(CTES["nested"], pairs="pairs7")
CTES["tree7"] = _renamed(CTES["tree"], means="means7", places="places7", nested="nested7")
CTES["depth7"] = """WITH RECURSIVE down(tumour_id, k, parent, depth) AS (SELECT tumour_id, k, parent, 0 FROM tree7 WHERE parent = -1
    UNION ALL SELECT e.tumour_id, e.k, e.parent, depth + 1 FROM tree7 e JOIN down p ON e.tumour_id = p.tumour_id AND e.parent = p.k) SELECT * FROM down"""
_LOGIT = "1 / (1 + exp(-least(greatest({}, -500), 500)))"
CTES["relations7"] = f"""SELECT k, other, ln(a / (a + d + s + 0.001::DOUBLE)) AS above, ln(d / (a + d + s + 0.001::DOUBLE)) AS below, ln(0.001::DOUBLE / (a + d + s + 0.001::DOUBLE)) AS beside
    FROM (SELECT k, other, avg({_LOGIT.format('(center - other_center) / 0.1::DOUBLE')}) AS a, avg({_LOGIT.format('(other_center - center) / 0.1::DOUBLE')}) AS d, avg({_LOGIT.format('5 - abs(center - other_center) / 0.1::DOUBLE')}) AS s FROM pairs7 GROUP BY 1, 2)"""
# all parent vectors of nodes 1..6, each node's chain of up to six ancestors, and those whose every chain ends at node 0
CTES["vectors7"] = "SELECT row_number() OVER () AS id, [-1, p1, p2, p3, p4, p5, p6] AS p FROM " + ", ".join(f"(SELECT unnest(range(0, 7)) AS p{i})" for i in range(1, 7)) + " WHERE " + " AND ".join(f"p{i} <> {i}" for i in range(1, 7))
CTES["chains7"] = "SELECT id, node, [a1, a2, a3, a4, a5, a6] AS chain FROM (SELECT *, CASE WHEN a5 > 0 THEN p[a5 + 1] ELSE -1 END AS a6 FROM (SELECT *, CASE WHEN a4 > 0 THEN p[a4 + 1] ELSE -1 END AS a5 FROM (SELECT *, CASE WHEN a3 > 0 THEN p[a3 + 1] ELSE -1 END AS a4 FROM (SELECT *, CASE WHEN a2 > 0 THEN p[a2 + 1] ELSE -1 END AS a3 FROM (SELECT *, CASE WHEN a1 > 0 THEN p[a1 + 1] ELSE -1 END AS a2 FROM (SELECT id, p, node, p[node + 1] AS a1 FROM vectors7, (SELECT unnest(range(1, 7)) AS node))))))) WHERE true"
CTES["rooted7"] = "SELECT id FROM chains7 GROUP BY 1 HAVING bool_and(list_contains(chain, 0))"
CTES["gains7"] = """SELECT id, sum(x.above - x.beside + y.below - y.beside) AS gain FROM (SELECT id, node, unnest(list_filter(chain, lambda a: a >= 0)) AS up FROM chains7 JOIN rooted7 USING (id))
    JOIN relations7 x ON x.k = up AND x.other = node JOIN relations7 y ON y.k = node AND y.other = up GROUP BY 1"""
CTES["z64"] = "SELECT label AS arm, (vec_id % 100) / 100.0::DOUBLE AS reward, embedding::DOUBLE[] AS z FROM embeddings"
_FIVE_FIT = f"WITH five_obs AS ({sql('SELECT mut_id, sample_id, alt, depth, adj, (mut_id % 5)::BIGINT AS tumour_id FROM obs')}),\n{unrolled(3, 3, 'five_obs')}"
_TEN = range(1, 11)
_PRESET = f"""WITH five_obs AS ({sql('SELECT mut_id, sample_id, alt, depth, adj, (mut_id % 5)::BIGINT AS tumour_id FROM obs')}),
{", ".join(unrolled(k, 2, 'five_obs', f'_of_{k}') for k in _TEN)},
fits AS ({" UNION ALL ".join(f"SELECT tumour_id, {k} AS n_clones, sum(ll) AS ll, count(*) AS n FROM (SELECT DISTINCT tumour_id, mut_id, ll FROM resp_of_{k}_1) GROUP BY 1" for k in _TEN)}),
judged AS (SELECT *, -2 * ll + n_clones * (SELECT count(DISTINCT sample_id) FROM five_obs) * ln(n) AS bic FROM fits),
chosen AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY tumour_id ORDER BY bic, n_clones) = 1),
clones AS (SELECT p.*, c.n_clones, c.ll, c.bic FROM ({" UNION ALL ".join(f"SELECT {k} AS n_clones, tumour_id, k, sample_id, center FROM params_of_{k}_2" for k in _TEN)}) p JOIN chosen c USING (tumour_id, n_clones)),
means AS ({CTES["means"].replace("FROM params", "FROM clones")}),
places AS ({CTES["places"]}),
pairs AS ({CTES["pairs"].replace("params ", "clones ")}),
nested AS ({CTES["nested"]}),
tree AS ({CTES["tree"]})"""
_ACTIVE = [c for c in CONFIG_NAMES if c not in DEFAULT_EXCLUDE_CONFIGS]

ORACLE_SQL: dict[str, str] = {
    "ccf_projection_all_samples": sql(f"SELECT tumour_id, mut_id, sample_id, round({_clip(f'{_VAF} / greatest(adj * 0.5::DOUBLE, 1e-9::DOUBLE)', '0.0::DOUBLE', '2.0::DOUBLE')}, 9) AS ccf FROM all_obs"),
    "depth_stats_all_samples": sql(f"SELECT tumour_id, {_rounded('depth_median, depth_cv, frac_low_depth')} FROM all_depth"),
    "cn_landscape_all_samples": sql(f"SELECT tumour_id, {_rounded('frac_cna, ploidy, n_cn_states, frac_loh, subclonal_cn, wgd')} FROM all_cn"),
    "vaf_shape_all_samples": sql(f"SELECT tumour_id, {_rounded('skewness, kurtosis, clonal_peak_width')} FROM all_shape"),
    "tail_test_all_samples": sql("SELECT tumour_id, has_pareto_tail FROM all_shape"),
    "kde_peaks_all_samples": sql("SELECT * FROM all_peaks"),
    "kde_purity_all_samples": sql("SELECT tumour_id, round(purity_estimate, 6) AS purity_estimate FROM all_purities"),
    "meta_features_whole": sql(f"SELECT tumour_id, {_rounded(_FEATURES)} FROM all_features"),
    "feature_vectors": sql(f"SELECT tumour_id, (i - 1)::INT AS i, round(v[i], 6) AS value FROM (SELECT tumour_id, [{_FEATURES}] AS v FROM (SELECT * REPLACE (1.0::DOUBLE AS mappability) FROM all_features)), (SELECT unnest(range(1, 22)) AS i)"),
    "bic_sweep_cohort": sql("SELECT tumour_id, K::INT AS K, round(log_lik, 3) AS log_lik, round(bic, 3) AS bic FROM bics5"),
    "min_bic_select": sql("SELECT tumour_id, K::INT AS K, round(log_lik, 3) AS log_lik, round(bic, 3) AS bic FROM bics5 QUALIFY row_number() OVER (PARTITION BY tumour_id ORDER BY bic, K) = 1"),
    "merge_test": sql("SELECT tumour_id, k, other, round(gap, 9) AS gap, gap < 0.01::DOUBLE AS merges FROM (SELECT a.tumour_id, a.k::INT AS k, b.k::INT AS other, max(abs(a.center - b.center)) AS gap FROM params5_15 a JOIN params5_15 b ON a.tumour_id = b.tumour_id AND a.sample_id = b.sample_id AND a.k <> b.k GROUP BY 1, 2, 3)"),
    "merge_places": sql("SELECT tumour_id, k::INT AS k, place::INT AS place FROM merged15"),
    "merge_prune": sql(f"""SELECT tumour_id, sample_id, new_k::INT AS k, place::INT AS place, round(share, 7) AS share, round({_clip('center', '1e-6::DOUBLE', '1 - 1e-6::DOUBLE')}, 7) AS center
        FROM (SELECT m.tumour_id, place, sample_id, sum(mass * center) / sum(mass) AS center FROM masses15 m JOIN params5_15 p ON p.tumour_id = m.tumour_id AND p.k = m.k GROUP BY 1, 2, 3) JOIN kept15 USING (tumour_id, place)"""),
    "merge_prune_assign": sql("SELECT tumour_id, mut_id, arg_max(k, struct_pack(a := r, b := -k))::INT AS k, round(max(r), 6) AS r FROM moved15 GROUP BY 1, 2"),
    "dirichlet_update": sql(f"SELECT tumour_id, k::INT AS k, round(alpha, 6) AS alpha, round({_psi('alpha')} - {_psi('total')}, 6) AS expected_log_pi FROM alphas5"),
    "dirichlet_kl": sql(f"SELECT tumour_id, round(lgamma(any_value(total)) - lgamma(3::DOUBLE) + sum((alpha - 1) * ({_psi('alpha')} - {_psi('total')}) - lgamma(alpha)), 4) AS kl FROM alphas5 GROUP BY 1"),
    "stick_weights": sql("""SELECT tumour_id, k::INT AS k, round(w / sum(w) OVER (PARTITION BY tumour_id), 9) AS weight FROM (SELECT tumour_id, k, center * coalesce(product(1 - center) OVER (PARTITION BY tumour_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS w
        FROM params5_15 WHERE sample_id = 'A')"""),
    "digamma_depth": sql(f"SELECT mut_id, sample_id, round({_psi('x')}, 9) AS digamma FROM (SELECT *, depth / 10 + 0.05::DOUBLE AS x FROM obs)"),
    "logsumexp_alt": sql("SELECT mut_id, round(max(top) + ln(sum(exp(alt / 10 - top))), 9) AS total FROM (SELECT *, max(alt / 10) OVER (PARTITION BY mut_id) AS top FROM obs) GROUP BY 1"),
    "em_distributed_3": sql("SELECT k::INT AS k, sample_id, round(center, 7) AS center FROM params_3"),
    "quantiles_selected": sql(f"SELECT tumour_id, sample_id, (i - 1)::INT AS i, round(q[i], 9) AS value FROM (SELECT tumour_id, sample_id, quantile_cont({_VAF}, [{', '.join(repr(i / 16) for i in range(1, 16))}]) AS q FROM all_obs GROUP BY 1, 2), (SELECT unnest(range(1, 16)) AS i)"),
    "depth_quantiles_selected": "SELECT sample_id, (i - 1)::INT AS i, round(q[i], 6) AS value FROM (SELECT l_returnflag AS sample_id, quantile_cont(l_extendedprice, [0.0, 0.05, 0.5, 0.95, 1.0]) AS q FROM lineitem GROUP BY 1), (SELECT unnest(range(1, 6)) AS i)",
    "preset_quantumclone_v1_2": f"{_PRESET} SELECT c.tumour_id, k::INT AS k, sample_id, round(center, 7) AS center, n_clones::INT AS n_clones, round(ll, 3) AS ll, round(bic, 3) AS bic, parent::INT AS parent FROM clones c JOIN tree USING (tumour_id, k)",
    "fit_tasks_active": f"SELECT DISTINCT l_suppkey AS tumour_id, config FROM lineitem, (SELECT unnest({[c for c in _ACTIVE if c not in PILOTS]!r}) AS config)",
    "corpus_assembled": sql(
        f"""SELECT tumour_id, sc, config, round(score, 6) AS score, (i - 1)::INT AS i, round(v[i], 6) AS value FROM (SELECT tumour_id, [{_FEATURES}] AS v FROM (SELECT * REPLACE (1.0::DOUBLE AS mappability) FROM all_features))
        JOIN (SELECT tumour_id, sc, CASE config {' '.join(f"WHEN '{c}' THEN '{CONFIG_NAMES[i]}'" for i, c in enumerate(('click', 'error', 'purchase', 'signup')))} END AS config, score FROM corpus) USING (tumour_id), (SELECT unnest(range(1, 22)) AS i) WHERE config IS NOT NULL"""
    ),
    "cohort_fit_3": f"{_FIVE_FIT} SELECT tumour_id, k::INT AS k, sample_id, round(center, 7) AS center, round(ll, 3) AS ll FROM params_3 JOIN (SELECT tumour_id, sum(ll) AS ll FROM (SELECT DISTINCT tumour_id, mut_id, ll FROM resp_2) GROUP BY 1) USING (tumour_id)",
    "cohort_fit_assigned_3": f"{_FIVE_FIT} SELECT tumour_id, mut_id, arg_max(k, struct_pack(a := r, b := -k))::INT AS k, round(max(r), 6) AS r FROM resp_2 GROUP BY 1, 2",
    "em_grouped_3": sql("SELECT k::INT AS k, sample_id, round(center, 7) AS center FROM params_3"),
    "em_trace_3": sql(" UNION ALL ".join(f"SELECT {i + 1} AS iteration, round(sum(ll), 3) AS log_lik FROM (SELECT DISTINCT mut_id, ll FROM resp_{i})" for i in range(3))),
    "mfvi_distributed_2": sql(f"SELECT k::INT AS k, sample_id, round({_clip('sum(r * alt) / greatest(sum(r * depth), 1e-10::DOUBLE)', '1e-6::DOUBLE', '1 - 1e-6::DOUBLE')}, 7) AS center FROM obs JOIN resp_vi USING (tumour_id, mut_id) GROUP BY 1, 2"),
    "tail_weight_em": sql("SELECT tumour_id, sample_id, round(tau, 7) AS tau FROM tau_4"),
    "artefact_reassign": sql("""SELECT tumour_id, mut_id, arg_max(k, struct_pack(a := r, b := -k))::INT AS k FROM resp7 JOIN (SELECT tumour_id, k FROM (SELECT *, bool_or(nestable) OVER (PARTITION BY tumour_id) AS any_of FROM nestable7) WHERE nestable OR NOT any_of)
        USING (tumour_id, k) GROUP BY 1, 2"""),
    "plot_tree_places": sql("SELECT tumour_id, k, parent, depth, round((row_number() OVER (PARTITION BY tumour_id, depth ORDER BY k) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY tumour_id, depth), 9) AS x, round(-depth::DOUBLE, 9) AS y FROM depth7"),
    "plot_tree_layout": sql("SELECT tumour_id, k, parent, depth, (row_number() OVER (PARTITION BY tumour_id, depth ORDER BY k) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY tumour_id, depth) AS x, -depth::DOUBLE AS y FROM depth7"),
    "tree_depth_chain": "SELECT (p_size % 3)::BIGINT AS tumour_id, p_partkey AS k, coalesce(lag(p_partkey) OVER o, -1) AS parent, (row_number() OVER o - 1)::INT AS depth FROM part WINDOW o AS (PARTITION BY p_size % 3 ORDER BY p_partkey)",
    "tree_enumeration_score": sql("""SELECT round((SELECT sum(beside) FROM relations7) + gain, 6) AS score, array_to_string(p, ',') AS parents FROM gains7 JOIN vectors7 USING (id) ORDER BY gain DESC LIMIT 1"""),
    "head_suffstats_all": sql("SELECT arm, (i - 1)::INT AS i, (j - 1)::INT AS j, round(sum(z[i] * z[j]), 6) AS zz FROM z64, range(1, 65) a(i), range(1, 65) b(j) GROUP BY 1, 2, 3"),
    "head_vectors_all": sql("SELECT arm, (i - 1)::INT AS i, round(sum(z[i] * reward), 6) AS zy, count(*) AS n FROM z64, range(1, 65) a(i) GROUP BY 1, 2"),
    "reward_average": "SELECT config, round(sum(0.01::DOUBLE * pow(0.99::DOUBLE, behind) * reward), 9) AS average, count(*) AS n FROM (SELECT event_type AS config, value / 500 AS reward, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS behind FROM events) GROUP BY 1",
    "running_window_stats": "SELECT (floor(epoch(ts))::BIGINT // 300) * 300 AS start, event_type AS config, round(avg(value / 500), 9) AS mean_reward, count(*) AS n FROM events GROUP BY 1, 2",
    "fit_tasks": sql("SELECT DISTINCT tumour_id, config FROM (SELECT tumour_id, sc, arg_max(config, struct_pack(a := score, b := -ascii(config), c := config)) AS config FROM corpus GROUP BY 1, 2)"),
    "unique_tumours": sql("SELECT tumour_id, count(DISTINCT config) AS configs, count(*) AS scores FROM corpus GROUP BY 1"),
    "mean_attributions": "SELECT name, round(value, 6) AS value FROM (SELECT p_type AS name, avg(abs(p_retailprice - 1200)) AS value FROM part GROUP BY 1) ORDER BY value DESC, name LIMIT 10",
    "label_remap": sql("SELECT tumour_id, mut_id, CASE WHEN est_k < 0 THEN -1 ELSE dense_rank() OVER (PARTITION BY tumour_id, est_k >= 0 ORDER BY est_k) - 1 END::INT AS k FROM labels"),
    "store_roundtrip": sql("SELECT tumour_id, mut_id, sample_id, alt, depth, round(adj, 9) AS adj, total_cn FROM all_obs"),
    "store_pruned": sql("SELECT tumour_id, sample_id, count(*) AS n, sum(depth) AS depth FROM all_obs WHERE tumour_id IN (1, 3) GROUP BY 1, 2"),
    "manifest_roundtrip": "SELECT count(*) AS n_tumours, 7::BIGINT AS seed, 'quantum' AS kind FROM supplier",
    "variant_table_roundtrip": "SELECT 'chr' || (p_size % 22 + 1) AS chrom, p_partkey AS start, p_partkey AS stop, round(p_size / 100::DOUBLE, 9) AS vaf FROM part",
    "fasta_index": "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'chr' ELSE '' END || n_nationkey AS name, (n_nationkey * 1000 + 5)::BIGINT AS length FROM nation WHERE n_nationkey BETWEEN 1 AND 22",
    "plot_colours": f"SELECT (p_size - 2)::INT AS k, count(*) AS n, CASE WHEN p_size >= 2 THEN {pl.CLONE_PALETTE}[((p_size - 2) % {len(pl.CLONE_PALETTE)} + 1)::INT] END AS colour FROM part GROUP BY p_size",
}
