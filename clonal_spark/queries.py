"""The query catalogue over the driver's tables. Mutations are parts, samples return flags; see sources.observations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonal_spark.config import CONFIGS, CloneConfig, EmissionModel, NoiseModel, PhyloMode
from clonal_spark.functions.emission import EMISSIONS
from clonal_spark.operators import features as fe
from clonal_spark.operators import mixture as mo
from clonal_spark.operators import noise as no
from clonal_spark.operators import phylo as ph
from clonal_spark.operators import phylo_np
from clonal_spark.operators import plots as pl
from clonal_spark.operators import scoring as sg
from clonal_spark.plans.auto import RoutedModel, explain_table
from clonal_spark.plans.model import GenerativeModel
from clonal_spark.plans.router import MetaRouter, head_sums, head_vectors
from clonal_spark.session import Scratch
from clonal_spark.sources import observations as ob
from clonal_spark.sources import simulate as si

Query = Callable[[SparkSession, str], DataFrame]
K = 3
#: Cells of a tumour beyond which no task of these queries holds it whole, and of a block of it.
BLOCK_CELLS = 100_000
#: Presets whose tumours and K are groups (plans.model.fit_one_k); larger tumours of them go by blocks.
BY_BLOCKS = ("quantumclone_v1", "mobster", "decifer_style")
#: The same of a preset of hundreds of iterations, each a pass over the blocks: only tumours that are too large for a group go so.
LARGER_BLOCKS = {"longitudinal_clinical": 1_000_000}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _obs(spark, sf):
    """Written once: a query reads it several times, and steps that follow start from its files."""
    return Scratch(spark, "observations").write(ob.from_lineitem(spark, sf), "dense")


def _whole_cohort(spark, sf):
    return ob.from_lineitem(spark, sf, tumour="supplier")


def _params(spark, sf):
    return mo.quantile_init(_obs(spark, sf), K)


def _resp(spark, sf, emission: EmissionModel = EmissionModel.BINOMIAL):
    obs = _obs(spark, sf)
    params = mo.quantile_init(obs, K)
    return mo.e_step(mo.log_likelihoods(obs, params, EMISSIONS[emission]()), mo.uniform_weights(params))


def _centers7(spark, sf):
    """Seven clones by supplier, three samples; a clone's hits are discounts from its own percentage on."""
    k = F.col("l_suppkey") % 7
    rows = _table(spark, sf, "lineitem")
    hit = F.sum(F.when(F.round(F.col("l_discount") * 100) >= 2 + k, F.col("l_quantity")).otherwise(0.0))
    return rows.groupBy(F.lit(0).cast("long").alias("tumour_id"), k.alias("k"), F.col("l_returnflag").alias("sample_id")).agg((hit / F.sum("l_quantity")).alias("center"))


def _labels(spark, sf):
    return _table(spark, sf, "part").select((F.col("p_size") % 5).cast("long").alias("tumour_id"), F.col("p_partkey").alias("mut_id"), (F.ascii(F.substring("p_brand", 7, 1)) % 6).alias("true_k"), (F.length("p_type") % 5 - 1).alias("est_k"), F.lit(5).alias("n_true"))


def _corpus(spark, sf):
    rows = _table(spark, sf, "events").groupBy(F.col("user_id").alias("tumour_id"), (F.col("event_id") % 5).alias("sc"), F.col("event_type").alias("config"))
    return rows.agg(F.max(F.col("value") / 500).alias("score"))


def _best(spark, sf):
    return _corpus(spark, sf).groupBy("tumour_id", "sc").agg(F.max("score").alias("best"))


def _first_selected(corpus: DataFrame) -> DataFrame:
    first = corpus.agg(F.min("config").alias("selected"))
    return corpus.select("tumour_id", "sc").distinct().crossJoin(F.broadcast(first))  # one row


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def flagship_em_step(spark, sf):
    """Observations to quantile centers, one binomial expectation step and hard assignments."""
    return _round(mo.hard_assign(_resp(spark, sf)), 6, "r")


def vaf_projection(spark, sf):
    return _obs(spark, sf).select("tumour_id", "mut_id", "sample_id", F.round(mo.vaf(), 9).alias("vaf"))


def adj_from_cn(spark, sf):
    return _round(_obs(spark, sf).select("mut_id", "sample_id", "total_cn", "adj"), 9, "adj")


def quantile_init(spark, sf):
    return _round(_params(spark, sf), 9, "center")


def _loglik(emission: EmissionModel) -> Query:
    def run(spark, sf):
        obs = _obs(spark, sf)
        return _round(mo.log_likelihoods(obs, mo.quantile_init(obs, K), EMISSIONS[emission]()), 5, "log_lik")

    return run


def e_step_resp(spark, sf):
    return _round(_resp(spark, sf).drop("log_r"), 6, "r").withColumn("ll", F.round("ll", 5))


def m_step_centers(spark, sf):
    return _round(mo.m_step(_obs(spark, sf), _resp(spark, sf)), 8, "center")


def mixing_weights(spark, sf):
    return _round(mo.mixing_weights(_resp(spark, sf)), 7, "log_pi")


def marginal_ll_bic(spark, sf):
    return _round(mo.marginal_fit(_resp(spark, sf), F.lit(3)), 3, "log_lik", "bic")


def em_unrolled_3(spark, sf):
    obs = _obs(spark, sf)
    return _round(mo.em_steps(obs, mo.quantile_init(obs, K), EMISSIONS[EmissionModel.BINOMIAL](), 3)[0].drop("log_pi"), 7, "center")


def elbo_terms(spark, sf):
    return _round(mo.elbo_terms(_resp(spark, sf)), 3, "expected", "entropy")


def tail_filter_mask(spark, sf):
    return no.tail_mask(_obs(spark, sf))


def expand_noise(spark, sf):
    mask = no.tail_mask(_obs(spark, sf))
    kept = mo.hard_assign(_resp(spark, sf)).drop("r").join(mask.where("kept").select(*mo.MUT), mo.MUT, "left_semi")
    return no.expand(mask, kept)


def multiplicity_adj(spark, sf):
    return _round(no.multiplicity_adj(_obs(spark, sf), 0.8).select("mut_id", "sample_id", "adj"), 9, "adj")


def artefact_nestability(spark, sf):
    return no.presence_partners(_centers7(spark, sf), 0.45)


def nesting_matrix(spark, sf):
    return ph.nesting_matrix(_params(spark, sf))


def nesting_order(spark, sf):
    return _round(ph.nesting_order(_params(spark, sf)), 8, "mean")


def greedy_tree(spark, sf):
    return ph.greedy_tree(_params(spark, sf))


def constrained_clamp(spark, sf):
    return _round(ph.clamp_chain(_centers7(spark, sf)), 9, "center")


def pairs_tensor(spark, sf):
    return _round(ph.pairs_tensor(_params(spark, sf)), 7, "ancestor", "descendant", "branching", "same")


def tree_topo_depth(spark, sf):
    return ph.depths(ph.greedy_tree(_params(spark, sf)))


def plot_tree_layout(spark, sf):
    return ph.layout(ph.greedy_tree(_centers7(spark, sf)))


def tree_enumeration_best(spark, sf):
    """All 7 ** 5 labelled trees over seven clones, scored in parallel; the first best one."""
    centers = _centers7(spark, sf).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("sample_id", "center"))).alias("c")).orderBy("k")
    pairs = phylo_np.pairs_tensor(pd.DataFrame([[x.center for x in r.c] for r in centers.collect()]).to_numpy())
    k = len(pairs)

    def run(batches):
        for b in batches:
            trees = [phylo_np.decode_prufer(phylo_np.sequence_of(int(i), k), k) for i in b["id"]]
            yield pd.DataFrame({"id": b["id"], "score": [phylo_np.tree_score(t, pairs) for t in trees], "parents": [t.tolist() for t in trees]})

    scored = spark.range(k ** (k - 2)).repartition(16).mapInPandas(run, "id long, score double, parents array<int>")
    return scored.agg(F.max(F.struct("score", (-F.col("id")).alias("minus"), "parents")).alias("t")).select((-F.col("t.minus")).alias("tree"), "t.score", "t.parents")


def longitudinal_tree(spark, sf):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c = rows.pivot_table(index="k", columns="sample_id", values="center")
        return pd.DataFrame({"tumour_id": rows["tumour_id"].iloc[0], "k": c.index, "parent": phylo_np.longitudinal_parents(c.to_numpy())})

    return _centers7(spark, sf).groupBy("tumour_id").applyInPandas(run, "tumour_id long, k long, parent long")


def contingency(spark, sf):
    return sg.contingency(sg.valid_pairs(_labels(spark, sf)))


def contingency_all(spark, sf):
    return sg.contingency(_labels(spark, sf))


def v_measure(spark, sf):
    return _round(sg.v_measure(sg.valid_pairs(_labels(spark, sf))), 9, "v_measure")


def sc1a(spark, sf):
    centers = _params(spark, sf)
    return _round(sg.sc1a(centers, centers.select("tumour_id").distinct().withColumn("purity", F.lit(0.8))), 9, "score")


def sc1b(spark, sf):
    labels = _labels(spark, sf)
    centers = labels.select("tumour_id").distinct().join(_centers7(spark, sf).drop("tumour_id").withColumn("all", F.lit(1)), F.col("all") == 1).drop("all")
    return _round(sg.sc1b(labels, centers, centers), 9, "score")


def sc2a(spark, sf):
    rows = _table(spark, sf, "part").select(F.col("p_partkey").alias("mut_id"), (F.col("p_size") % 6 + 1).alias("t"), (F.length("p_type") % 6).alias("e"))
    return rows.select("mut_id", F.round(sg.sc2a(F.col("t"), F.col("e")), 9).alias("score"))


def sc3(spark, sf):
    nodes = _table(spark, sf, "part").select((F.col("p_partkey") % 20).alias("tumour_id"), F.col("p_partkey").alias("k"), (F.col("p_size") % 3).alias("parent"), (F.length("p_name") % 3).alias("est"))
    sizes = nodes.groupBy("tumour_id").agg(F.count("*").alias("true_k")).select("tumour_id", "true_k", F.col("true_k").alias("est_k"), F.lit(True).alias("has_true"), F.lit(True).alias("has_est"))
    return _round(sg.sc3(nodes.select("tumour_id", "k", "parent"), nodes.select("tumour_id", "k", F.col("est").alias("parent")), sizes), 9, "score")


def adaptive_elimination(spark, sf):
    return _round(sg.eliminated(_corpus(spark, sf), -0.3), 9, "least")


def resume_antijoin(spark, sf):
    corpus = _corpus(spark, sf)
    return ob.todo(corpus.select("tumour_id", "config").distinct(), corpus.where("score > 0.9"))


def best_config_label(spark, sf):
    corpus = _corpus(spark, sf)
    names = sorted(r.config for r in corpus.select("config").distinct().collect())  # event types: a short fixed list
    return _round(sg.best_config(corpus.withColumn("config_idx", F.array_position(F.array(*map(F.lit, names)), F.col("config")) - 1)), 9, "score")


def _whole_encoded(spark, sf):
    return _table(spark, sf, "embeddings").select(F.col("label").alias("arm"), (F.col("vec_id") % 100 / 100.0).alias("reward"), F.col("embedding").cast("array<double>").alias("z"))


def head_suffstats_whole(spark, sf):
    return head_sums(_whole_encoded(spark, sf), ["arm"])


def head_vectors_whole(spark, sf):
    return head_vectors(_whole_encoded(spark, sf), ["arm"])


def oracle_regret(spark, sf):
    corpus = _corpus(spark, sf)
    return _round(sg.oracle_regret(corpus, _first_selected(corpus)), 9, "regret")


def routing_gain(spark, sf):
    corpus = _corpus(spark, sf)
    return _round(sg.routing_gain(corpus, _first_selected(corpus), "purchase"), 9, "gain")


def selection_counts(spark, sf):
    corpus = _corpus(spark, sf)
    names = sorted(r.config for r in corpus.select("config").distinct().collect())
    selected = corpus.groupBy("tumour_id", "sc").agg(F.max(F.struct("score", "config")).alias("b")).select("tumour_id", "sc", F.col("b.config").alias("selected"))
    return sg.selection_counts(selected, names)


def score_distribution(spark, sf):
    return _round(sg.score_distribution(_best(spark, sf), ["sc"], "best"), 6, "mean", "std", "median", "least", "most")


def uncertainty_quartiles(spark, sf):
    rows = _best(spark, sf).withColumn("uncertainty", F.abs(F.col("best") - 0.5))
    return _round(sg.uncertainty_quartiles(rows, ["sc"], score="best"), 6, "mean_score", "mean_uncertainty")


def cumulative_regret(spark, sf):
    rows = _best(spark, sf).withColumn("regret", 1 - F.col("best"))
    return _round(sg.running_regret(rows, ["sc"], ["tumour_id"]).select("sc", "tumour_id", "cumulative"), 6, "cumulative")


def allocate_clone_sizes(spark, sf):
    counts = _table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("tumour_id"), F.col("l_linenumber").cast("int").alias("k")).agg(F.count("*").alias("c"))
    share = F.col("c") / F.sum("c").over(mo.Window.partitionBy("tumour_id"))
    return sg.allocate(counts.select("tumour_id", "k", share.alias("fraction"), F.lit(100).alias("total")))


def plot_vaf_hist(spark, sf):
    return pl.vaf_histogram(_obs(spark, sf), mo.hard_assign(_resp(spark, sf)))


def plot_scatter(spark, sf):
    return _round(pl.cellularity_scatter(_obs(spark, sf), mo.hard_assign(_resp(spark, sf))), 9, "vaf")


def plot_fish(spark, sf):
    return _round(pl.fish(_params(spark, sf)), 8, "center", "low", "high")


def plot_samples(spark, sf):
    return _round(pl.sample_comparison(_params(spark, sf), ["A", "N", "R"]), 8, "A", "N", "R")


def plot_heatmap(spark, sf):
    resp = _resp(spark, sf)
    return _round(pl.responsibility_rows(resp, mo.hard_assign(resp)), 6, "r")


def plot_resp_violin(spark, sf):
    return _round(pl.top_responsibility(_resp(spark, sf)), 6, "least", "q1", "median", "q3", "most")


def plot_top_attr(spark, sf):
    rows = _table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg((F.avg("p_retailprice") - 1200).alias("value"))
    return _round(pl.top_attributions(rows), 6, "value")


def plot_bic_curve(spark, sf):
    rows = _table(spark, sf, "orders").groupBy((F.col("o_custkey") % 10).cast("long").alias("tumour_id"), (F.col("o_orderkey") % 10 + 1).cast("int").alias("K")).agg(F.min("o_totalprice").alias("bic"))
    return pl.bic_curve(rows)


def pileup_counts(spark, sf):
    reads = _table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("chrom"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_returnflag").alias("base"))
    return ob.count_alleles(reads, reads.select("chrom", "pos").distinct().withColumn("alt_base", F.lit("R"))).drop("alt_base")


def _fit(name: str) -> Query:
    """One fit per region of suppliers: a cohort of five tumours with three samples each."""

    def run(spark, sf):
        obs = _obs(spark, sf).withColumn("tumour_id", F.pmod("mut_id", F.lit(5)))
        if name == "phyloclone_style":
            return GenerativeModel(CONFIGS[name]).fit(obs).fit_summary
        if name in BY_BLOCKS or name in LARGER_BLOCKS:
            return GenerativeModel(name).fit_cohort(obs, LARGER_BLOCKS.get(name, BLOCK_CELLS)).fit_summary
        return GenerativeModel(name).fit(obs).fit_summary

    return run


def bic_sweep_1iter(spark, sf):
    """BIC of one binomial expectation step for K = 1..10."""
    sweep = mo.bic_sweep(_obs(spark, sf), list(range(1, 11)), EMISSIONS[EmissionModel.BINOMIAL]())
    return _round(pl.bic_curve(sweep.select("tumour_id", F.col("K").cast("long").alias("K"), "bic")), 3, "bic")


def fit_distributed(spark, sf):
    """The whole table's tumour, to convergence at all K, in the form that its size asks for."""
    config = CloneConfig(emission=EmissionModel.BINOMIAL, inference=CONFIGS["quantumclone_v1"].inference, k_prior=CONFIGS["quantumclone_v1"].k_prior, phylo=PhyloMode.NONE, noise=NoiseModel.NONE)
    return GenerativeModel(config).fit_cohort(_obs(spark, sf)).fit_summary.select("K", "ll", "bic", "n_iter")


def simulate_cohort(spark, sf):
    """A tumour for each five suppliers, 20 at least."""
    return si.simulate(si.params_table(spark, max(20, _table(spark, sf, "supplier").count() // 5)))


def augment_cohort(spark, sf):
    return si.augment(simulate_cohort(spark, sf), 2)


def head_mean_select(spark, sf):
    return RoutedModel(MetaRouter()).choose(_whole_cohort(spark, sf))


def explain_attributions(spark, sf):
    return explain_table(MetaRouter(), fe.as_vector(fe.meta_features(_whole_cohort(spark, sf))), "SC2B")


def meta_features_all_samples(spark, sf):
    """Every feature over all samples of each tumour."""
    return fe.meta_features(_whole_cohort(spark, sf))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        flagship_em_step, vaf_projection, adj_from_cn, quantile_init,
        e_step_resp, m_step_centers, mixing_weights, marginal_ll_bic, em_unrolled_3, elbo_terms, tail_filter_mask, expand_noise, multiplicity_adj, artefact_nestability, nesting_matrix,
        nesting_order, greedy_tree, constrained_clamp, pairs_tensor, tree_topo_depth, plot_tree_layout, tree_enumeration_best, longitudinal_tree, contingency, contingency_all, v_measure, sc1a, sc1b, sc2a, sc3,
        adaptive_elimination, resume_antijoin, best_config_label, oracle_regret, routing_gain, selection_counts, score_distribution, uncertainty_quartiles, cumulative_regret,
        allocate_clone_sizes, plot_vaf_hist, plot_scatter, plot_fish, plot_samples, plot_heatmap, plot_resp_violin, plot_top_attr, plot_bic_curve, pileup_counts, bic_sweep_1iter, fit_distributed,
        simulate_cohort, augment_cohort, head_mean_select, explain_attributions, meta_features_all_samples, head_suffstats_whole, head_vectors_whole,
    )
}
QUERIES["hard_assign"] = flagship_em_step
QUERIES |= {f"loglik_{n}": _loglik(e) for n, e in (("binomial", EmissionModel.BINOMIAL), ("beta_binomial", EmissionModel.BETA_BINOMIAL), ("bb_pareto", EmissionModel.BB_PARETO), ("dcf", EmissionModel.DCF_BB))}
QUERIES |= {f"fit_{name}": _fit(name) for name in CONFIGS}
