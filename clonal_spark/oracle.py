"""DuckDB SQL of the query catalogue, from shared common table expressions."""

from __future__ import annotations

_E = "1e-10::DOUBLE"


def _clip(x: str, low: str, high: str) -> str:
    return f"least(greatest({x}, {low}), {high})"


_VAF = "alt / greatest(depth, 1.0::DOUBLE)"
_MU = _clip("adj * center", _E, f"1 - {_E}")
_CHOOSE = "(lgamma(depth + 1) - lgamma(alt + 1) - lgamma(depth - alt + 1))"
_BINOMIAL = f"({_CHOOSE} + CASE WHEN alt = 0 THEN 0 ELSE alt * ln(mu) END + CASE WHEN depth - alt = 0 THEN 0 ELSE (depth - alt) * ln(1 - mu) END)"
_BB = f"({_CHOOSE} + lgamma(alt + mu * 100) + lgamma(depth - alt + (1 - mu) * 100) - lgamma(depth + 100) - lgamma(mu * 100) - lgamma((1 - mu) * 100) + lgamma(100))"
_TAIL = f"(ln(0.05::DOUBLE) - 2 * ln({_clip(_VAF, _E, '1.0::DOUBLE')}))"
_BODY = f"(ln(0.95::DOUBLE) + {_BB})"
_BB_PARETO = f"(greatest({_BODY}, {_TAIL}) + ln(1 + exp(-abs({_BODY} - {_TAIL}))))"
EMISSIONS = {"binomial": _BINOMIAL, "beta_binomial": _BB, "bb_pareto": _BB_PARETO, "dcf": _BB}

CTES: dict[str, str] = {
    "reads": "SELECT l_partkey AS mut_id, l_returnflag AS sample_id, sum(l_quantity) AS depth, sum(CASE WHEN l_discount >= 0.05::DOUBLE THEN l_quantity ELSE 0.0::DOUBLE END) AS alt FROM lineitem GROUP BY 1, 2",
    "obs": "SELECT 0::BIGINT AS tumour_id, r.mut_id, sample_id, alt, depth, 2.0::DOUBLE / ((1 + p_size % 4) * 0.8::DOUBLE + 0.4::DOUBLE) AS adj, (1 + p_size % 4)::DOUBLE AS total_cn FROM reads r JOIN part ON p_partkey = r.mut_id "
    "WHERE r.mut_id IN (SELECT mut_id FROM reads GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem))",
    "cohort_reads": "SELECT l_suppkey AS tumour_id, l_partkey AS mut_id, l_returnflag AS sample_id, sum(l_quantity) AS depth, sum(CASE WHEN l_discount >= 0.05::DOUBLE THEN l_quantity ELSE 0.0::DOUBLE END) AS alt FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2, 3",
    "cohort": "SELECT tumour_id, mut_id, sample_id, alt, depth, 2.0::DOUBLE / ((1 + p_size % 4) * 0.8::DOUBLE + 0.4::DOUBLE) AS adj FROM cohort_reads JOIN part ON p_partkey = mut_id",
    "quantiles": f"SELECT tumour_id, sample_id, quantile_cont({_VAF}, [0.25, 0.5, 0.75]) AS q FROM obs GROUP BY 1, 2",
    "params": f"SELECT tumour_id, sample_id, i - 1 AS k, {_clip('q[i]', '1e-6::DOUBLE', '1 - 1e-6::DOUBLE')} AS center FROM quantiles, (SELECT unnest([1, 2, 3]) AS i)",
    "means": "SELECT tumour_id, k, avg(center) AS mean FROM params GROUP BY 1, 2",
    "places": "SELECT *, row_number() OVER (PARTITION BY tumour_id ORDER BY mean DESC, k) - 1 AS place FROM means",
    "pairs": "SELECT a.tumour_id, a.sample_id, a.k, b.k AS other, a.center, b.center AS other_center FROM params a JOIN params b ON a.tumour_id = b.tumour_id AND a.sample_id = b.sample_id AND a.k <> b.k",
    "nested": "SELECT tumour_id, k, other, bool_and(center <= other_center + 1e-6::DOUBLE) AS nested FROM pairs GROUP BY 1, 2, 3",
    "tree": """SELECT m.tumour_id, m.k, CASE WHEN m.k = r.k THEN -1 ELSE coalesce(b.other, r.k) END AS parent FROM means m JOIN places r ON r.tumour_id = m.tumour_id AND r.place = 0
        LEFT JOIN (SELECT n.tumour_id, n.k, arg_min(n.other, struct_pack(a := o.mean, b := n.other)) AS other FROM nested n JOIN means x ON x.tumour_id = n.tumour_id AND x.k = n.k
                   JOIN means o ON o.tumour_id = n.tumour_id AND o.k = n.other WHERE nested AND o.mean > x.mean GROUP BY 1, 2) b ON b.tumour_id = m.tumour_id AND b.k = m.k""",
    "centers7": "SELECT 0::BIGINT AS tumour_id, l_suppkey % 7 AS k, l_returnflag AS sample_id, sum(CASE WHEN round(l_discount * 100) >= 2 + l_suppkey % 7 THEN l_quantity ELSE 0.0::DOUBLE END) / sum(l_quantity) AS center FROM lineitem GROUP BY 1, 2, 3",
    "labels": "SELECT (p_size % 5)::BIGINT AS tumour_id, p_partkey AS mut_id, ascii(substring(p_brand, 7, 1)) % 6 AS true_k, length(p_type) % 5 - 1 AS est_k, 5 AS n_true FROM part",
    "valid": "SELECT * FROM labels WHERE est_k >= 0 AND true_k < n_true",
    "cells": "SELECT tumour_id, true_k, est_k, count(*) AS n FROM valid GROUP BY 1, 2, 3",
    "corpus": "SELECT user_id AS tumour_id, event_id % 5 AS sc, event_type AS config, max(value / 500) AS score FROM events GROUP BY 1, 2, 3",
    "selected": "SELECT tumour_id, sc, (SELECT config FROM (SELECT DISTINCT config FROM corpus) ORDER BY config LIMIT 1) AS selected FROM (SELECT DISTINCT tumour_id, sc FROM corpus)",
    "shaped": f"SELECT *, {_VAF} AS vaf, {_clip(f'{_VAF} / greatest(adj * 0.5::DOUBLE, 1e-9::DOUBLE)', '0.0::DOUBLE', '2.0::DOUBLE')} AS ccf FROM cohort",
}
for _name, _expr in EMISSIONS.items():
    CTES[f"lik_{_name}"] = f"SELECT tumour_id, mut_id, k, sum({_expr}) AS log_lik FROM (SELECT *, {_MU} AS mu FROM obs JOIN params USING (tumour_id, sample_id)) GROUP BY 1, 2, 3"


def _e_step(lik: str, weights: str) -> str:
    return f"""SELECT tumour_id, mut_id, k, log_r, exp(log_r - top) / sum(exp(log_r - top)) OVER w AS r, top + ln(sum(exp(log_r - top)) OVER w) AS ll
        FROM (SELECT *, max(log_r) OVER (PARTITION BY tumour_id, mut_id) AS top FROM (SELECT tumour_id, mut_id, k, log_lik + {weights} AS log_r FROM {lik})) WINDOW w AS (PARTITION BY tumour_id, mut_id)"""


CTES["resp"] = _e_step("lik_binomial", "ln(1 / 3::DOUBLE)")
for _i in range(3):  # unrolled steps
    _p = "params" if not _i else f"params_{_i}"
    CTES[f"liks_{_i}"] = f"SELECT tumour_id, mut_id, k, sum({_BINOMIAL}) AS log_lik FROM (SELECT *, {_MU} AS mu FROM obs JOIN {_p} USING (tumour_id, sample_id)) GROUP BY 1, 2, 3"
    _w = "ln(1 / 3::DOUBLE)" if not _i else f"(SELECT log_pi FROM weights_{_i} w WHERE w.k = liks_{_i}.k)"
    CTES[f"resp_{_i}"] = _e_step(f"liks_{_i}", _w)
    CTES[f"params_{_i + 1}"] = f"SELECT tumour_id, k, sample_id, {_clip('sum(r * alt) / greatest(sum(r * depth), 1e-10::DOUBLE)', '1e-6::DOUBLE', '1 - 1e-6::DOUBLE')} AS center FROM obs JOIN resp_{_i} USING (tumour_id, mut_id) GROUP BY 1, 2, 3"
    CTES[f"weights_{_i + 1}"] = f"SELECT tumour_id, k, ln(greatest(avg(r), 1e-10::DOUBLE)) AS log_pi FROM resp_{_i} GROUP BY 1, 2"



def unrolled(k: int, steps: int, obs: str = "obs", tag: str = "") -> str:
    """Expressions quantiles, params_i, weights_i and resp_i (with the tag) of EM steps at a fixed K over all tumours of obs."""
    low, high = "1e-6::DOUBLE", "1 - 1e-6::DOUBLE"
    out = [
        f"quantiles{tag} AS (SELECT tumour_id, sample_id, quantile_cont({_VAF}, [{', '.join(repr(i / (k + 1)) for i in range(1, k + 1))}]) AS q FROM {obs} GROUP BY 1, 2)",
        f"params{tag}_0 AS (SELECT tumour_id, sample_id, i - 1 AS k, {_clip('q[i]', low, high)} AS center FROM quantiles{tag}, (SELECT unnest(range(1, {k + 1})) AS i))",
    ]
    for i in range(steps):
        weight, joined = (f"ln(1 / {k}::DOUBLE)", "") if not i else ("log_pi", f" JOIN weights{tag}_{i} USING (tumour_id, k)")
        out.append(f"""liks{tag}_{i} AS (SELECT tumour_id, mut_id, k, sum({_BINOMIAL}) AS log_lik FROM (SELECT *, {_MU} AS mu FROM {obs} JOIN params{tag}_{i} USING (tumour_id, sample_id)) GROUP BY 1, 2, 3),
logs{tag}_{i} AS (SELECT tumour_id, mut_id, k, log_lik + {weight} AS log_r FROM liks{tag}_{i}{joined}),
resp{tag}_{i} AS (SELECT tumour_id, mut_id, k, e / sum(e) OVER w AS r, top + ln(sum(e) OVER w) AS ll FROM (SELECT *, exp(log_r - top) AS e FROM (SELECT *, max(log_r) OVER (PARTITION BY tumour_id, mut_id) AS top FROM logs{tag}_{i})) WINDOW w AS (PARTITION BY tumour_id, mut_id)),
params{tag}_{i + 1} AS (SELECT tumour_id, k, sample_id, {_clip('sum(r * alt) / greatest(sum(r * depth), 1e-10::DOUBLE)', low, high)} AS center FROM {obs} JOIN resp{tag}_{i} USING (tumour_id, mut_id) GROUP BY 1, 2, 3),
weights{tag}_{i + 1} AS (SELECT tumour_id, k, ln(greatest(avg(r), 1e-10::DOUBLE)) AS log_pi FROM resp{tag}_{i} GROUP BY 1, 2)""")
    return ",\n".join(out)


_LOGIT = "1 / (1 + exp(-least(greatest({}, -500), 500)))"


def sql(select: str) -> str:
    """WITH the expressions that select needs, in the order of CTES."""
    import re

    need, todo = set(), [select]
    while todo:
        for name in re.findall(r"\b\w+\b", todo.pop()):
            if name in CTES and name not in need:
                need.add(name)
                todo.append(CTES[name])
    if "depths" in need:
        need.add("depths")
    parts = [f"{n} AS ({body})" for n, body in CTES.items() if n in need]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


def _kde(low: float, high: float, factor: float, start: float, stop: float, points: int, least: int) -> str:
    step = (stop - start) / (points - 1)
    return f"""(SELECT tumour_id, i, i * {step!r}::DOUBLE + {start}::DOUBLE AS x, sum(exp(-0.5::DOUBLE * pow((i * {step!r}::DOUBLE + {start}::DOUBLE - ccf) / (sd * {factor}::DOUBLE), 2))) AS density
        FROM (SELECT * FROM shaped WHERE ccf > {low} AND ccf < {high}) JOIN (SELECT tumour_id, stddev_samp(ccf) AS sd FROM shaped WHERE ccf > {low} AND ccf < {high} GROUP BY 1 HAVING count(*) >= {least} AND stddev_samp(ccf) > 0) USING (tumour_id),
             range(0, {points}) t(i) GROUP BY 1, 2, 3)"""


CTES["peaks"] = f"""SELECT tumour_id, greatest(coalesce(n, 1.0::DOUBLE), 1.0::DOUBLE) AS n_peaks FROM (SELECT DISTINCT tumour_id FROM shaped) LEFT JOIN
    (SELECT tumour_id, sum((density > before AND density > after AND density > 0.1::DOUBLE * top)::INT)::DOUBLE AS n FROM
      (SELECT *, lag(density) OVER l AS before, lead(density) OVER l AS after, max(density) OVER (PARTITION BY tumour_id) AS top FROM {_kde(0.01, 1.99, 0.1, 0.01, 1.5, 200, 10)} WINDOW l AS (PARTITION BY tumour_id ORDER BY i)) GROUP BY 1) USING (tumour_id)"""
CTES["purities"] = f"""SELECT tumour_id, coalesce(x, 0.5::DOUBLE) AS purity_estimate FROM (SELECT DISTINCT tumour_id FROM shaped) LEFT JOIN
    (SELECT tumour_id, arg_max(x, struct_pack(a := density, b := -i)) AS x FROM {_kde(0.3, 1.5, 0.15, 0.3, 1.5, 100, 5)} GROUP BY 1) USING (tumour_id)"""
CTES["depth_part"] = "SELECT tumour_id, quantile_cont(depth, 0.5) AS depth_median, stddev_pop(depth) / greatest(avg(depth), 1e-9::DOUBLE) AS depth_cv, avg((depth < 20)::INT) AS frac_low_depth FROM cohort GROUP BY 1"
CTES["cn_part"] = "SELECT tumour_id, avg((abs(adj - 1) > 0.05)::INT) AS frac_cna, 2.0::DOUBLE / greatest(avg(adj), 0.1::DOUBLE) AS ploidy, count(DISTINCT round_even(adj, 2))::DOUBLE AS n_cn_states, avg((adj > 1.2)::INT) AS frac_loh, 0.0::DOUBLE AS subclonal_cn, (2.0::DOUBLE / greatest(avg(adj), 0.1::DOUBLE) > 3)::INT::DOUBLE AS wgd FROM cohort GROUP BY 1"
CTES["moments"] = "SELECT tumour_id, count(*) AS n, avg(ccf) AS m FROM shaped GROUP BY 1"
CTES["shape_part"] = """SELECT tumour_id, CASE WHEN count(*) > 2 AND var_pop(ccf) > 0 THEN avg(pow(ccf - m, 3)) / pow(var_pop(ccf), 1.5) ELSE 0 END AS skewness,
    CASE WHEN count(*) > 2 AND var_pop(ccf) > 0 THEN avg(pow(ccf - m, 4)) / pow(var_pop(ccf), 2) - 3 ELSE 0 END AS kurtosis,
    CASE WHEN count(*) < 10 OR count(*) FILTER (ccf > 0.5 AND ccf < 1.5) < 5 THEN 0.5 ELSE 2.355::DOUBLE * stddev_pop(ccf) FILTER (ccf > 0.5 AND ccf < 1.5) END AS clonal_peak_width,
    CASE WHEN count(*) < 20 THEN 0.0 ELSE (avg((vaf > 0.01 AND vaf < 0.15)::INT) > 0.3)::INT::DOUBLE END AS has_pareto_tail FROM shaped JOIN moments USING (tumour_id) GROUP BY 1"""
CTES["tail_stats"] = f"SELECT tumour_id, sample_id, median(v) AS med, avg(v) AS m, var_pop(v) AS s2 FROM (SELECT *, {_clip(_VAF, '1e-8::DOUBLE', '1 - 1e-8::DOUBLE')} AS v FROM obs) GROUP BY 1, 2"
CTES["tail_pars"] = f"""SELECT tumour_id, sample_id, {_clip('med', '0.05::DOUBLE', '0.95::DOUBLE')} AS mu, CASE WHEN s2 <= 0 OR s2 >= mm * (1 - mm) THEN 50.0::DOUBLE ELSE {_clip('mm * (1 - mm) / s2 - 1', '1.0::DOUBLE', '1000.0::DOUBLE')} END AS phi
    FROM (SELECT *, {_clip('m', '0.01::DOUBLE', '0.99::DOUBLE')} AS mm FROM tail_stats)"""
CTES["tail_cells"] = f"""SELECT tumour_id, mut_id, sample_id, exp(t - (greatest(t, b) + ln(1 + exp(-abs(t - b))))) AS p_tail FROM
    (SELECT *, -ln(v) - ln(-ln(1e-8::DOUBLE)) + ln(0.1::DOUBLE) AS t, (mu * phi - 1) * ln(v) + ((1 - mu) * phi - 1) * ln(1 - v) - (lgamma(mu * phi) + lgamma((1 - mu) * phi) - lgamma(phi)) + ln(0.9::DOUBLE) AS b
     FROM (SELECT *, {_clip(_VAF, '1e-8::DOUBLE', '1 - 1e-8::DOUBLE')} AS v FROM obs) JOIN tail_pars USING (tumour_id, sample_id))"""
CTES["tail_muts"] = "SELECT tumour_id, mut_id, bool_and(p_tail <= 0.5) AS stays FROM tail_cells GROUP BY 1, 2"
CTES["kept"] = "SELECT tumour_id, mut_id, stays OR sum(stays::INT) OVER (PARTITION BY tumour_id) < 2 AS kept FROM tail_muts"
CTES["assigned"] = "SELECT tumour_id, mut_id, arg_max(k, struct_pack(a := r, b := -k)) AS k, max(r) AS r FROM resp GROUP BY 1, 2"
CTES["best_scores"] = "SELECT tumour_id, sc, max(score) AS best FROM corpus GROUP BY 1, 2"
CTES["entropies"] = """SELECT t.tumour_id, t.h AS h_true, t.c AS n_true, e.h AS h_est, e.c AS n_est FROM
    (SELECT tumour_id, -sum(n / total * ln(n / total + 1e-15::DOUBLE)) AS h, count(*) AS c FROM (SELECT tumour_id, true_k, sum(n)::DOUBLE AS n, sum(sum(n)) OVER (PARTITION BY tumour_id) AS total FROM cells GROUP BY 1, 2) GROUP BY 1) t
    JOIN (SELECT tumour_id, -sum(n / total * ln(n / total + 1e-15::DOUBLE)) AS h, count(*) AS c FROM (SELECT tumour_id, est_k, sum(n)::DOUBLE AS n, sum(sum(n)) OVER (PARTITION BY tumour_id) AS total FROM cells GROUP BY 1, 2) GROUP BY 1) e USING (tumour_id)"""
CTES["givens"] = """SELECT tumour_id, -sum(ne / total * n / ne * ln(n / ne + 1e-15::DOUBLE)) AS hte, -sum(nt / total * n / nt * ln(n / nt + 1e-15::DOUBLE)) AS het FROM
    (SELECT tumour_id, n::DOUBLE AS n, (sum(n) OVER (PARTITION BY tumour_id, est_k))::DOUBLE AS ne, (sum(n) OVER (PARTITION BY tumour_id, true_k))::DOUBLE AS nt, (sum(n) OVER (PARTITION BY tumour_id))::DOUBLE AS total FROM cells) GROUP BY 1"""
CTES["z"] = "SELECT vec_id, label AS arm, (vec_id % 100) / 100.0::DOUBLE AS reward, embedding[:8]::DOUBLE[] AS z FROM embeddings"

_SWEEP = " UNION ALL ".join(f"SELECT {k} AS n_k, tumour_id, sample_id, i - 1 AS k, {_clip('q[i]', '1e-6::DOUBLE', '1 - 1e-6::DOUBLE')} AS center FROM (SELECT tumour_id, sample_id, quantile_cont({_VAF}, [{', '.join(f'{i}::DOUBLE / {k + 1}' for i in range(1, k + 1))}]) AS q FROM obs GROUP BY 1, 2), (SELECT unnest(range(1, {k + 1})) AS i)" for k in range(1, 11))
CTES["sweep"] = f"""SELECT n_k, tumour_id, mut_id, ln(sum(exp(l - top))) + max(top) - ln(n_k) AS ll FROM (SELECT *, max(l) OVER (PARTITION BY n_k, tumour_id, mut_id) AS top FROM
    (SELECT n_k, tumour_id, mut_id, k, sum({_BINOMIAL}) AS l FROM (SELECT *, {_MU} AS mu FROM obs JOIN ({_SWEEP}) USING (tumour_id, sample_id)) GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3"""

_FEATURES = "depth_median, depth_cv, frac_low_depth, frac_cna, wgd, ploidy, n_cn_states, frac_loh, subclonal_cn, skewness, kurtosis, n_peaks, clonal_peak_width, has_pareto_tail, purity_estimate, n_samples, is_longitudinal, n_mutations, sequencing_type, nrpcc, mappability"


def _rounded(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n.strip()}, {digits}) AS {n.strip()}" for n in names.split(","))


ORACLE_SQL: dict[str, str] = {
    "flagship_em_step": sql("SELECT tumour_id, mut_id, k, round(r, 6) AS r FROM assigned"),
    "vaf_projection": sql(f"SELECT tumour_id, mut_id, sample_id, round({_VAF}, 9) AS vaf FROM obs"),
    "ccf_projection": sql("SELECT tumour_id, mut_id, sample_id, round(ccf, 9) AS ccf FROM shaped"),
    "adj_from_cn": sql("SELECT mut_id, sample_id, total_cn, round(adj, 9) AS adj FROM obs"),
    "depth_stats": sql(f"SELECT tumour_id, {_rounded('depth_median, depth_cv, frac_low_depth')} FROM depth_part"),
    "cn_landscape": sql(f"SELECT tumour_id, {_rounded('frac_cna, ploidy, n_cn_states, frac_loh, subclonal_cn, wgd')} FROM cn_part"),
    "vaf_shape": sql(f"SELECT tumour_id, {_rounded('skewness, kurtosis, clonal_peak_width')} FROM shape_part"),
    "tail_test": sql("SELECT tumour_id, has_pareto_tail FROM shape_part"),
    "kde_peaks": sql("SELECT * FROM peaks"),
    "kde_purity": sql("SELECT tumour_id, round(purity_estimate, 6) AS purity_estimate FROM purities"),
    "meta_features_cohort": sql(
        f"""SELECT tumour_id, {_rounded(_FEATURES)} FROM (SELECT *, 1.0::DOUBLE AS n_samples, 0.0::DOUBLE AS is_longitudinal, n::DOUBLE AS n_mutations, (n > 1000)::INT::DOUBLE AS sequencing_type, depth_median * n / greatest(n_peaks, 1.0::DOUBLE) AS nrpcc, 1.0::DOUBLE AS mappability
        FROM depth_part JOIN cn_part USING (tumour_id) JOIN shape_part USING (tumour_id) JOIN peaks USING (tumour_id) JOIN purities USING (tumour_id) JOIN moments USING (tumour_id))"""
    ),
    "quantile_init": sql("SELECT tumour_id, sample_id, k, round(center, 9) AS center FROM params"),
    **{f"loglik_{n}": sql(f"SELECT tumour_id, mut_id, k, round(log_lik, 5) AS log_lik FROM lik_{n}") for n in EMISSIONS},
    "e_step_resp": sql("SELECT tumour_id, mut_id, k, round(r, 6) AS r, round(ll, 5) AS ll FROM resp"),
    "hard_assign": sql("SELECT tumour_id, mut_id, k, round(r, 6) AS r FROM assigned"),
    "m_step_centers": sql("SELECT tumour_id, k, sample_id, round(center, 8) AS center FROM params_1"),
    "mixing_weights": sql("SELECT tumour_id, k, round(log_pi, 7) AS log_pi FROM weights_1"),
    "marginal_ll_bic": sql("SELECT tumour_id, n_mut, 3::BIGINT AS n_clones, round(ll, 3) AS log_lik, round(-2 * ll + 9 * ln(n_mut), 3) AS bic FROM (SELECT tumour_id, count(*) AS n_mut, sum(ll) AS ll FROM (SELECT DISTINCT tumour_id, mut_id, ll FROM resp) GROUP BY 1)"),
    "em_unrolled_3": sql("SELECT tumour_id, k, sample_id, round(center, 7) AS center FROM params_3"),
    "elbo_terms": sql("SELECT tumour_id, round(sum(r * log_r), 3) AS expected, round(sum(-r * ln(greatest(r, 1e-300::DOUBLE))), 3) AS entropy FROM resp GROUP BY 1"),
    "tail_filter_mask": sql("SELECT * FROM kept"),
    "expand_noise": sql("SELECT tumour_id, mut_id, CASE WHEN kept THEN a.k ELSE -1 END AS k FROM kept JOIN assigned a USING (tumour_id, mut_id)"),
    "multiplicity_adj": sql(f"""SELECT mut_id, sample_id, round(arg_min(m / (total_cn * 0.8::DOUBLE + 0.4::DOUBLE), struct_pack(a := abs({_VAF} / (m / (total_cn * 0.8::DOUBLE + 0.4::DOUBLE)) - 1), b := m)), 9) AS adj
        FROM (SELECT *, unnest(range(1, total_cn::BIGINT + 1)) AS m FROM obs) GROUP BY 1, 2"""),
    "artefact_nestability": sql("""SELECT tumour_id, k, coalesce(bool_or(fits), false) AS nestable FROM (SELECT a.tumour_id, a.k, b.k AS other, bool_and(NOT (a.center > 0.45) OR b.center > 0.45) OR bool_and(NOT (b.center > 0.45) OR a.center > 0.45) AS fits
        FROM centers7 a LEFT JOIN centers7 b ON a.tumour_id = b.tumour_id AND a.sample_id = b.sample_id AND a.k <> b.k GROUP BY 1, 2, 3) GROUP BY 1, 2"""),
    "nesting_matrix": sql("SELECT * FROM nested"),
    "nesting_order": sql("SELECT tumour_id, k, round(mean, 8) AS mean, place FROM places"),
    "greedy_tree": sql("SELECT * FROM tree"),
    "constrained_clamp": sql(f"""SELECT tumour_id, k, sample_id, round({_clip('min(center + place * 1e-6::DOUBLE) OVER (PARTITION BY tumour_id, sample_id ORDER BY place ROWS UNBOUNDED PRECEDING) - place * 1e-6::DOUBLE', '1e-6::DOUBLE', '1 - 1e-6::DOUBLE')}, 9) AS center
        FROM (SELECT c.*, row_number() OVER (PARTITION BY c.sample_id ORDER BY m.mean DESC, c.k) - 1 AS place FROM centers7 c JOIN (SELECT k, avg(center) AS mean FROM centers7 GROUP BY 1) m USING (k))"""),
    "pairs_tensor": sql(f"""SELECT tumour_id, k, other, round(a / (a + d + s + 0.001::DOUBLE), 7) AS ancestor, round(d / (a + d + s + 0.001::DOUBLE), 7) AS descendant, round(0.001::DOUBLE / (a + d + s + 0.001::DOUBLE), 7) AS branching, round(s / (a + d + s + 0.001::DOUBLE), 7) AS same
        FROM (SELECT tumour_id, k, other, avg({_LOGIT.format('(center - other_center) / 0.1::DOUBLE')}) AS a, avg({_LOGIT.format('(other_center - center) / 0.1::DOUBLE')}) AS d, avg({_LOGIT.format('5 - abs(center - other_center) / 0.1::DOUBLE')}) AS s FROM pairs GROUP BY 1, 2, 3)"""),
    "contingency": sql("SELECT * FROM cells"),
    "v_measure": sql("SELECT tumour_id, round(CASE WHEN n_true <= 1 THEN 1.0 ELSE 2 * (1 - hte / h_true) * (CASE WHEN n_est > 1 THEN 1 - het / h_est ELSE 1 END) / ((1 - hte / h_true) + (CASE WHEN n_est > 1 THEN 1 - het / h_est ELSE 1 END)) END, 9) AS v_measure FROM givens JOIN entropies USING (tumour_id)"),
    "sc1a": sql("SELECT tumour_id, round(greatest(0.0::DOUBLE, 1 - abs(max(center) - 0.8::DOUBLE)), 9) AS score FROM params GROUP BY 1"),
    "sc2a": "SELECT p_partkey AS mut_id, round(CASE WHEN e <= 0 THEN 0.0 ELSE greatest(0.0::DOUBLE, 1 - abs(t - e) / greatest(t, e)::DOUBLE) END, 9) AS score FROM (SELECT p_partkey, 1 + p_size % 6 AS t, length(p_type) % 6 AS e FROM part)",
    "sc1b": sql("""SELECT tumour_id, round(avg(s), 9) AS score FROM (SELECT tumour_id, sample_id, greatest(0.0::DOUBLE, 1 - sqrt(sum(n * pow(t.center - e.center, 2)) / sum(n))) AS s
        FROM cells JOIN (SELECT k AS true_k, sample_id, center FROM centers7) t USING (true_k) JOIN (SELECT k AS est_k, sample_id, center FROM centers7) e USING (est_k, sample_id) GROUP BY 1, 2) GROUP BY 1"""),
    "sc3": """SELECT tumour_id, round(hit::DOUBLE / greatest(edges, 1), 9) AS score FROM (SELECT (p_partkey % 20)::BIGINT AS tumour_id, count(*) AS edges, sum((p_size % 3 = length(p_name) % 3)::INT) AS hit FROM part GROUP BY 1)""",
    "adaptive_elimination": sql("SELECT tumour_id, round(min(best), 9) AS least FROM best_scores GROUP BY 1 HAVING count(*) = 5 AND min(best) > 0.5 - 0.3"),
    "resume_antijoin": sql("SELECT DISTINCT tumour_id, config FROM corpus WHERE (tumour_id, config) NOT IN (SELECT tumour_id, config FROM corpus WHERE score > 0.9)"),
    "best_config_label": sql("SELECT tumour_id, sc, arg_max(config, struct_pack(a := score, b := -idx)) AS config, round(max(score), 9) AS score FROM corpus JOIN (SELECT config, row_number() OVER (ORDER BY config) - 1 AS idx FROM (SELECT DISTINCT config FROM corpus)) USING (config) GROUP BY 1, 2"),
    "head_suffstats": sql("SELECT arm, i - 1 AS i, j - 1 AS j, round(sum(z[i] * z[j]), 6) AS zz FROM z, range(1, 9) a(i), range(1, 9) b(j) GROUP BY 1, 2, 3"),
    "head_vectors": sql("SELECT arm, i - 1 AS i, round(sum(z[i] * reward), 6) AS zy, count(*) AS n FROM z, range(1, 9) a(i) GROUP BY 1, 2"),
    "oracle_regret": sql("SELECT round(avg(best - coalesce(c.score, 0)), 9) AS regret, count(*) AS n FROM best_scores JOIN selected USING (tumour_id, sc) LEFT JOIN corpus c ON c.tumour_id = best_scores.tumour_id AND c.sc = best_scores.sc AND c.config = selected"),
    "routing_gain": sql("""SELECT round(avg(coalesce(c.score, 0) - coalesce(b.score, 0)), 9) AS gain, count(*) AS n FROM selected s LEFT JOIN corpus c ON c.tumour_id = s.tumour_id AND c.sc = s.sc AND c.config = s.selected
        LEFT JOIN corpus b ON b.tumour_id = s.tumour_id AND b.sc = s.sc AND b.config = 'purchase'"""),
    "selection_counts": sql("SELECT sc, config, count(b.tumour_id) AS n FROM (SELECT DISTINCT sc FROM corpus), (SELECT DISTINCT config FROM corpus) LEFT JOIN (SELECT tumour_id, sc AS s, arg_max(config, struct_pack(a := score, b := config)) AS c FROM corpus GROUP BY 1, 2) b ON s = sc AND c = config GROUP BY 1, 2"),
    "score_distribution": sql(f"SELECT sc, {_rounded('mean, std, median, least, most')}, n FROM (SELECT sc, avg(best) AS mean, stddev_pop(best) AS std, quantile_cont(best, 0.5) AS median, min(best) AS least, max(best) AS most, count(*) AS n FROM best_scores GROUP BY 1)"),
    "uncertainty_quartiles": sql("""SELECT sc, quarter, round(avg(best), 6) AS mean_score, round(avg(u), 6) AS mean_uncertainty, count(*) AS n FROM (SELECT *, (place >= n // 4)::INT + (place >= 2 * n // 4)::INT + (place >= 3 * n // 4)::INT AS quarter
        FROM (SELECT *, row_number() OVER (PARTITION BY sc ORDER BY u, tumour_id) - 1 AS place, count(*) OVER (PARTITION BY sc) AS n FROM (SELECT *, abs(best - 0.5::DOUBLE) AS u FROM best_scores)) WHERE n >= 4) GROUP BY 1, 2"""),
    "cumulative_regret": sql("SELECT sc, tumour_id, round(sum(1 - best) OVER (PARTITION BY sc ORDER BY tumour_id ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM best_scores"),
    "allocate_clone_sizes": """WITH s AS (SELECT l_suppkey AS tumour_id, l_linenumber AS k, count(*) AS c FROM lineitem GROUP BY 1, 2), f AS (SELECT *, c / sum(c) OVER (PARTITION BY tumour_id)::DOUBLE * 100 AS exact FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY tumour_id ORDER BY exact - floor(exact) DESC, k) AS place, 100 - sum(floor(exact)) OVER (PARTITION BY tumour_id) AS rest FROM f) SELECT tumour_id, k::INT AS k, (floor(exact) + (place <= rest)::INT)::BIGINT AS size FROM r""",
    "plot_vaf_hist": sql(f"SELECT tumour_id, sample_id, k, least(floor({_VAF} * 50), 49)::INT AS bin, count(*) AS n FROM obs JOIN assigned USING (tumour_id, mut_id) GROUP BY 1, 2, 3, 4"),
    "plot_scatter": sql(f"SELECT tumour_id, mut_id, sample_id, k, round({_VAF}, 9) AS vaf FROM obs JOIN assigned USING (tumour_id, mut_id)"),
    "plot_fish": sql("SELECT tumour_id, sample_id, k, place, round(center, 8) AS center, round(high - center, 8) AS low, round(high, 8) AS high FROM (SELECT *, sum(center) OVER (PARTITION BY tumour_id, sample_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS high FROM params JOIN places USING (tumour_id, k))"),
    "plot_samples": sql("SELECT tumour_id, k, round(max(center) FILTER (sample_id = 'A'), 8) AS A, round(max(center) FILTER (sample_id = 'N'), 8) AS N, round(max(center) FILTER (sample_id = 'R'), 8) AS R FROM params GROUP BY 1, 2"),
    "plot_heatmap": sql("SELECT tumour_id, row, mut_id, assigned, k, round(r, 6) AS r FROM resp JOIN (SELECT tumour_id, mut_id, k AS assigned, row_number() OVER (ORDER BY k, mut_id) AS row FROM assigned) USING (tumour_id, mut_id)"),
    "plot_resp_violin": sql(f"SELECT tumour_id, k, n, {_rounded('least, q1, median, q3, most')} FROM (SELECT tumour_id, k, count(*) AS n, min(r) AS least, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.75) AS q3, max(r) AS most FROM assigned GROUP BY 1, 2)"),
    "plot_top_attr": "SELECT name, round(value, 6) AS value FROM (SELECT p_brand AS name, avg(p_retailprice) - 1200 AS value FROM part GROUP BY 1) ORDER BY abs(value) DESC, name LIMIT 10",
    "plot_bic_curve": "SELECT tumour_id, K, bic, row_number() OVER (PARTITION BY tumour_id ORDER BY bic, K) = 1 AS best FROM (SELECT (o_custkey % 10)::BIGINT AS tumour_id, (1 + o_orderkey % 10)::INT AS K, min(o_totalprice) AS bic FROM orders GROUP BY 1, 2)",
    "tree_topo_depth": sql("""SELECT tumour_id, k, parent, d AS depth FROM (WITH RECURSIVE down(tumour_id, k, parent, d) AS (SELECT tumour_id, k, parent, 0 FROM tree WHERE parent = -1
        UNION ALL SELECT e.tumour_id, e.k, e.parent, d + 1 FROM tree e JOIN down p ON e.tumour_id = p.tumour_id AND e.parent = p.k) SELECT * FROM down)"""),
    "pileup_counts": "SELECT l_linestatus AS chrom, l_linenumber::BIGINT AS pos, sum((l_returnflag = 'R')::INT)::BIGINT AS alt, count(*) AS depth FROM lineitem GROUP BY 1, 2",
    "bic_sweep_1iter": sql("SELECT tumour_id, K, round(bic, 3) AS bic, row_number() OVER (PARTITION BY tumour_id ORDER BY bic, K) = 1 AS best FROM (SELECT tumour_id, n_k::BIGINT AS K, -2 * sum(ll) + n_k * 3 * ln(count(*)) AS bic FROM sweep GROUP BY tumour_id, n_k)"),
    "contingency_all": sql("SELECT tumour_id, true_k, est_k, count(*) AS n FROM labels GROUP BY 1, 2, 3"),
}
