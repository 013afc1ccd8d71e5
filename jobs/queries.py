"""The jobs as queries over the whole tables, with their DuckDB SQL. Each runs twice into one new folder, and the output is
what stands after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonal_spark.config import FEATURE_NAMES
from clonal_spark.oracle import _FEATURES, _rounded, unrolled
from clonal_spark.oracle import sql as with_tables
from clonal_spark.session import Scratch
from clonal_spark.sources import texts
from clonal_spark.whole_queries import CTES  # noqa: F401  (registers the cohort's expressions)
from jobs import cohort_features, text_mixture


def job1_cohort_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "job1")
    # a pattern, as the table may be a single file, which a stream does not take
    for _ in range(2):
        out = cohort_features.run(spark, f"{sf_dir}/lineitem.[p]arquet", f"{sf_dir}/part.parquet", scratch.path("output"), scratch.path("checkpoint"))
    return out.withColumns({n: F.round(n, 6) for n in FEATURE_NAMES})


def job2_text_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "job2")
    for _ in range(2):
        out = text_mixture.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", scratch.path("output"))
    return out.drop("folder").withColumns({n: F.round(n, 6) for n in ("probability", "component_share", "component_repeats", "component_long", "v_measure")})


QUERIES = {f.__name__: f for f in (job1_cohort_features, job2_text_mixture)}

_JOB1 = with_tables(f"SELECT tumour_id, (tumour_id % {cohort_features.DEFAULTS['folders']})::INT AS folder, {_rounded(_FEATURES)} FROM (SELECT * REPLACE (1.0::DOUBLE AS mappability) FROM all_features)")

_K, _STEPS = text_mixture.DEFAULTS["components"], text_mixture.DEFAULTS["steps"]


_JOB2 = rf"""
WITH docs AS (SELECT coalesce(source, '') AS tumour_id, doc_id AS mut_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
counts AS (SELECT tumour_id, mut_id, sum(len(ws))::BIGINT AS words, sum(len(ws) - len(list_distinct(ws)))::BIGINT AS repeats, sum(len(list_filter(ws, lambda w: length(w) >= {texts.LONG})))::BIGINT AS long_words
           FROM docs GROUP BY 1, 2 HAVING sum(len(ws)) > 0),
obs AS (SELECT tumour_id, mut_id, 'long' AS sample_id, long_words::DOUBLE AS alt, words::DOUBLE AS depth, 1.0::DOUBLE AS adj FROM counts
        UNION ALL SELECT tumour_id, mut_id, 'repeats', repeats::DOUBLE, words::DOUBLE, 1.0::DOUBLE FROM counts),
{unrolled(_K, _STEPS)},
found AS (SELECT tumour_id, mut_id, (min(k) FILTER (r >= top - {text_mixture.TIE!r}::DOUBLE))::INT AS component, max(r) AS probability
          FROM (SELECT *, max(r) OVER (PARTITION BY tumour_id, mut_id) AS top FROM resp_{_STEPS - 1}) GROUP BY 1, 2),
components AS (SELECT tumour_id, k::INT AS component, exp(any_value(log_pi)) AS component_share, max(center) FILTER (sample_id = 'repeats') AS component_repeats, max(center) FILTER (sample_id = 'long') AS component_long
               FROM params_{_STEPS} JOIN weights_{_STEPS} USING (tumour_id, k) GROUP BY 1, 2),
marked AS (SELECT f.tumour_id, l.true_k, f.component AS est_k FROM found f JOIN (SELECT doc_id, min(quality) AS true_k FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1) l ON l.doc_id = f.mut_id),
cells AS (SELECT tumour_id, true_k, est_k, count(*)::DOUBLE AS n FROM marked GROUP BY 1, 2, 3),
sums AS (SELECT *, sum(n) OVER (PARTITION BY tumour_id, true_k) AS nt, sum(n) OVER (PARTITION BY tumour_id, est_k) AS ne, sum(n) OVER (PARTITION BY tumour_id) AS total FROM cells),
given AS (SELECT tumour_id, sum(-ne / total * n / ne * ln(n / ne + 1e-15::DOUBLE)) AS h_true_est, sum(-nt / total * n / nt * ln(n / nt + 1e-15::DOUBLE)) AS h_est_true FROM sums GROUP BY 1),
h_true AS (SELECT tumour_id, sum(-nt / total * ln(nt / total + 1e-15::DOUBLE)) AS h, count(*) AS n FROM (SELECT DISTINCT tumour_id, true_k, nt, total FROM sums) GROUP BY 1),
h_est AS (SELECT tumour_id, sum(-ne / total * ln(ne / total + 1e-15::DOUBLE)) AS h, count(*) AS n FROM (SELECT DISTINCT tumour_id, est_k, ne, total FROM sums) GROUP BY 1),
parts AS (SELECT g.tumour_id, t.n AS n_true, 1 - h_true_est / CASE WHEN t.n > 1 THEN t.h END AS hom, CASE WHEN e.n > 1 THEN 1 - h_est_true / e.h ELSE 1 END AS com FROM given g JOIN h_true t USING (tumour_id) JOIN h_est e USING (tumour_id)),
agreement AS (SELECT tumour_id, CASE WHEN n_true <= 1 THEN 1.0::DOUBLE WHEN hom + com = 0 THEN 0.0::DOUBLE ELSE 2 * hom * com / (hom + com) END AS v_measure FROM parts)
SELECT tumour_id, mut_id, words, repeats, long_words, component, round(probability, 6) AS probability, round(component_share, 6) AS component_share,
       round(component_repeats, 6) AS component_repeats, round(component_long, 6) AS component_long, round(v_measure, 6) AS v_measure
FROM counts JOIN found USING (tumour_id, mut_id) JOIN components USING (tumour_id, component) LEFT JOIN agreement USING (tumour_id)
"""

ORACLE_SQL = {"job1_cohort_features": _JOB1, "job2_text_mixture": _JOB2}
