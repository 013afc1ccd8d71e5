"""Queries opN_<name> over the driver's tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonal_spark.llm import alignment, bpe, chaining, column_bwt, gru_lm, host_reputation, minhash, mixing, projection_search, repetition, token_store, toxicity
from clonal_spark.session import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.by_document(chaining.passages(_table(spark, sf_dir, "documents")))


def op2_content_addressed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    token_store.write_store(_table(spark, sf_dir, "documents"), scratch, public_tokenizers.path("byte_bpe_50k.json"), plain_added=False)
    return token_store.read_digests(spark, scratch)


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op4_projection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_search.search(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op5_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_bwt.removals(_table(spark, sf_dir, "documents"), passages=column_bwt.PASSAGE)


def op6_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_coverage(_table(spark, sf_dir, "documents"))


def op7_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op8_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(_table(spark, sf_dir, "documents"))


def op9_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_gru_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(_table(spark, sf_dir, "documents"))


def op11_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_event_sweep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_collinear_chaining, op2_content_addressed_store, op3_host_reputation, op4_projection_search, op5_column_bwt, op6_repetition_coverage, op7_capped_water_filling, op8_setsketch_near_dedup, op9_duckdb_bpe, op10_gru_language_model,
    op11_instance_toxicity, op12_event_sweep_alignment,
)}

#: Word pattern of the contracts.
_WORD = r"[^\x20\x09-\x0D]+"

_RULES = sorted(host_reputation.RULES, key=lambda r: (-len(r[0]), r[0]))


def _fits(rule: str) -> str:
    name, slash, rest = rule.partition("/")
    return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}')"


def _level_sql(name: str, groups: str) -> str:
    return f"""{name}_groups AS ({groups}),
{name} AS (SELECT g.*, n + kappa AS strength, (bad + kappa * prior) / (n + kappa) AS mean
  FROM {name}_groups g, (SELECT 1 / least(greatest(CASE WHEN sum((n - 1) * prior * (1 - prior)) > 0
      THEN (sum(n * pow(bad::DOUBLE / n - prior, 2)) - sum(prior * (1 - prior))) / sum((n - 1) * prior * (1 - prior)) ELSE {host_reputation.RHO_LEAST} END,
      {host_reputation.RHO_LEAST}::DOUBLE), {host_reputation.RHO_MOST}::DOUBLE) - 1 AS kappa FROM {name}_groups WHERE n > 0))"""


_OP3 = rf"""
WITH parsed AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{host_reputation._UPPER}', '{host_reputation._LOWER}') AS host,
                       coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
outcome AS (SELECT doc_id AS page_id, (coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL),
hosts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad, string_split(host, '.')[-1] AS suffix, array_to_string(string_split(host, '.')[-2:], '.') AS domain
          FROM parsed LEFT JOIN outcome USING (page_id) GROUP BY host),
{_level_sql("by_suffix", f"SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior FROM hosts, (SELECT (sum(bad) + {host_reputation.PRIOR_BAD}::DOUBLE) / (sum(n) + {host_reputation.PRIOR_ALL}::DOUBLE) AS prior FROM hosts) GROUP BY suffix")},
{_level_sql("by_domain", "SELECT h.suffix, h.domain, sum(h.n) AS n, sum(h.bad) AS bad, any_value(s.mean) AS prior FROM hosts h JOIN by_suffix s USING (suffix) GROUP BY 1, 2")},
{_level_sql("by_host", "SELECT h.host, h.n, h.bad, d.mean AS prior FROM hosts h JOIN by_domain d USING (domain)")},
known AS (SELECT host, n::BIGINT AS n_labelled, bad::BIGINT AS n_bad, mean AS bad_mean, mean - {host_reputation.Z}::DOUBLE * sqrt(mean * (1 - mean) / (strength + 1)) AS bad_bound FROM by_host),
ruled AS (SELECT *, CASE {' '.join(f"WHEN {_fits(r)} THEN '{r}'" for r, _ in _RULES)} END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in _RULES)} WHEN bad_bound > {host_reputation.LIMIT}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict,
       n_labelled, n_bad, round(bad_mean, 6) AS bad_mean, round(bad_bound, 6) AS bad_bound
FROM ruled JOIN known USING (host)
"""

_OP6_GRAMS = ",\n".join(
    f"""g{n} AS (SELECT doc_id, sum(CASE WHEN covered THEN length(w) ELSE 0 END)::BIGINT AS dup_chars_{n}, sum(covered::INT)::BIGINT AS n_covered_{n}
  FROM (SELECT doc_id, w, coalesce(max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), false) AS covered
        FROM (SELECT doc_id, i, w, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice
              FROM (SELECT doc_id, i, w, CASE WHEN i + {n - 1} <= n_words THEN list_aggregate(ws[i : i + {n - 1}], 'string_agg', ' ') END AS gram FROM words)))
  GROUP BY doc_id)"""
    for n in repetition.NGRAM_LIMITS
)
_OP6 = f"""
WITH docs AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
base AS (SELECT doc_id, text, ws, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
                length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM docs),
words AS (SELECT doc_id, ws, n_words, unnest(ws) AS w, unnest(range(1, n_words + 1)) AS i FROM base WHERE n_words > 0),
lines AS (SELECT doc_id, line, count(*) AS n, any_value(line_chars) AS line_chars
          FROM (SELECT doc_id, line, coalesce(list_sum(list_transform(regexp_extract_all(line, '{_WORD}'), lambda w: length(w))), 0) AS line_chars
                FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base WHERE n_words > 0))
          WHERE line_chars > 0 GROUP BY 1, 2),
dup AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines, sum(CASE WHEN n > 1 THEN n * line_chars ELSE 0 END)::BIGINT AS dup_line_chars FROM lines GROUP BY 1),
{_OP6_GRAMS},
joined AS (SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_covered_5, 0) AS n_repeat_words,
                  coalesce(dup_line_chars, 0) AS dup_line_chars, {', '.join(f'coalesce(dup_chars_{n}, 0) AS dup_chars_{n}' for n in repetition.NGRAM_LIMITS)}
           FROM base b LEFT JOIN dup USING (doc_id) {' '.join(f'LEFT JOIN g{n} USING (doc_id)' for n in repetition.NGRAM_LIMITS)}),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM joined)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {repetition.LINE_LIMIT} * word_chars
       {' '.join(f'AND 100 * dup_chars_{n} <= {most} * word_chars' for n, most in repetition.NGRAM_LIMITS.items())} AS kept FROM judged
"""

_OP7 = f"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS position FROM docs GROUP BY source),
weighed AS (SELECT *, [{', '.join(map(str, mixing.WEIGHTS))}][(position - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM sources),
ranked AS (SELECT *, sum(source_size) OVER () AS budget, sum(weight) OVER () AS sum_weight,
                  sum(source_size) OVER o - source_size AS sizes_before, sum(weight) OVER o - weight AS weights_before
           FROM weighed WHERE source_size > 0 WINDOW o AS (ORDER BY source_size::DOUBLE / weight, position)),
capped AS (SELECT *, weight * (budget - {mixing.MAX_EPOCHS} * sizes_before) > {mixing.MAX_EPOCHS} * source_size * (sum_weight - weights_before) AS capped FROM ranked),
level AS (SELECT source, capped, CASE WHEN capped THEN ({mixing.MAX_EPOCHS} * source_size)::DOUBLE ELSE
                 (weight * (budget - coalesce(sum({mixing.MAX_EPOCHS} * source_size) FILTER (capped) OVER (), 0)))::DOUBLE / (sum(weight) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM capped),
placed AS (SELECT d.*, s.source_size, coalesce(l.target, 0.0::DOUBLE) AS target, coalesce(l.capped, false) AS capped,
                  sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
           FROM docs d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN level l ON d.source IS NOT DISTINCT FROM l.source),
epochs AS (SELECT *, CASE WHEN capped THEN {mixing.MAX_EPOCHS} WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM placed)
SELECT doc_id, source, size, source_size, target,
       (whole * size + least(greatest(CASE WHEN capped THEN 0 ELSE round(target)::BIGINT - whole * source_size END - start, 0), size))::BIGINT AS taken FROM epochs
"""

_OP8 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{host_reputation._UPPER}', '{host_reputation._LOWER}'), '{_WORD}') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN list_aggregate(ws, 'string_agg', ' ') ELSE list_aggregate(ws[i : i + 4], 'string_agg', ' ') END AS s
             FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM docs WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM docs d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY 1) c ON c.node = d.doc_id
"""

ORACLE_SQL = {"op8_setsketch_near_dedup": _OP8, "op3_host_reputation": _OP3, "op6_repetition_coverage": _OP6, "op7_capped_water_filling": _OP7}
