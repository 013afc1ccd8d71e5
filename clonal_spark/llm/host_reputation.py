"""URL filters: rules first, then empirical-Bayes host reputation.

A labelled page is bad if its quality label is 0 or its toxic label is 1. Counts of bad pages are shrunk
from suffix to registered domain to host: at each level a beta prior is centred on the parent's posterior
mean, and its strength comes from the groups' overdispersion by the method of moments. A host is blocked
if even the lower bound of its posterior bad rate (Z posterior standard deviations below the mean) exceeds
LIMIT. Without a list of public suffixes, the suffix is the host's last label and the registered domain its
last two.

Defined results: a null url, or one without ://, has an empty host and path, no rule, and the reputation
of the empty host; hosts without labels have their parent's; a page with several labels counts each; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
LIMIT, Z = 0.5, 2.0
#: Bounds of the overdispersion of one level.
RHO_LEAST, RHO_MOST = 0.001, 0.5
PRIOR_BAD, PRIOR_ALL = 1.0, 10.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _level(groups: DataFrame) -> DataFrame:
    """groups: key, n, bad and its parent's mean as `prior`. Adds `mean` and `strength`. The method of moments runs over all groups as one aggregate."""
    spread = F.col("prior") * (1 - F.col("prior"))
    moments = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), F.lit(2))).alias("found"),
        F.sum(spread).alias("expected"),
        F.sum((F.col("n") - 1) * spread).alias("scale"),
    )
    rho = F.when(F.col("scale") > 0, (F.col("found") - F.col("expected")) / F.when(F.col("scale") > 0, F.col("scale"))).otherwise(F.lit(RHO_LEAST))
    kappa = moments.select((1 / F.least(F.greatest(rho, F.lit(RHO_LEAST)), F.lit(RHO_MOST)) - 1).alias("kappa"))
    joined = groups.crossJoin(F.broadcast(kappa))  # one row of one number
    return joined.withColumn("strength", F.col("n") + F.col("kappa")).withColumn("mean", (F.col("bad") + F.col("kappa") * F.col("prior")) / F.col("strength"))


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (host, n_labelled, n_bad, bad_mean, bad_bound) from pages (page_id, host) and labels (doc_id, quality, toxic)."""
    outcome = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").select(F.col("doc_id").alias("page_id"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("long").alias("bad"))
    labelled = pages.join(outcome, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = labelled.withColumns({"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})
    total = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + PRIOR_BAD) / (F.coalesce(F.sum("n"), F.lit(0)) + PRIOR_ALL)).alias("prior"))
    by_suffix = _level(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(total)))
    by_domain = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_domain = _level(by_domain.join(by_suffix.select("suffix", F.col("mean").alias("prior")), "suffix"))
    by_host = _level(hosts.join(by_domain.select("domain", F.col("mean").alias("prior")), "domain"))
    bound = F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    return by_host.select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), F.col("mean").alias("bad_mean"), bound.alias("bad_bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and its host's figures. Only ids and urls are read. A label is
    a page's outcome where its doc_id equals the page_id: the tables share numbers, and nothing else says which page a
    label belongs to. A page of several labels counts each; null ids have none."""
    url = pages[url_col].cast("string")
    parsed = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = reputations(parsed.select("page_id", "host"), labels)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    joined = parsed.join(known, "host", "left")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad_bound") > LIMIT, "block").otherwise("allow")).alias("verdict"), "n_labelled", "n_bad", F.round("bad_mean", 6).alias("bad_mean"), F.round("bad_bound", 6).alias("bad_bound"))
