"""Splits each source's documents into components of like making: python -m jobs.text_mixture --help.

1. Documents become counts (words, words that repeat an earlier one, long words) and the observations of sources.texts,
   written to observations/.
2. A binomial mixture of `components` clones is fitted to every source at once, `steps` EM steps from quantile centers.
3. Each document gets its component, the component's share and rates, and its source's V-measure against labelled quality,
   written to documents/.

Both tables are partitioned into `folders` folders by source, and are written anew by each run, so a run again gives
the same result. A null source is ''; documents without an id or a word have no row; rows of one source and id add up; a source
without labels has a null V-measure. Components whose probabilities are within TIE are equal: the first one counts."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonal_spark.config import EmissionModel
from clonal_spark.functions.emission import EMISSIONS
from clonal_spark.operators import mixture as mo
from clonal_spark.operators import scoring as sg
from clonal_spark.session import Scratch
from clonal_spark.sources import texts
from jobs.common import LOG, configuration, session

DEFAULTS = {"components": 3, "steps": 4, "long": texts.LONG, "folders": 16, "truth": "quality"}
TIE = 1e-9


def _folder(folders: int) -> Column:
    return F.pmod(F.crc32(F.col("tumour_id").cast("binary")), F.lit(folders)).cast("int").alias("folder")


def _write(df: DataFrame, path: str, folders: int) -> DataFrame:
    rows = df.select("*", _folder(folders))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("folder").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def assigned(resp: DataFrame) -> DataFrame:
    """(tumour_id, mut_id, component, probability)."""
    clones = F.collect_list(F.struct("r", "k")).alias("clones")
    rows = resp.groupBy(*mo.MUT).agg(clones, F.max("r").alias("probability"))
    near = F.filter("clones", lambda c: c["r"] >= F.col("probability") - TIE)
    return rows.select(*mo.MUT, F.array_min(F.transform(near, lambda c: c["k"])).cast("int").alias("component"), "probability")


def run(spark: SparkSession, documents: str, labels: str, output: str, config: dict | None = None) -> DataFrame:
    """Fits all sources and returns the documents' table as it then stands."""
    config = DEFAULTS | (config or {})
    counts = _write(texts.word_counts(spark.read.parquet(documents), config["long"]), f"{output}/observations", config["folders"])
    obs = texts.observations(counts)
    centers, resp = mo.em_steps(obs, mo.quantile_init(obs, config["components"]), EMISSIONS[EmissionModel.BINOMIAL](), config["steps"])
    found = Scratch(spark, "text-mixture").write(assigned(resp), "found")
    truth = spark.read.parquet(labels).where(F.col("doc_id").isNotNull() & F.col(config["truth"]).isNotNull()).groupBy(F.col("doc_id").alias("mut_id")).agg(F.min(config["truth"]).alias("true_k"))
    agreement = sg.v_measure(found.join(truth, "mut_id").select(*mo.MUT, "true_k", F.col("component").alias("est_k")))
    rate = lambda s: F.max(F.when(F.col("sample_id") == s, F.col("center")))
    components = centers.groupBy("tumour_id", F.col("k").cast("int").alias("component")).agg(F.exp(F.first("log_pi")).alias("component_share"), rate("repeats").alias("component_repeats"), rate("long").alias("component_long"))
    rows = counts.drop("folder").join(found, mo.MUT).join(components, ["tumour_id", "component"]).join(agreement, "tumour_id", "left")
    out = _write(rows, f"{output}/documents", config["folders"])
    LOG.info("read %s and %s; %d documents with words", documents, labels, counts.count())
    for r in out.groupBy("component").agg(F.count("*").alias("n"), F.countDistinct("tumour_id").alias("sources")).orderBy("component").collect():  # one row a component
        LOG.info("wrote component %d of %d sources to %s/documents: %d documents", r.component, r.sources, output, r.n)
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--documents", required=True)
    p.add_argument("--labels", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--config", help="JSON file over the defaults")
    a = p.parse_args(argv)
    spark = session("text-mixture")
    try:
        run(spark, a.documents, a.labels, a.output, configuration(spark, a.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
