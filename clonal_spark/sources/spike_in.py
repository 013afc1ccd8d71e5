"""Tumours by spiking variants into real reads: the plan is tables here, the spiking is done by a program given as a function.

A program takes the variants of one sample (chrom, pos, vaf) and gives their read counts; `command_program` is one
that calls an external script on files that every executor sees. Without programs, callers use the simulator."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from clonal_spark.sources.simulate import SIMULATED, _rng, cellularities, clone_sizes, long

# The prior of the parameters.
CLONES, CLONE_SHARES = [1, 2, 3, 4, 5], [0.1, 0.3, 0.3, 0.2, 0.1]
MUTATIONS, MUTATION_SHARES = [100, 200, 500, 1000, 2000], [0.1, 0.2, 0.3, 0.3, 0.1]
SAMPLES, SAMPLE_SHARES = [1, 2, 3], [0.5, 0.3, 0.2]
PURITY, DEPTH, DEPTH_SPREAD, DEPTH_RANGE = (5, 2), 100, 0.5, (20, 1000)
ALTERED, COPIES, COPY_SHARES, VAF_RANGE = 0.2, [1, 3, 4], [0.3, 0.5, 0.2], (0.001, 0.999)
#: Seconds that one sample may take.
LIMIT = 600
PARAMS = "tumour_id long, n_clones int, n_mutations int, n_samples int, purity double, depth int, seed long"

Program = Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]


def params_table(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for i in b["id"]:
                rng = _rng(seed, int(i), 2)
                pick = lambda values, shares: int(rng.choice(values, p=shares))  # noqa: B023, E731
                rows.append((int(i), pick(CLONES, CLONE_SHARES), pick(MUTATIONS, MUTATION_SHARES), pick(SAMPLES, SAMPLE_SHARES), float(rng.beta(*PURITY)), int(np.clip(np.exp(rng.normal(np.log(DEPTH), DEPTH_SPREAD)), *DEPTH_RANGE)), int(rng.integers(0, 2**31))))
            yield pd.DataFrame(rows, columns=["tumour_id", "n_clones", "n_mutations", "n_samples", "purity", "depth", "seed"])

    return spark.range(n).mapInPandas(run, PARAMS)


def plan(p: dict) -> pd.DataFrame:
    """The truth of one tumour in long form, with expected fractions as alt and a depth of 1."""
    rng = _rng(p["seed"], p["tumour_id"], 3)
    k, n, s = int(p["n_clones"]), int(p["n_mutations"]), int(p["n_samples"])
    label = np.repeat(np.arange(k), clone_sizes(rng.dirichlet(np.full(k, 2.0)), n))
    center = cellularities(k, s, float(p["purity"]), rng)[label]
    cn = np.full(n, 2.0)
    altered = rng.choice(n, max(1, int(ALTERED * n)), replace=False)
    cn[altered] = rng.choice(COPIES, len(altered), p=COPY_SHARES)
    adj = np.repeat((2 / (p["purity"] * cn + (1 - p["purity"]) * 2))[:, None], s, 1)
    return long(p["tumour_id"], np.clip(center * adj, *VAF_RANGE), np.ones((n, s)), adj, cn, label, center)


def spike(params: DataFrame, positions: DataFrame, program: Program) -> DataFrame:
    """Observations with truth columns. positions: (mut_id, chrom, pos), as many as the largest tumour has mutations; a
    sample of a tumour is one call of the program, and each has a task of its own."""

    def planned(batches):
        for b in batches:
            for p in b.to_dict("records"):
                yield plan(p)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("mut_id")
        alt, depth = program(rows[["chrom", "pos"]].assign(vaf=rows["alt"]).reset_index(drop=True))
        return rows.assign(alt=np.asarray(alt, float), depth=np.maximum(np.asarray(depth, float), 1)).drop(columns=["chrom", "pos"])

    wanted = params.mapInPandas(planned, SIMULATED)
    columns = wanted.columns
    return wanted.join(positions, "mut_id").select(*columns, "chrom", "pos").groupBy("tumour_id", "sample_id").applyInPandas(lambda rows: run(rows)[columns], SIMULATED)


@dataclass
class Tools:
    """A spiking script, reads and a reference, as paths that every executor sees."""

    script: str
    reads: str
    reference: str

    def missing(self) -> list[str]:
        there = lambda x: os.path.exists(x)
        return [x for x, ok in ((self.script, shutil.which(self.script) or there(self.script)), (self.reads, there(self.reads)), (self.reference, there(self.reference))) if not ok]


def command_program(tools: Tools, count: Callable[[str, pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> Program:
    """Calls the script on a variant file and counts alleles of the reads that it writes."""
    if missing := tools.missing():
        raise RuntimeError(f"not found: {', '.join(missing)}")

    def run(variants: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        with tempfile.TemporaryDirectory() as folder:
            table, out = os.path.join(folder, "variants.tsv"), os.path.join(folder, "spiked.bam")
            variants[["chrom", "pos", "pos", "vaf"]].to_csv(table, sep="\t", header=False, index=False)
            subprocess.run([tools.script, "-v", table, "-f", tools.reads, "-r", tools.reference, "-o", out], check=True, timeout=LIMIT)
            return count(out, variants)

    return run
