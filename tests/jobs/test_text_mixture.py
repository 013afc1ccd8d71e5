"""The mixture of documents by source against a plain NumPy form, and hard rows."""

import math
import os
import re

import numpy as np
import pytest

from clonal_spark.sources import texts
from jobs import text_mixture as job
from jobs.common import configuration

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain_counts(rows, long=texts.LONG):
    out = {}
    for i, text, source in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if i is None or not words:
            continue
        seen = out.setdefault((source or "", i), [0, 0, 0])
        for k, v in enumerate((len(words), len(words) - len(set(words)), sum(len(w) >= long for w in words))):
            seen[k] += v
    return {k: tuple(v) for k, v in out.items()}


def plain_fit(counts, k, steps):
    """Of one source: {id: (component, probability)}, shares and rates (long, repeats)."""
    ids = sorted(counts)
    depth = np.array([counts[i][0] for i in ids], float)[:, None]
    alt = np.array([[counts[i][2], counts[i][1]] for i in ids], float)
    centers = np.clip(np.quantile(alt / np.maximum(depth, 1), [j / (k + 1) for j in range(1, k + 1)], axis=0), 1e-6, 1 - 1e-6)
    log_pi = np.full(k, -math.log(k))
    for _ in range(steps):
        mu = np.clip(centers, 1e-10, 1 - 1e-10)
        lik = (alt[:, None] * np.log(mu) + (depth - alt)[:, None] * np.log(1 - mu)).sum(2) + log_pi
        r = np.exp(lik - lik.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        centers = np.clip((r.T @ alt) / np.maximum(r.T @ depth, 1e-10), 1e-6, 1 - 1e-6)
        log_pi = np.log(np.maximum(r.mean(0), 1e-10))
    best = [int(np.flatnonzero(x >= x.max() - job.TIE)[0]) for x in r]
    return {i: (b, float(x.max())) for i, b, x in zip(ids, best, r, strict=True)}, np.exp(log_pi), centers


def check(spark, rows, labels, tmp_path, config):
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels"))
    out = str(tmp_path / "out")
    first = job.run(spark, str(tmp_path / "docs"), str(tmp_path / "labels"), out, config).collect()
    again = job.run(spark, str(tmp_path / "docs"), str(tmp_path / "labels"), out, config).collect()
    line = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(str, map(line, first))) == sorted(map(str, map(line, again)))
    got = {(r.tumour_id, r.mut_id): r for r in again}
    counts = plain_counts(rows, config.get("long", texts.LONG))
    assert len(again) == len(got) and {k: (r.words, r.repeats, r.long_words) for k, r in got.items()} == counts
    k, steps = config.get("components", 3), config.get("steps", 4)
    for source in {s for s, _ in counts}:
        fit, shares, centers = plain_fit({i: c for (s, i), c in counts.items() if s == source}, k, steps)
        for i, (b, p) in fit.items():
            r = got[source, i]
            assert (r.component, r.probability) == (b, pytest.approx(p, abs=1e-7))
            assert r.component_share == pytest.approx(shares[b]) and (r.component_long, r.component_repeats) == pytest.approx(tuple(centers[b]))
    return got


def test_given_documents(spark, tmp_path):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    got = check(spark, rows, labels, tmp_path, {"components": 2, "steps": 3, "folders": 4})
    assert len(got) > 150 and any(r.v_measure is not None for r in got.values()) and {r.folder for r in got.values()} == {0, 1, 2, 3}


def test_hard_rows(spark, tmp_path):
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (None, "no id", "a"), (4, "one two two", None), (5, "one two two", None), (5, "one two two", None), (6, "x", ""),
        (7, "word " * 50_000, "a"), (8, "unimaginably long words " * 40, "a"), (9, "a b c d", "a"), (10, "a b c d", "a"), (11, "tabs\tand\nlines\r\nhere here", "only one"),
    ]
    labels = [(7, 1, 0), (7, 0, 0), (8, None, 0), (None, 1, 1), (9, 1, 0), (10, 0, 0), (99, 1, 0)]
    got = check(spark, rows, labels, tmp_path, {})
    assert got["", 5].words == 6 and got["only one", 11].v_measure is None and got["a", 9].v_measure is not None


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string, folder int, words string").write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels"))
    assert job.run(spark, str(tmp_path / "docs"), str(tmp_path / "labels"), str(tmp_path / "out")).count() == 0


def test_configuration(spark):
    assert configuration(spark, f"{ROOT}/jobs/text_mixture.json", job.DEFAULTS) == job.DEFAULTS
