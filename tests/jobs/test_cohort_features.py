"""The incremental job: growing input in several runs against one run over everything, failures and hard rows."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from clonal_spark.operators import features as fe
from clonal_spark.sources import observations as ob
from jobs import cohort_features as job

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.drop("folder").collect())


def whole(spark, path):
    """All features of a table, without the job."""
    obs = ob.with_copy_numbers(ob.read_counts(spark.read.parquet(path), F.col("l_suppkey").cast("long"), F.col("l_returnflag")), spark.read.parquet(f"{SF}/part.parquet"), True)
    return fe.meta_features(obs)


@pytest.fixture
def places(tmp_path):
    return {"lineitem": str(tmp_path / "in"), "part": f"{SF}/part.parquet", "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}


def grow(spark, places, k, n=3):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").where(F.col("l_orderkey") % n == k)
    rows.repartition(2).write.mode("append").parquet(places["lineitem"])
    return rows


def batches(spark, places):
    return {r.batch for r in spark.read.parquet(f"{places['output']}/counts").select("batch").distinct().collect()}


def test_growing_input(spark, places):
    config = {"files_per_batch": 1, "folders": 5}
    for k in (0, 1):
        grow(spark, places, k)
    first = job.run(spark, **places, config=config)
    assert rounded(first) == rounded(whole(spark, places["lineitem"])) and len(batches(spark, places)) == 4
    grow(spark, places, 2)
    second = rounded(job.run(spark, **places, config=config))
    assert second == rounded(whole(spark, f"{SF}/lineitem.parquet")) and len(batches(spark, places)) == 6
    assert rounded(job.run(spark, **places, config=config)) == second and len(batches(spark, places)) == 6


def test_only_touched_folders_are_written(spark, places):
    config = {"folders": 4}
    grow(spark, places, 0, 1)
    job.run(spark, **places, config=config)
    files = {(d, f) for d, _, names in os.walk(f"{places['output']}/features") for f in names if f.endswith(".parquet")}
    one = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_suppkey % 4 = 1").limit(20)
    one.coalesce(1).write.mode("append").parquet(places["lineitem"])
    got = job.run(spark, **places, config=config)
    after = {(d, f) for d, _, names in os.walk(f"{places['output']}/features") for f in names if f.endswith(".parquet")}
    assert {d.rpartition("=")[2] for d, _ in files - after} == {"1"} and rounded(got) == rounded(whole(spark, places["lineitem"]))


def test_failure_between_the_two_writes(spark, places, monkeypatch):
    """A batch that wrote its counts and then failed runs again under its number and adds nothing twice."""
    grow(spark, places, 0, 1)
    write = job._replace

    def fails(df, path, *by):
        if path.endswith("features"):
            raise RuntimeError("lost")
        write(df, path, *by)

    monkeypatch.setattr(job, "_replace", fails)
    with pytest.raises(Exception, match="lost"):
        job.run(spark, **places)
    assert len(batches(spark, places)) == 1
    monkeypatch.setattr(job, "_replace", write)
    assert rounded(job.run(spark, **places)) == rounded(whole(spark, places["lineitem"])) and len(batches(spark, places)) == 1


def test_hard_rows(spark, places):
    """Rows without a key are left out, other columns of any name and repeated rows take no harm."""
    rows = grow(spark, places, 0, 1)
    extra = rows.limit(3)
    bad = extra.withColumn("l_suppkey", F.lit(None).cast("long")).unionByName(extra.withColumn("l_returnflag", F.lit(None).cast("string")))
    bad.withColumns({"folder": F.lit(9), "batch": F.lit("x"), "depth": F.lit(1.0)}).write.mode("append").parquet(places["lineitem"])
    extra.write.mode("append").parquet(places["lineitem"])
    want = spark.read.parquet(places["lineitem"]).where("l_suppkey IS NOT NULL AND l_returnflag IS NOT NULL")
    want.write.parquet(places["lineitem"] + "-known")
    assert rounded(job.run(spark, **places)) == rounded(whole(spark, places["lineitem"] + "-known"))


def test_empty_table(spark, places):
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(0).write.parquet(places["lineitem"])
    assert job.run(spark, **places).count() == 0 and job.run(spark, **places).count() == 0


def test_command_line(spark, places, tmp_path):
    grow(spark, places, 0, 1)
    (tmp_path / "config.json").write_text(json.dumps({"folders": 3}))
    line = [sys.executable, "-m", "jobs.cohort_features", *[x for k, v in places.items() for x in (f"--{k}", v)], "--config", str(tmp_path / "config.json")]
    done = subprocess.run(line, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "new rows of" in done.stderr and "/features holds" in done.stderr
    assert rounded(job.read(spark, places["output"])) == rounded(whole(spark, places["lineitem"]))
    assert {r.folder for r in job.read(spark, places["output"]).collect()} <= {0, 1, 2}


def test_unknown_setting(spark, tmp_path):
    from jobs.common import configuration

    (tmp_path / "c.json").write_text('{"folder": 3}')
    with pytest.raises(ValueError, match="folder"):
        configuration(spark, str(tmp_path / "c.json"), job.DEFAULTS)
    assert configuration(spark, f"{ROOT}/jobs/cohort_features.json", job.DEFAULTS) == job.DEFAULTS
