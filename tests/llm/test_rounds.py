"""What the rounds of op5_near_dups leave on disk and ask of the driver, and the condition that they compare sketches by."""

import os

import numpy as np
from pyspark.sql import functions as F

from kilnworks.llm import near_dups
from kilnworks.llm import workspace as ws


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    ws.write_table(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "shuffled")
    assert not shuffle_files(spark) - before
    assert spark.conf.get(ws.CLEANUP, None) is None


def test_jobs_of_component_rounds(spark):
    """Stars of 40 families that two heads share: few jobs, as the driver keeps the plans and stages of each."""
    edges = [(f"{f:02}n{i:02}", f"{f:02}{head}") for f in range(40) for i in range(10) for head in "az" if head == "a" or i < 2]
    df = spark.createDataFrame(edges, "a string, b string")
    spark.sparkContext.setJobGroup("components", "")
    try:
        got = {r.node: r.root for r in near_dups.components(df).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {x: f"{x[:2]}a" for e in edges for x in e}
    assert jobs <= 25, jobs


def test_sketches_differ_where_registers_do(spark):
    r = np.random.default_rng(5)
    a = r.integers(0, 2**63, (60, near_dups.REGISTERS), dtype="uint64")
    b = np.where(r.random(a.shape) < np.linspace(0, 0.4, 60)[:, None], r.integers(0, 2**63, a.shape, dtype="uint64"), a)
    longs = near_dups.REGISTERS // 16
    rows = [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(near_dups.sketches(a), near_dups.sketches(b), strict=True))]
    got = spark.createDataFrame(rows, "i int, a array<long>, b array<long>").where(near_dups.plausible("a", "b", longs)).collect()
    agree = near_dups.ALIKE + (1 - near_dups.ALIKE) / 16
    most = int(near_dups.REGISTERS * (1 - agree) + 3.5 * (near_dups.REGISTERS * agree * (1 - agree)) ** 0.5)
    differ = ((a & np.uint64(15)) != (b & np.uint64(15))).sum(axis=1)
    assert {x.i for x in got} == set(np.flatnonzero(differ <= most).tolist()) and 0 < len(got) < 60
