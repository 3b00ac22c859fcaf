"""Ends of processors by weight, against the plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from cartloom.operators import distribute as D


def plain(weights, p):
    """Processor of each weight, in descending order, ties by place."""
    order = sorted(range(len(weights)), key=lambda i: (-weights[i], i))
    target, proc, run, out = sum(weights) / p, 0, 0, {}
    for i in order:
        out[i] = proc
        run += weights[i]
        if float(run) >= target and proc < p - 1:
            proc, run = proc + 1, 0
    return out


def rng_weights(kind):
    rng = random.Random(kind)
    return {
        "even": [10] * 500, "zipf": [10**6 // (i + 1) for i in range(700)], "random": [rng.randint(0, 1000) for _ in range(800)], "heavy": [10**9, 10**8, 5 * 10**7, *[rng.randint(1, 50) for _ in range(400)]],
        "zeros": [0] * 20, "few": [5, 4, 3], "none": [], "large": [rng.randint(10**14, 10**15) for _ in range(300)], "tail": [100, *[0] * 50],
    }[kind]


@pytest.mark.parametrize("kind", ["even", "zipf", "random", "heavy", "zeros", "few", "none", "large", "tail"])
@pytest.mark.parametrize("p, rows", [(1, 10**6), (4, 10**6), (130, 10**6), (130, 40)])
def test_ends(spark, monkeypatch, kind, p, rows):
    monkeypatch.setattr(D, "END_ROWS", rows)
    weights = rng_weights(kind)
    df = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "idx long, weight long")
    assert {r.idx: r.proc_id for r in D.block_by_weight(df, p).collect()} == plain(weights, p)


def test_thousand_processors_take_few_jobs(spark):
    df = spark.range(60_000).select(F.col("id").alias("idx"), (F.pmod(F.xxhash64("id"), F.lit(5000)) + 100).alias("weight"))
    weights = [r.weight for r in df.orderBy("idx").collect()]
    group = "bwt-jobs"
    spark.sparkContext.setJobGroup(group, group)
    got = {r.idx: r.proc_id for r in D.block_by_weight(df, 1000).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = plain(weights, 1000)
    assert [(i, got[i], want[i]) for i in got if got[i] != want[i]][:5] == [] and max(got.values()) >= 900
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 40
