"""What keeps the driver small: few jobs, and nothing left of what it has read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from assaykit.llm import quality
from assaykit.llm.common import broadcast_if_small
from assaykit.plans.graph import components


def jobs(spark, run):
    """What run returns, and how many jobs it took."""
    spark.sparkContext.setJobGroup(name := f"counted-{id(run)}", "")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def hinted(df):
    return "Hint broadcast" in df._jdf.queryExecution().logical().toString()


def test_rows_are_counted_by_the_job_that_writes_them(spark):
    held, n = jobs(spark, lambda: broadcast_if_small(spark.range(100)))
    assert n == 1 and hinted(held) and held.count() == 100
    assert not hinted(broadcast_if_small(spark.range(100), limit=99)) and hinted(broadcast_if_small(spark.range(100), limit=100))
    assert hinted(none := broadcast_if_small(spark.range(100).where("id < 0"))) and none.count() == 0
    assert hinted(none := broadcast_if_small(spark.createDataFrame([], "id long").groupBy("id").count())) and none.count() == 0


def test_components_that_are_stars_take_no_round(spark):
    star = spark.createDataFrame([(1, i) for i in range(2, 30)] + [(40, 41)], "a long, b long")
    roots, n = jobs(spark, lambda: components(star))
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(101, 100), (102, 101), (7, 7)], "a long, b long")
    assert n <= 6  # with a round to see no change: 15
    assert {tuple(r) for r in roots.collect()} == {(i, 1) for i in range(1, 30)} | {(40, 40), (41, 40)}
    assert {tuple(r) for r in components(chain).collect()} == {(i, 0) for i in range(61)} | {(i, 100) for i in range(100, 103)}
    assert components(chain.where("a < 0")).count() == 0


def test_training_leaves_no_features_with_arrow(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{i * j % 977}" for j in range(300)), i % 2) for i in range(400)], "doc_id long, text string, label int")
    before = pa.total_allocated_bytes()
    quality.train(rows)
    assert pa.total_allocated_bytes() - before < 100_000
