from __future__ import annotations

import numpy as np
import pytest
from millrace.operators import joins
from pyspark.sql import functions as F


@pytest.mark.parametrize("wide, bounds", [("int", (True, True)), ("double", (False, False))])
def test_rows_of_large_cells_are_dealt_out(spark, op, monkeypatch, wide, bounds):
    """Most rows of both sides in one cell: all pairs, each once, and not in one task."""
    monkeypatch.setattr(joins, "CELL_ROWS", 50, raising=False)
    left = spark.range(600).select(F.col("id").alias("a"), F.when(F.col("id") < 500, 7).otherwise(F.col("id") % 40).cast(wide).alias("x"))
    right = spark.range(400).select(F.col("id").alias("b"), F.when(F.col("id") < 300, 5).when(F.col("id") < 310, None).otherwise(F.col("id") % 40 - 5).cast(wide).alias("y"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = op("IntervalJoin", left, right, leftAttributeName="x", rightAttributeName="y", constant=3, includeLeftBound=bounds[0], includeRightBound=bounds[1])
        pairs = got.select("a", "b", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    under = lambda p, q, closed: p <= q if closed else p < q
    rows, others = left.collect(), right.collect()
    wanted = [(m.a, r.b) for m in rows for r in others if r.y is not None and under(r.y, m.x, bounds[0]) and under(m.x, r.y + 3, bounds[1])]
    assert sorted((p.a, p.b) for p in pairs) == sorted(wanted)
    tasks = [p.task for p in pairs]
    assert max(map(tasks.count, set(tasks))) < len(tasks) / 3


def written(plan) -> int:
    """Rows that the exchanges of a plan that has run have written."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.finalPhysicalPlan()
    elif plan.nodeName() == "ShuffleQueryStage":
        plan = plan.plan()
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    children = plan.children()
    return own + sum(written(children.apply(i)) for i in range(children.size()))


@pytest.mark.parametrize("more", [[], ["repeat('x', 20) AS text"]])
def test_right_rows_are_not_shuffled_once_a_cell(spark, op, more):
    """An interval touches five cells; a right row is written to the one or two blocks of cells that it touches."""
    rows = spark.range(6000).selectExpr("id", "cast(id * 7919 % 800 - 400 AS int) AS x", *more)
    got = op("IntervalJoin", rows, rows, leftAttributeName="x", rightAttributeName="x", constant=8, includeRightBound=False).agg(F.count("*"), F.sum(F.col("id") * 3 + F.col("id#@1")))
    x = np.arange(6000) * 7919 % 800 - 400
    a, b = np.nonzero((x[:, None] >= x[None, :]) & (x[:, None] < x[None, :] + 8))
    assert tuple(got.collect()[0]) == (len(a), int((a * 3 + b).sum()))
    assert written(got._jdf.queryExecution().executedPlan()) < 3 * 6000
