"""Running a workflow step by step: statistics, pausing, changes, failures, going on in another process, values beside the data."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.quantiles import order_statistics, quantiles
from millrace.plans.execution import COMPLETED, FAILED, KILLED, PAUSED, Execution
from millrace.plans.workflow import Workflow
from millrace.registry import make
from millrace.streaming.streams import StreamInput

BAD = """
class Picky(RowFunction):
    def process_tuple(self, tuple_, port):
        if tuple_['v'] == 7:
            raise ValueError('seven')
        yield tuple_
"""
GOOD = BAD.replace("raise ValueError('seven')", "tuple_['v'] = 70")


def flow_of(spark, code: str | None = None) -> Workflow:
    flow = Workflow()
    flow.operators["in"] = StreamInput(spark.range(20).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).repartition(2))
    flow.add("some", "Filter", "in", predicates=[{"attribute": "v", "condition": ">=", "value": "5"}])
    last = flow.add("own", "PythonUDFV2", "some", code=code) if code else "some"
    flow.add("sum", "Aggregate", last, groupByKeys=["k"], aggregations=[{"aggFunction": "sum", "attribute": "v", "result attribute": "s"}])
    return flow


def sums(df) -> dict:
    return {r.k: r.s for r in df.collect()}


def test_statistics_and_results(spark):
    run = Execution(spark, flow_of(spark))
    assert sums(run.run()["sum"]) == {k: sum(v for v in range(5, 20) if v % 3 == k) for k in range(3)}
    assert run.status == COMPLETED and run.step() is None
    done = {r.operatorId: r for r in run.statistics().where(f"status = {COMPLETED}").collect()}
    assert (done["in"].inputTupleCnt, done["in"].outputTupleCnt, done["some"].inputTupleCnt, done["some"].outputTupleCnt, done["sum"].outputTupleCnt) == (0, 20, 20, 15, 3)
    assert done["some"].dataProcessingTime > 0 and done["some"].inputTupleSize > 0 and done["in"].numWorkers >= 1


def test_pause_change_and_go_on_elsewhere(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    run = Execution(spark, flow_of(spark), folder)
    assert run.step() == "in" and run.step() == "some"
    run.pause()
    assert run.run() == {} and run.status == PAUSED and run.left() == ["sum"]
    kept = run.stored["in"][0].path
    run.replace("some", "Filter", predicates=[{"attribute": "v", "condition": "<", "value": "3"}])
    assert run.left() == ["some", "sum"]
    # Another process with the same folder finds what is done.
    other = Execution(spark, run.flow, folder)
    assert other.left() == ["some", "sum"] and other.stored["in"][0].path == kept
    assert sums(other.run()["sum"]) == {0: 0, 1: 1, 2: 2}
    run.resume()
    assert run.wait(120) == COMPLETED and sums(run.results()["sum"]) == {0: 0, 1: 1, 2: 2}


def test_failures_are_kept_retried_or_skipped(spark):
    run = Execution(spark, flow_of(spark, BAD))
    run.start()
    assert run.wait(120) == FAILED and run.failed[0] == "own" and "seven" in run.failed[1] and set(run.stored) == {"in", "some"}
    run.replace("own", "PythonUDFV2", code=GOOD)
    run.resume()
    assert run.wait(120) == COMPLETED and sums(run.results()["sum"])[1] == sum(v for v in range(5, 20) if v % 3 == 1) + 63
    run = Execution(spark, flow_of(spark, BAD))
    with pytest.raises(Exception, match="seven"):
        run.run()
    run.skip("own")
    assert sums(run.run()["sum"])[1] == sum(v for v in range(5, 20) if v % 3 == 1)


def test_failing_rows_are_skipped_and_told(spark):
    df = spark.range(20).select(F.col("id").alias("v"))
    own = make("PythonUDFV2", code=BAD, skipFailing=True)
    assert sorted(r.v for r in own.apply(spark, [[df]])[0].collect()) == [v for v in range(20) if v != 7]
    assert [tuple(r) for r in own.failures(df).collect()] == [(7, "ValueError: seven")]


def test_kill_stops_a_running_operator(spark):
    flow = flow_of(spark)
    flow.add("slow", "Sleep", "some", sleepTime=30)
    run = Execution(spark, flow)
    run.start()
    while "some" not in run.stored or "sum" not in run.stored:
        run.wait(0.1)
    run.wait(2)
    run.kill()
    assert run.wait(25) == KILLED and "slow" not in run.stored


def test_values_beside_the_data(spark):
    flow = flow_of(spark)
    told = StreamInput(spark.createDataFrame([], "x int"))
    told.give_state = lambda: {"big": False}
    flow.operators["told"] = told
    flow.add("if", "If", "told", "some", conditionName="big")
    run = Execution(spark, flow)
    run.run()
    assert [run.output("if", p).count() for p in (0, 1)] == [15, 0] and run.states["if"] == {"big": False}


def test_order_statistics_and_quantiles(spark, monkeypatch):
    from millrace.functions import quantiles as module

    monkeypatch.setattr(module, "FEW", 3)
    monkeypatch.setattr(module, "CELLS", 7)
    r = random.Random(3)
    for values in ([r.gauss(0, 1) for _ in range(200)], [1.0] * 50 + [2.0] * 3, [float("inf"), float("-inf"), 0.0, 1e308, -1e308, 5.0], [3.0], [r.choice([-1.0, 0.5, 1e-9]) for _ in range(90)]):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        ranks = [0, 1, len(values) // 2, len(values) - 1, len(values)]
        got = order_statistics(df, "v", ranks)
        assert got == {k: sorted(values)[k] if k < len(values) else None for k in ranks}
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    assert quantiles(df, "v", [0.0, 0.25, 0.5, 0.99]) == [0.0, 2.5, 5.0, pytest.approx(9.9)] and quantiles(df.limit(0), "v", [0.5]) == [None]


def test_a_large_reservoir_keeps_rows_in_place(spark, op, monkeypatch):
    from millrace.operators import control

    monkeypatch.setattr(control, "TOP_ROWS", 10)
    name = "number of item sampled in reservoir sampling"
    df = spark.range(500)
    some = op("ReservoirSampling", df, **{name: 120})
    assert some.count() == some.distinct().count() == 120
    assert op("ReservoirSampling", df, **{name: 900}).count() == 500


def test_pages_say_what_is_not_drawn(spark, monkeypatch):
    from millrace.viz import charts

    monkeypatch.setattr(charts, "SHOWN", 20)
    df = spark.range(50).selectExpr("cast(id as double) AS x", "cast(id * 2 as double) AS y", "cast(id as string) AS s", "cast(id % 7 as string) AS t")
    page = make("Scatterplot", xColumn="x", yColumn="y").html(df)
    assert "20 of 50 rows are drawn" in page and page.count("<circle") == 20
    assert page == make("Scatterplot", xColumn="x", yColumn="y").html(df.repartition(5))
    assert "not available" in make("NetworkGraph", source="s", destination="t").html(df)
    assert "rows are drawn" not in make("Scatterplot", xColumn="x", yColumn="y").html(df.limit(20))


def test_drawings(spark):
    df = spark.range(40).selectExpr("cast(id % 4 as string) AS a", "concat('b', id % 3) AS b", "cast(id + 1 as double) AS v", "cast(id % 5 as double) AS x", "cast(id % 7 as double) AS y", "concat('p', id) AS l", "concat('[''r'', ''', id % 6, ''']') AS e")
    flow = make("SankeyDiagram", **{"Source Attribute": "a", "Target Attribute": "b", "Value Attribute": "v"}).html(df)
    assert flow.count("<path") == 12 and flow.count("<rect") == 7
    for kind, shape in (("IcicleChart", "<rect"), ("HierarchyChart", "<rect")):
        assert make(kind, hierarchy=[{"attributeName": "a"}, {"attributeName": "b"}], value="v").html(df).count(shape) == 16
    assert make("HierarchyChart", hierarchy=[{"attributeName": "a"}, {"attributeName": "b"}], value="v", hierarchyChartType="sunburst chart").html(df).count("<circle") == 16
    assert make("ContourPlot", x="x", y="y", z="v", gridSize="3").html(df).count("<rect") == 9
    assert make("TreePlot", **{"Edge List Column": "e"}).html(df.select("e").distinct()).count("<line") == 6
    graph = make("NetworkGraph", source="a", destination="b").html(df)
    assert graph.count("<line") == 12 and graph.count("<circle") == 7
    assert make("BoxViolinPlot", value="v").html(df).count("<rect") == 1
    tree = make("Dendrogram", xVal="x", yVal="v", Labels="l")
    assert tree.html(df).count("<line") == 3 * 39
    steps = tree.clusters(df).orderBy("step").collect()
    assert len(steps) == 39 and steps[-1]["size"] == 40 and all(a["distance"] <= b["distance"] + 1e-9 for a, b in zip(steps, steps[1:], strict=False))
