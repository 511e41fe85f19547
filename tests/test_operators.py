import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.registry import PropertyError


def test_filter_nulls_and_empty_predicates(spark, op, rows):
    df = spark.createDataFrame([("a", 1, True, 2), (None, None, None, None)], "s string, i int, b boolean, l long")
    for c in df.columns:
        assert op("Filter", df, predicates=[{"attribute": c, "condition": "is null", "value": "x"}]).count() == 1
        assert op("Filter", df, predicates=[{"attribute": c, "condition": "is not null", "value": None}]).count() == 1
    assert op("Filter", df, predicates=[]).count() == 0
    assert op("Filter", df, predicates=[{"attribute": "s", "condition": "!=", "value": "b"}]).count() == 1
    assert op("Filter", df, predicates=[{"attribute": "b", "condition": "=", "value": "True"}]).count() == 1


def test_filter_compares_texts_as_numbers_where_both_are(spark, op, rows):
    df = spark.createDataFrame([("9",), ("10",), ("x",), (None,)], "s string")
    assert rows(op("Filter", df, predicates=[{"attribute": "s", "condition": ">", "value": "9.5"}])) == [("10",), ("x",)]
    assert rows(op("Filter", df, predicates=[{"attribute": "s", "condition": ">", "value": "a"}])) == [("x",)]


def test_projection_errors(spark, op):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert op("Projection", df, attributes=[{"originalAttribute": "b", "alias": "x"}, {"originalAttribute": "a", "alias": " "}]).columns == ["x", "a"]
    assert op("Projection", df, isDrop=True, attributes=[{"originalAttribute": "a"}]).columns == ["b"]
    for bad in ([], [{"originalAttribute": "c"}], [{"originalAttribute": "a", "alias": "x"}, {"originalAttribute": "b", "alias": "X"}]):
        with pytest.raises(PropertyError):
            op("Projection", df, attributes=bad)


def test_unnest_regex_limit_distinct_sort(spark, op, rows):
    df = spark.createDataFrame([("a-b-c", 1), ("d", 2), ("--", 3), (None, 4)], "f string, i int")
    assert rows(op("UnnestString", df, **{"Delimiter": "-", "Attribute": "f", "Result attribute": "p"}).select("p")) == [("a",), ("b",), ("c",), ("d",)]
    with pytest.raises(PropertyError):
        op("UnnestString", df, **{"Attribute": "f", "Result attribute": " "})
    assert rows(op("Regex", df, attribute="f", regex="B", caseInsensitive=True).select("i")) == [(1,)]
    assert op("Limit", df, limit=-1).count() == 0
    assert op("Limit", df, limit=2).count() == 2
    twice = df.unionAll(df)
    assert op("Distinct", twice).count() == 4
    nan = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,)], "x double")
    for how, first in (("ASC", [1.0, 2.0]), ("DESC", [2.0, 1.0])):
        assert [r[0] for r in op("Sort", nan, attributes=[{"attribute": "x", "sortPreference": how}]).collect()][:2] == first


def test_hash_join_kinds_nulls_and_clashes(spark, op, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "p"), (3, "q"), (None, "r")], "k int, v string")
    key = {"buildAttributeName": "k", "probeAttributeName": "k"}
    inner = op("HashJoin", a, b, **key)
    assert inner.columns == ["k", "v", "v#@1"]
    assert rows(inner) == [(2, "y", "p"), (None, "z", "r")]
    assert rows(op("HashJoin", a, b, joinType="left outer", **key)) == [(1, "x", None), (2, "y", "p"), (None, "z", "r")]
    assert rows(op("HashJoin", a, b, joinType="right outer", **key)) == [(2, "y", "p"), (3, None, "q"), (None, "z", "r")]
    assert op("HashJoin", a, b, joinType="full outer", **key).count() == 4
    empty = spark.createDataFrame([], a.schema)
    assert op("HashJoin", a, empty, **key).count() == 0
    assert op("HashJoin", empty, b, joinType="full outer", **key).count() == 3


@pytest.mark.parametrize(("left", "right", "n"), [(True, True, 11), (True, False, 9), (False, True, 8), (False, False, 6)])
def test_interval_join_bounds(spark, op, left, right, n):
    points = spark.range(1, 11).select(F.col("id").cast("double").alias("p"), F.lit(0).alias("x"))
    starts = spark.createDataFrame([(1.0, 1), (5.0, 1), (8.0, 1)], "s double, x int")
    got = op("IntervalJoin", points, starts, leftAttributeName="p", rightAttributeName="s", constant=3, includeLeftBound=left, includeRightBound=right)
    assert (got.count(), len(got.columns)) == (n, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_interval_join_matches_brute_force(spark, op, rows):
    r = random.Random(5)
    for constant in (0, 1, 7, 30):
        a = [r.randint(-100, 100) for _ in range(80)]
        b = [r.randint(-100, 100) for _ in range(60)] + [None]
        got = op("IntervalJoin", spark.createDataFrame([(x,) for x in a], "a int"), spark.createDataFrame([(x,) for x in b], "b long"), leftAttributeName="a", rightAttributeName="b", constant=constant)
        assert rows(got) == sorted(((x, y) for x, y in itertools.product(a, b) if y is not None and y <= x <= y + constant), key=lambda t: tuple((v is None, str(v)) for v in t))


def test_interval_join_of_months(spark, op, rows):
    a = spark.sql("SELECT explode(array(TIMESTAMP '2020-02-29', TIMESTAMP '2020-03-01', TIMESTAMP '2020-01-30')) t")
    b = spark.sql("SELECT TIMESTAMP '2020-01-31' s")
    got = op("IntervalJoin", a, b, leftAttributeName="t", rightAttributeName="s", constant=1, timeIntervalType="month")
    assert [str(r.t) for r in got.collect()] == ["2020-02-29 00:00:00"]


def test_cartesian_names(spark, op):
    a = spark.createDataFrame([(1, 2)] * 5, "left int, x int")
    b = spark.createDataFrame([(1, 2, 3)] * 7, "left int, `left#@1` int, y int")
    got = op("CartesianProduct", a, b)
    assert got.columns == ["left", "x", "left#@1#@1", "left#@1", "y"] and len(set(got.columns)) == 5
    assert got.count() == 35


def test_sets_treat_nulls_as_equal(spark, op, rows):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (3, "y")], "k int, v string")
    empty = spark.createDataFrame([], a.schema)
    assert rows(op("Intersect", a, b)) == [(1, None)]
    assert rows(op("Difference", a, b)) == [(2, "x")]
    assert rows(op("SymmetricDifference", a, b)) == [(2, "x"), (3, "y")]
    assert rows(op("SymmetricDifference", a, empty)) == [(1, None), (2, "x")]
    assert op("Intersect", empty, empty).count() == 0
    other = spark.createDataFrame([(1,)], "k int")
    assert op("Intersect", a, other).count() == 0
    with pytest.raises(PropertyError):
        op("Difference", a, other)


def test_aggregate_edges(spark, op, rows):
    df = spark.createDataFrame([("a", None, 1), ("a", None, None), (None, 2.0, 3)], "k string, x double, i int")
    units = [{"aggFunction": f, "attribute": a, "result attribute": f} for f, a in (("sum", "x"), ("count", "i"), ("average", "x"), ("min", "x"), ("max", "x"))]
    assert rows(op("Aggregate", df, groupByKeys=["k"], aggregations=units)) == [("a", 0.0, 1, None, None, None), (None, 2.0, 1, 2.0, 2.0, 2.0)]
    assert op("Aggregate", df.limit(0), aggregations=units).count() == 0
    assert op("Aggregate", df, aggregations=units).count() == 1
    with pytest.raises(PropertyError):
        op("Aggregate", df, aggregations=[{"aggFunction": "sum", "attribute": "k", "result attribute": "s"}])
    with pytest.raises(PropertyError):
        op("Aggregate", df, aggregations=[])


def test_split_sampling_if(spark, op):
    df = spark.range(2000).toDF("id")
    from millrace.registry import make

    a, b = make("Split", k=30, random=True).apply(spark, [[df]])
    assert a.count() + b.count() == 2000 and a.intersect(b).count() == 0 and 400 < a.count() < 800
    assert op("ReservoirSampling", df, **{"number of item sampled in reservoir sampling": 17}).distinct().count() == 17
    assert op("ReservoirSampling", df, **{"number of item sampled in reservoir sampling": 9999}).count() == 2000
    assert 100 < op("RandomKSampling", df, **{"random k sample percentage": 10}).count() < 320
    no = spark.createDataFrame([(False,)], "c boolean")
    assert [d.count() for d in make("If", conditionName="c").apply(spark, [[no], [df]])] == [2000, 0]
    parts = make("SortPartitions", sortAttributeName="id", domainMin=0, domainMax=1999, partitions=4).apply(spark, [[df]])[0]
    each = [[r.id for r in p] for p in parts.rdd.glom().collect()]
    assert all(p == sorted(p) for p in each) and sum(map(len, each)) == 2000
    with pytest.raises(PropertyError):
        op("Dummy", df)


SAMPLES = ["3 stars", "4 stars", "Trump", "Trump Biden", "hello", "the name", "an eye", "to you", "Twitter", "안녕하세요", "你好", "_!@,-", "don't panic", "costs 3.14 now", None]


@pytest.mark.parametrize(
    ("query", "n"),
    [("3", 1), ("Trump", 2), ("Trump AND Biden", 1), ('"Trump AND Biden"', 0), ('"Trump Biden"', 1), ('"Biden Trump"', 0), ("ell", 0), ("the", 1), ("an", 1), ("to", 1), ("twitter", 1), ("안녕하세요", 1), ("你好", 1), ("@", 0), ("_!@,-", 0), ("stars -3", 1), ("trump hello", 3), ("+trump NOT biden", 1), ("(3 OR 4) AND stars", 2), ("tw*", 1), ("tr?mp", 2), ("don't", 1), ("3.14", 1), ("-trump", 0)],
)
def test_keyword_search(spark, op, query, n):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "text string")
    assert op("KeywordSearch", df, attribute="text", keyword=query).count() == n


def test_keyword_search_refuses_what_it_cannot_do(spark, op):
    df = spark.createDataFrame([("a",)], "text string")
    for bad in ("a^", "f:", "a AND", "(a"):
        with pytest.raises(PropertyError):
            op("KeywordSearch", df, attribute="text", keyword=bad)


@pytest.mark.parametrize(
    ("kind", "dictionary", "text", "match"),
    [("Scan", "nice a a person", "nice a a person", True), ("Scan", "nice", "nice a a person", False), ("Substring", "nice a a person and good", "nice a a person", True), ("Substring", "nice", "nice a a person", False), ("Conjunction", "nice person", "Persons, nicely nice", True), ("Conjunction", "the", "some word", True), ("Conjunction", "running dogs", "the dog runs", True), ("Conjunction", "cat", "dog", False), ("Scan", "a", "", False), ("Conjunction", "a", None, False)],
)
def test_dictionary_matcher(spark, op, kind, dictionary, text, match):
    df = spark.createDataFrame([(text,)], "t string")
    assert op("DictionaryMatcher", df, **{"Dictionary": dictionary, "Attribute": "t", "result attribute": "m", "Matching type": kind}).first()["m"] is match


def test_stemmer():
    from millrace.functions.stemming import stem

    pairs = "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi relational:relat digitizer:digit formaliti:formal triplicate:triplic hopeful:hope goodness:good revival:reviv adoption:adopt probate:probat rate:rate controll:control roll:roll"
    assert {p: stem(p.split(":")[0]) for p in pairs.split()} == {p: p.split(":")[1] for p in pairs.split()}


def test_user_functions(spark, op, rows):
    df = spark.createDataFrame([(i, float(i) if i % 3 else None) for i in range(10)], "i int, x double").repartition(3)
    batch = "class B(BatchFunction):\n    BATCH_SIZE = 4\n    def process_batch(self, batch, port):\n        yield {'n': len(batch)}\n"
    got = op("PythonUDFV2", df, code=batch, retainInputColumns=False, outputColumns=[{"attributeName": "n", "attributeType": "integer"}])
    assert sorted(r.n for r in got.collect()) == [2, 4, 4]
    finish = "class S(RowFunction):\n    def open(self):\n        self.t = 0\n    def process_tuple(self, tuple_, port):\n        self.t += tuple_['i']\n        yield None\n    def on_finish(self, port):\n        yield {'t': self.t}\n"
    assert rows(op("PythonUDFV2", df, code=finish, retainInputColumns=False, outputColumns=[{"attributeName": "t", "attributeType": "long"}])) == [(45,)]
    lam = op("PythonLambdaFunction", df, lambdaAttributeUnits=[{"attributeName": "Add New Column", "newAttributeName": "y", "attributeType": "string", "expression": "str(tuple_['x'])"}])
    assert {r.y for r in lam.where("i in (0, 1)").collect()} == {"None", "1.0"}
    assert rows(op("PythonTableReducer", df, lambdaAttributeUnits=[{"attributeName": "m", "attributeType": "double", "expression": "table['x'].sum()"}])) == [(27.0,)]
    with pytest.raises(PropertyError):
        op("PythonUDFV2", df, code=finish, retainInputColumns=True, outputColumns=[{"attributeName": "I", "attributeType": "long"}])
    with pytest.raises(PropertyError):
        op("PythonUDFV2", df, code="x = 1", outputColumns=[])
    with pytest.raises(RuntimeError, match="R runtime"):
        op("RUDF", df, code="function(t, p) t")
