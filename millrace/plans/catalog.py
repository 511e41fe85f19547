"""The registered queries: each operator over the driver's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import results
from millrace.functions import storage
from millrace.plans.workflow import Workflow
from millrace.registry import make

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def run(spark: SparkSession, kind: str, /, *inputs: DataFrame, port: int = 0, **properties: Any) -> DataFrame:
    """One operator over DataFrames."""
    return make(kind, **properties).apply(spark, [[i] for i in inputs])[port]


def simple(name: str, sql: str | None, kind: str, tables: list[str], /, port: int = 0, then: Callable[[DataFrame], DataFrame] | None = None, **properties: Any) -> None:
    """Registers one operator over whole tables, of which `table(a, b)` is a projection."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = []
        for t in tables:
            base, _, columns = t.rstrip(")").partition("(")
            df = table(spark, sf_dir, base)
            frames.append(df.select(*(c.strip() for c in columns.split(","))) if columns else df)
        out = run(spark, kind, *frames, port=port, **properties)
        return then(out) if then else out

    QUERIES[name] = f
    if sql is not None:
        ORACLE_SQL[name] = sql


def chart(name: str, sql: str | None, kind: str, source: str, then: Callable[[DataFrame], DataFrame] | None = None, /, **properties: Any) -> None:
    """Registers the data that a chart shows."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        base, _, columns = source.rstrip(")").partition("(")
        df = table(spark, sf_dir, base)
        out = make(kind, **properties).prepare(df.select(*(c.strip() for c in columns.split(","))) if columns else df)
        return then(out) if then else out

    QUERIES[name] = f
    if sql is not None:
        ORACLE_SQL[name] = sql


def rounded(*columns: str, digits: int = 2) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: F.round(c, digits) for c in columns})


def where(*conditions: tuple[str, str, str | None]) -> list[dict]:
    return [{"attribute": a, "condition": c, "value": v} for a, c, v in conditions]


def aggregations(*units: tuple[str, str, str]) -> list[dict]:
    return [{"aggFunction": f, "attribute": a, "result attribute": r} for f, a, r in units]


# A whole workflow ---------------------------------------------------------------------------------------------------

FLAGSHIP = {
    "operators": [
        {"operatorID": "customers", "operatorType": "ParquetScan", "fileName": "{dir}/customer.parquet"},
        {"operatorID": "orders", "operatorType": "ParquetScan", "fileName": "{dir}/orders.parquet"},
        {"operatorID": "items", "operatorType": "ParquetScan", "fileName": "{dir}/lineitem.parquet"},
        {"operatorID": "segment", "operatorType": "Filter", "predicates": [{"attribute": "c_mktsegment", "condition": "=", "value": "BUILDING"}]},
        {"operatorID": "theirs", "operatorType": "HashJoin", "buildAttributeName": "c_custkey", "probeAttributeName": "o_custkey"},
        {"operatorID": "lines", "operatorType": "HashJoin", "buildAttributeName": "o_orderkey", "probeAttributeName": "l_orderkey"},
        {
            "operatorID": "revenue", "operatorType": "Aggregate", "groupByKeys": ["o_orderpriority"],
            "aggregations": [{"aggFunction": "sum", "attribute": "l_extendedprice", "result attribute": "revenue"}, {"aggFunction": "count", "attribute": "l_linenumber", "result attribute": "n_lines"}],
        },
        {"operatorID": "sorted", "operatorType": "Sort", "attributes": [{"attribute": "revenue", "sortPreference": "DESC"}]},
    ],
    "links": [
        {"fromOpId": "customers", "fromPortId": {"id": 0}, "toOpId": "segment", "toPortId": {"id": 0}},
        {"fromOpId": "segment", "fromPortId": {"id": 0}, "toOpId": "theirs", "toPortId": {"id": 0}},
        {"fromOpId": "orders", "fromPortId": {"id": 0}, "toOpId": "theirs", "toPortId": {"id": 1}},
        {"fromOpId": "theirs", "fromPortId": {"id": 0}, "toOpId": "lines", "toPortId": {"id": 0}},
        {"fromOpId": "items", "fromPortId": {"id": 0}, "toOpId": "lines", "toPortId": {"id": 1}},
        {"fromOpId": "lines", "fromPortId": {"id": 0}, "toOpId": "revenue", "toPortId": {"id": 0}},
        {"fromOpId": "revenue", "fromPortId": {"id": 0}, "toOpId": "sorted", "toPortId": {"id": 0}},
    ],
    "opsToViewResult": ["sorted"],
}


@query("""SELECT o_orderpriority, round(sum(l_extendedprice), 2) AS revenue, count(l_linenumber)::INTEGER AS n_lines
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderpriority""")
def flagship_revenue(spark, sf_dir):
    operators = [{k: v.replace("{dir}", sf_dir) if k == "fileName" else v for k, v in o.items()} for o in FLAGSHIP["operators"]]
    return Workflow.from_json(FLAGSHIP | {"operators": operators}).result(spark).withColumn("revenue", F.round("revenue", 2))


# Filter, projection, casts ------------------------------------------------------------------------------------------

simple("filter_or_numeric", "SELECT * FROM lineitem WHERE l_quantity > 45 OR l_discount <= 0.01", "Filter", ["lineitem"], predicates=where(("l_quantity", ">", "45"), ("l_discount", "<=", "0.01")))
simple("filter_string_numeric_compare", "SELECT p_partkey, p_brand, p_name FROM part WHERE p_brand > 'Brand#3' OR p_name < '5'", "Filter", ["part(p_partkey, p_brand, p_name)"], predicates=where(("p_brand", ">", "Brand#3"), ("p_name", "<", "5")))
simple("filter_timestamp", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01 00:00:00'", "Filter", ["orders(o_orderkey, o_orderdate)"], predicates=where(("o_orderdate", ">=", "1995-06-01")))
simple("filter_long", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_orderkey < 100", "Filter", ["orders(o_orderkey, o_custkey)"], predicates=where(("o_custkey", "=", "7"), ("o_orderkey", "<", "100")))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders WHERE nullif(o_orderstatus, 'P') <> 'F'")
def filter_not_equal_excludes_null(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("status"))
    return run(spark, "Filter", df, predicates=where(("status", "!=", "F")))


simple("filter_empty_passes_nothing", "SELECT * FROM nation WHERE false", "Filter", ["nation"], predicates=[])
simple("project_alias", "SELECT c_name AS name, c_custkey, c_acctbal AS balance FROM customer", "Projection", ["customer"], attributes=[{"originalAttribute": "c_name", "alias": "name"}, {"originalAttribute": "c_custkey", "alias": ""}, {"originalAttribute": "c_acctbal", "alias": "balance"}])
simple("project_drop", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer", "Projection", ["customer"], isDrop=True, attributes=[{"originalAttribute": "c_name", "alias": ""}, {"originalAttribute": "c_mktsegment", "alias": ""}])
simple("cast_double_to_int", "SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::INTEGER AS l_extendedprice FROM lineitem", "TypeCasting", ["lineitem(l_orderkey, l_linenumber, l_extendedprice)"], typeCastingUnits=[{"attribute": "l_extendedprice", "resultType": "integer"}])
simple("cast_ts_to_long_ms", "SELECT o_orderkey, epoch_ms(o_orderdate) AS o_orderdate FROM orders", "TypeCasting", ["orders(o_orderkey, o_orderdate)"], typeCastingUnits=[{"attribute": "o_orderdate", "resultType": "long"}])
simple("cast_int_to_bool", "SELECT n_nationkey <> 0 AS n_nationkey, n_name FROM nation", "TypeCasting", ["nation(n_nationkey, n_name)"], typeCastingUnits=[{"attribute": "n_nationkey", "resultType": "boolean"}])
simple("cast_long_to_string", "SELECT c_custkey::VARCHAR AS c_custkey, c_nationkey::DOUBLE AS c_nationkey FROM customer", "TypeCasting", ["customer(c_custkey, c_nationkey)"], typeCastingUnits=[{"attribute": "c_custkey", "resultType": "string"}, {"attribute": "c_nationkey", "resultType": "double"}])
simple("cast_ts_to_string", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.0' AS o_orderdate FROM orders", "TypeCasting", ["orders(o_orderkey, o_orderdate)"], typeCastingUnits=[{"attribute": "o_orderdate", "resultType": "string"}])


@query("SELECT o_orderkey, regexp_extract(o_orderpriority, '^[0-9]+')::INTEGER AS o_orderpriority FROM orders WHERE regexp_matches(o_orderpriority, '^[0-9]')")
def cast_string_prefix_to_int(spark, sf_dir):
    df = run(spark, "Regex", table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), attribute="o_orderpriority", regex="^[0-9]")
    return run(spark, "TypeCasting", df, typeCastingUnits=[{"attribute": "o_orderpriority", "resultType": "integer"}])


simple("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "Distinct", ["orders(o_orderstatus, o_orderpriority)"])
simple("unnest_words", "SELECT * FROM (SELECT p_partkey, p_type, unnest(string_split(p_type, ' ')) AS word FROM part) WHERE word <> ''", "UnnestString", ["part(p_partkey, p_type)"], **{"Delimiter": " ", "Attribute": "p_type", "Result attribute": "word"})
simple("unnest_regex", "SELECT * FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.]\\s*')) AS sentence FROM documents) WHERE sentence <> ''", "UnnestString", ["documents(doc_id, text)"], then=lambda df: df.drop("text"), **{"Delimiter": "[.][ \\t\\n\\f\\r]*", "Attribute": "text", "Result attribute": "sentence"})


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_sorted(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    df = run(spark, "Sort", df, attributes=[{"attribute": "o_totalprice", "sortPreference": "DESC"}, {"attribute": "o_orderkey", "sortPreference": "ASC"}])
    return run(spark, "Limit", df, limit=25)


@query("""SELECT o_orderkey, v, row_number() OVER (ORDER BY v DESC NULLS LAST, o_orderkey ASC NULLS LAST)::INTEGER AS place
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders)""")
def sort_multi_nulls_last(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v")
    ordered = run(spark, "Sort", df, attributes=[{"attribute": "v", "sortPreference": "DESC"}, {"attribute": "o_orderkey", "sortPreference": "ASC"}])
    # Places of a total order: partitions are in order, so a row's place is its partition's start plus its own.
    path = storage.shared_folder(spark)
    ordered.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = {r["p"]: r["count"] for r in rows.groupBy("p").count().collect()}
    starts, at = {}, 0
    for p in sorted(counts):
        starts[p], at = at, at + counts[p]
    start = F.create_map(*(F.lit(x) for p in sorted(starts) for x in (p, starts[p])))[F.col("p")]
    place = (start + (F.col("m") - F.shiftleft(F.col("p").cast("long"), 33)) + 1).cast("int")
    return rows.select("o_orderkey", "v", place.alias("place"))


@query("SELECT n_nationkey, n_name, least(greatest(n_nationkey // 6, 0), 3)::INTEGER AS range FROM nation")
def sort_partitions(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    op = make("SortPartitions", sortAttributeName="n_nationkey", domainMin=0, domainMax=23, partitions=4)
    return op.apply(spark, [[df]])[0].select("*", op.bucket(df, 4).alias("range"))


# Text search ----------------------------------------------------------------------------------------------------------

_W = "regexp_matches(lower(text), '(^|[^a-zà-ÿ0-9_])({w})([^a-zà-ÿ0-9_]|$)')"
simple("regex_documents", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')", "Regex", ["documents(doc_id, text)"], then=lambda df: df.select("doc_id"), attribute="text", regex="[0-9]{3}-[0-9]{4}")
simple("keyword_term", f"SELECT doc_id FROM documents WHERE {_W.format(w='worthless')}", "KeywordSearch", ["documents(doc_id, text)"], then=lambda df: df.select("doc_id"), attribute="text", keyword="worthless")
simple("keyword_and", f"SELECT doc_id FROM documents WHERE {_W.format(w='the')} AND {_W.format(w='with')}", "KeywordSearch", ["documents(doc_id, text)"], then=lambda df: df.select("doc_id"), attribute="text", keyword="the AND with")
simple("keyword_or_not", f"SELECT doc_id FROM documents WHERE {_W.format(w='und')} AND NOT {_W.format(w='der')}", "KeywordSearch", ["documents(doc_id, text)"], then=lambda df: df.select("doc_id"), attribute="text", keyword="+und -der")
simple("keyword_phrase", f"SELECT doc_id FROM documents WHERE {_W.format(w='of[^a-zà-ÿ0-9_]+the')}", "KeywordSearch", ["documents(doc_id, text)"], then=lambda df: df.select("doc_id"), attribute="text", keyword='"of the"')
simple("dict_scan", "SELECT n_nationkey, n_name, coalesce(lower(n_name) IN ('nation_1', 'nation_7', 'france'), false) AS matched FROM nation", "DictionaryMatcher", ["nation(n_nationkey, n_name)"], **{"Dictionary": "NATION_1,nation_7,France", "Attribute": "n_name", "result attribute": "matched", "Matching type": "Scan"})
simple("dict_substring", "SELECT r_regionkey, r_name, r_name <> '' AND (contains('north america and asia', lower(r_name)) OR contains('europe', lower(r_name))) AS found FROM region", "DictionaryMatcher", ["region"], **{"Dictionary": "North America and Asia,Europe", "Attribute": "r_name", "result attribute": "found", "Matching type": "Substring"})

# Joins ------------------------------------------------------------------------------------------------------------------

_OC = ["customer(c_custkey, c_name)", "orders(o_orderkey, o_custkey, o_totalprice)"]
_JOIN = {"buildAttributeName": "c_custkey", "probeAttributeName": "o_custkey"}
simple("join_inner", "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey", "HashJoin", _OC, joinType="inner", **_JOIN)
simple("join_left", "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey", "HashJoin", _OC, joinType="left outer", **_JOIN)
simple("join_right", "SELECT coalesce(s_nationkey, n_nationkey) AS s_nationkey, s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey", "HashJoin", ["supplier(s_nationkey, s_suppkey)", "nation(n_nationkey, n_name)"], buildAttributeName="s_nationkey", probeAttributeName="n_nationkey", joinType="right outer")


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS n, b.n AS "n#@1" FROM (SELECT c_nationkey % 13 AS k, count(*) AS n FROM customer GROUP BY 1) a
FULL JOIN (SELECT s_nationkey % 17 + 5 AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def join_full(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 13).alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 17 + 5).alias("k")).agg(F.count("*").alias("n"))
    return run(spark, "HashJoin", a, b, buildAttributeName="k", probeAttributeName="k", joinType="full outer")


@query("""SELECT a.n_name, a.k, b.r_name FROM (SELECT n_name, nullif(n_regionkey, 2) AS k FROM nation) a
JOIN (SELECT r_name, nullif(r_regionkey, 2) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k""")
def join_null_keys(spark, sf_dir):
    a = table(spark, sf_dir, "nation").selectExpr("n_name", "nullif(n_regionkey, 2) AS k")
    b = table(spark, sf_dir, "region").selectExpr("r_name", "nullif(r_regionkey, 2) AS k")
    return run(spark, "HashJoin", a, b, buildAttributeName="k", probeAttributeName="k")


simple("cartesian_region_nation", "SELECT r.r_regionkey, r.r_name, n.n_nationkey, n.n_name, n.n_regionkey FROM region r, nation n", "CartesianProduct", ["region", "nation"])
simple("cartesian_clash", 'SELECT a.r_regionkey, a.r_name, b.r_regionkey AS "r_regionkey#@1", b.r_name AS "r_name#@1" FROM region a, region b', "CartesianProduct", ["region", "region"])


@query("SELECT p_partkey, p_size, s_suppkey, k FROM part JOIN (SELECT s_suppkey, (s_suppkey % 40)::INTEGER AS k FROM supplier) s ON p_size >= k AND p_size <= k + 3")
def interval_join_int(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "cast(s_suppkey % 40 as int) AS k")
    return run(spark, "IntervalJoin", table(spark, sf_dir, "part").select("p_partkey", "p_size"), s, leftAttributeName="p_size", rightAttributeName="k", constant=3)


@query("SELECT o_orderkey, o_totalprice, c_custkey, c_acctbal FROM orders JOIN customer ON o_totalprice > c_acctbal AND o_totalprice < c_acctbal + 5")
def interval_join_double_open(spark, sf_dir):
    return run(spark, "IntervalJoin", table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), leftAttributeName="o_totalprice", rightAttributeName="c_acctbal", constant=5, includeLeftBound=False, includeRightBound=False)


@query("""SELECT a.event_id, a.ts, b.event_id AS "event_id#@1", b.ts AS "ts#@1" FROM events a JOIN events b ON a.ts >= b.ts AND a.ts < b.ts + INTERVAL 1 HOUR""")
def interval_join_ts_hour(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return run(spark, "IntervalJoin", e, e, leftAttributeName="ts", rightAttributeName="ts", constant=1, timeIntervalType="hour", includeRightBound=False)


@query("""SELECT o.o_orderkey, o.o_orderdate, c.k FROM orders o JOIN (SELECT DISTINCT o_orderdate AS k FROM orders) c
ON o.o_orderdate >= c.k AND o.o_orderdate <= c.k + INTERVAL 1 MONTH""")
def interval_join_ts_month(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = o.select(F.col("o_orderdate").alias("k")).distinct()
    return run(spark, "IntervalJoin", o, k, leftAttributeName="o_orderdate", rightAttributeName="k", constant=1, timeIntervalType="month")


# Aggregation --------------------------------------------------------------------------------------------------------------

simple(
    "agg_all_functions",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total, count(l_orderkey)::INTEGER AS n, round(avg(l_extendedprice), 4) AS mean, min(l_discount) AS low, max(l_tax) AS high,
    max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1, 2""",
    "Aggregate", ["lineitem"], then=lambda df: df.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4), "last_ship": F.col("last_ship").cast("timestamp_ntz")}), groupByKeys=["l_returnflag", "l_linestatus"],
    aggregations=aggregations(("sum", "l_quantity", "total"), ("count", "l_orderkey", "n"), ("average", "l_extendedprice", "mean"), ("min", "l_discount", "low"), ("max", "l_tax", "high"), ("max", "l_shipdate", "last_ship")),
)


@query("SELECT k, sum(n_nationkey)::INTEGER AS total, count(v)::INTEGER AS n FROM (SELECT nullif(n_regionkey, 1) AS k, n_nationkey, nullif(n_nationkey, 3) AS v FROM nation) GROUP BY k")
def agg_group_nulls(spark, sf_dir):
    df = table(spark, sf_dir, "nation").selectExpr("nullif(n_regionkey, 1) AS k", "n_nationkey", "nullif(n_nationkey, 3) AS v")
    return run(spark, "Aggregate", df, groupByKeys=["k"], aggregations=aggregations(("sum", "n_nationkey", "total"), ("count", "v", "n")))


@query("SELECT count(o_orderkey)::INTEGER AS n, round(sum(o_totalprice), 2) AS total, min(o_orderstatus) AS x FROM orders HAVING count(*) > 0")
def agg_global(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    sums = run(spark, "Aggregate", orders, aggregations=aggregations(("count", "o_orderkey", "n"), ("sum", "o_totalprice", "total")))
    # The operator's min is of numbers and times only, so the least text comes by Sort and Limit.
    ordered = run(spark, "Sort", orders.select(F.col("o_orderstatus").alias("x")), attributes=[{"attribute": "x", "sortPreference": "ASC"}])
    return run(spark, "CartesianProduct", sums, run(spark, "Limit", ordered, limit=1)).withColumn("total", F.round("total", 2))


@query("SELECT count(*)::INTEGER AS n FROM nation WHERE false HAVING count(*) > 0")
def agg_empty_input(spark, sf_dir):
    return run(spark, "Aggregate", table(spark, sf_dir, "nation").limit(0), aggregations=aggregations(("count", "n_nationkey", "n")))


simple("agg_concat_sorted", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1", "Aggregate", ["nation"], groupByKeys=["n_regionkey"], aggregations=aggregations(("concat", "n_name", "names")))
simple("agg_ts_minmax", "SELECT event_type, min(ts) AS first, max(ts) AS last, avg(epoch_us(ts) // 1000) AS mean FROM events GROUP BY 1", "Aggregate", ["events"], then=lambda df: df.select("event_type", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "mean"), groupByKeys=["event_type"], aggregations=aggregations(("min", "ts", "first"), ("max", "ts", "last"), ("average", "ts", "mean")))

# Sets -----------------------------------------------------------------------------------------------------------------------


def _sides(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 20).alias("k"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 20 + 3).alias("k"))
    return c, s


_A, _B = "SELECT c_nationkey % 20 AS k FROM customer", "SELECT s_nationkey % 20 + 3 AS k FROM supplier"


@query(f"{_A} UNION ALL {_B}")
def union_all(spark, sf_dir):
    return make("Union").apply(spark, [list(_sides(spark, sf_dir))])[0]


@query(f"{_A} INTERSECT {_B}")
def intersect(spark, sf_dir):
    return run(spark, "Intersect", *_sides(spark, sf_dir))


@query(f"{_A} EXCEPT {_B}")
def difference(spark, sf_dir):
    return run(spark, "Difference", *_sides(spark, sf_dir))


@query(f"({_A} EXCEPT {_B}) UNION ALL ({_B} EXCEPT {_A})")
def symmetric_difference(spark, sf_dir):
    return run(spark, "SymmetricDifference", *_sides(spark, sf_dir))


# Sampling, routing ------------------------------------------------------------------------------------------------------------



@query("SELECT least(count(*), 100)::INTEGER AS n, least(count(*), 100)::INTEGER AS different FROM orders")
def reservoir_k(spark, sf_dir):
    rows = run(spark, "ReservoirSampling", table(spark, sf_dir, "orders").select("o_orderkey"), **{"number of item sampled in reservoir sampling": 100})
    return rows.agg(F.count("*").cast("int").alias("n"), F.count_distinct("o_orderkey").cast("int").alias("different"))


@query("SELECT count(*) AS n, 0::BIGINT AS in_both FROM orders")
def split_union_complete(spark, sf_dir):
    a, b = make("Split", k=70, random=False, seed=3).apply(spark, [[table(spark, sf_dir, "orders").select("o_orderkey")]])
    keys = a.withColumn("port", F.lit(1)).unionAll(b.withColumn("port", F.lit(2))).groupBy("o_orderkey").agg(F.bit_or("port").alias("ports"))
    return keys.agg(F.count("*").alias("n"), F.sum((F.col("ports") == 3).cast("long")).alias("in_both"))


@query("SELECT * FROM region")
def if_true_branch(spark, sf_dir):
    state = spark.createDataFrame([(True,)], "big boolean")
    return make("If", conditionName="big").apply(spark, [[state], [table(spark, sf_dir, "region")]])[1]


@query("SELECT * FROM region WHERE false")
def if_true_leaves_false_branch_empty(spark, sf_dir):
    state = spark.createDataFrame([(True,)], "big boolean")
    return make("If", conditionName="big").apply(spark, [[state], [table(spark, sf_dir, "region")]])[0]


simple("sleep", "SELECT * FROM region", "Sleep", ["region"], sleepTime=0)

# User functions -----------------------------------------------------------------------------------------------------------------

simple("lambda_add_column", "SELECT o_orderkey * 2 AS o_orderkey, o_totalprice, o_totalprice * 2 AS gross, substr(o_orderstatus, 1, 1) || '!' AS mark, o_orderstatus FROM orders", "PythonLambdaFunction", ["orders(o_orderkey, o_totalprice, o_orderstatus)"], lambdaAttributeUnits=[
    {"attributeName": "Add New Column", "newAttributeName": "gross", "attributeType": "double", "expression": "tuple_['o_totalprice'] * 2"},
    {"attributeName": "Add New Column", "newAttributeName": "mark", "attributeType": "string", "expression": "tuple_['o_orderstatus'][0] + '!'"},
    {"attributeName": "o_orderkey", "newAttributeName": "", "attributeType": "long", "expression": "tuple_['o_orderkey'] * 2"},
])
simple("table_reducer", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer", "PythonTableReducer", ["customer(c_custkey, c_acctbal)"], then=rounded("total"), lambdaAttributeUnits=[{"attributeName": "n", "attributeType": "long", "expression": "len(table)"}, {"attributeName": "total", "attributeType": "double", "expression": "table['c_acctbal'].sum()"}])
simple("udf_rows", "SELECT n_nationkey, n_name, length(n_name)::INTEGER AS size FROM nation WHERE n_nationkey % 2 = 0", "PythonUDFV2", ["nation(n_nationkey, n_name)"], outputColumns=[{"attributeName": "size", "attributeType": "integer"}], code="""
class Even(RowFunction):
    def process_tuple(self, tuple_, port):
        if tuple_['n_nationkey'] % 2 == 0:
            tuple_['size'] = len(tuple_['n_name'])
            yield tuple_
""")
simple("udf_table", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1", "PythonUDFV2", ["customer(c_mktsegment)"], retainInputColumns=False, outputColumns=[{"attributeName": "c_mktsegment", "attributeType": "string"}, {"attributeName": "n", "attributeType": "long"}], code="""
class Counts(TableFunction):
    def process_table(self, table, port):
        yield table.groupby('c_mktsegment').size().rename('n').reset_index()
""")
simple("udf_dual", "SELECT c_custkey, c_nationkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey", "DualInputPortsPythonUDFV2", ["nation", "customer(c_custkey, c_nationkey)"], workers=4, outputColumns=[{"attributeName": "nation", "attributeType": "string"}], code="""
class Lookup(RowFunction):
    def open(self):
        self.names = {}
    def process_tuple(self, tuple_, port):
        if port == 0:
            self.names[tuple_['n_nationkey']] = tuple_['n_name']
        else:
            tuple_['nation'] = self.names[tuple_['c_nationkey']]
            yield tuple_
""")


@query("SELECT i::INTEGER AS i, (i * i)::BIGINT AS square FROM range(10) t(i)")
def udf_source(spark, sf_dir):
    code = "class Squares(SourceFunction):\n    def produce(self):\n        for i in range(10):\n            yield {'i': i, 'square': i * i}\n"
    return make("PythonUDFSourceV2", code=code, columns=[{"attributeName": "i", "attributeType": "integer"}, {"attributeName": "square", "attributeType": "long"}]).apply(spark, [])[0]


# Sources and results ----------------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark, sf_dir):
    path = results.export(table(spark, sf_dir, "nation"), storage.shared_folder(spark), "csv")
    return make("CSVFileScan", fileName=path).apply(spark, [])[0]


@query("SELECT c_custkey::INTEGER AS c_custkey, c_name, c_acctbal FROM customer")
def csv_parallel(spark, sf_dir):
    path = results.export(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), storage.shared_folder(spark), "csv")
    return make("ParallelCSVFileScan", fileName=path).apply(spark, [])[0]


@query("""SELECT n_nationkey AS "key", n_name AS "place.name", n_regionkey AS "place.region1" FROM nation""")
def jsonl_flatten(spark, sf_dir):
    path = storage.shared_folder(spark)
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("name"), F.array("n_regionkey").alias("region")).alias("place")).write.json(path)
    return make("JSONLFileScan", fileName=path, flatten=True).apply(spark, [])[0]


@query("SELECT r_name AS line FROM region")
def file_lines(spark, sf_dir):
    path = storage.shared_folder(spark)
    table(spark, sf_dir, "region").select("r_name").write.text(path)
    return make("FileScan", fileName=path).apply(spark, [])[0]


@query("SELECT i::INTEGER AS line FROM (VALUES (2), (3)) t(i)")
def text_input(spark, sf_dir):
    return make("TextInput", textInput="1\n2\n3\n4", attributeType="integer", fileScanOffset=1, fileScanLimit=2).apply(spark, [])[0]


simple("column_stats", """SELECT 'o_orderkey' AS "column", count(o_orderkey) AS not_null_count, min(o_orderkey)::DOUBLE AS low, max(o_orderkey)::DOUBLE AS high FROM orders
UNION ALL SELECT 'o_totalprice', count(o_totalprice), min(o_totalprice), max(o_totalprice) FROM orders""", "Projection", ["orders"], then=lambda df: results.column_statistics(df).select("column", "not_null_count", F.col("min").cast("double").alias("low"), F.col("max").cast("double").alias("high")), attributes=[{"originalAttribute": "o_orderkey", "alias": ""}, {"originalAttribute": "o_totalprice", "alias": ""}])


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 5")
def result_page(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")
    return results.Results.write(df, storage.shared_folder(spark)).page(2)


simple("result_preview", "SELECT doc_id::VARCHAR AS doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE coalesce(text, 'NULL') END AS text FROM documents", "Projection", ["documents"], then=results.preview, attributes=[{"originalAttribute": "doc_id", "alias": ""}, {"originalAttribute": "text", "alias": ""}])

# Scores and models --------------------------------------------------------------------------------------------------------------------

@query("""WITH p AS (SELECT quality AS a, 1 - toxic AS p FROM labels), c AS (SELECT DISTINCT a AS label FROM p)
SELECT 'class_' || label AS "Class", round(coalesce((SELECT count(*) FROM p WHERE a = label AND p = label) / nullif((SELECT count(*) FROM p WHERE p = label), 0)::DOUBLE, 0), 4) AS "Precision Score",
round((SELECT count(*) FROM p WHERE a = label AND p = label) / (SELECT count(*) FROM p WHERE a = label)::DOUBLE, 4) AS "Recall Score", NULL::DOUBLE AS "Accuracy" FROM c
UNION ALL SELECT 'Overall', NULL, NULL, round(avg((a = p)::INTEGER), 4) FROM p""")
def scorer_classification(spark, sf_dir):
    df = table(spark, sf_dir, "labels").selectExpr("quality", "1 - toxic AS p")
    return run(spark, "Scorer", df, actualValueColumn="quality", predictValueColumn="p", classificationMetrics=["Accuracy", "Precision Score", "Recall Score"])


@query("SELECT round(avg((l_extendedprice - l_quantity * 1000) ** 2), 2) AS \"MSE\", round(avg(abs(l_extendedprice - l_quantity * 1000)), 2) AS \"MAE\", round(1 - avg((l_extendedprice - l_quantity * 1000) ** 2) / var_pop(l_extendedprice), 4) AS \"R2\" FROM lineitem")
def scorer_regression(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_extendedprice AS a", "l_quantity * 1000 AS p")
    out = run(spark, "Scorer", df, isRegression=True, actualValueColumn="a", predictValueColumn="p", regressionMetrics=["MSE", "MAE", "R2"])
    return out.select(F.round("MSE", 2).alias("MSE"), F.round("MAE", 2).alias("MAE"), F.round("R2", 4).alias("R2"))


# Data of charts -------------------------------------------------------------------------------------------------------------------------

chart("viz_sankey", "SELECT o_orderstatus AS source, o_orderpriority AS target, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2", "SankeyDiagram", "orders", rounded("value"), **{"Source Attribute": "o_orderstatus", "Target Attribute": "o_orderpriority", "Value Attribute": "o_totalprice"})
chart("viz_dot_counts", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1", "DotPlot", "events", **{"Count Attribute": "event_type"})
chart("viz_range_slider_mean", "SELECT p_size AS x, round(avg(p_retailprice), 4) AS y FROM part GROUP BY 1", "RangeSlider", "part", rounded("y", digits=4), **{"Y-axis": "p_retailprice", "X-axis": "p_size", "Duplicates": "Mean"})
chart("viz_range_slider_sum", "SELECT p_size AS x, round(sum(p_retailprice), 2) AS y FROM part GROUP BY 1", "RangeSlider", "part", rounded("y"), **{"Y-axis": "p_retailprice", "X-axis": "p_size", "Duplicates": "Sum"})
chart("viz_box_quartiles", "SELECT min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q1, median(l_quantity) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS max, count(l_quantity) AS count FROM lineitem", "BoxViolinPlot", "lineitem", value="l_quantity")
for _kind, _name in (("HierarchyChart", "viz_hierarchy_rollup"), ("IcicleChart", "viz_icicle_rollup")):
    chart(_name, "SELECT l_returnflag AS level0, l_linestatus AS level1, (CASE WHEN l_linestatus IS NULL THEN 1 ELSE 2 END)::INTEGER AS depth, round(sum(l_quantity) FILTER (WHERE l_quantity > 0), 2) AS value FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))", _kind, "lineitem", rounded("value"), hierarchy=[{"attributeName": "l_returnflag"}, {"attributeName": "l_linestatus"}], value="l_quantity")
chart("viz_volcano", "SELECT l_quantity AS effect, round(-log10(l_tax), 6) AS neg_log10_p FROM lineitem WHERE l_tax > 0", "VolcanoPlot", "lineitem", rounded("neg_log10_p", digits=6), effectColumn="l_quantity", pvalueColumn="l_tax")
chart("viz_hist2d", """WITH e AS (SELECT min(l_quantity) a, max(l_quantity) b, min(l_discount) c, max(l_discount) d, count(*)::DOUBLE n FROM lineitem)
SELECT least(floor((l_quantity - a) / (b - a) * 5), 4)::INTEGER AS x_bin, least(floor((l_discount - c) / (d - c) * 4), 3)::INTEGER AS y_bin, round(100 * count(*) / any_value(n), 6) AS value FROM lineitem, e GROUP BY 1, 2""", "Histogram2D", "lineitem", rounded("value", digits=6), xColumn="l_quantity", yColumn="l_discount", xBins=5, yBins=4, normalize="percent")
chart("viz_histogram", """WITH e AS (SELECT min(o_totalprice) a, max(o_totalprice) b FROM orders)
SELECT least(floor((o_totalprice - a) / (b - a) * 10), 9)::INTEGER AS bin, o_orderstatus AS color, count(*) AS count FROM orders, e GROUP BY 1, 2""", "Histogram", "orders", lambda df: df.drop("from"), value="o_totalprice", color="o_orderstatus")
chart("viz_bar", "SELECT c_mktsegment AS field, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1", "BarChart", "customer", rounded("value"), value="c_acctbal", fields="c_mktsegment")
chart("viz_time_series", 'SELECT ts AS time, value, event_type AS category FROM events WHERE value IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL', "TimeSeriesPlot", "events", lambda df: df.withColumn("time", F.col("time").cast("timestamp_ntz")), timeColumn="ts", valueColumn="value", CategoryColumn="event_type")
chart("viz_contour", """WITH e AS (SELECT min(l_quantity) a, max(l_quantity) b, min(l_discount) c, max(l_discount) d FROM lineitem)
SELECT least(floor((l_quantity - a) / (b - a) * 4), 3)::INTEGER AS x_bin, least(floor((l_discount - c) / (d - c) * 4), 3)::INTEGER AS y_bin, round(avg(l_extendedprice), 2) AS z FROM lineitem, e GROUP BY 1, 2""", "ContourPlot", "lineitem", rounded("z"), x="l_quantity", y="l_discount", z="l_extendedprice", gridSize="4")
chart("viz_line", "SELECT 0 AS trace, 'price' AS name, p_partkey::VARCHAR AS x, p_retailprice AS y FROM part", "LineChart", "part", lines=[{"xValue": "p_partkey", "yValue": "p_retailprice", "name": "price", "mode": "line", "color": ""}])
chart("viz_error_bands", "SELECT 0 AS trace, 'band' AS name, p_partkey::VARCHAR AS x, p_retailprice AS y, p_retailprice AS upper, p_size::DOUBLE AS lower FROM part", "ContinuousErrorBands", "part", bands=[{"xValue": "p_partkey", "yValue": "p_retailprice", "name": "band", "yUpper": "p_retailprice", "yLower": "p_size"}])
chart("viz_waterfall", "SELECT r_name AS x, r_regionkey AS y FROM region", "WaterfallChart", "region", xColumn="r_name", yColumn="r_regionkey")
chart("viz_pie", "SELECT n_name AS name, n_nationkey AS value FROM nation", "PieChart", "nation", value="n_nationkey", name="n_name")
chart("viz_quiver", "SELECT l_quantity AS x, l_discount AS y, l_tax AS u, l_extendedprice AS v FROM lineitem", "QuiverPlot", "lineitem", x="l_quantity", y="l_discount", u="l_tax", v="l_extendedprice")
chart("viz_html", 'SELECT html AS "html-content" FROM pages', "HTMLVisualizer", "pages", htmlContentAttrName="html")
chart("viz_scatter", "SELECT c_acctbal, c_nationkey, c_mktsegment FROM customer", "Scatterplot", "customer", xColumn="c_acctbal", yColumn="c_nationkey", colorColumn="c_mktsegment")
chart("viz_area", "SELECT p_partkey, p_retailprice FROM part", "FilledAreaPlot", "part", x="p_partkey", y="p_retailprice")
chart("viz_bubble", "SELECT p_partkey, p_size, p_retailprice FROM part", "BubbleChart", "part", xValue="p_partkey", yValue="p_size", zValue="p_retailprice")
chart("viz_bullet", "SELECT c_acctbal AS value, 100.0::DOUBLE AS delta, NULL::DOUBLE AS threshold FROM customer", "BulletChart", "customer", value="c_acctbal", deltaReference="100")
chart("viz_gauge", "SELECT c_acctbal AS value, 10.0::DOUBLE AS delta, 50.0::DOUBLE AS threshold FROM customer", "GaugeChart", "customer", value="c_acctbal", delta="10", threshold="50", steps=[{"start": "0", "end": "10"}])
chart("viz_network_edges", "SELECT DISTINCT n_name AS source, n_regionkey::VARCHAR AS destination FROM nation", "NetworkGraph", "nation", source="n_name", destination="n_regionkey")
chart("viz_scatter_matrix", "SELECT p_size, p_retailprice, p_brand FROM part", "ScatterMatrixChart", "part", **{"Selected Attributes": ["p_size", "p_retailprice"], "Color": "p_brand"})
chart("viz_heat", "SELECT l_quantity AS x, l_discount AS y, l_tax AS value FROM lineitem", "HeatMap", "lineitem", x="l_quantity", y="l_discount", Values="l_tax")
chart("viz_scatter3d", "SELECT l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem", "Scatter3DChart", "lineitem", x="l_quantity", y="l_discount", z="l_tax")
chart("viz_funnel", "SELECT n_nationkey AS x, n_name AS y FROM nation", "FunnelPlot", "nation", x="n_nationkey", y="n_name")
chart("viz_table", "SELECT n_name, n_nationkey FROM nation", "TablesPlot", "nation", includedColumns=[{"attributeName": "n_name"}, {"attributeName": "n_nationkey"}])
chart("viz_figure_table", "SELECT n_name FROM nation", "FigureFactoryTable", "nation", columns=[{"attributeName": "n_name"}])
chart("viz_nested_table", "SELECT c_custkey AS id, round(c_acctbal, 2) AS balance FROM customer", "NestedTable", "customer", lambda df: df.select("who.*", "money.*"), includedColumns=[{"attributeGroup": "who", "originalName": "c_custkey", "newName": "id"}, {"attributeGroup": "money", "originalName": "c_acctbal", "newName": "balance"}])
chart("viz_ternary", "SELECT l_quantity, l_discount, l_tax FROM lineitem", "TernaryPlot", "lineitem", firstVariable="l_quantity", secondVariable="l_discount", thirdVariable="l_tax")
chart("viz_dendrogram_points", "SELECT p_size::DOUBLE AS x, p_retailprice AS y, p_name AS label FROM part", "Dendrogram", "part", xVal="p_size", yVal="p_retailprice", Labels="p_name")


@query("SELECT 'a' AS parent, n_name AS child FROM nation")
def viz_tree_edges(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select(F.concat(F.lit("['a', '"), "n_name", F.lit("']")).alias("edge"))
    return make("TreePlot", **{"Edge List Column": "edge"}).prepare(df)
