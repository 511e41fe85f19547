"""Registered queries over whole tables, against their SQL."""

from __future__ import annotations

import duckdb

from millrace.plans import catalog

SF = "/root/testdata/sf0.001"
#: Over 2000 orders.
LARGER = "/root/testdata/sf0.01"


def by_sql(name: str, sf: str = SF) -> list[tuple]:
    db = duckdb.connect()
    for t in ("orders", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return sorted(db.execute(catalog.ORACLE_SQL[name]).fetchall(), key=str)


def by_spark(spark, name: str, sf: str = SF) -> list[tuple]:
    return sorted((tuple(r) for r in catalog.QUERIES[name](spark, sf).collect()), key=str)


def test_every_place_of_a_sort(spark):
    got = by_spark(spark, "sort_multi_nulls_last", LARGER)
    assert got == by_sql("sort_multi_nulls_last", LARGER)
    assert sorted(r[2] for r in got) == list(range(1, catalog.table(spark, LARGER, "orders").count() + 1))


def test_interval_joins_of_whole_tables(spark):
    for name in ("interval_join_ts_hour", "interval_join_ts_month"):
        got = by_spark(spark, name)
        assert got == by_sql(name) and got, name
    # Every event lies in its own interval, so all of them are met on the right side.
    right = {r["event_id#@1"] for r in catalog.QUERIES["interval_join_ts_hour"](spark, SF).collect()}
    assert len(right) == catalog.table(spark, SF, "events").count()


def test_global_minimum_is_computed(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS o_orderkey, 2.5D AS o_totalprice, 'P' AS o_orderstatus UNION ALL SELECT 2L, 1.25D, 'O'")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in catalog.QUERIES["agg_global"](spark, str(tmp_path)).collect()] == [(2, 3.75, "O")]
    assert by_spark(spark, "agg_global") == by_sql("agg_global")
