from __future__ import annotations

import os
import random

import corpus_pipeline
import duckdb
from millrace.llm import quality_rules
from millrace.llm.queries import ORACLE_SQL, QUERIES


def filler(i: int, n: int = 60) -> str:
    r = random.Random(i)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_short_lines_of_a_host_go(spark):
    rows = [(i, f"Read more\n\n{filler(i)}", "a") for i in range(30)] + [(50, "Read more\n" * 100 + filler(50), "a"), (60, f"Read more\n{filler(60)}", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality_rules_stage(spark, df, "").collect()}
    # Blank lines stay; the first document keeps the line; 50 is depleted; b has too few documents.
    assert kept[0] == rows[0][1] and kept[5] == f"\n{filler(5)}" and kept[60] == rows[-1][1] and 50 not in kept


def same_as_sql(spark, sf: str) -> None:
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'" if os.path.isdir(f"{sf}/documents.parquet") else f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = QUERIES["op3_quality_rules"](spark, sf)
    wanted = db.execute(ORACLE_SQL["op3_quality_rules"])
    assert got.columns == [c[0] for c in wanted.description]
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(wanted.fetchall(), key=key)


def test_all_lines_are_counted_as_in_sql(spark):
    same_as_sql(spark, "/root/testdata/sf0.001")


def test_repeated_rows_are_one_document_as_in_sql(spark, tmp_path):
    """30 rows of one document and one other share a line: two documents. Rows of one id may differ, or repeat as a whole."""
    rows = [(1, f"common line here\n{filler(1)}", "a")] * 30 + [(2, f"common line here\n{filler(2)}", "a")]
    rows += [(100 + i, f"seen by many\n{filler(i, 20)}\n{filler(i + 40)}", "b") for i in range(25)] * 2 + [(100, f"seen by many\n{filler(77)}", "b")]
    rows += [(300, None, None), (301, "", "a"), (302, "x y z " * 40, None), (302, "x y z " * 40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, str(tmp_path))
    got = {(r.doc_id, r.n_words): r.n_removed_lines for r in quality_rules.verdicts(df).collect()}
    assert got[1, 63] == got[2, 63] == 0 and got[101, 83] == 1 and got[100, 83] == 0


def test_rows_without_doc_id_are_no_document(spark):
    rows = [(None, f"seen by many\n{filler(i)}", "b") for i in range(30)] + [(i, f"seen by some\n{filler(i)}", "b") for i in range(20)] + [(None, f"seen by some\n{filler(50)}", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.n_removed_lines for r in quality_rules.verdicts(df).collect()} == {0}
