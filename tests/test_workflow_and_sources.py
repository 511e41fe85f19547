import io
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import results
from millrace.plans.workflow import Workflow
from millrace.registry import PropertyError, describe_operators, make
from millrace.streaming import streams


def scan(spark, kind, **properties):
    return make(kind, **properties).apply(spark, [])[0]


def test_workflow_json_ports_and_errors(spark):
    flow = Workflow()
    flow.add("a", "TextInput", textInput="1\n2\n3", attributeType="integer")
    flow.add("split", "Split", "a", random=False)
    flow.add("both", "Union", ("split", 0))
    flow.link(("split", 1), "both")
    flow.add("total", "Aggregate", "both", aggregations=[{"aggFunction": "sum", "attribute": "line", "result attribute": "s"}])
    assert flow.result(spark).first().s == 6
    flow.add("bad", "Projection", "a", attributes=[{"originalAttribute": "nope"}])
    flow.add("behind", "Distinct", "bad")
    schemas, errors = flow.compile(spark)
    assert set(errors) == {"bad"} and "behind" not in schemas and schemas["total"][0].names == ["s"]
    circle = Workflow()
    circle.add("x", "Distinct")
    circle.add("y", "Distinct", "x")
    circle.link("y", "x")
    with pytest.raises(PropertyError, match="circle"):
        circle.order()
    with pytest.raises(PropertyError):
        Workflow.from_json({"operators": [{"operatorID": "q", "operatorType": "NoSuch"}]})
    with pytest.raises(PropertyError, match="missing"):
        make("Regex")


def test_every_operator_is_described():
    found = {d["operatorType"] for d in describe_operators()}
    assert len(found) >= 148 and {"Filter", "SklearnRidge", "SklearnTrainingRidge", "SankeyDiagram", "RedditSearch", "SVRTrainer"} <= found


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,when,"note, long",n\n1,5/28/2010,"two\nlines",1.5\n2,6/1/2010,"say ""x""",2\nbad,6/2/2010,z,3\n' + "".join(f"{i},6/3/2010,w,4\n" for i in range(3, 120)))
    df = scan(spark, "CSVFileScan", fileName=str(p))
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "timestamp", "string", "double"]
    p.write_text(p.read_text().replace("bad", "7"))
    df = scan(spark, "CSVFileScan", fileName=str(p), offset=1, limit=2)
    assert [tuple(r)[0::2] for r in df.collect()] == [(2, 'say "x"'), (7, "z")]
    q = tmp_path / "b.csv"
    q.write_text("1;x\n2;\n" + "3;y\n" * 100 + "oops;y\n")
    df = scan(spark, "CSVFileScan", fileName=str(q), customDelimiter=";", hasHeader=False)
    assert df.columns == ["column-1", "column-2"] and df.count() == 102  # the row whose number doesn't parse goes
    assert scan(spark, "ParallelCSVFileScan", fileName=str(q), customDelimiter=";", hasHeader=False).count() == 102
    assert scan(spark, "CSVOldFileScan", fileName=str(q), customDelimiter=";", hasHeader=False, offset=1, limit=1).count() == 1


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in [{"id": 186199912341, "b": True, "a": {"c": 1, "d": [5, {"e": "x"}]}}, {"id": 2, "b": None, "at": "2005-12-10T03:46:36Z"}, {"id": 3}]))
    flat = scan(spark, "JSONLFileScan", fileName=str(p), flatten=True)
    assert flat.dtypes == [("a.c", "int"), ("a.d1", "int"), ("a.d2.e", "string"), ("at", "timestamp"), ("b", "boolean"), ("id", "bigint")]
    assert flat.count() == 3
    assert scan(spark, "JSONLFileScan", fileName=str(p)).columns == ["at", "b", "id"]
    assert scan(spark, "JSONLFileScan", fileName=str(p), offset=1, limit=1).first().id == 2


def test_files_text_arrow_url(spark, tmp_path):
    p = tmp_path / "lines.txt"
    p.write_bytes(b"line1\r\nline2\r\n")
    assert [r[0] for r in scan(spark, "FileScan", fileName=str(p)).collect()] == ["line1", "line2"]
    both = scan(spark, "FileScan", fileName=str(p), outputFileName=True, fileScanOffset=1)
    assert [tuple(r) for r in both.collect()] == [("lines.txt", "line2")]
    assert scan(spark, "FileScan", fileName=str(p), attributeType="binary").first()[0] == p.read_bytes()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x/a.txt", "1\n2")
        z.writestr("__MACOSX/a.txt", "9")
    (tmp_path / "z.zip").write_bytes(buffer.getvalue())
    assert sorted(r[0] for r in scan(spark, "FileScan", fileName=str(tmp_path / "z.zip"), extract=True, attributeType="integer").collect()) == [1, 2]
    u = tmp_path / "u16.txt"
    u.write_bytes("ä\nb".encode("utf-16"))
    assert [r[0] for r in scan(spark, "FileScan", fileName=str(u), fileEncoding="UTF_16").collect()] == ["ä", "b"]
    a = tmp_path / "t.arrow"
    results.export(spark.range(10).withColumn("s", F.col("id").cast("string")), str(a), "arrow")
    assert scan(spark, "ArrowSource", fileName=str(a), offset=2, limit=3).count() == 3
    with pa.OSFile(str(a)) as f:
        assert pa.ipc.open_file(f).read_all().num_rows == 10
    assert scan(spark, "URLFetcher", url=p.as_uri()).first()[0].startswith("line1")
    assert scan(spark, "URLFetcher", url=(tmp_path / "no").as_uri()).first()[0].startswith("Fetch failed")


def test_jdbc_by_embedded_database(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).select(F.col("id").alias("ID"), (F.col("id") * 2).cast("decimal(10,2)").alias("V")).write.format("jdbc").options(url=url, driver=driver, dbtable="T").save()
    op = make("PostgreSQLSource", host="h", database="d", table="T", progressive=True, batchByColumn="ID", min="10", max="auto", interval=25)
    op.url, op.driver = (lambda: url), driver
    parts = list(op.batches(spark))
    assert [p.count() for p in parts] == [25, 25, 25, 15]
    assert op.apply(spark, [])[0].dtypes == [("ID", "bigint"), ("V", "double")]
    assert make("MySQLSource", host="h", database="d", table="t", keywordSearch=True, keywordSearchByColumn="c", keywords="+it's", limit=3, offset=1).whole() == "SELECT * FROM t WHERE 1 = 1 AND MATCH(c) AGAINST ('+it''s' IN BOOLEAN MODE) LIMIT 3 OFFSET 1"
    with pytest.raises(PropertyError):
        make("MySQLSource", host="h", database="d", table="t; drop").query()


def test_services_by_fakes(spark):
    sent = []

    def transport(url, statement):
        sent.append(statement)
        return [{"Fields": [{"FieldName": "b", "FieldType": "int64"}, {"FieldName": "a", "FieldType": "string"}]}] if "Metadata" in statement else [{"b": 3, "a": "x"}]

    df = scan(spark, "AsterixDBSource", host="h", database="d", table="t", regexSearch=True, regexSearchByColumn="a", regex="x+", geoSearch=True, geoSearchByColumns=["p"], geoSearchBoundingBox=["1,2", "3,4"], filterCondition=True, filterPredicates=[{"attribute": "b", "condition": ">", "value": "1"}, {"attribute": "a", "condition": "is null"}], limit=5, transport=transport)
    assert [tuple(r) for r in df.collect()] == [("x", 3)]
    assert sent[1] == "SELECT a, b FROM d.t WHERE 1 = 1 AND regexp_contains(a, 'x+') AND (spatial_intersect(p, create_rectangle(point('1.0,2.0'), point('3.0,4.0')))) AND (b > 1 OR a IS NULL) LIMIT 5;"
    from millrace.sources import apis

    page = {"data": [{"id": "1", "text": "hi", "author_id": "u", "created_at": "2020-01-01T00:00:00Z", "public_metrics": {"like_count": 2}}], "includes": {"users": [{"id": "u", "username": "n"}]}, "meta": {}}
    tweets = scan(spark, "TwitterSearch", apiKey="k", apiSecretKey="s", searchQuery="q", limit=5, client=lambda: apis.twitter_pages("recent", {}, {}, False, lambda u, h: page))
    assert len(tweets.columns) == 33 and tweets.first().user_name == "n"
    posts = scan(spark, "RedditSearch", clientId="i", clientSecret="s", query="q", limit=2, client=lambda: (apis.submission_row({"id": str(i), "score": i, "edited": False, "created_utc": 1.0, "author": "w"}) for i in range(9)))
    assert posts.count() == 2 and posts.first().author_name == "w" and posts.first().edited is None
    with pytest.raises(PropertyError):
        scan(spark, "RedditSearch", clientId="i", clientSecret="s", query="q", limit=1001)


def test_results(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 3 else "x" * (i * 30), bytes([i])) for i in range(12)], "i int, s string, b binary")
    stored = results.Results.write(df.orderBy("i").coalesce(1), str(tmp_path / "r"))
    assert [r.i for r in stored.page(2).collect()] == [5, 6, 7, 8, 9]
    assert [r.i for r in stored.after(10).collect()] == [10, 11] and stored.count() == 12
    stats = {r["column"]: r for r in results.column_statistics(df).collect()}
    assert stats["i"]["min"] == "0.0" and stats["s"]["not_null_count"] == 11
    shown = results.preview(df).collect()
    assert shown[3].s == "NULL" and shown[5].s == "x" * 100 + "..." and "length: 1" in shown[0].b
    with zipfile.ZipFile(results.export(df, str(tmp_path / "p.zip"), "zip")) as z:
        assert z.namelist()
    assert open(results.export(df, str(tmp_path / "cell"), "data", row=2, column=0)).read() == "2"
    flagged = streams.updates(df.where("i < 3"), df.where("i between 1 and 4"))
    assert sorted((r[0], r.i) for r in flagged.collect()) == [(False, 0), (True, 3), (True, 4)]


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = spark.range(20).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    df.repartition(4).write.parquet(folder)
    flow = Workflow()
    flow.add("in", "ParquetScan", fileName=folder)
    flow.add("some", "Filter", "in", predicates=[{"attribute": "v", "condition": ">=", "value": "5"}])
    batch = flow.result(spark).count()
    source = streams.stream(spark, folder, df.schema, files_per_batch=2)
    q = streams.start(spark, streams.with_input(flow, "in", source), "some_rows", str(tmp_path / "c1"))
    q.awaitTermination(60)
    assert spark.table("some_rows").count() == batch == 15
    flow.add("sum", "Aggregate", "some", groupByKeys=["k"], aggregations=[{"aggFunction": "sum", "attribute": "v", "result attribute": "s"}])
    q = streams.start(spark, streams.with_input(flow, "in", streams.stream(spark, folder, df.schema)), "sums")
    q.awaitTermination(60)
    assert sum(r.s for r in spark.table("sums").collect()) == sum(range(5, 20))
    flow.add("top", "Sort", "sum", attributes=[{"attribute": "s"}])
    with pytest.raises(PropertyError):
        streams.output_mode(flow)
    seen = []
    streams.run_batches(spark, streams.stream(spark, folder, df.schema, files_per_batch=2), flow, "in", lambda d, n: seen.append(d.count())).awaitTermination(60)
    assert len(seen) >= 2
