"""Queries of sources, results, streams, sampling and routing that catalog doesn't have."""

from __future__ import annotations

import contextlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyarrow import fs
from pyspark.sql import functions as F

from millrace import results
from millrace.functions import storage
from millrace.plans.catalog import query, run, simple, table
from millrace.plans.execution import COMPLETED, Execution
from millrace.plans.workflow import Workflow
from millrace.registry import make
from millrace.sources import apis
from millrace.streaming import streams
from millrace.viz import charts


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").orderBy("n_nationkey")


def _put(spark, data: bytes, name: str) -> str:
    """A file in the shared folder."""
    uri = f"{storage.shared_folder(spark)}/{name}"
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(path) as f:
        f.write(data)
    return uri


# Files --------------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 3")
def csv_old(spark, sf_dir):
    path = results.export(_nations(spark, sf_dir).coalesce(1), storage.shared_folder(spark), "csv")
    return make("CSVOldFileScan", fileName=path, offset=3, limit=10).apply(spark, [])[0]


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def arrow_source(spark, sf_dir):
    path = results.export(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), f"{storage.shared_folder(spark)}.arrow", "arrow")
    return make("ArrowSource", fileName=path).apply(spark, [])[0]


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def cache_source(spark, sf_dir):
    stored = results.Results.write(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), storage.shared_folder(spark))
    return make("CacheSource", storageUri=stored.path).apply(spark, [])[0].drop("__row")


@query("SELECT 'a line' || chr(10) || 'and another' AS content")
def file_single_string(spark, sf_dir):
    uri = _put(spark, b"a line\nand another", "text.txt")
    return make("FileScan", fileName=uri, attributeType="single string", attributeName="content").apply(spark, [])[0]


@query("SELECT 'bytes.bin' AS filename, '00ff10' AS content")
def file_binary(spark, sf_dir):
    out = make("FileScan", fileName=_put(spark, b"\x00\xff\x10", "bytes.bin"), attributeType="binary", attributeName="content", outputFileName=True).apply(spark, [])[0]
    return out.select("filename", F.lower(F.hex("content")).alias("content"))


@query("SELECT n_nationkey::BIGINT AS line FROM nation")
def file_of_zip(spark, sf_dir):
    """Every nation's key in a file of its own within a ZIP."""
    import io

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for r in _nations(spark, sf_dir).select("n_nationkey").collect():  # 25 rows
            z.writestr(f"keys/{r[0]}.txt", f"{r[0]}\n")
    return make("FileScan", fileName=_put(spark, held.getvalue(), "keys.zip"), extract=True, attributeType="long").apply(spark, [])[0]


@query("SELECT r_name AS line FROM region")
def file_utf16(spark, sf_dir):
    names = "\n".join(r[0] for r in table(spark, sf_dir, "region").select("r_name").collect())  # 5 rows
    return make("FileScan", fileName=_put(spark, names.encode("utf-16"), "names.txt"), fileEncoding="UTF_16").apply(spark, [])[0]


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def export_zip(spark, sf_dir):
    """A ZIP of Parquet files, unpacked and read."""
    path, folder = f"{storage.shared_folder(spark)}.zip", storage.shared_folder(spark)
    results.export(table(spark, sf_dir, "nation"), path, "zip")
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    source, at = fs.FileSystem.from_uri(path)
    with source.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        for name in z.namelist():
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(z.read(name))
    return spark.read.parquet(folder)


@query("SELECT n_name AS line FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 7")
def export_value(spark, sf_dir):
    path = results.export(_nations(spark, sf_dir), f"{storage.shared_folder(spark)}.txt", "data", row=7, column=1)
    return make("FileScan", fileName=path).apply(spark, [])[0]


# Databases and services -----------------------------------------------------------------------------------------------


_LOWER = ("n_nationkey", "n_name", "n_regionkey")


def _embedded(spark, sf_dir, kind: str, **properties):
    """A JDBC source over the nations in the database that comes with Spark.

    That database lives in one process, so the driver makes it in memory and backs it up into an archive in the shared
    folder, which every executor may open for reading.
    """
    name, driver = f"m{uuid.uuid4().hex}", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    jvm = spark._jvm
    connect = lambda url: getattr(jvm, driver)().connect(url, jvm.java.util.Properties())
    made = connect(f"jdbc:derby:memory:{name};create=true")
    made.setAutoCommit(False)
    made.createStatement().execute("CREATE TABLE NATION (N_NATIONKEY INTEGER, N_NAME CLOB, N_REGIONKEY INTEGER)")
    put = made.prepareStatement("INSERT INTO NATION VALUES (?, ?, ?)")
    for row in table(spark, sf_dir, "nation").select(*_LOWER).toLocalIterator():
        for place, value in enumerate(row, 1):
            put.setObject(place, value)
        put.executeUpdate()
    made.commit()
    made.setAutoCommit(True)
    with tempfile.TemporaryDirectory(prefix="millrace-") as folder:
        backup = made.prepareStatement("CALL SYSCS_UTIL.SYSCS_BACKUP_DATABASE(?)")
        backup.setString(1, folder)
        backup.execute()
        made.close()
        with contextlib.suppress(Py4JError):  # dropping always ends by an error that says so
            connect(f"jdbc:derby:memory:{name};drop=true")
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for f in sorted(p for p in Path(folder).rglob("*") if p.is_file()):
                z.write(f, str(f.relative_to(folder)))
    _, path = fs.FileSystem.from_uri(_put(spark, data.getvalue(), "database.jar"))
    url = f"jdbc:derby:jar:({path}){name}"
    op = make(kind, host="h", database="d", table="NATION", **properties)
    op.url, op.driver = (lambda: url), driver
    return op


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def jdbc_whole(spark, sf_dir):
    return _embedded(spark, sf_dir, "MySQLSource").apply(spark, [])[0].toDF(*_LOWER)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 3 AND n_nationkey <= 20")
def jdbc_ranges(spark, sf_dir):
    op = _embedded(spark, sf_dir, "PostgreSQLSource", progressive=True, batchByColumn="N_NATIONKEY", min="3", max="20", interval=5)
    return op.apply(spark, [])[0].toDF(*_LOWER)


@query("SELECT v::INTEGER AS step, count(*) AS n FROM nation, (VALUES (1, 9), (2, 19), (3, 24)) s(v, top) WHERE n_nationkey <= top GROUP BY v")
def jdbc_progressive_results(spark, sf_dir):
    """A workflow's result after each range of the source: more and more rows."""
    op = _embedded(spark, sf_dir, "PostgreSQLSource", progressive=True, batchByColumn="N_NATIONKEY", min="0", max="auto", interval=10)
    flow = Workflow()
    flow.add("in", "CSVFileScan", fileName="")
    flow.add("rows", "Aggregate", "in", aggregations=[{"aggFunction": "count", "attribute": "N_NATIONKEY", "result attribute": "n"}])
    steps = [d.select(F.lit(i).alias("step"), F.col("n").cast("long").alias("n")) for i, d in enumerate(streams.progressive(spark, op, flow, "in"), 1)]
    out = steps[0]
    for s in steps[1:]:
        out = out.unionAll(s)
    return out


@query("SELECT n_name AS a, n_nationkey::BIGINT AS b FROM nation WHERE n_nationkey > 4")
def asterixdb(spark, sf_dir):
    """A service that answers as the database would: only what the statement asks for."""
    rows = [{"a": r.n_name, "b": r.n_nationkey} for r in _nations(spark, sf_dir).collect()]  # 25 rows

    def transport(url: str, statement: str) -> list[dict]:
        if "Metadata" in statement:
            return [{"Fields": [{"FieldName": "b", "FieldType": "int64"}, {"FieldName": "a", "FieldType": "string"}]}]
        if statement != "SELECT a, b FROM d.t WHERE 1 = 1 AND (b > 4);":
            raise ValueError(statement)
        return [r for r in rows if r["b"] > 4]

    op = make("AsterixDBSource", host="h", database="d", table="t", filterCondition=True, filterPredicates=[{"attribute": "b", "condition": ">", "value": "4"}], transport=transport)
    return op.apply(spark, [])[0]


def _tweets(rows, size: int = 10):
    """Pages of a service whose tweets are given rows, each by the user of its region."""
    pages = [rows[i : i + size] for i in range(0, len(rows), size)]

    def fetch(url: str, headers: dict) -> dict:
        k = int(url.rpartition("next_token=")[2]) if "next_token=" in url else 0
        data = [{"id": str(r.n_nationkey), "text": r.n_name, "author_id": str(r.n_regionkey), "created_at": "2020-01-02T03:04:05Z", "public_metrics": {"like_count": r.n_nationkey}} for r in pages[k]]
        users = [{"id": str(u), "username": f"user{u}"} for u in sorted({r.n_regionkey for r in pages[k]})]
        return {"data": data, "includes": {"users": users}, "meta": {"next_token": str(k + 1)} if k + 1 < len(pages) else {}}

    return fetch


_TWEETS = "SELECT n_nationkey::VARCHAR AS id, n_name AS text, 'user' || n_regionkey AS user_name, n_nationkey::BIGINT AS like_count FROM nation"


def _search(spark, sf_dir, kind: str, endpoint: str, **properties):
    fetch = _tweets(_nations(spark, sf_dir).collect(), 25)  # 25 rows
    op = make(kind, apiKey="k", apiSecretKey="s", searchQuery="q", client=lambda: apis.twitter_pages(endpoint, {}, {}, False, fetch), **properties)
    return op.apply(spark, [])[0].select("id", "text", "user_name", "like_count")


@query(f"{_TWEETS} ORDER BY n_nationkey LIMIT 12")
def twitter_recent(spark, sf_dir):
    return _search(spark, sf_dir, "TwitterSearch", "recent", limit=12)


@query(_TWEETS)
def twitter_archive(spark, sf_dir):
    return _search(spark, sf_dir, "TwitterFullArchiveSearch", "all", limit=1000, fromDateTime="2020-01-01T00:00:00Z")


@query("SELECT n_nationkey::VARCHAR AS id, n_nationkey::INTEGER AS score, n_name AS author_name FROM nation ORDER BY n_nationkey LIMIT 7")
def reddit(spark, sf_dir):
    rows = _nations(spark, sf_dir).collect()  # 25 rows
    client = lambda: (apis.submission_row({"id": str(r.n_nationkey), "score": r.n_nationkey, "author": r.n_name, "created_utc": 1.0, "edited": False}) for r in rows)
    return make("RedditSearch", clientId="i", clientSecret="s", query="q", limit=7, client=client).apply(spark, [])[0].select("id", "score", "author_name")


@query("""SELECT 'what the address gives' AS "URL content" """)
def url_fetcher(spark, sf_dir):
    uri = _put(spark, b"what the address gives", "page.txt")
    return make("URLFetcher", url=uri if uri.startswith("file://") else f"file://{uri}").apply(spark, [])[0]


# Streams and results ----------------------------------------------------------------------------------------------------


def _streamed(spark, sf_dir, flow: Workflow, mode: str):
    """A workflow over the nations as a stream of four files, and its result."""
    folder, name = storage.shared_folder(spark), f"stream_{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "nation")
    rows.repartition(4).write.parquet(folder)
    flow = streams.with_input(flow, "in", streams.stream(spark, folder, rows.schema, files_per_batch=1))
    if streams.output_mode(flow) != mode:
        raise ValueError(f"the output mode isn't {mode}")
    q = streams.start(spark, flow, name, storage.shared_folder(spark))
    q.awaitTermination()
    return spark.table(name)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey >= 2")
def stream_filter(spark, sf_dir):
    flow = Workflow()
    flow.add("in", "ParquetScan", fileName="")
    flow.add("some", "Filter", "in", predicates=[{"attribute": "n_regionkey", "condition": ">=", "value": "2"}])
    return _streamed(spark, sf_dir, flow, "append")


@query("SELECT n_regionkey, count(*)::INTEGER AS n FROM nation GROUP BY 1")
def stream_aggregate(spark, sf_dir):
    flow = Workflow()
    flow.add("in", "ParquetScan", fileName="")
    flow.add("sum", "Aggregate", "in", groupByKeys=["n_regionkey"], aggregations=[{"aggFunction": "count", "attribute": "n_name", "result attribute": "n"}])
    return _streamed(spark, sf_dir, flow, "complete")


@query("""SELECT false AS "__internal_is_insertion", n_nationkey, n_name FROM nation WHERE n_nationkey < 3
UNION ALL SELECT true, n_nationkey, n_name FROM nation WHERE n_nationkey > 20""")
def result_updates(spark, sf_dir):
    """Rows that go and rows that come between two results."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return streams.updates(rows.where("n_nationkey <= 20"), rows.where("n_nationkey >= 3"))


# Sampling, routing, rows that the first catalog's data don't have -------------------------------------------------------------


@query("SELECT true AS near, 0::BIGINT AS others FROM (SELECT count(*) FROM lineitem)")
def sample_bernoulli(spark, sf_dir):
    """Of the rows a tenth is kept, within five standard deviations, and no row that isn't there."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    kept = run(spark, "RandomKSampling", items, **{"random k sample percentage": 10})
    n = items.count()
    near = F.abs(F.count("*") - F.lit(0.1 * n)) < F.lit(5 * (0.09 * n) ** 0.5)
    return kept.join(items.withColumn("there", F.lit(True)).distinct(), ["l_orderkey", "l_linenumber"], "left").agg(near.alias("near"), F.sum(F.col("there").isNull().cast("long")).alias("others"))


@query("SELECT 'false' AS port, r_regionkey, r_name FROM region")
def if_false_branch(spark, sf_dir):
    state = spark.createDataFrame([(False,)], "big boolean")
    out = make("If", conditionName="big").apply(spark, [[state], [table(spark, sf_dir, "region")]])
    return out[0].select(F.lit("false").alias("port"), "*").unionAll(out[1].select(F.lit("true").alias("port"), "*"))


@query("SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS p FROM events) WHERE v IS NULL OR p IS NULL")
def filter_is_null(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS p")
    return run(spark, "Filter", df, predicates=[{"attribute": "v", "condition": "is null", "value": None}, {"attribute": "p", "condition": "is null", "value": None}]).drop("p")


simple("regex_find_ci", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)^small')", "Regex", ["part(p_partkey, p_type)"], attribute="p_type", regex="^small", caseInsensitive=True)


@query("SELECT n_nationkey, n_name, range, row_number() OVER (PARTITION BY range ORDER BY n_nationkey)::INTEGER AS place FROM (SELECT n_nationkey, n_name, least(greatest(n_nationkey // 6, 0), 3)::INTEGER AS range FROM nation)")
def sort_partitions_order(spark, sf_dir):
    """Each row's range, and its place within, as the rows come."""
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartition(3)
    op = make("SortPartitions", sortAttributeName="n_nationkey", domainMin=0, domainMax=23, partitions=4)
    path = storage.shared_folder(spark)
    op.apply(spark, [[df]])[0].select("*", op.bucket(df, 4).alias("range"), F.monotonically_increasing_id().alias("m")).write.parquet(path)
    rows = spark.read.parquet(path)
    first = rows.groupBy("range").agg(F.min("m").alias("first"))
    return rows.join(first, "range").select("n_nationkey", "n_name", "range", (F.col("m") - F.col("first") + 1).cast("int").alias("place"))


# Charts with a column for each role, and those that the first catalog has no SQL for ---------------------------------------


def _chart(spark, df, kind: str, **properties):
    return make(kind, **properties).prepare(df)


@query("SELECT l_shipdate AS date, l_extendedprice AS open, l_quantity AS high, l_discount AS low, l_tax AS close FROM lineitem")
def viz_candlestick(spark, sf_dir):
    return _chart(spark, table(spark, sf_dir, "lineitem"), "CandlestickChart", date="l_shipdate", open="l_extendedprice", high="l_quantity", low="l_discount", close="l_tax")


@query("SELECT o_orderdate AS begun, o_orderdate + INTERVAL 3 DAY AS done, o_orderkey AS job, o_orderstatus AS kind FROM orders WHERE o_orderkey % 5 <> 0")
def viz_gantt(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr("o_orderdate AS begun", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 3 DAY END AS done", "o_orderkey AS job", "o_orderstatus AS kind")
    return _chart(spark, df, "GanttChart", start="begun", finish="done", task="job", color="kind")


@query("""SELECT c_nationkey AS entity, max(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS start, max(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS "end",
max(c_acctbal) FILTER (WHERE c_mktsegment = 'FURNITURE') AS dot_0 FROM customer GROUP BY 1 HAVING max(c_acctbal) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) IS NOT NULL""")
def viz_dumbbell(spark, sf_dir):
    given = {"categoryColumnName": "c_mktsegment", "dumbbellStartValue": "BUILDING", "dumbbellEndValue": "MACHINERY", "measurementColumnName": "c_acctbal", "comparedColumnName": "c_nationkey", "dots": [{"dotValue": "FURNITURE"}]}
    return _chart(spark, table(spark, sf_dir, "customer"), "DumbbellPlot", **given)


@query("""SELECT '<img src="data:image/png;base64,' || base64(encode(url)) || '" style="max-width:100%">' AS image FROM pages""")
def viz_image(spark, sf_dir):
    return _chart(spark, table(spark, sf_dir, "pages").select(F.col("url").cast("binary").alias("raw")), "ImageVisualizer", binaryContent="raw")


@query("""SELECT '<!DOCTYPE html><html lang="en"><body><div class="modal-body"><iframe src="' || url || '" frameborder="0" style="height:100vh; width:100%; border:none;"></iframe></div></body></html>' AS "html-content" FROM pages""")
def viz_url(spark, sf_dir):
    return run(spark, "URLVisualizer", table(spark, sf_dir, "pages"), urlContentAttrName="url")


_WORD = r"[\p{L}\p{M}\p{Nd}_]"


@query(f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '{_WORD}[\\p{{L}}\\p{{M}}\\p{{Nd}}_'']+')) AS word FROM documents)
SELECT word, count(*) AS count FROM w WHERE NOT list_contains(string_split('{" ".join(sorted(charts.CLOUD_STOP))}', ' '), word) GROUP BY word ORDER BY count DESC, word LIMIT 50""")
def viz_wordcloud_topn(spark, sf_dir):
    return _chart(spark, table(spark, sf_dir, "documents"), "WordCloud", textColumn="text", topN=50)


_HAS = "regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])({w})([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')"


@query(f"""SELECT doc_id, coalesce({_HAS.format(w="worthless|worthlessness")} OR {_HAS.format(w="pathetic|pathetical|pathetically")} AND {_HAS.format(w="thing|things")}
OR {_HAS.format(w="de|des")} AND {_HAS.format(w="la|las")}, false) AS matched FROM documents""")
def dict_conjunction(spark, sf_dir):
    """All words of an entry among those of the text, whatever their endings; SQL names the forms."""
    given = {"Dictionary": "worthless,pathetic things,de la", "Attribute": "text", "result attribute": "matched", "Matching type": "Conjunction"}
    return run(spark, "DictionaryMatcher", table(spark, sf_dir, "documents").select("doc_id", "text"), **given).drop("text")


@query("SELECT 'keyword' AS what, doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{M}\\p{N}_])(of[^\\p{L}\\p{M}\\p{N}_]+the|nothing|th[^ ]ng)([^\\p{L}\\p{M}\\p{N}_]|$)')")
def keyword_syntax(spark, sf_dir):
    """A phrase, a fuzzy term and a wildcard, and a field."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return run(spark, "KeywordSearch", df, attribute="text", keyword='"of the" OR text:nothing OR th?ng').select(F.lit("keyword").alias("what"), "doc_id")


# Step by step --------------------------------------------------------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('in', 0, 25), ('some', 25, 15), ('sum', 15, 3)) s("operatorId", "inputTupleCnt", "outputTupleCnt")""")
def runtime_statistics(spark, sf_dir):
    """Rows in and out of each operator of a workflow that ran step by step, was paused, changed, and went on."""
    flow = Workflow()
    flow.add("in", "ParquetScan", fileName=f"{sf_dir}/nation.parquet")
    flow.add("some", "Filter", "in", predicates=[{"attribute": "n_regionkey", "condition": "=", "value": "9"}])
    flow.add("sum", "Aggregate", "some", groupByKeys=["n_regionkey"], aggregations=[{"aggFunction": "count", "attribute": "n_name", "result attribute": "n"}])
    one = Execution(spark, flow)
    one.step()
    one.step()
    one.pause()
    one.replace("some", "Filter", predicates=[{"attribute": "n_regionkey", "condition": ">=", "value": "2"}])
    two = Execution(spark, flow, one.folder)  # as another process would, with what is done
    two.run()
    last = one.statistics().where("operatorId = 'in'").unionAll(two.statistics()).where(f"status = {COMPLETED}")
    return last.select("operatorId", F.col("inputTupleCnt").cast("int").alias("inputTupleCnt"), F.col("outputTupleCnt").cast("int").alias("outputTupleCnt"))


@query("SELECT n_nationkey, n_name, 'ValueError: too high' AS error FROM nation WHERE n_nationkey > 21")
def udf_failures(spark, sf_dir):
    code = "class Low(RowFunction):\n    def process_tuple(self, tuple_, port):\n        if tuple_['n_nationkey'] > 21:\n            raise ValueError('too high')\n        yield tuple_\n"
    return make("PythonUDFV2", code=code, skipFailing=True).failures(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


_SHAPES = {
    "BarChart": ({"value": "v", "fields": "a"}, "rect", 5), "PieChart": ({"value": "v", "name": "a"}, "circle", 5), "SankeyDiagram": ({"Source Attribute": "a", "Target Attribute": "b", "Value Attribute": "v"}, "path", 5),
    "NetworkGraph": ({"source": "a", "destination": "b"}, "line", 5), "Dendrogram": ({"xVal": "v", "yVal": "v", "Labels": "a"}, "line", 12), "Scatterplot": ({"xColumn": "v", "yColumn": "a"}, "circle", 5),
    "IcicleChart": ({"hierarchy": [{"attributeName": "a"}, {"attributeName": "b"}], "value": "v"}, "rect", 10), "HierarchyChart": ({"hierarchy": [{"attributeName": "a"}, {"attributeName": "b"}], "value": "v"}, "rect", 10),
    "ContourPlot": ({"x": "v", "y": "v", "z": "v", "gridSize": "2"}, "rect", 4), "BoxViolinPlot": ({"value": "v"}, "rect", 1), "TreePlot": ({"Edge List Column": "e"}, "line", 5),
}


@query(f"SELECT * FROM (VALUES {', '.join(f'({k!r}, {n})' for k, (_, _, n) in _SHAPES.items())}) s(kind, shapes)")
def viz_page(spark, sf_dir):
    """Pages over the regions: how many shapes each drawing has."""
    df = table(spark, sf_dir, "region").selectExpr("r_name AS a", "concat('to ', r_name) AS b", "cast(r_regionkey + 1 AS double) AS v", "concat('[\"all\", \"', r_name, '\"]') AS e")
    counts = {k: run(spark, k, df, **given).first()[0].count(f"<{shape} ") for k, (given, shape, _) in _SHAPES.items()}
    return spark.createDataFrame(list(counts.items()), "kind string, shapes int")
