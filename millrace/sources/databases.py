"""Database sources: MySQL and PostgreSQL by JDBC, whole or range by range, and AsterixDB by HTTP."""

from __future__ import annotations

import json
import re
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import types
from millrace.operators.rows import COMPARE
from millrace.registry import Operator, PropertyError, many, operator

_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*)?")


def quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def identifier(name: str) -> str:
    """A table or column name that needs no quotes; any other is refused."""
    if not _PLAIN.fullmatch(name or ""):
        raise PropertyError(f"{name!r} can't be the name of a table or column")
    return name


def moment(millis: int) -> str:
    return datetime.fromtimestamp(millis / 1000, UTC).strftime("%Y-%m-%d %H:%M:%S.%f")


def ranges(low: float, high: float, interval: float) -> Iterator[tuple[float, float, bool]]:
    """Ranges [from, to) of the given width from low up; the last one ends with high and holds it."""
    if interval <= 0:
        raise PropertyError("interval must be positive")
    at = low
    while at + interval < high:
        yield at, at + interval, False
        at += interval
    yield at, high, True


class _Jdbc(Operator):
    """Reads one table. In progressive mode the rows come range by range of a column: run() reads all ranges, each by
    a task of its own; batches() yields them one by one."""

    driver = ""
    default_port = 0

    def url(self) -> str:
        raise NotImplementedError

    def keyword_condition(self) -> str:
        raise NotImplementedError

    def query(self) -> str:
        where = ["1 = 1"]
        if self.keywordSearch and self.keywordSearchByColumn and self.keywords:
            where.append(self.keyword_condition())
        return f"SELECT * FROM {identifier(self.table)} WHERE {' AND '.join(where)}"

    def whole(self) -> str:
        q = self.query()
        if self.limit is not None:
            q += f" LIMIT {int(self.limit)}"
        if self.offset:
            q += f" OFFSET {int(self.offset)}"
        return q

    def reader(self, spark: SparkSession):
        r = spark.read.format("jdbc").option("url", self.url()).option("driver", self.driver)
        for k, v in (("user", self.username), ("password", self.password)):
            if v:
                r = r.option(k, v)
        return r

    def conditions(self, spark: SparkSession) -> list[str]:
        """Of each range the condition that its rows meet."""
        c = identifier(self.batchByColumn)
        r = self.reader(spark)
        found = r.option("query", f"SELECT MIN({c}) AS lo, MAX({c}) AS hi FROM ({self.query()}) t").load()
        kind = types.name_of(found.schema[0].dataType)
        if kind not in ("integer", "long", "double", "timestamp"):
            raise PropertyError(f"{c} can't be read range by range: it is {kind}")
        both = [F.unix_millis(F.col(f"`{x}`").cast("timestamp")) if kind == "timestamp" else F.col(f"`{x}`") for x in found.columns]
        row = found.select(*both).first()

        def bound(given: str | None, own):
            if given in (None, "", "auto"):
                return own
            if kind == "timestamp":
                parsed = spark.range(1).select(F.unix_millis(types.parse_timestamp(F.lit(given)))).first()[0]
                return int(given) if parsed is None else parsed
            return float(given) if kind == "double" else int(given)

        low, high = bound(self.min, row[0]), bound(self.max, row[1])
        if low is None or high is None:
            return []
        text = (lambda v: f"TIMESTAMP {quoted(moment(v))}") if kind == "timestamp" else str
        return [f"{c} >= {text(a)} AND {c} {'<=' if closed else '<'} {text(b)}" for a, b, closed in ranges(low, high, self.interval)]

    def run(self, spark):
        if not self.progressive:
            return self._renamed(self.reader(spark).option("query", self.whole()).load())
        parts = list(self.batches(spark))
        if not parts:
            return self._renamed(self.reader(spark).option("query", f"{self.query()} AND 1 = 0").load())
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        if self.offset:
            out = out.offset(int(self.offset))
        return out if self.limit is None else out.limit(int(self.limit))

    def batches(self, spark: SparkSession) -> Iterator[DataFrame]:
        """One DataFrame per range, in order; nothing is read before it runs."""
        for condition in self.conditions(spark):
            yield self._renamed(self.reader(spark).option("query", f"{self.query()} AND {condition}").load())

    def _renamed(self, df: DataFrame) -> DataFrame:
        """Columns of the eight types: decimals as doubles, dates as timestamps."""
        to = {T.DecimalType: "double", T.FloatType: "double", T.DateType: "timestamp", T.TimestampNTZType: "timestamp", T.ShortType: "int", T.ByteType: "int"}
        return df.select(*(F.col(f"`{f.name}`").cast(to[type(f.dataType)]).alias(f.name) if type(f.dataType) in to else F.col(f"`{f.name}`") for f in df.schema))


@operator("MySQLSource", "Database")
class MySQLSource(_Jdbc):
    """A MySQL table; keywords by full-text search in boolean mode."""

    inputs = 0
    host: str
    database: str
    table: str
    username: str = ""
    password: str = ""
    port: str = "default"
    limit: int | None = None
    offset: int | None = None
    keywordSearch: bool = False
    keywordSearchByColumn: str = ""
    keywords: str = ""
    progressive: bool = False
    batchByColumn: str = ""
    min: str = "auto"
    max: str = "auto"
    interval: int = 1_000_000_000

    driver = "com.mysql.cj.jdbc.Driver"

    def url(self) -> str:
        return f"jdbc:mysql://{self.host}:{3306 if self.port == 'default' else int(self.port)}/{self.database}?autoReconnect=true&useSSL=true"

    def keyword_condition(self) -> str:
        return f"MATCH({identifier(self.keywordSearchByColumn)}) AGAINST ({quoted(self.keywords)} IN BOOLEAN MODE)"


@operator("PostgreSQLSource", "Database")
class PostgreSQLSource(_Jdbc):
    """A PostgreSQL table; keywords by a text search query."""

    inputs = 0
    host: str
    database: str
    table: str
    username: str = ""
    password: str = ""
    port: str = "default"
    limit: int | None = None
    offset: int | None = None
    keywordSearch: bool = False
    keywordSearchByColumn: str = ""
    keywords: str = ""
    progressive: bool = False
    batchByColumn: str = ""
    min: str = "auto"
    max: str = "auto"
    interval: int = 1_000_000_000

    driver = "org.postgresql.Driver"

    def url(self) -> str:
        return f"jdbc:postgresql://{self.host}:{5432 if self.port == 'default' else int(self.port)}/{self.database}"

    def keyword_condition(self) -> str:
        return f"{identifier(self.keywordSearchByColumn)} @@ to_tsquery({quoted(self.keywords)})"


def post_query(url: str, statement: str) -> list[dict]:
    """Results of a statement from a query service."""
    data = urllib.parse.urlencode({"statement": statement}).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data=data), timeout=600) as r:  # noqa: S310
        return json.loads(r.read())["results"]


_ASTERIX = {"int8": "integer", "int16": "integer", "int32": "integer", "int64": "long", "float": "double", "double": "double", "boolean": "boolean", "datetime": "timestamp", "date": "timestamp", "time": "timestamp", "string": "string"}


@operator("AsterixDBSource", "Database")
class AsterixDBSource(Operator):
    """An AsterixDB dataset by SQL++: keyword, regular expression, geographic and general conditions, all of which hold.

    Columns are in order of name. `transport` sends a statement; tests replace it.
    """

    inputs = 0
    host: str
    database: str
    table: str
    port: str = "default"
    limit: int | None = None
    offset: int | None = None
    keywordSearch: bool = False
    keywordSearchByColumn: str = ""
    keywords: str = ""
    regexSearch: bool = False
    regexSearchByColumn: str = ""
    regex: str = ""
    geoSearch: bool = False
    geoSearchByColumns: list = many()
    geoSearchBoundingBox: list = many()
    filterCondition: bool = False
    filterPredicates: list = many()
    transport: Callable[[str, str], list[dict]] = post_query

    def url(self) -> str:
        return f"http://{self.host}:{19002 if self.port == 'default' else int(self.port)}/query/service"

    def dataset(self) -> str:
        return f"{identifier(self.database)}.{identifier(self.table)}"

    def conditions(self) -> list[str]:
        out = []
        if self.keywordSearch and self.keywordSearchByColumn and self.keywords:
            words = ", ".join(quoted(w.strip()) for w in self.keywords.split(",") if w.strip())
            out.append(f"ftcontains({identifier(self.keywordSearchByColumn)}, [{words}], {{'mode': 'all'}})")
        if self.regexSearch and self.regexSearchByColumn and self.regex:
            out.append(f"regexp_contains({identifier(self.regexSearchByColumn)}, {quoted(self.regex)})")
        if self.geoSearch and self.geoSearchByColumns and self.geoSearchBoundingBox:
            points = [tuple(map(float, str(p).replace(" ", "").split(","))) for p in self.geoSearchBoundingBox]
            text = " ".join(f"{x},{y}" for x, y in points)
            shape = f"create_rectangle(point({quoted(text.split()[0])}), point({quoted(text.split()[1])}))" if len(points) == 2 else f"polygon({quoted(text)})"
            out.append("(" + " OR ".join(f"spatial_intersect({identifier(c)}, {shape})" for c in self.geoSearchByColumns) + ")")
        if self.filterCondition and self.filterPredicates:
            tests = []
            for p in self.filterPredicates:
                how = p["condition"]
                if how in ("is null", "is not null"):
                    tests.append(f"{identifier(p['attribute'])} {how.upper()}")
                elif how in COMPARE:
                    value = str(p.get("value") or "")
                    tests.append(f"{identifier(p['attribute'])} {how} {value if types._is_double(value) else quoted(value)}")
                else:
                    raise PropertyError(f"AsterixDBSource: no condition {how!r}")
            out.append("(" + " OR ".join(tests) + ")")
        return out

    def statement(self, columns: list[str]) -> str:
        q = f"SELECT {', '.join(columns)} FROM {self.dataset()} WHERE {' AND '.join(['1 = 1', *self.conditions()])}"
        if self.limit is not None:
            q += f" LIMIT {int(self.limit)}"
        if self.offset:
            q += f" OFFSET {int(self.offset)}"
        return q + ";"

    def columns(self) -> list[tuple[str, str]]:
        meta = self.transport(self.url(), f"SELECT dt.Derived.Record.Fields FROM Metadata.`Dataset` ds, Metadata.`Datatype` dt WHERE ds.DatasetName = {quoted(self.table)} AND dt.DatatypeName = ds.DatatypeName AND ds.DataverseName = {quoted(self.database)};")
        return sorted((f["FieldName"], _ASTERIX.get(f["FieldType"], "string")) for f in meta[0]["Fields"])

    def run(self, spark):
        columns = self.columns()
        rows = self.transport(self.url(), self.statement([identifier(n) for n, _ in columns]))
        schema = T.StructType([T.StructField(n, T.StringType()) for n, _ in columns])
        texts = [[None if r.get(n) is None else v if isinstance(v := r[n], str) else json.dumps(v) for n, _ in columns] for r in rows]
        df = spark.createDataFrame(texts, schema)
        return df.select(*(types.parse(F.col(f"`{n}`"), k).alias(n) for n, k in columns))
