"""File sources: CSV, JSON lines, text and binary files, literal text, Arrow files, Parquet."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.functions import storage, types
from millrace.registry import Operator, PropertyError, check_names, operator

#: Rows from which column types are inferred.
SAMPLE_ROWS = 100
ENCODINGS = {"UTF_8": "UTF-8", "UTF_16": "UTF-16", "US_ASCII": "US-ASCII"}


def encoding(name: str) -> str:
    if name not in ENCODINGS:
        raise PropertyError(f"no encoding {name!r}")
    return ENCODINGS[name]


def sliced(df: DataFrame, offset: int | None, limit: int | None) -> DataFrame:
    if offset:
        df = df.offset(max(int(offset), 0))
    return df if limit is None else df.limit(max(int(limit), 0))


def typed(df: DataFrame, kinds: list[str], names: list[str] | None = None) -> DataFrame:
    """A DataFrame of texts with its columns parsed; rows with a text that doesn't parse are dropped."""
    names = names or df.columns
    parsed = [types.parse(F.col(f"`{c}`"), k).alias(n) for c, k, n in zip(df.columns, kinds, names, strict=True)]
    good = F.lit(True)
    for c, k in zip(df.columns, kinds, strict=True):
        if k not in ("string", "binary"):
            good &= F.col(f"`{c}`").isNull() | types.parse(F.col(f"`{c}`"), k).isNotNull()
    return df.where(good).select(*parsed)


def _csv_texts(spark: SparkSession, path: str, separator: str, header: bool, charset: str, multi_line: bool) -> DataFrame:
    reader = spark.read.option("sep", separator).option("encoding", charset).option("multiLine", multi_line).option("escape", '"').option("header", header)
    reader = reader.option("mode", "PERMISSIVE").option("inferSchema", False).option("comment", "").option("nullValue", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    df = reader.csv(path)
    return df if header else df.toDF(*(f"column-{i + 1}" for i in range(len(df.columns))))


@operator("CSVFileScan", "Data input")
class CSVFileScan(Operator):
    """A CSV file with types inferred from its first rows; a quoted value may hold line ends. Rows that don't fit are
    dropped, then come offset and limit."""

    inputs = 0
    multi_line = True
    fileName: str
    fileEncoding: str = "UTF_8"
    customDelimiter: str = ","
    hasHeader: bool = True
    limit: int | None = None
    offset: int | None = None

    def run(self, spark):
        df = _csv_texts(spark, self.fileName, self.customDelimiter or ",", self.hasHeader, encoding(self.fileEncoding), self.multi_line)
        check_names(df.columns)
        return sliced(typed(df, types.infer_columns(self.sample(df), len(df.columns))), self.offset, self.limit)

    def sample(self, df: DataFrame) -> list:
        return df.limit(SAMPLE_ROWS).collect()


@operator("CSVOldFileScan", "Data input")
class CSVOldFileScan(CSVFileScan):
    """Like CSVFileScan, but types are inferred from the rows behind the offset."""

    def sample(self, df: DataFrame) -> list:
        return sliced(df, self.offset, SAMPLE_ROWS).collect()


@operator("ParallelCSVFileScan", "Data input")
class ParallelCSVFileScan(CSVFileScan):
    """A CSV file without line ends in values, read in splits by many tasks; rows of nulls only are dropped."""

    multi_line = False

    def run(self, spark):
        df = _csv_texts(spark, self.fileName, self.customDelimiter or ",", self.hasHeader, encoding(self.fileEncoding), False)
        check_names(df.columns)
        some = F.coalesce(*(F.col(f"`{c}`") for c in df.columns)).isNotNull()
        return typed(df.where(some), types.infer_columns(self.sample(df), len(df.columns)))


def flat(value: dict, deep: bool, prefix: str = "") -> dict[str, str | None]:
    """Fields of a JSON object as texts; flattened, objects give `a.b` and arrays `a1`, `a2`."""
    out: dict[str, str | None] = {}

    def put(name: str, v: object) -> None:
        if isinstance(v, dict):
            if deep:
                for k, x in v.items():
                    put(f"{name}.{k}" if name else k, x)
        elif isinstance(v, list):
            if deep:
                for i, x in enumerate(v, 1):
                    put(f"{name}{i}", x)
        else:
            out[name] = None if v is None else ("true" if v else "false") if isinstance(v, bool) else v if isinstance(v, str) else json.dumps(v)

    for k, v in value.items():
        put(k, v)
    return out


@operator("JSONLFileScan", "Data input")
class JSONLFileScan(Operator):
    """One JSON object a line: scalar fields, or all of them flattened, as columns in order of name, with inferred types.

    Fields that none of the first rows has are no columns. A JSON null is null. Rows that don't fit are dropped.
    """

    inputs = 0
    fileName: str
    fileEncoding: str = "UTF_8"
    flatten: bool = False
    limit: int | None = None
    offset: int | None = None

    def run(self, spark):
        deep = self.flatten
        lines = spark.read.text(self.fileName) if self.fileEncoding == "UTF_8" else _decoded_lines(spark, self.fileName, encoding(self.fileEncoding))
        lines = lines.where(F.trim("value") != "")
        sample = [flat(json.loads(r[0]), deep) for r in sliced(lines, self.offset, SAMPLE_ROWS).collect()]
        names = sorted({k for r in sample for k in r})
        check_names(names)
        if not names:
            raise PropertyError("JSONLFileScan: no fields in the first rows")
        kinds = types.infer_columns(([r.get(n) for n in names] for r in sample), len(names))
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for line in b["value"]:
                    try:
                        row = flat(json.loads(line), deep)
                    except (ValueError, AttributeError):
                        continue
                    rows.append([row.get(n) for n in names])
                yield pd.DataFrame(rows, columns=schema.names, dtype=object)

        return typed(sliced(lines.mapInPandas(run, schema), self.offset, self.limit), kinds, names)


def _decoded_lines(spark: SparkSession, path: str, charset: str) -> DataFrame:
    whole = spark.read.format("binaryFile").load(path).select(F.decode("content", charset).alias("t"))
    return whole.select(F.explode(F.split("t", "\r?\n")).alias("value"))


KINDS = {"string": "string", "single string": "string", "integer": "integer", "long": "long", "double": "double", "boolean": "boolean", "timestamp": "timestamp", "binary": "binary"}


def attribute_kind(name: str) -> str:
    if name not in KINDS:
        raise PropertyError(f"no attribute type {name!r}")
    return KINDS[name]


def as_attribute(text: Column, kind: str) -> Column:
    """A line as a value of the type; one that doesn't parse fails."""
    if kind == "string":
        return text
    parsed = types.parse(text, kind)
    return F.when(text.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit(f"no {kind}: "), text)).cast(types.SPARK[kind])).otherwise(parsed)


@operator("FileScan", "Data input")
class FileScan(Operator):
    """Any file: its lines as one typed column, or all of it as one text or as bytes; files of a ZIP one by one."""

    inputs = 0
    fileName: str
    fileEncoding: str = "UTF_8"
    attributeType: str = "string"
    attributeName: str = "line"
    extract: bool = False
    outputFileName: bool = False
    fileScanLimit: int | None = None
    fileScanOffset: int | None = None

    def run(self, spark):
        kind, charset = attribute_kind(self.attributeType), encoding(self.fileEncoding)
        whole = self.attributeType in ("single string", "binary")
        if not self.extract and not whole and charset == "UTF-8":
            raw = spark.read.text(self.fileName).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"))
            return self._named(sliced(raw, self.fileScanOffset, self.fileScanLimit), as_attribute(F.col("content"), kind))
        files = spark.read.format("binaryFile").load(self.fileName).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
        if self.extract:
            files = files.mapInPandas(_unzip, "filename string, content binary")
        if self.attributeType == "binary":
            return self._named(files, F.col("content"))
        text = files.select("filename", F.decode("content", charset).alias("content"))
        if whole:
            return self._named(text, F.col("content"))
        lines = text.select("filename", F.explode(F.split(F.regexp_replace("content", "\r?\n$", ""), "\r?\n")).alias("content"))
        return self._named(sliced(lines, self.fileScanOffset, self.fileScanLimit), as_attribute(F.col("content"), kind))

    def _named(self, df: DataFrame, value: Column) -> DataFrame:
        name = self.attributeName.strip() or "line"
        return df.select(*(["filename"] if self.outputFileName else []), value.alias(name))


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for raw in b["content"]:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for item in z.infolist():
                    if not item.is_dir() and not item.filename.startswith("__MACOSX"):
                        yield pd.DataFrame({"filename": [item.filename], "content": [z.read(item)]})


@operator("TextInput", "Data input")
class TextInput(Operator):
    """A literal text as rows; types as in FileScan."""

    inputs = 0
    textInput: str = ""
    attributeType: str = "string"
    attributeName: str = "line"
    fileScanLimit: int | None = None
    fileScanOffset: int | None = None

    def run(self, spark):
        kind, name = attribute_kind(self.attributeType), self.attributeName.strip() or "line"
        if self.attributeType in ("single string", "binary"):
            rows = [self.textInput]
        else:
            start = max(self.fileScanOffset or 0, 0)
            stop = None if self.fileScanLimit is None else start + max(self.fileScanLimit, 0)
            rows = self.textInput.splitlines()[start:stop]
        df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, content string").coalesce(1)
        return df.select((F.col("content").cast("binary") if kind == "binary" else as_attribute(F.col("content"), kind)).alias(name))


@operator("ParquetScan", "Data input")
class ParquetScan(Operator):
    """A Parquet file or folder; filters and projections behind it reach the scan."""

    inputs = 0
    fileName: str
    limit: int | None = None
    offset: int | None = None

    def run(self, spark):
        return sliced(spark.read.parquet(self.fileName), self.offset, self.limit)


class _ArrowBatch(InputPartition):
    def __init__(self, index: int):
        self.index = index


def _opened(path: str):
    files, place = storage.filesystem(path)
    return files.open_input_file(place)


class ArrowFileReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        with _opened(self.path) as f:
            return [_ArrowBatch(i) for i in range(pa.ipc.open_file(f).num_record_batches)] or [_ArrowBatch(-1)]

    def read(self, partition):
        if partition.index >= 0:
            with _opened(self.path) as f:
                yield pa.ipc.open_file(f).get_batch(partition.index)


class ArrowFile(DataSource):
    """An Arrow IPC file, one partition per record batch; the path must be readable on every executor."""

    @classmethod
    def name(cls) -> str:
        return "millrace_arrow"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        with _opened(self.options["path"]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema):
        return ArrowFileReader(self.options["path"])


@operator("ArrowSource", "Data input")
class ArrowSource(Operator):
    """An Arrow IPC file; columns and types are the file's."""

    inputs = 0
    fileName: str
    limit: int | None = None
    offset: int | None = None

    def run(self, spark):
        spark.dataSource.register(ArrowFile)
        return sliced(spark.read.format("millrace_arrow").load(self.fileName), self.offset, self.limit)


@operator("CacheSource", "Data input")
class CacheSource(Operator):
    """A result that was written before (see results.Results)."""

    inputs = 0
    storageUri: str

    def run(self, spark):
        return spark.read.parquet(self.storageUri)
