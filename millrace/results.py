"""What is done with results: written tables with pages and statistics, previews, exports."""

from __future__ import annotations

import base64
import shutil
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import storage, types

PAGE = 5
TEXT_SHOWN = 100
INSERTED = "__internal_is_insertion"


def with_insertion_flag(df: DataFrame, inserted: bool = True) -> DataFrame:
    """df with a first column that says whether a row is inserted or retracted."""
    return df.select(F.lit(inserted).alias(INSERTED), "*")


@dataclass
class Results:
    """A result written as Parquet, with rows numbered in partition order."""

    spark: SparkSession
    path: str

    @classmethod
    def write(cls, df: DataFrame, path: str) -> Results:
        df.withColumn("__row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
        return cls(df.sparkSession, path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def get(self) -> DataFrame:
        return self.rows().drop("__row")

    def count(self) -> int:
        return self.rows().count()

    def between(self, start: int, stop: int) -> DataFrame:
        """Rows start to stop (without it) in written order; the offset is found by a top-k, not a full sort."""
        return self.rows().orderBy("__row").limit(max(stop, 0)).offset(max(start, 0)).drop("__row")

    def after(self, offset: int) -> DataFrame:
        return self.rows().orderBy("__row").offset(max(offset, 0)).drop("__row")

    def page(self, number: int, size: int = PAGE) -> DataFrame:
        """Page `number`, counted from 1."""
        return self.between((number - 1) * size, number * size)


def column_statistics(df: DataFrame) -> DataFrame:
    """column, not_null_count, min, max (numbers as text of doubles, timestamps as days) of each column, in one pass."""
    parts = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), types.name_of(f.dataType)
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        low = high = F.lit(None).cast("string")
        if kind in ("integer", "long", "double"):
            low, high = (x(c).cast("double").cast("string") for x in (F.min, F.max))
        elif kind == "timestamp":
            low, high = (F.date_format(x(c).cast("timestamp"), "yyyy-MM-dd") for x in (F.min, F.max))
        parts.append(F.struct(F.lit(f.name).alias("column"), F.count(c).alias("not_null_count"), low.alias("min"), high.alias("max")))
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def preview(df: DataFrame, full_text: bool = False) -> DataFrame:
    """Every column as a short text: nulls as NULL, long texts cut, bytes as hexadecimal digits with their length."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            text = F.concat(F.lit("bytes'"), F.lower(F.hex(F.substring(c, 1, 20))), F.lit("' (length: "), F.length(c).cast("string"), F.lit(")"))
        elif types.name_of(f.dataType) == "timestamp":
            text = types.timestamp_text(c)
        else:
            text = c.cast("string")
            if isinstance(f.dataType, T.StringType) and not full_text:
                text = F.when(F.length(c) > TEXT_SHOWN, F.concat(F.substring(c, 1, TEXT_SHOWN), F.lit("..."))).otherwise(c)
        out.append(F.coalesce(text, F.lit("NULL")).alias(f.name))
    return df.select(*out)


def export(df: DataFrame, path: str, kind: str = "csv", row: int = 0, column: int = 0) -> str:
    """Writes a result and returns the path, a folder or file of this machine or a URI: csv and parquet folders (any
    size), zip of Parquet, arrow, html or data (one value) files. One file is put together on the driver, from parts
    that executors have written or serialized."""
    if kind == "csv":
        shown = df.select(*(F.base64(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`") for f in df.schema))
        shown.write.mode("overwrite").option("header", True).csv(path)
        return path
    if kind == "parquet":
        df.write.mode("overwrite").parquet(path)
        return path
    files, place = storage.filesystem(path)
    if kind == "zip":
        folder = f"{path}.parts"
        df.write.mode("overwrite").parquet(folder)
        found = [f for f in files.get_file_info(fs.FileSelector(f"{place}.parts")) if f.path.endswith(".parquet")]
        with files.open_output_stream(place) as out, zipfile.ZipFile(out, "w") as z:
            for f in sorted(found, key=lambda f: f.path):
                with files.open_input_stream(f.path) as part, z.open(f.base_name, "w", force_zip64=True) as to:
                    shutil.copyfileobj(part, to, 1 << 20)
        files.delete_dir(f"{place}.parts")
    elif kind == "arrow":
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(df.schema)
        with files.open_output_stream(place) as f, pa.ipc.new_file(f, schema) as out:
            for r in df.mapInArrow(_serialized, "part binary").toLocalIterator():
                for part in pa.ipc.open_stream(r[0]):
                    out.write_batch(pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(part.columns, schema.types, strict=True)], schema=schema))
    elif kind in ("html", "data"):
        at = 0 if kind == "html" else row
        value = df.offset(at).first()
        cell = None if value is None else value[0 if kind == "html" else column]
        with files.open_output_stream(place) as f:
            f.write(bytes(cell) if isinstance(cell, bytes | bytearray) else str("" if cell is None else cell).encode())
    else:
        raise ValueError(f"no kind of export {kind!r}")
    return path


def _serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as the bytes of an Arrow stream of its own."""
    for b in batches:
        held = pa.BufferOutputStream()
        with pa.ipc.new_stream(held, b.schema) as out:
            out.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([held.getvalue().to_pybytes()], pa.binary())], ["part"])


def data_url(raw: bytes, kind: str) -> str:
    return f"data:{kind};base64,{base64.b64encode(raw).decode()}"
