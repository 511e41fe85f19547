"""User functions in Python (rows, batches, tables, sources, two inputs), row expressions, Java and R."""

from __future__ import annotations

import io
import pickle
import re
import shutil
import subprocess
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import types
from millrace.registry import Operator, PropertyError, check_names, field_of, many, operator

#: Most rows that a table function gets at once; more are an error, as the whole table lies in one worker.
TABLE_ROWS = 5_000_000


class UserFunction:
    """Base of user classes; they override what they need of it. Results may be dicts, sequences, Series, DataFrames, lists of these, or None."""

    BATCH_SIZE = 1000

    def open(self) -> None: ...
    def close(self) -> None: ...
    def on_finish(self, port: int) -> Iterator[Any]:
        return iter(())


class RowFunction(UserFunction):
    def process_tuple(self, tuple_: dict, port: int) -> Iterator[Any]:
        raise NotImplementedError


class BatchFunction(UserFunction):
    def process_batch(self, batch: pd.DataFrame, port: int) -> Iterator[Any]:
        raise NotImplementedError


class TableFunction(UserFunction):
    def process_table(self, table: pd.DataFrame, port: int) -> Iterator[Any]:
        raise NotImplementedError


class SourceFunction(UserFunction):
    def produce(self) -> Iterator[Any]:
        raise NotImplementedError


_NAMES = {
    "UDFOperatorV2": RowFunction, "UDFTableOperator": TableFunction, "UDFBatchOperator": BatchFunction, "UDFSourceOperator": SourceFunction,
    "RowFunction": RowFunction, "TableFunction": TableFunction, "BatchFunction": BatchFunction, "SourceFunction": SourceFunction,
    "pd": pd, "Iterator": Iterator, "Any": Any, "Tuple": dict, "TupleLike": Any, "Table": pd.DataFrame, "TableLike": Any, "Batch": pd.DataFrame, "BatchLike": Any, "overrides": lambda f: f,
}


def load(code: str) -> UserFunction:
    """An instance of the user class that a text defines: the last one. Lines that import all of a module (the runtime) are dropped."""
    from typing import Optional, Union

    space: dict[str, Any] = dict(_NAMES) | {"Optional": Optional, "Union": Union}
    lines = [ln for ln in code.splitlines() if not re.fullmatch(r"from \w+ import \*", ln.strip())]
    exec(compile("\n".join(lines), "<user function>", "exec"), space)  # noqa: S102  running user code is this operator's purpose
    own = [v for k, v in space.items() if isinstance(v, type) and issubclass(v, UserFunction) and v not in _NAMES.values() and v is not UserFunction]
    if not own:
        raise PropertyError("the code defines no class for rows, batches, tables or a source")
    return own[-1]()


def rows_of(value: Any, names: list[str]) -> Iterator[dict]:
    """Rows that a user function's result stands for."""
    if value is None:
        return
    if isinstance(value, pd.DataFrame):
        yield from value.to_dict("records")
    elif isinstance(value, pd.Series):
        yield value.to_dict()
    elif isinstance(value, dict):
        yield value
    elif isinstance(value, list) and all(v is None or isinstance(v, dict | pd.Series | pd.DataFrame | tuple) for v in value):
        for v in value:
            yield from rows_of(v, names)
    else:
        yield dict(zip(names, value, strict=True))


def fit_value(value: Any, kind: T.DataType) -> Any:
    """A value for a column: NaN and missing become null, any object in a binary column is pickled."""
    if isinstance(kind, T.BinaryType):
        return value if value is None or isinstance(value, bytes) else pickle.dumps(value)
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value and not isinstance(kind, T.DoubleType)):
        return None
    if isinstance(kind, T.DoubleType):
        value = float(value)
        return None if value != value else value
    if isinstance(kind, T.IntegerType | T.LongType):
        return int(value)
    if isinstance(kind, T.StringType):
        return str(value)
    if isinstance(kind, T.BooleanType):
        return bool(value)
    return value


def _frame(rows: list[dict], schema: T.StructType) -> pd.DataFrame:
    data = {f.name: pd.Series([fit_value(r.get(f.name), f.dataType) for r in rows], dtype=object) for f in schema}
    return pd.DataFrame(data, columns=schema.names)


def _packed(results: Iterator[Any], schema: T.StructType, size: int = 1000) -> Iterator[pd.DataFrame]:
    held: list[dict] = []
    for value in results:
        held.extend(rows_of(value, schema.names))
        if len(held) >= size:
            yield _frame(held, schema)
            held = []
    if held:
        yield _frame(held, schema)


def plain(frame: pd.DataFrame) -> list[dict]:
    """Rows as dicts, with None for null."""
    columns = [c.astype(object).where(c.notna(), None).tolist() if c.hasnans else c.astype(object).tolist() for _, c in frame.items()]
    names = frame.columns.tolist()
    return [dict(zip(names, row, strict=True)) for row in zip(*columns, strict=True)] if names else [{} for _ in range(len(frame))]


def _process(code: str, port: int, batches: Iterator[pd.DataFrame], first: list[pd.DataFrame] | None = None, skip: bool = False) -> Iterator[Any]:
    f = load(code)
    f.open()
    if first is not None:
        yield from _feed(f, iter(first), port - 1, skip)
        yield from f.on_finish(port - 1) or ()
    yield from _feed(f, batches, port, skip)
    yield from f.on_finish(port) or ()
    f.close()


def _failures(code: str, batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """Rows at which a row function fails, with the error; what it gives for others is dropped."""
    f = load(code)
    f.open()
    for b in batches:
        for row in plain(b):
            own = dict(row)
            try:
                for _ in f.process_tuple(row, 0) or ():
                    pass
            except Exception as e:  # noqa: BLE001  any error of a user's function
                yield own | {"error": f"{type(e).__name__}: {e}"}
    f.close()


def _feed(f: UserFunction, batches: Iterator[pd.DataFrame], port: int, skip: bool) -> Iterator[Any]:
    if isinstance(f, TableFunction):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size > TABLE_ROWS:
                raise PropertyError(f"a table function gets at most {TABLE_ROWS} rows")
        if held:
            yield from f.process_table(pd.concat(held, ignore_index=True), port) or ()
    elif isinstance(f, BatchFunction):
        if not isinstance(f.BATCH_SIZE, int) or f.BATCH_SIZE <= 0:
            raise PropertyError("BATCH_SIZE must be a positive whole number")
        rest = None
        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            while len(rest) >= f.BATCH_SIZE:
                yield from f.process_batch(rest.iloc[: f.BATCH_SIZE].reset_index(drop=True), port) or ()
                rest = rest.iloc[f.BATCH_SIZE :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from f.process_batch(rest, port) or ()
    else:
        for b in batches:
            for row in plain(b):
                try:
                    yield from f.process_tuple(row, port) or ()
                except Exception:
                    if not skip:
                        raise


def declared(columns: list[dict]) -> list[T.StructField]:
    return [T.StructField(c["attributeName"], types.spark_type(c["attributeType"]), True) for c in columns or []]


def result_schema(df: DataFrame | None, retain: bool, columns: list[dict]) -> T.StructType:
    fields = [T.StructField(f.name, f.dataType, True) for f in df.schema] if df is not None and retain else []
    out = T.StructType(fields + declared(columns))
    check_names(out.names)
    return out


@operator("PythonUDFV2", "User-defined Functions")
class PythonUDFV2(Operator):
    """A user class over the rows, batches or table of each worker; one worker sees all rows, several share them.

    With skipFailing, rows at which a row function fails are left out; failures() tells which they are and why.
    """

    unstable = True
    code: str
    workers: int = 1
    retainInputColumns: bool = True
    outputColumns: list = many()
    skipFailing: bool = False

    def run(self, spark, df):
        schema, code, skip = result_schema(df, self.retainInputColumns, self.outputColumns), self.code, self.skipFailing
        load(code)  # fails here rather than in a worker
        dealt = df.coalesce(1) if self.workers <= 1 else df.repartition(self.workers)
        return dealt.mapInPandas(lambda batches: _packed(_process(code, 0, batches, skip=skip), schema), schema)

    def failures(self, df: DataFrame) -> DataFrame:
        """The rows at which the row function fails, and a column error."""
        if not isinstance(load(self.code), RowFunction):
            raise PropertyError("only a function of rows can fail at one row")
        schema, code = result_schema(df, True, [{"attributeName": "error", "attributeType": "string"}]), self.code
        return df.mapInPandas(lambda batches: _packed(_failures(code, batches), schema), schema)


@operator("DualInputPortsPythonUDFV2", "User-defined Functions")
class DualInputPortsPythonUDFV2(Operator):
    """A user class that gets all rows of port 0 (a model or build table, which every worker holds) before those of port 1."""

    inputs = 2
    unstable = True
    code: str
    workers: int = 1
    retainInputColumns: bool = True
    outputColumns: list = many()
    #: Rows that port 0 may have.
    modelRows: int = 1_000_000

    def run(self, spark, model, df):
        schema, code = result_schema(df, self.retainInputColumns, self.outputColumns), self.code
        load(code)
        first = model.limit(self.modelRows + 1).toPandas()
        if len(first) > self.modelRows:
            raise PropertyError(f"port 0 may have at most {self.modelRows} rows")
        held = spark.sparkContext.broadcast(first)
        dealt = df.coalesce(1) if self.workers <= 1 else df.repartition(self.workers)
        return dealt.mapInPandas(lambda batches: _packed(_process(code, 1, batches, [held.value]), schema), schema)


@operator("PythonUDFSourceV2", "User-defined Functions")
class PythonUDFSourceV2(Operator):
    """Rows that a user class produces, in one worker."""

    inputs = 0
    unstable = True
    code: str
    workers: int = 1
    columns: list = many()

    def run(self, spark):
        schema, code = T.StructType(declared(self.columns)), self.code
        check_names(schema.names)
        load(code)

        def make(batches):
            for _ in batches:
                f = load(code)
                f.open()
                yield from _packed(iter(f.produce()), schema)
                f.close()

        return spark.range(1, numPartitions=1).mapInPandas(make, schema)


def _evaluated(steps: list[tuple[str, str, T.DataType]], batches: Iterator[pd.DataFrame], schema: T.StructType) -> Iterator[pd.DataFrame]:
    """Batches with the values of expressions over each row; the expressions are compiled once a task."""
    ready = [(name, eval(f"lambda tuple_: ({code}\n)", {"pd": pd}), kind) for name, code, kind in steps]  # noqa: S307  user expressions are this operator's purpose
    for b in batches:
        rows = plain(b)
        for row in rows:
            for name, f, kind in ready:
                row[name] = fit_value(f(row), kind)
        yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in schema.names}, columns=schema.names)


@operator("PythonLambdaFunction", "User-defined Functions")
class PythonLambdaFunction(Operator):
    """Python expressions over each row (`tuple_`), one after the other: each adds a column or replaces one, with its type."""

    lambdaAttributeUnits: list = many()

    def run(self, spark, df):
        fields = {f.name: f.dataType for f in df.schema}
        steps = []
        for u in self.lambdaAttributeUnits:
            added = u.get("attributeName") in (None, "", "Add New Column")
            name = u["newAttributeName"] if added else field_of(df, u["attributeName"]).name
            if added and name.lower() in (c.lower() for c in fields):
                raise PropertyError(f"PythonLambdaFunction: there is a column {name!r} already")
            fields[name] = types.spark_type(u["attributeType"])
            compile(u["expression"], name, "eval")
            steps.append((name, u["expression"], fields[name]))
        schema = T.StructType([T.StructField(n, t, True) for n, t in fields.items()])
        return df.mapInPandas(lambda batches: _evaluated(steps, batches, schema), schema)


@operator("PythonTableReducer", "User-defined Functions")
class PythonTableReducer(Operator):
    """One row of Python expressions over the whole table (`table`, a pandas DataFrame in one worker)."""

    lambdaAttributeUnits: list = many()

    def run(self, spark, df):
        units = [(u["attributeName"], u["expression"], types.spark_type(u["attributeType"])) for u in self.lambdaAttributeUnits]
        schema = T.StructType([T.StructField(n, t, True) for n, _, t in units])
        check_names(schema.names)

        def run(batches):
            held = list(batches)
            if sum(map(len, held)) > TABLE_ROWS:
                raise PropertyError(f"a table function gets at most {TABLE_ROWS} rows")
            if held:
                table = pd.concat(held, ignore_index=True)
                yield _frame([{n: eval(e, {"pd": pd}, {"table": table}) for n, e, _ in units}], schema)  # noqa: S307

        return df.coalesce(1).mapInPandas(run, schema)


@operator("JavaUDF", "User-defined Functions")
class JavaUDF(Operator):
    """A Java function on the class path (org.apache.spark.sql.api.java.UDF*), by class name in `code`; each output
    column is its result for the columns that `arguments` names. Source text isn't compiled here."""

    code: str
    workers: int = 1
    retainInputColumns: bool = True
    outputColumns: list = many()
    arguments: list = many()

    def run(self, spark, df):
        name = f"millrace_{abs(hash(self.code))}"
        schema = result_schema(df, self.retainInputColumns, self.outputColumns)
        fields = declared(self.outputColumns)
        if len(fields) != 1:
            raise PropertyError("JavaUDF: one output column is needed")
        if not self.code.replace(".", "").replace("_", "").replace("$", "").isalnum():
            raise PropertyError("JavaUDF: code must name a class on the class path")
        spark.udf.registerJavaFunction(name, self.code, fields[0].dataType)
        out = df.withColumn(fields[0].name, F.call_function(name, *(F.col(f"`{a}`") for a in self.arguments)))
        return out.select(*(f"`{n}`" for n in schema.names))


_R_ROWS = """
rows <- list()
for (i in seq_len(nrow(table))) {
  got <- f(as.list(table[i, , drop = FALSE]), 0)
  if (!is.null(got)) rows[[length(rows) + 1]] <- as.data.frame(got, check.names = FALSE, stringsAsFactors = FALSE)
}
out <- if (length(rows)) do.call(rbind, rows) else table[0, , drop = FALSE]
"""


def r_program(script: str, reads: bool, by_row: bool) -> str:
    """An R program that reads CSV from standard input (if there is input), calls the function and writes CSV to standard output.

    What the function prints goes to standard error. By row the function gets a list and gives a list, a data frame or NULL.
    """
    body = "table <- read.csv(file('stdin'), check.names = FALSE, stringsAsFactors = FALSE)\n" if reads else ""
    call = _R_ROWS if by_row and reads else f"out <- f({'table, 0' if reads else ''})\n"
    return f"sink(stderr())\n{body}f <- {script}\n{call}sink()\nwrite.csv(as.data.frame(out, check.names = FALSE), stdout(), row.names = FALSE)\n"


def run_r(script: str, frame: pd.DataFrame | None, columns: list[str], by_row: bool = False) -> pd.DataFrame:
    """Runs r_program in a process of its own, over pipes."""
    program = shutil.which("Rscript")
    if program is None:
        raise RuntimeError("R runtime not available")
    given = None if frame is None else frame.to_csv(index=False).encode()
    done = subprocess.run([program, "-e", r_program(script, frame is not None, by_row)], input=given, check=True, capture_output=True)
    return pd.read_csv(io.BytesIO(done.stdout))[columns]


@operator("RUDF", "User-defined Functions")
class RUDF(Operator):
    """An R function of a table (or with useTupleAPI of a row, as a list) and a port number; needs Rscript in the workers.

    One worker sees the whole table; rows may be dealt out to several.
    """

    unstable = True
    code: str
    workers: int = 1
    useTupleAPI: bool = False
    retainInputColumns: bool = True
    outputColumns: list = many()

    def run(self, spark, df):
        schema, code, by_row = result_schema(df, self.retainInputColumns, self.outputColumns), self.code, self.useTupleAPI
        if shutil.which("Rscript") is None:
            raise RuntimeError("R runtime not available")

        def run(batches):
            if by_row:
                for b in batches:
                    yield _frame(plain(run_r(code, b, schema.names, True)), schema)
                return
            held = list(batches)
            if sum(map(len, held)) > TABLE_ROWS:
                raise PropertyError(f"a table function gets at most {TABLE_ROWS} rows")
            if held:
                yield _frame(plain(run_r(code, pd.concat(held, ignore_index=True), schema.names)), schema)

        dealt = df.repartition(self.workers) if by_row and self.workers > 1 else df.coalesce(1)
        return dealt.mapInPandas(run, schema)


@operator("RUDFSource", "User-defined Functions")
class RUDFSource(Operator):
    """Rows that an R function without arguments returns, in one worker; needs Rscript there."""

    inputs = 0
    unstable = True
    code: str
    workers: int = 1
    useTupleAPI: bool = False
    columns: list = many()

    def run(self, spark):
        schema, code = T.StructType(declared(self.columns)), self.code
        if shutil.which("Rscript") is None:
            raise RuntimeError("R runtime not available")

        def run(batches):
            for _ in batches:
                yield _frame(plain(run_r(code, None, schema.names)), schema)

        return spark.range(1, numPartitions=1).mapInPandas(run, schema)
