"""Workflows over streams: the same operators, on streaming DataFrames, with the output mode that their kind asks for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.plans.workflow import Workflow
from millrace.registry import Operator, PropertyError

#: Operators that make their rows anew as input grows; their whole result is the output.
SNAPSHOT = {"Aggregate", "DotPlot", "BarChart", "SankeyDiagram"}
#: Operators that need all input before the first row; they run within each micro-batch only.
BLOCKING = {"Sort", "ReservoirSampling", "SymmetricDifference", "Difference", "Intersect", "Limit", "PythonTableReducer"}


class StreamInput(Operator):
    """A source that stands for a streaming (or any) DataFrame given in Python."""

    inputs = 0

    def __init__(self, df: DataFrame):
        self.df = df

    def run(self, spark):
        return self.df


def stream(spark: SparkSession, folder: str, schema, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Files that appear in a folder, as a stream."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)


def with_input(flow: Workflow, name: str, df: DataFrame) -> Workflow:
    """The workflow with a source replaced by a DataFrame."""
    if name not in flow.operators:
        raise PropertyError(f"no operator {name}")
    return Workflow({n: StreamInput(df) if n == name else o for n, o in flow.operators.items()}, flow.links, flow.view)


def output_mode(flow: Workflow) -> str:
    """`complete` where a result is made anew, else `append`."""
    kinds = {o.name for o in flow.operators.values()}
    if found := sorted(kinds & BLOCKING):
        raise PropertyError(f"{', '.join(found)} need all of their input: run the workflow by run_batches")
    return "complete" if kinds & SNAPSHOT else "append"


def start(spark: SparkSession, flow: Workflow, name: str, checkpoint: str | None = None, sink: str = "memory", path: str | None = None) -> StreamingQuery:
    """Starts a workflow whose sources are streams. With a checkpoint it goes on where it stopped; stop() pauses it."""
    df = flow.result(spark)
    if not df.isStreaming:
        raise PropertyError("the workflow reads no stream")
    writer = df.writeStream.queryName(name).outputMode(output_mode(flow)).format(sink).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start(path) if path else writer.start()


def run_batches(spark: SparkSession, source: DataFrame, flow: Workflow, name: str, take: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Runs a workflow over every micro-batch of a stream by itself; take gets each batch's result and number."""

    def one(batch: DataFrame, number: int) -> None:
        take(with_input(flow, name, batch).result(spark), number)

    writer = source.writeStream.foreachBatch(one).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def progressive(spark: SparkSession, source: Operator, flow: Workflow, name: str) -> Iterator[DataFrame]:
    """Results of a workflow after each range of a database source, over all ranges so far."""
    read: DataFrame | None = None
    for part in source.batches(spark):
        read = part if read is None else read.unionAll(part)
        yield with_input(flow, name, read).result(spark)


def updates(before: DataFrame | None, now: DataFrame) -> DataFrame:
    """What changes between two snapshots: rows with a flag, false for those that go and true for those that come."""
    from millrace.results import with_insertion_flag

    if before is None:
        return with_insertion_flag(now)
    return with_insertion_flag(before.exceptAll(now), False).unionAll(with_insertion_flag(now.exceptAll(before)))
