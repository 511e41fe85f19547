"""A workflow run operator by operator: pausing, changing operators, retries, going on after a loss, and statistics.

Workflow.run() leaves all to Catalyst in one plan. An Execution instead writes what each operator puts out to a folder
that outlives it, so that a user can stop between two operators, look at what is there, change what is to come, and go
on; in this or in a new process. That costs a write and a read of every result.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.functions import storage
from millrace.plans.workflow import Workflow
from millrace.registry import Operator, PropertyError, make

# The columns of the statistics, and the numbers of states in them.
STATISTICS = (
    "operatorId string, time timestamp, inputTupleCnt long, inputTupleSize long, outputTupleCnt long, outputTupleSize long, "
    "dataProcessingTime long, controlProcessingTime long, idleTime long, numWorkers int, status int"
)
READY, RUNNING, PAUSED, COMPLETED, FAILED, KILLED = range(6)


@dataclass
class Stored:
    """An output port's rows in the folder: path, rows, bytes, files, and the schema as JSON."""

    path: str
    rows: int
    size: int
    files: int
    schema: str


class Execution:
    """One run of a workflow in a folder (without one: in a folder that goes with the process). step() runs the next operator, run() all that are left, start() in the background.

    `state` are values beside the data: an operator that has a method take_state gets those of the operators before it,
    and what its method give_state returns goes on to those behind it. For instance If reads its condition there if
    port 0 has none.
    """

    def __init__(self, spark: SparkSession, flow: Workflow, folder: str | None = None):
        self.spark, self.flow = spark, flow
        self.folder = folder or storage.shared_folder(spark)
        self.stored: dict[str, list[Stored]] = {}
        self.states: dict[str, dict[str, Any]] = {}
        self.events: list[tuple] = []
        self.status = READY
        self.failed: tuple[str, str] | None = None
        self._pause, self._kill, self._thread = threading.Event(), threading.Event(), None
        self._group = f"millrace-{uuid.uuid4().hex}"
        self._made = time.time_ns()
        self._read_manifest()

    # What is there -----------------------------------------------------------------------------------------------

    def output(self, name: str, port: int = 0) -> DataFrame:
        """What an operator has put out."""
        s = self.stored[name][port]
        return self.spark.read.schema(T.StructType.fromJson(json.loads(s.schema))).parquet(s.path)

    def results(self) -> dict[str, DataFrame]:
        return {n: self.output(n) for n in self.flow.sinks() if n in self.stored}

    def statistics(self) -> DataFrame:
        """A row per change of an operator's state: rows and bytes in and out, nanoseconds of planning, of work and between."""
        return self.spark.createDataFrame(self.events, STATISTICS)

    def left(self) -> list[str]:
        return [n for n in self.flow.order() if n not in self.stored]

    # Running -------------------------------------------------------------------------------------------------------

    def step(self) -> str | None:
        """Runs the next operator and returns its id; None if none is left. A failure leaves all before it as it is."""
        name = next(iter(self.left()), None)
        if name is None:
            self.status = COMPLETED
            return None
        self.status, self.failed = RUNNING, None
        begun = time.time_ns()
        before = [(k.source, self.stored[k.source][k.source_port]) for k in self.flow.links if k.target == name]
        rows, size = sum(s.rows for _, s in before), sum(s.size for _, s in before)
        self._told(name, RUNNING, rows, size)
        context = self.spark.sparkContext
        context.setJobGroup(self._group, f"operator {name}", interruptOnCancel=True)
        try:
            found = {s: [self.output(s, p) for p in range(len(self.stored[s]))] for s, _ in before}
            op = self.flow.operators[name]
            state = {k: v for s, _ in before for k, v in self.states.get(s, {}).items()}
            if state and hasattr(op, "take_state"):
                op.take_state(state)
            out = op.apply(self.spark, self.flow._inputs(name, found))
            planned = time.time_ns()
            stored = [self._write(df, f"{self.folder}/{name}/{port}-{uuid.uuid4().hex}") for port, df in enumerate(out)]
        except Exception as e:
            self.status, self.failed = (KILLED if self._kill.is_set() else FAILED), (name, str(e))
            self._told(name, self.status, rows, size, work=time.time_ns() - begun)
            raise
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        self.stored[name] = stored
        self.states[name] = state | (op.give_state() if hasattr(op, "give_state") else {})
        idle = begun - self._made if not self.events else 0
        self._told(name, COMPLETED, rows, size, stored, work=time.time_ns() - planned, control=planned - begun, idle=idle)
        self._write_manifest()
        if not self.left():
            self.status = COMPLETED
        return name

    def run(self) -> dict[str, DataFrame]:
        """Runs what is left, until it is paused or killed; the results as far as they are there."""
        while not self._pause.is_set() and not self._kill.is_set() and self.step() is not None:
            pass
        if self.left():
            self.status = KILLED if self._kill.is_set() else PAUSED
        return self.results()

    def start(self) -> None:
        """run() in the background."""

        def work() -> None:
            try:
                self.run()
            except Exception:  # noqa: BLE001  status and `failed` tell it
                pass

        self._thread = threading.Thread(target=work, daemon=True)
        self._thread.start()

    def wait(self, seconds: float | None = None) -> int:
        """Waits for the background, and returns the status."""
        if self._thread is not None:
            self._thread.join(seconds)
        return self.status

    def pause(self) -> None:
        """The operator that runs is the last one until resume()."""
        self._pause.set()

    def resume(self) -> None:
        """Goes on in the background; also after a failure, with what has been replaced or skipped meanwhile."""
        self.wait()
        self._pause.clear()
        self._kill.clear()
        self.start()

    def kill(self) -> None:
        """Cancels the running jobs; what is written stays."""
        self._kill.set()
        self.spark.sparkContext.cancelJobGroup(self._group)

    # Changes between two steps -----------------------------------------------------------------------------------------

    def replace(self, name: str, kind: str, /, **properties: Any) -> None:
        """Another operator in an operator's place. What it and those behind it have put out is dropped, all else stays."""
        if name not in self.flow.operators:
            raise PropertyError(f"no operator {name}")
        self.flow.operators[name] = make(kind, **properties)
        self.forget(name)

    def forget(self, name: str) -> None:
        """Drops what an operator and those behind it have put out, so that they run again."""
        gone = {name}
        for n in self.flow.order():
            if any(k.target == n and k.source in gone for k in self.flow.links):
                gone.add(n)
        for n in gone & set(self.stored):
            for s in self.stored.pop(n):
                files, path = storage.filesystem(s.path)
                files.delete_dir(path)
            self.states.pop(n, None)
        self._write_manifest()

    def skip(self, name: str) -> None:
        """An operator that failed hands on what came to its first port."""
        self.flow.operators[name] = _Through(self.flow.operators[name].inputs)

    # The folder -------------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, path: str) -> Stored:
        df.write.parquet(path)
        files, place = storage.filesystem(path)
        parts = [f for f in files.get_file_info(fs.FileSelector(place)) if f.path.endswith(".parquet")]
        return Stored(path, self.spark.read.schema(df.schema).parquet(path).count(), sum(f.size for f in parts), len(parts), df.schema.json())

    def _write_manifest(self) -> None:
        """Of the operators that are done, their places; written aside and then moved, so that it is whole at any time."""
        files, root = storage.filesystem(self.folder)
        files.create_dir(root, recursive=True)
        data = {"stored": {n: [vars(s) for s in out] for n, out in self.stored.items()}, "states": self.states}
        with files.open_output_stream(f"{root}/manifest.new") as f:
            f.write(json.dumps(data).encode())
        files.move(f"{root}/manifest.new", f"{root}/manifest.json")

    def _read_manifest(self) -> None:
        files, root = storage.filesystem(self.folder)
        if files.get_file_info(f"{root}/manifest.json").type != fs.FileType.File:
            return
        with files.open_input_stream(f"{root}/manifest.json") as f:
            data = json.loads(f.read())
        self.stored = {n: [Stored(**s) for s in out] for n, out in data["stored"].items() if n in self.flow.operators}
        self.states = {n: s for n, s in data["states"].items() if n in self.stored}

    def _told(self, name: str, status: int, rows: int, size: int, stored: list[Stored] = (), work: int = 0, control: int = 0, idle: int = 0) -> None:
        self.events.append((name, datetime.now(UTC), rows, size, sum(s.rows for s in stored), sum(s.size for s in stored), work, control, idle, max((s.files for s in stored), default=0), status))


class _Through(Operator):
    """Hands on its first port."""

    def __init__(self, inputs: int):
        self.inputs = inputs

    def run(self, spark, *inputs):
        return inputs[0]
