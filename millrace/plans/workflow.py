"""A workflow: a graph of operators, given as JSON or built in Python, folded into DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.functions import storage
from millrace.registry import Operator, PropertyError, make

#: Keys of an operator's JSON that aren't properties.
_OWN = {"operatorID", "operatorType", "operatorVersion", "inputPorts", "outputPorts", "showAdvanced", "isDisabled", "customDisplayName"}


@dataclass(frozen=True)
class Link:
    source: str
    source_port: int
    target: str
    target_port: int


@dataclass
class Workflow:
    """Operators by id and the links between their ports."""

    operators: dict[str, Operator] = field(default_factory=dict)
    links: list[Link] = field(default_factory=list)
    view: list[str] = field(default_factory=list)

    @classmethod
    def from_json(cls, document: str | dict[str, Any]) -> Workflow:
        d = json.loads(document) if isinstance(document, str) else document
        flow = cls(view=list(d.get("opsToViewResult") or []))
        for o in d["operators"]:
            if o["operatorID"] in flow.operators:
                raise PropertyError(f"operator {o['operatorID']} stands more than once")
            flow.operators[o["operatorID"]] = make(o["operatorType"], **{k: v for k, v in o.items() if k not in _OWN})
        for k in d.get("links") or []:
            flow.links.append(Link(k["fromOpId"], _port(k.get("fromPortId")), k["toOpId"], _port(k.get("toPortId"))))
        return flow

    def add(self, name: str, kind: str, /, *inputs: str | tuple[str, int], **properties: Any) -> str:
        """Adds an operator whose input ports are linked to others, in order; returns its id."""
        if name in self.operators:
            raise PropertyError(f"operator {name} stands more than once")
        self.operators[name] = make(kind, **properties)
        for port, source in enumerate(inputs):
            self.link(source, (name, port))
        return name

    def link(self, source: str | tuple[str, int], target: str | tuple[str, int]) -> None:
        s, t = ((x, 0) if isinstance(x, str) else x for x in (source, target))
        self.links.append(Link(*s, *t))

    def order(self) -> list[str]:
        """Ids, every operator behind those it reads."""
        for k in self.links:
            for name in (k.source, k.target):
                if name not in self.operators:
                    raise PropertyError(f"a link names {name}, which is no operator")
        waiting = {n: {k.source for k in self.links if k.target == n} for n in self.operators}
        done: list[str] = []
        while waiting:
            ready = [n for n, needs in waiting.items() if needs <= set(done)]
            if not ready:
                raise PropertyError(f"the links make a circle of {', '.join(sorted(waiting))}")
            done += ready
            for n in ready:
                del waiting[n]
        return done

    def _inputs(self, name: str, found: dict[str, list[DataFrame]]) -> list[list[DataFrame]]:
        ports: list[list[DataFrame]] = [[] for _ in range(self.operators[name].inputs)]
        for k in self.links:
            if k.target == name:
                if k.target_port >= len(ports):
                    raise PropertyError(f"{name} has no input port {k.target_port}")
                if k.source_port >= len(found[k.source]):
                    raise PropertyError(f"{k.source} has no output port {k.source_port}")
                ports[k.target_port].append(found[k.source][k.source_port])
        return ports

    def build(self, spark: SparkSession) -> dict[str, list[DataFrame]]:
        """Of each operator a DataFrame per output port. Nothing runs but what an operator needs to plan.

        What several operators read of an unstable operator is written to the shared folder, so that they see the same
        rows, also when an executor is lost.
        """
        found: dict[str, list[DataFrame]] = {}
        for name in self.order():
            op = self.operators[name]
            out = op.apply(spark, self._inputs(name, found))
            if op.unstable and len(out) == 1 and sum(k.source == name for k in self.links) > 1:
                out = [out[0] if out[0].isStreaming else storage.kept(out[0])]
            found[name] = out
        return found

    def compile(self, spark: SparkSession) -> tuple[dict[str, list[T.StructType]], dict[str, str]]:
        """Output schemas of each operator, and what is wrong with those that have none; behind one of these nothing is told."""
        found: dict[str, list[DataFrame]] = {}
        errors: dict[str, str] = {}
        for name in self.order():
            if any(k.target == name and k.source not in found for k in self.links):
                continue
            try:
                found[name] = self.operators[name].apply(spark, self._inputs(name, found))
            except (PropertyError, PySparkException, ValueError, KeyError, RuntimeError, OSError) as e:
                errors[name] = str(e)
        return {n: [d.schema for d in out] for n, out in found.items()}, errors

    def sinks(self) -> list[str]:
        """Operators whose results are looked at: those asked for, else those that nothing reads."""
        return self.view or [n for n in self.operators if all(k.source != n for k in self.links)]

    def run(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The first output of each operator that is looked at."""
        found = self.build(spark)
        return {n: found[n][0] for n in self.sinks()}

    def result(self, spark: SparkSession) -> DataFrame:
        """The result of a workflow with a single sink."""
        out = self.run(spark)
        if len(out) != 1:
            raise PropertyError(f"the workflow has {len(out)} results")
        return next(iter(out.values()))


def _port(value: Any) -> int:
    if value is None:
        return 0
    return int(value["id"] if isinstance(value, dict) else value)
