"""Operators by name: properties in, DataFrames in and out."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REGISTRY: dict[str, type[Operator]] = {}


class PropertyError(ValueError):
    """An operator's properties don't fit each other or its input."""


def wire(name: str, default: Any = dataclasses.MISSING, **more: Any) -> Any:
    """A property whose JSON name differs from the field's."""
    if isinstance(default, list):
        return dataclasses.field(default_factory=lambda: list(default), metadata={"wire": name}, **more)
    return dataclasses.field(default=default, metadata={"wire": name}, **more)


def many() -> Any:
    return dataclasses.field(default_factory=list)


@dataclass
class Operator:
    """Base of all operators. Subclasses are dataclasses of their properties and say how many input ports they have.

    run() gets the session and one DataFrame per input port, and returns one DataFrame, or a list with one per
    output port. An input port with several links gets their union.
    """

    name: ClassVar[str] = ""
    group: ClassVar[str] = ""
    inputs: ClassVar[int] = 1
    outputs: ClassVar[int] = 1
    #: Two runs over one input may differ: what several consumers read must be kept.
    unstable: ClassVar[bool] = False

    @classmethod
    def from_json(cls, properties: dict[str, Any]) -> Operator:
        known = {f.metadata.get("wire", f.name): f for f in dataclasses.fields(cls)}
        given = {known[k].name: v for k, v in properties.items() if k in known and v is not None}
        missing = [w for w, f in known.items() if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING and f.name not in given]
        if missing:
            raise PropertyError(f"{cls.name}: missing {', '.join(missing)}")
        return cls(**given)

    def apply(self, spark: SparkSession, ports: list[list[DataFrame]]) -> list[DataFrame]:
        if len(ports) < self.inputs or any(not p for p in ports[: self.inputs]):
            raise PropertyError(f"{self.name}: every one of its {self.inputs} input ports needs a link")
        joined = []
        for links in ports[: self.inputs]:
            for other in links[1:]:
                check_same_schema(links[0], other)
            df = links[0]
            for other in links[1:]:
                df = df.union(other)
            check_names(df.columns)
            joined.append(df)
        out = self.run(spark, *joined)
        return out if isinstance(out, list) else [out]

    def run(self, spark: SparkSession, *inputs: DataFrame) -> DataFrame | list[DataFrame]:
        raise NotImplementedError


def operator(name: str, group: str = ""):
    """Registers a dataclass under its JSON name."""

    def add(cls: type[Operator]) -> type[Operator]:
        cls = dataclass(cls)
        cls.name, cls.group = name, group
        if name in REGISTRY:
            raise ValueError(f"{name} is registered already")
        REGISTRY[name] = cls
        return cls

    return add


def load_all() -> dict[str, type[Operator]]:
    """The registry with every module's operators in it."""
    import millrace.ml.classifiers  # noqa: F401
    import millrace.ml.inference  # noqa: F401
    import millrace.ml.scorer  # noqa: F401
    import millrace.operators.aggregates  # noqa: F401
    import millrace.operators.control  # noqa: F401
    import millrace.operators.joins  # noqa: F401
    import millrace.operators.rows  # noqa: F401
    import millrace.operators.sets  # noqa: F401
    import millrace.operators.text  # noqa: F401
    import millrace.operators.udf  # noqa: F401
    import millrace.sources.apis  # noqa: F401
    import millrace.sources.databases  # noqa: F401
    import millrace.sources.files  # noqa: F401
    import millrace.viz.charts  # noqa: F401

    return REGISTRY


def make(name: str, /, **properties: Any) -> Operator:
    """An operator by its JSON name and JSON property names."""
    found = load_all().get(name)
    if found is None:
        raise PropertyError(f"no operator {name!r}")
    return found.from_json(properties)


def describe_operators() -> list[dict[str, Any]]:
    """Name, group, ports and properties of every operator."""
    return [
        {"operatorType": n, "group": c.group, "inputPorts": c.inputs, "outputPorts": c.outputs, "properties": {f.metadata.get("wire", f.name): str(f.type) for f in dataclasses.fields(c)}}
        for n, c in sorted(load_all().items())
    ]


def check_names(columns: list[str]) -> None:
    """Column names must differ, whatever their case."""
    low = [c.lower() for c in columns]
    if twice := sorted({c for c in low if low.count(c) > 1}):
        raise PropertyError(f"columns that stand more than once: {', '.join(twice)}")


def check_same_schema(a: DataFrame, b: DataFrame) -> None:
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        raise PropertyError(f"schemas differ: {a.schema.simpleString()} and {b.schema.simpleString()}")


def field_of(df: DataFrame, name: str) -> T.StructField:
    """The column of a name, in any case; fails if there is none."""
    for f in df.schema:
        if f.name.lower() == (name or "").lower():
            return f
    raise PropertyError(f"no column {name!r} among {', '.join(df.columns)}")


def col(df: DataFrame, name: str):
    """Column by name, also where the name holds dots or signs."""
    return df["`" + field_of(df, name).name.replace("`", "``") + "`"]


def new_name(df: DataFrame, name: str) -> str:
    """A name for a column to be added: not blank and not taken."""
    if not (name or "").strip():
        raise PropertyError("the result's name is blank")
    if name.lower() in (c.lower() for c in df.columns):
        raise PropertyError(f"there is a column {name!r} already")
    return name
