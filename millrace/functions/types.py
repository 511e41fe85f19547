"""The eight attribute types: mapping to Spark, inference from text, parsing and casting as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARK: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "binary": T.BinaryType(),
}

# The date shapes that are understood, as (shape of the text, pattern). Month comes before day
# where both are numbers, unless the first is over 12. Zones are dropped by the session's time zone, UTC.
_D = r"\d{1,2}"
_TIME = r"\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?"
_MONTH = r"[A-Za-z]{3}"
_ZONE = r"\s?(Z|UTC|GMT|[+-]\d{2}:?\d{2})"
DATES: tuple[tuple[str, str], ...] = (
    (rf"\d{{4}}-{_D}-{_D}([T ]{_TIME}({_ZONE})?)?", ""),
    (rf"\d{{4}}/{_D}/{_D}( {_TIME})?", "y/M/d[ H:m[:s]]"),
    (rf"(0?[1-9]|1[0-2])/{_D}/\d{{4}}( {_TIME})?", "M/d/y[ H:m[:s]]"),
    (rf"(1[3-9]|2\d|3[01])/{_D}/\d{{4}}( {_TIME})?", "d/M/y[ H:m[:s]]"),
    (rf"(0?[1-9]|1[0-2])/{_D}/\d{{2}}( {_TIME})?", "M/d/yy[ H:m[:s]]"),
    (rf"(0?[1-9]|1[0-2])/{_D}/\d{{2}} {_D}:{_D} [AP]M(, [A-Z]{{3,4}})?", "M/d/yy h:m a"),
    (rf"{_D}-{_MONTH}-\d{{4}}( {_TIME})?", "d-MMM-y[ H:m[:s]]"),
    (rf"{_D} {_MONTH} \d{{4}}( {_TIME}( GMT| UTC)?)?", "d MMM y[ H:m[:s]]"),
    (rf"[A-Za-z]+, {_D}-{_MONTH}-\d{{2}} {_TIME} (GMT|UTC)", "d-MMM-yy H:m:s"),
    (rf"[A-Za-z]{{3}}, {_D} {_MONTH} \d{{4}} {_TIME} (GMT|UTC)", "d MMM y H:m:s"),
    (r"\d{4}年\d{1,2}月\d{1,2}日( \d{1,2}:\d{1,2}(:\d{1,2})?)?", "y年M月d日[ H:m[:s]]"),
)
_SHAPES = [re.compile(shape) for shape, _ in DATES]


def name_of(kind: T.DataType) -> str:
    """Attribute type of a Spark type; what has no counterpart passes as `any`."""
    if isinstance(kind, T.TimestampNTZType | T.DateType):
        return "timestamp"
    if isinstance(kind, T.DecimalType | T.FloatType):
        return "double"
    if isinstance(kind, T.ByteType | T.ShortType):
        return "integer"
    return next((n for n, t in SPARK.items() if t == kind), "any")


def spark_type(name: str) -> T.DataType:
    name = name.lower()
    if name not in SPARK:
        raise ValueError(f"no attribute type {name!r}")
    return SPARK[name]


def _is_integer(s: str, bits: int) -> bool:
    return bool(re.fullmatch(r"[+-]?\d+", s)) and -(1 << bits) <= int(s) < 1 << bits


def _is_double(s: str) -> bool:
    return bool(re.fullmatch(r"[+-]?(NaN|Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?)", s))


#: What each type accepts, in the order in which a column widens.
_ACCEPTS = (
    ("integer", lambda s: _is_integer(s, 31)),
    ("long", lambda s: _is_integer(s, 63)),
    ("timestamp", lambda s: any(p.fullmatch(s) for p in _SHAPES)),
    ("double", _is_double),
    ("boolean", lambda s: s.lower() in ("true", "false") or _is_integer(s, 31)),
    ("string", lambda s: True),
)
_ORDER = [n for n, _ in _ACCEPTS]


def infer(value: str | None, so_far: str = "integer") -> str:
    """The narrowest type, not narrower than so_far, that accepts a text; null keeps the type."""
    if value is None:
        return so_far
    s = value.strip()
    return next(n for n, ok in _ACCEPTS[_ORDER.index(so_far) :] if ok(s))


def infer_columns(rows: Iterable[Iterable[str | None]], width: int) -> list[str]:
    """Types of columns from rows of texts; a column of nulls only stays integer."""
    kinds = ["integer"] * width
    for row in rows:
        for i, v in enumerate(row):
            kinds[i] = infer(v, kinds[i])
    return kinds


def parse_timestamp(text: Column) -> Column:
    """A text as timestamp, null where no shape fits. Years of two digits are from 1970 to 2069."""
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    s = F.regexp_replace(whole, r"^[A-Za-z]+, ", "")  # a weekday
    cut = F.regexp_replace(F.regexp_replace(s, r"(, [A-Z]{3,4}| GMT| UTC)$", ""), "Z$", "+00:00")
    # The first shape is Spark's own.
    iso = F.when(cut.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d.*)?$"), cut.try_cast("timestamp"))
    tries = []
    for shape, pattern in DATES[1:]:
        t = F.try_to_timestamp(cut, F.lit(pattern))
        if "yy" in pattern:
            t = F.when(F.year(t) >= 2070, t - F.make_interval(F.lit(100))).otherwise(t)
        tries.append(F.when(whole.rlike(f"^({shape})$"), t))
    return F.coalesce(iso, *tries)


def parse(text: Column, kind: str) -> Column:
    """A text column as a scan reads it: null where the text doesn't parse."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    if kind == "string":
        return text
    if kind == "binary":
        return text.cast("binary")
    if kind == "timestamp":
        return parse_timestamp(text)
    if kind == "boolean":
        return F.when(F.lower(s) == "true", True).when(F.lower(s) == "false", False).otherwise(s.try_cast("int") == 1)
    if kind in ("integer", "long"):
        return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast(SPARK[kind]))
    return s.try_cast(SPARK[kind])


def timestamp_text(c: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss.f` with as many fraction digits as needed, one at least."""
    return F.regexp_replace(F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"(\.\d)(\d*?)0*$", "$1$2")


def _number_prefix(text: Column) -> Column:
    """The number that a text starts with, commas dropped; fails if there is none."""
    found = F.regexp_replace(F.regexp_extract(F.trim(text), r"^(-?[\d,]*\.?\d*)", 1), ",", "")
    return F.when(text.isNull(), None).otherwise(found.cast("double"))


def cast(c: Column, source: T.DataType, target: str) -> Column:
    """Cast by the rules of the TypeCasting operator: what can't be cast fails, null stays null."""
    kind = name_of(source)
    target = target.lower()
    if target in ("any", kind) and not isinstance(source, T.TimestampNTZType | T.DateType | T.DecimalType | T.FloatType | T.ByteType | T.ShortType):
        return c
    if kind == "timestamp":
        c = c.cast("timestamp")
    if target == "binary":
        return c.cast("binary") if kind == "string" else c
    illegal = F.raise_error(F.lit(f"can't cast {kind} to {target}")).cast(spark_type(target))
    if target == "string":
        return timestamp_text(c) if kind == "timestamp" else c.cast("string")
    if target in ("integer", "long"):
        if kind == "string":
            return _truncated(_number_prefix(c), target)
        if kind == "timestamp":
            return F.unix_millis(c) if target == "long" else F.when(c.isNotNull(), illegal)
        if kind == "long" and target == "integer":
            return _wrapped(c)
        return _truncated(c, target) if kind == "double" else c.cast(SPARK[target])
    if target == "double":
        return F.when(c.isNotNull(), illegal) if kind == "timestamp" else F.trim(c).cast("double") if kind == "string" else c.cast("double")
    if target == "boolean":
        if kind == "timestamp":
            return F.when(c.isNotNull(), illegal)
        if kind == "string":
            s = F.lower(F.trim(c))
            return F.when(s == "true", True).when(s == "false", False).otherwise(s.cast("int") == 1)
        return c != 0
    if target == "timestamp":
        if kind == "timestamp":
            return c
        if kind == "long":
            return F.timestamp_millis(c)
        if kind == "string":
            return F.when(c.isNotNull(), F.coalesce(parse_timestamp(c), F.raise_error(F.concat(F.lit("no timestamp: "), c)).cast("timestamp")))
        return F.when(c.isNotNull(), illegal)
    raise ValueError(f"no attribute type {target!r}")


def _truncated(c: Column, target: str) -> Column:
    """Toward zero, at most the type's bounds; NaN is 0."""
    low, high = (-(1 << 31), (1 << 31) - 1) if target == "integer" else (-(1 << 63), (1 << 63) - 1)
    whole = F.when(F.isnan(c), F.lit(0.0)).otherwise(c)
    return F.when(whole <= float(low), F.lit(low)).when(whole >= float(high), F.lit(high)).otherwise(whole.try_cast("long")).cast(SPARK[target])


def _wrapped(c: Column) -> Column:
    """The low 32 bits of a long."""
    low = F.pmod(c, F.lit(1 << 32))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")
