"""Operators that look at one row at a time: projection, filter, regex, casts, unnesting; distinct, limit and sort."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import types
from millrace.registry import Operator, PropertyError, check_names, col, field_of, many, new_name, operator, wire


@operator("Projection", "Data cleaning")
class Projection(Operator):
    """Keeps columns in the order given, renamed by a non-blank alias, or drops them."""

    attributes: list = many()
    isDrop: bool = False

    def run(self, spark, df):
        if not self.attributes:
            raise PropertyError("Projection: no attributes")
        names = [field_of(df, a["originalAttribute"]).name for a in self.attributes]
        if self.isDrop:
            gone = {n.lower() for n in names}
            return df.select(*(col(df, c) for c in df.columns if c.lower() not in gone))
        aliases = [(a.get("alias") or "").strip() or n for a, n in zip(self.attributes, names, strict=True)]
        check_names(aliases)
        return df.select(*(col(df, n).alias(a) for n, a in zip(names, aliases, strict=True)))


def _is_number(s: str) -> bool:
    return types._is_double(s.strip())


COMPARE = {
    "=": lambda a, b: a == b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "!=": lambda a, b: a != b,
}


def predicate(df: DataFrame, attribute: str, condition: str, value: str | None) -> Column:
    """One condition of Filter. A null fails every comparison.

    Strings compare as numbers where both sides are numbers, else as text; integers and doubles as doubles;
    longs with a whole number; booleans as lower-case text; timestamps by the millisecond.
    """
    c, kind = col(df, attribute), types.name_of(field_of(df, attribute).dataType)
    if condition == "is null":
        return c.isNull()
    if condition == "is not null":
        return c.isNotNull()
    if condition not in COMPARE:
        raise PropertyError(f"Filter: no condition {condition!r}")
    value = "" if value is None else str(value)
    test = COMPARE[condition]
    if kind == "string":
        plain = test(c, F.lit(value))
        if not _is_number(value):
            return F.coalesce(plain, F.lit(False))
        number = F.trim(c).try_cast("double")
        return F.coalesce(F.when(number.isNotNull(), test(number, F.lit(float(value.strip().rstrip("fFdD"))))).otherwise(plain), F.lit(False))
    if kind in ("integer", "double"):
        number = float(value.strip())
        # A whole literal is compared in the column's own type: the scan can then skip row groups by it.
        same = F.lit(int(number)) if kind == "integer" and number.is_integer() and abs(number) < 1 << 31 else F.lit(number)
        return F.coalesce(test(c, same), F.lit(False))
    if kind == "long":
        return F.coalesce(test(c, F.lit(int(value.strip())).cast("long")), F.lit(False))
    if kind == "boolean":
        return F.coalesce(test(c.cast("string"), F.lit(value.strip().lower())), F.lit(False))
    if kind == "timestamp":
        moment = F.date_trunc("millisecond", types.parse_timestamp(F.lit(value)))
        return F.coalesce(test(F.date_trunc("millisecond", c.cast("timestamp")), moment), F.lit(False))
    raise PropertyError(f"Filter: {attribute} can't be compared")


@operator("Filter", "Data cleaning")
class Filter(Operator):
    """Rows for which one of the predicates holds; none without predicates."""

    predicates: list = many()

    def run(self, spark, df):
        tests = [predicate(df, p["attribute"], p["condition"], p.get("value")) for p in self.predicates]
        return df.where(reduce(or_, tests, F.lit(False)) if tests else F.lit(False))


@operator("Regex", "Search")
class Regex(Operator):
    """Rows whose text has a match of a Java regular expression somewhere; nulls have none."""

    attribute: str
    regex: str
    caseInsensitive: bool = False

    def run(self, spark, df):
        return df.where(col(df, self.attribute).cast("string").rlike(("(?i)" if self.caseInsensitive else "") + self.regex))


@operator("TypeCasting", "Data cleaning")
class TypeCasting(Operator):
    """Casts columns in place; see types.cast."""

    typeCastingUnits: list = many()

    def run(self, spark, df):
        to = {field_of(df, u["attribute"]).name: u["resultType"] for u in self.typeCastingUnits}
        return df.select(*(types.cast(col(df, f.name), f.dataType, to[f.name]).alias(f.name) if f.name in to else col(df, f.name) for f in df.schema))


@operator("UnnestString", "Data cleaning")
class UnnestString(Operator):
    """One row for each non-empty piece between matches of a delimiter (a regular expression); nulls give no row."""

    delimiter: str = wire("Delimiter", ",")
    attribute: str = wire("Attribute", "")
    result: str = wire("Result attribute", "unnestResult")

    def run(self, spark, df):
        name = new_name(df, self.result)
        pieces = F.filter(F.split(col(df, self.attribute).cast("string"), self.delimiter), lambda x: x != "")
        return df.select("*", F.explode(pieces).alias(name))


@operator("Distinct", "Data cleaning")
class Distinct(Operator):
    """Each different row once; nulls are equal."""

    def run(self, spark, df):
        return df.distinct()


@operator("Limit", "Data cleaning")
class Limit(Operator):
    """The first rows, at most `limit`; behind Sort they are the top rows."""

    limit: int = 0

    def run(self, spark, df):
        return df.limit(max(int(self.limit), 0))


def ordering(df: DataFrame, attribute: str, descending: bool) -> Column:
    """Nulls, and NaN with them, come last either way."""
    c, kind = col(df, attribute), field_of(df, attribute).dataType
    if isinstance(kind, T.DoubleType | T.FloatType):
        c = F.nanvl(c, F.lit(None).cast(kind))
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


@operator("Sort", "Sort")
class Sort(Operator):
    """All rows in order of several columns, each ASC or DESC."""

    attributes: list = many()

    def run(self, spark, df):
        if not self.attributes:
            raise PropertyError("Sort: no attributes")
        return df.orderBy(*(ordering(df, a["attribute"], str(a.get("sortPreference", "ASC")).upper().startswith("D")) for a in self.attributes))


@operator("SortPartitions", "Sort")
class SortPartitions(Operator):
    """Rows dealt out by equal-width ranges of a numeric column between two bounds, each partition in order.

    Values beyond a bound go to the outermost range; nulls to the first. A hot range is a hot partition by
    definition of equal widths.
    """

    sortAttributeName: str
    domainMin: int
    domainMax: int
    partitions: int = 0

    def bucket(self, df: DataFrame, n: int) -> Column:
        if self.domainMax < self.domainMin:
            raise PropertyError("SortPartitions: domainMax is under domainMin")
        width = max((self.domainMax - self.domainMin + n) // n, 1)
        at = F.floor((col(df, self.sortAttributeName) - F.lit(self.domainMin)) / F.lit(width))
        return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)), F.lit(0)).cast("int")

    def run(self, spark, df):
        n = self.partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = "__range"
        return df.withColumn(name, self.bucket(df, n)).repartitionByRange(n, name).sortWithinPartitions(name, F.col(f"`{self.sortAttributeName}`").asc_nulls_first()).drop(name)
