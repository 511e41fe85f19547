"""Group-by aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import types
from millrace.registry import Operator, PropertyError, check_names, col, field_of, many, operator

NUMERIC = ("integer", "long", "double", "timestamp")


def aggregate_column(df, function: str, attribute: str, result: str) -> Column:
    """One aggregate. Sums keep their type and are 0 over nulls only (the epoch for timestamps); counts are integers;
    averages of timestamps are in milliseconds; concat joins by commas in order of value, nulls as empty pieces that
    vanish in front."""
    field = field_of(df, attribute)
    kind, c = types.name_of(field.dataType), col(df, attribute)
    if function in ("sum", "average", "min", "max") and kind not in NUMERIC:
        raise PropertyError(f"Aggregate: {function} of {attribute}, which is {kind}")
    if isinstance(field.dataType, T.TimestampNTZType | T.DateType):
        c = c.cast("timestamp")
    millis = F.unix_millis(c) if kind == "timestamp" else c
    if function == "sum":
        total = F.coalesce(F.sum(millis), F.lit(0))
        out = F.timestamp_millis(total) if kind == "timestamp" else total.cast(types.SPARK[kind])
    elif function == "count":
        out = F.count(c).cast("int")
    elif function == "average":
        out = F.avg(millis).cast("double")
    elif function == "min":
        out = F.min(c)
    elif function == "max":
        out = F.max(c)
    elif function == "concat":
        if kind != "string":
            raise PropertyError(f"Aggregate: concat of {attribute}, which is {kind}")
        # Nulls and empty texts sort first, so they vanish as leading pieces do.
        texts = F.array_sort(F.collect_list(F.when(c != "", c)))
        out = F.array_join(texts, ",")
    else:
        raise PropertyError(f"Aggregate: no function {function!r}")
    return out.alias(result)


@operator("Aggregate", "Aggregate")
class Aggregate(Operator):
    """Keys, then results. Null keys are one group; no rows in, no row out, also without keys."""

    aggregations: list = many()
    groupByKeys: list = many()

    def run(self, spark, df):
        if not self.aggregations:
            raise PropertyError("Aggregate: no aggregations")
        results = [a.get("result attribute") or "" for a in self.aggregations]
        if any(not r.strip() for r in results):
            raise PropertyError("Aggregate: a result's name is blank")
        keys = [field_of(df, k).name for k in self.groupByKeys or []]
        check_names(keys + results)
        columns = [aggregate_column(df, a["aggFunction"].lower(), a["attribute"], r) for a, r in zip(self.aggregations, results, strict=True)]
        if keys:
            return df.groupBy(*(col(df, k) for k in keys)).agg(*columns)
        # One partial row per task; a row in the end only if there was one.
        return df.agg(F.count(F.lit(1)).alias("__rows"), *columns).where("__rows > 0").drop("__rows")
