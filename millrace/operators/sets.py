"""Set operations; all but Union make each row at most once, with nulls equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millrace.registry import Operator, check_same_schema, operator


@operator("Union", "Set")
class Union(Operator):
    """All rows of all links; they must have one schema."""

    def run(self, spark, df):
        return df


@operator("Intersect", "Set")
class Intersect(Operator):
    """Rows that both sides have; none if their schemas differ."""

    inputs = 2

    def run(self, spark, left, right):
        if [(f.name, f.dataType) for f in left.schema] != [(f.name, f.dataType) for f in right.schema]:
            return left.limit(0)
        return left.intersect(right)


@operator("Difference", "Set")
class Difference(Operator):
    """Rows of the left side that the right one lacks."""

    inputs = 2

    def run(self, spark, left, right):
        check_same_schema(left, right)
        return left.subtract(right)


@operator("SymmetricDifference", "Set")
class SymmetricDifference(Operator):
    """Rows that one side only has: one shuffle over both, in which each side is a bit."""

    inputs = 2

    def run(self, spark, left, right):
        check_same_schema(left, right)
        names = [f"c{i}" for i in range(len(left.columns))]
        both = left.toDF(*names).withColumn("__side", F.lit(1)).unionAll(right.toDF(*names).withColumn("__side", F.lit(2)))
        return both.groupBy(*names).agg(F.bit_or("__side").alias("__sides")).where("__sides < 3").select(*names).toDF(*left.columns)


def union_all(frames):
    """Union of any number of DataFrames of one schema."""
    return reduce(lambda a, b: (check_same_schema(a, b), a.union(b))[1], frames)
