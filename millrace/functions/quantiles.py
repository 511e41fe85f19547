"""Values at given ranks of a column, exactly, by rounds of counts instead of a sort or a map of all different values."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that a range of values is cut into a round, and values that are brought to the driver at the end of it.
CELLS, FEW = 1000, 5000


@dataclass
class _Range:
    """Values from low to high, of which `skip` of all are smaller, and the ranks that are looked for in it."""

    low: float
    high: float
    skip: int
    count: int
    ranks: list[int]


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float | None]:
    """The value of each rank (from 0) among the doubles of a column that aren't null or NaN; None beyond the last.

    Each round counts the values of the cells of the ranges that still hold a rank: at most CELLS rows a rank come to
    the driver. A range is done when all its values are equal, or when they are FEW.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    found: dict[int, float | None] = {r: None for r in ranks if not 0 <= r < n}
    todo = [_Range(low, high, 0, n, sorted(r for r in set(ranks) if 0 <= r < n))]
    while todo := [t for t in todo if t.ranks]:
        for t in [t for t in todo if t.low == t.high]:
            found |= dict.fromkeys(t.ranks, t.low)
        todo = [t for t in todo if t.low != t.high]
        few = [t for t in todo if t.count <= FEW]
        for t in few:
            values = sorted(r[0] for r in rows.where(F.col("v").between(t.low, t.high)).collect())
            found |= {r: values[r - t.skip] for r in t.ranks}
        todo = [t for t in todo if t.count > FEW]
        if not todo:
            break
        # Infinite ends are cells of their own; a cell's own ends are what the next round starts from.
        which = reduce(lambda c, i: c.when(F.col("v").between(todo[i].low, todo[i].high), F.lit(i)), range(len(todo)), F.when(F.lit(False), F.lit(0)))
        cells = []
        for t in todo:
            a, b = (x if abs(x) != float("inf") else (1.7e308 if x > 0 else -1.7e308) for x in (t.low, t.high))
            # Halves, as the whole width may be no double.
            cell = F.floor((F.col("v") / 2 - F.lit(a / 2)) / F.lit(b / 2 - a / 2) * CELLS)
            cells.append(F.when(F.col("v") == float("-inf"), F.lit(-1)).when(F.col("v") == float("inf"), F.lit(CELLS)).otherwise(F.least(F.greatest(cell, F.lit(0)), F.lit(CELLS - 1))))
        cell = reduce(lambda c, i: c.when(F.col("t") == i, cells[i]), range(len(todo)), F.when(F.lit(False), F.lit(0)))
        counted = rows.withColumn("t", which).where("t is not null").withColumn("c", cell).groupBy("t", "c").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        after = []
        for i, t in enumerate(todo):
            skip = t.skip
            for r in sorted((r for r in counted if r["t"] == i), key=lambda r: r["c"]):
                after.append(_Range(r["low"], r["high"], skip, r["n"], [k for k in t.ranks if skip <= k < skip + r["n"]]))
                skip += r["n"]
        todo = after
    return found


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Values at shares between 0 and 1 of the way through a column, between two values in proportion."""
    n = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    places = [s * (n - 1) for s in shares]
    ranks = {int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places}
    values = order_statistics(df, column, sorted(ranks)) if n else {}
    out: list[float | None] = []
    for p in places:
        a, b = (values[int(p)], values[min(int(p) + 1, n - 1)]) if n else (None, None)
        out.append(None if a is None else a if a == b else a + (b - a) * (p - int(p)))
    return out
