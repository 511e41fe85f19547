"""Joins: by equal keys, by an interval, and all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import types
from millrace.registry import Operator, PropertyError, field_of, operator


def clash_names(left: list[str], right: list[str]) -> list[str]:
    """Names for the right columns: one that is taken by any other column gets #@1, or the next number that is free."""
    taken, out = {c.lower() for c in left}, []
    others = [c.lower() for c in right]
    for i, c in enumerate(right):
        name, k = c, 0
        while name.lower() in taken or (k and name.lower() in others[:i] + others[i + 1 :]):
            k += 1
            name = f"{c}#@{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def chained_names(left: list[str], right: list[str]) -> list[str]:
    """Like clash_names, but a name that is still taken gets another #@1."""
    taken, out = {c.lower() for c in left}, []
    others = [c.lower() for c in right]
    for i, c in enumerate(right):
        name = c
        while name.lower() in taken or (name != c and name.lower() in others[:i] + others[i + 1 :]):
            name += "#@1"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, mark: str) -> DataFrame:
    """df with plain column names, so that two sides never clash."""
    return df.toDF(*(f"{mark}{i}" for i in range(len(df.columns))))


JOINS = {"inner": "inner", "left outer": "left", "right outer": "right", "full outer": "full"}


@operator("HashJoin", "Join")
class HashJoin(Operator):
    """Equi-join on one column of each side, in which nulls are equal.

    The result has the left columns, then the right ones without their key. Rows without a partner keep the
    right key in the left key's column. Spark picks the strategy: a small side is broadcast by its size, a
    skewed key is split when the query runs.
    """

    inputs = 2
    buildAttributeName: str
    probeAttributeName: str
    joinType: str = "inner"

    def run(self, spark, left, right):
        if self.joinType not in JOINS:
            raise PropertyError(f"HashJoin: no join type {self.joinType!r}")
        lk, rk = field_of(left, self.buildAttributeName).name, field_of(right, self.probeAttributeName).name
        rest = [c for c in right.columns if c != rk]
        names = clash_names(left.columns, rest)
        a, b = numbered(left, "l"), numbered(right, "r")
        ka, kb = a[f"l{left.columns.index(lk)}"], b[f"r{right.columns.index(rk)}"]
        joined = a.join(b, ka.eqNullSafe(kb), JOINS[self.joinType])
        key = F.coalesce(ka, kb) if self.joinType in ("right outer", "full outer") else ka
        keep = [(key if c == lk else a[f"l{i}"]).alias(c) for i, c in enumerate(left.columns)]
        return joined.select(*keep, *(b[f"r{right.columns.index(c)}"].alias(n) for c, n in zip(rest, names, strict=True)))


UNITS = {"year": 366 * 86400, "month": 31 * 86400, "day": 86400, "hour": 3600, "minute": 60, "second": 1}


#: Cells of an interval: more of them leave fewer pairs to test, for more copies of the right rows.
CELLS = 4
#: 2 ** BLOCK_BITS neighbouring cells are shuffled as one block: more of them leave fewer copies of the right rows to shuffle.
BLOCK_BITS = 4
#: Rows of one cell that stay together; those of a cell with more are dealt out over parts.
CELL_ROWS = 20_000
#: Pairs to test of one block that stay together, unless they are less than a share of all pairs for each of so many tasks.
BLOCK_PAIRS, SHARES = 100_000_000, 2


def dealt(df: DataFrame, parts: DataFrame, mine: str, others: str, n: int) -> DataFrame:
    """df with part columns `mine`, drawn by a hash of the row, and `others`, one row for each part of the other side; and
    the task, of n, of the block's two parts.

    parts has both numbers of parts of the blocks that have more than one: few enough for a broadcast.
    """
    draw = F.pmod(F.xxhash64(*df.columns), F.coalesce(f"n_{mine}", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(f"n_{others}", F.lit(1)) - 1))
    df = df.join(F.broadcast(parts), "block", "left").withColumn(mine, draw).withColumn(others, every).drop("n_p", "n_q")
    return df.withColumn("task", F.pmod(F.xxhash64("block", "p", "q"), F.lit(n)).cast("int"))


def parts_of(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """block, n_p, n_q: the parts of the left and right rows of blocks that have more than one, given each row's block and cell."""
    cells = a.groupBy("block", "cell").agg(F.count("*").alias("a")).join(b.groupBy("block", "cell").agg(F.count("*").alias("b")), ["block", "cell"], "full").na.fill(0)
    blocks = cells.groupBy("block").agg(F.max("a").alias("most_a"), F.max("b").alias("most_b"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a").cast("double") * F.col("b")).alias("pairs"))
    share = F.greatest(F.lit(float(BLOCK_PAIRS)), blocks.agg(F.sum("pairs")).scalar() / (n * SHARES))
    # By both sides, so that each row gets as few copies as will do.
    blocks = blocks.withColumn("k", F.greatest(F.ceil(F.col("pairs") / share), F.lit(1)))
    blocks = blocks.withColumn("n_p", F.greatest(F.ceil(F.col("most_a") / CELL_ROWS), F.least("k", F.ceil(F.sqrt(F.col("k") * F.greatest("a", F.lit(1)) / F.greatest("b", F.lit(1)))))))
    blocks = blocks.withColumn("n_q", F.greatest(F.ceil(F.col("most_b") / CELL_ROWS), F.ceil(F.col("k") / F.col("n_p"))))
    return blocks.where("n_p > 1 or n_q > 1").select("block", F.col("n_p").cast("int"), F.col("n_q").cast("int"))


@operator("IntervalJoin", "Join")
class IntervalJoin(Operator):
    """Pairs with left in [right, right + constant]; each bound counts or doesn't. Nulls have no partner.

    Both sides are cut into cells of a quarter of the interval; a right row goes to the cells that its interval
    touches, a left row to its own. So it is an equi-join on the cell, with the exact condition beside it, and each
    pair is found once. Blocks of cells are shuffled, to a task by number, so a right row is written once or twice and
    copied to its cells in the task. Rows of blocks with many rows in a cell, or many pairs, are dealt out over parts,
    and each of them meets all parts of the other side. Streams aren't counted, so they are shuffled by cells.
    """

    inputs = 2
    leftAttributeName: str
    rightAttributeName: str
    constant: int = 10
    includeLeftBound: bool = True
    includeRightBound: bool = True
    timeIntervalType: str = "day"

    def run(self, spark, left, right):
        lf, rf = field_of(left, self.leftAttributeName), field_of(right, self.rightAttributeName)
        kinds = {types.name_of(lf.dataType), types.name_of(rf.dataType)}
        if not (kinds == {"timestamp"} or kinds <= {"integer", "long", "double"}):
            raise PropertyError(f"IntervalJoin: {lf.name} and {rf.name} can't be compared")
        a, b = numbered(left, "l"), numbered(right, "r")
        x, y = F.col(f"l{left.columns.index(lf.name)}"), F.col(f"r{right.columns.index(rf.name)}")
        if kinds == {"timestamp"}:
            unit = (self.timeIntervalType or "day").lower()
            if unit not in UNITS:
                raise PropertyError(f"IntervalJoin: no unit {unit!r}")
            wide = "timestamp"
            end = lambda c: c + F.make_interval(**{f"{'min' if unit == 'minute' else 'sec' if unit == 'second' else unit}s": F.lit(self.constant)})
            width = max(abs(self.constant) * UNITS[unit], 1) * 1_000_000 // CELLS
            place = lambda c: F.floor(F.unix_micros(c) / F.lit(width)).cast("long")
        else:
            wide = "double" if "double" in kinds else "long"
            end = lambda c: c + F.lit(self.constant).cast(wide)
            place = lambda c: F.floor(c / F.lit(max(abs(self.constant) / CELLS, 1))).cast("long")
        test = (F.col("x") >= F.col("y") if self.includeLeftBound else F.col("x") > F.col("y")) & (F.col("x") <= F.col("z") if self.includeRightBound else F.col("x") < F.col("z"))
        # What the condition reads is computed once a row, not once a pair.
        keys_a = lambda df, c: df.withColumn("x", c.cast(wide)).withColumn("cell", place(F.col("x")))
        keys_b = lambda df, c: df.withColumn("y", c.cast(wide)).withColumn("z", end(F.col("y"))).withColumn("low", place(F.col("y"))).withColumn("high", F.greatest(place(F.col("z")), "low"))
        own, others = keys_a(a, x).where(F.col("x").isNotNull()), keys_b(b, y).where(F.col("y").isNotNull())
        cells, on = F.explode(F.sequence("low", "high")), ["cell"]
        if left.isStreaming or right.isStreaming:
            others = others.withColumn("cell", cells)
        else:
            # By a number, as a few MB of rows can make billions of pairs and mustn't be put into a few tasks for their size.
            n, on = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), ["cell", "p", "q", "task"]
            block = lambda c: F.shiftright(c, BLOCK_BITS)
            parts = parts_of(own.select(block("cell").alias("block"), "cell"), others.select(cells.alias("cell")).select(block("cell").alias("block"), "cell"), n)
            own = dealt(a.where(x.isNotNull()).withColumn("block", block(place(x.cast(wide)))), parts, "p", "q", n).drop("block")
            others = dealt(others.withColumn("block", F.explode(F.sequence(block("low"), block("high")))).select("block", *b.columns), parts, "q", "p", n)
            own, others = keys_a(own.repartitionById(n, "task"), x), keys_b(others.repartitionById(n, "task"), y)
            first = F.shiftleft("block", BLOCK_BITS)
            # The task is one of the keys, so neither side is shuffled again by its cells.
            others = others.withColumn("cell", F.explode(F.sequence(F.greatest("low", first), F.least("high", first + (2**BLOCK_BITS - 1))))).drop("block")
        joined = own.join(others.drop("low", "high"), on).where(test)
        names = clash_names(left.columns, right.columns)
        return joined.select(*(F.col(f"l{i}").alias(c) for i, c in enumerate(left.columns)), *(F.col(f"r{i}").alias(n) for i, n in enumerate(names)))


@operator("CartesianProduct", "Join")
class CartesianProduct(Operator):
    """Every left row with every right row, as asked for by name."""

    inputs = 2

    def run(self, spark, left, right):
        names = chained_names(left.columns, right.columns)
        return numbered(left, "l").crossJoin(numbered(right, "r")).toDF(*left.columns, *names)

