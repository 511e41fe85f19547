"""Sampling, routing and other control."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from millrace.functions.quantiles import order_statistics
from millrace.functions.storage import kept
from millrace.registry import Operator, PropertyError, operator, wire

#: Rows that a top-k brings to one task.
TOP_ROWS = 100_000


@operator("RandomKSampling", "Utilities")
class RandomKSampling(Operator):
    """Keeps each row with a probability in percent."""

    unstable = True
    percentage: int = wire("random k sample percentage", 0)
    seed: int = 1

    def run(self, spark, df):
        return df.sample(False, min(max(self.percentage, 0), 100) / 100, self.seed)


@operator("ReservoirSampling", "Utilities")
class ReservoirSampling(Operator):
    """Rows drawn uniformly, as many as asked for or all: those of the least random numbers.

    Up to TOP_ROWS that is a top-k, which one task brings together; of more rows the numbers are written first, and
    the k-th is found by counts, so that rows stay where they are.
    """

    unstable = True
    k: int = wire("number of item sampled in reservoir sampling", 0)
    seed: int = 1

    def run(self, spark, df):
        k, drawn = max(self.k, 0), df.withColumn("__random", F.rand(self.seed))
        if k <= TOP_ROWS:
            return drawn.orderBy("__random").limit(k).drop("__random")
        drawn = kept(drawn)
        least = order_statistics(drawn, "__random", [k - 1])[k - 1]
        return (drawn if least is None else drawn.where(F.col("__random") <= F.lit(least))).drop("__random")


@operator("Split", "Utilities")
class Split(Operator):
    """Each row to port 0 with a probability of k percent, else to port 1.

    The random number is written with the row to the shared folder, so both ports agree also when an executor is lost.
    """

    outputs = 2
    unstable = True
    k: int = 80
    random: bool = True
    seed: int = 1

    def run(self, spark, df):
        seed = time.time_ns() % (1 << 31) if self.random else self.seed
        drawn = df.withColumn("__random", F.rand(seed))
        drawn = kept(drawn)
        first = F.col("__random") < self.k / 100
        return [drawn.where(first).drop("__random"), drawn.where(~first).drop("__random")]


@operator("If", "Control block")
class If(Operator):
    """All rows of port 1 to output 1 (True) or output 0 (False), by a boolean that the first row of port 0 has.

    True if port 0 has no row, or no such column, or a null there, and no value of that name came beside the data
    (see plans.execution).
    """

    inputs = 2
    outputs = 2
    conditionName: str = ""

    def take_state(self, state: dict) -> None:
        self.beside = {k.lower(): v for k, v in state.items()}

    def run(self, spark, state, df):
        name = next((c for c in state.columns if c.lower() == self.conditionName.lower()), None)
        row = state.select(f"`{name}`").first() if name else None
        value = row[0] if row is not None and row[0] is not None else getattr(self, "beside", {}).get(self.conditionName.lower())
        true = value is None or bool(value)
        return [df.limit(0), df] if true else [df, df.limit(0)]


@operator("Sleep", "Utilities")
class Sleep(Operator):
    """Every row after a wait of so many seconds, one after the other; for trying things out."""

    sleepTime: int = 0

    def run(self, spark, df):
        wait = self.sleepTime

        def run(batches):
            for b in batches:
                time.sleep(wait * len(b))
                yield b

        return df.coalesce(1).mapInPandas(run, df.schema)


@operator("Dummy", "Utilities")
class Dummy(Operator):
    """A placeholder in a drawn workflow; it can't run."""

    dummyOperator: str = ""

    def run(self, spark, df):
        raise PropertyError(f"Dummy: {self.dummyOperator or 'operator'} isn't known here")
