"""Connected components of a distributed edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, join_with_hot_keys


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_with_hot_keys(both, least, "u", "n", 2 * n, "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_with_hot_keys(down, least, "u", "n", n, "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, label (smallest long reachable from u) for every u that isn't its own label; edges have columns u, v (long).

    Each round is cut off by a reliable checkpoint. A node of very many edges is a hot key of the joins, which
    join_with_hot_keys deals out. Self-loops and repeated edges don't matter; nulls aren't allowed.
    """
    state = checkpointed(edges.where("u <> v").select("u", "v"))
    before = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or tuple(now) == before:
            return state.select("u", F.col("v").alias("label"))
        before = tuple(now)
        state = checkpointed(_small_star(_large_star(state, now[0]), now[0]))
