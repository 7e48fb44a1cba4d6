"""Connected components by alternating large-star and small-star steps, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.frames import beside_group
from graphloom.plans.storage import cut_at, remove


def _beside_least(rows: DataFrame, total: int) -> DataFrame:
    """``rows``, (u, v), with m, the least v of each u."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return beside_group(rows, "u", least, "n", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _beside_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` with u > v."""
    moved = _beside_least(edges, total).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): each vertex but a component's least, with that least vertex. ``edges``: (u, v) of one ordered type.

    Loops and repeated edges don't matter. Rounds are written to the shared folder until nothing changes, which takes a
    number of them that grows with the logarithm of the longest path; a round is deleted when the next is there.
    """
    spark = edges.sparkSession
    ordered = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = cut_at(ordered, name)
    state = _state(now)
    while True:
        before, last = state, path
        large, between = cut_at(_large_star(now, state[0]).where("u != v").distinct(), name)
        now, path = cut_at(_small_star(large, state[0]), name)
        remove(spark, last)
        remove(spark, between)
        state = _state(now)
        if before == state:
            return now


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") / 1024).cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)
