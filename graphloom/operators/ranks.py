"""Exact medians and percentiles without a buffer of all values: selection by counts in value ranges.

The values between two bounds are counted in ``BINS`` ranges of equal width, each
with its least and greatest value; the range in which a rank falls gives the next
bounds, until these are one value. A round reads the rows once and shuffles at
most ``BINS`` counts for a task and a pair of bounds. Groups, if there are any,
are all refined in the same rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.storage import cut, cut_at, remove

BINS, BROADCAST_ROWS = 4096, 100_000


def order_values(rows: DataFrame, group: list[str], value: Column, fractions: list[float]) -> DataFrame:
    """(group..., p, value): for each fraction p the value at place p * (n - 1) of a group's n values in order, interpolated.

    Null and NaN values are left out; a group without others is not listed. The result is a small table: a row a group
    and fraction.
    """
    spark, keys = rows.sparkSession, [f"_g{k}" for k in range(len(group))]
    v = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(group, keys)], value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = cut(v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0"), "sizes")
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for p in fractions])).alias("z")
    wanted = sizes.select(*keys, at, "lo", "hi").select(*keys, "z.p", "z.at", "lo", "hi")
    ranks = wanted.select(*keys, F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("k"), "lo", "hi").distinct().withColumn("base", F.lit(0).cast("long"))
    found, path = cut_at(ranks, "ranks")
    half = lambda x: F.col(x) / 2  # noqa: E731  differences of halves don't overflow
    while not (opened := found.where("lo < hi").select(*keys, "lo", "hi", "base").distinct()).isEmpty():
        inner = opened.select(*[F.col(k).alias(f"{k}_") for k in keys], "lo", "hi", "base")
        inner = F.broadcast(inner) if inner.count() <= BROADCAST_ROWS else inner
        inside = F.col("v").between(F.col("lo"), F.col("hi"))
        for k in keys:
            inside = inside & F.col(k).eqNullSafe(F.col(f"{k}_"))
        place = F.least(F.floor((half("v") - half("lo")) / (half("hi") - half("lo")) * BINS), F.lit(BINS - 1)).alias("bin")
        counted = v.join(inner, inside).groupBy(*keys, "lo", "hi", "base", place).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = Window.partitionBy(*keys, "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
        bins = counted.withColumn("base", F.col("base") + F.coalesce(F.sum("c").over(before), F.lit(0)))
        bins = bins.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("lo").alias("lo_"), F.col("base").alias("base_"), "c", "low", "high")
        own = (F.col("lo") == F.col("lo_")) & (F.col("k") >= F.col("base_")) & (F.col("k") < F.col("base_") + F.col("c"))
        for k in keys:
            own = own & F.col(k).eqNullSafe(F.col(f"{k}_"))
        narrowed = found.where("lo < hi").join(bins, own).select(*keys, "k", F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("base_").alias("base"))
        new, after = cut_at(found.where("lo = hi").select(*keys, "k", "lo", "hi", "base").union(narrowed), "ranks")
        remove(spark, path)
        found, path = new, after

    def valued(name: str, rank: Column) -> tuple[DataFrame, Column]:
        at = found.select(*[F.col(k).alias(f"{k}_{name}") for k in keys], F.col("k").alias(f"k_{name}"), F.col("lo").alias(name))
        same = F.col(f"k_{name}") == rank
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_{name}"))
        return at, same

    low, here = valued("below", F.floor("at"))
    high, there = valued("above", F.ceil("at"))
    met = wanted.join(low, here).join(high, there)
    share = F.col("at") - F.floor("at")
    exact = F.when(share == 0, F.col("below")).otherwise(F.col("below") + share * (F.col("above") - F.col("below")))
    return met.select(*[F.col(k).alias(c) for c, k in zip(group, keys)], "p", exact.alias("value"))
