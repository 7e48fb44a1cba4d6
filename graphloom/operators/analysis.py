"""Queries over results, labels, tiles and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.arith import is_close, nearly_equal
from graphloom.operators.ranks import order_values


def compare_results(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value", digits: int | None = 4, relative: float = 1e-4) -> DataFrame:
    """Rows of which the values differ or that one side lacks: keys, a, b. Compared after ``digits`` decimals, or relatively with None."""
    x, y = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    same = nearly_equal(F.col("a"), F.col("b"), digits) if digits is not None else is_close(F.col("a"), F.col("b"), relative)
    return x.join(y, keys, "full_outer").where(F.col("a").isNull() | F.col("b").isNull() | ~same)


def compare_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: differing ids, distinct labels on either side."""
    both = a.select("id", F.col("label").alias("a")).join(b.select("id", F.col("label").alias("b")), "id", "full_outer")
    return both.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"), F.countDistinct("a").alias("labels_a"), F.countDistinct("b").alias("labels_b"))


def canonical_labels(labels: DataFrame, as_text: bool = True) -> DataFrame:
    """(id, label): each label replaced by its least member, compared as text by default. A join, so a huge label is no single task's."""
    key = F.col("id").cast("string") if as_text else F.col("id")
    least = labels.groupBy("label").agg(F.min(key).alias("least"))
    return labels.join(least, "label").select("id", F.col("least").alias("label"))


def distinct_vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "tgt")).alias("v")).agg(F.countDistinct("v").alias("vertices"))


def distribution_stats(rows: DataFrame, value: Column) -> DataFrame:
    """Least, greatest, mean, population deviation, median."""
    v = rows.select(value.cast("double").alias("v"))
    stats = v.agg(F.min("v").alias("least"), F.max("v").alias("greatest"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))
    median = order_values(v, [], F.col("v"), [0.5]).select(F.col("value").alias("median"))
    return stats.join(F.broadcast(median), F.lit(True), "left")  # one row each


def percentiles(rows: DataFrame, value: Column, at: tuple[int, ...] = tuple(range(10, 100, 10))) -> DataFrame:
    """(p, value) for each percentage, interpolated."""
    found = order_values(rows, [], value, [p / 100 for p in at])
    return found.select(F.round(F.col("p") * 100).cast("int").alias("p"), "value")


def grid_density(edges: DataFrame, n: int, side: int) -> DataFrame:
    """Statistics of edges per cell, empty cells included: they are added as zeros by arithmetic, not made."""
    rows = -(-n // side)
    counts = edges.groupBy(F.floor(F.col("src") / side).alias("r"), F.floor(F.col("tgt") / side).alias("c")).agg(F.count("*").alias("k"))
    cells = rows * rows
    sums = counts.agg(F.count("*").alias("full"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("ss"))
    # the median is among the full cells' counts if fewer than half are empty
    ranked = counts.groupBy("k").agg(F.count("*").alias("m"))
    below = ranked.withColumn("to", F.sum("m").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))  # one row per distinct count
    lo_rank, hi_rank = (cells - 1) // 2, cells // 2  # from 0, zeros first
    empty = F.lit(cells) - F.col("full")
    at = lambda rank: F.when(F.lit(rank) < empty, F.lit(0)).otherwise(F.min(F.when(F.col("to") > F.lit(rank) - empty, F.col("k"))))
    joined = below.join(F.broadcast(sums))
    medians = joined.groupBy("full", "lo", "hi", "s", "ss").agg(((at(lo_rank) + at(hi_rank)) / 2).alias("median"))
    mean = F.col("s") / cells
    return medians.select(
        F.when(empty > 0, F.lit(0)).otherwise(F.col("lo")).cast("long").alias("least"),
        F.col("hi").alias("greatest"),
        mean.alias("mean"),
        "median",
        F.sqrt(F.col("ss") / cells - mean * mean).alias("deviation"),
    )


def log_stats(lines: DataFrame, column: str = "line", run: str = "run") -> DataFrame:
    """(run, rounds, median, mean, deviation, total) of the milliseconds in round-time lines."""
    ms = F.regexp_extract(column, r"Round Time for iteration \d+ ([0-9.]+)msec", 1)
    timed = lines.where(ms != "").select(run, ms.cast("double").alias("ms"))
    medians = order_values(timed, [run], F.col("ms"), [0.5]).select(F.col(run).alias("_run"), F.col("value").alias("median"))
    stats = timed.groupBy(run).agg(F.count("*").alias("rounds"), F.avg("ms").alias("mean"), F.stddev_pop("ms").alias("deviation"), F.sum("ms").alias("total"))
    return stats.join(medians, F.col(run).eqNullSafe(F.col("_run"))).select(run, "rounds", "median", "mean", "deviation", "total")


def disk_throughput(samples: DataFrame, blocks: int = 1024) -> DataFrame:
    """(sample, amount): per-device differences of running counters (device, sample, counter), summed over devices.

    A device's history is cut into blocks of samples; the last counter of each is carried to the device's next one, so
    no task sees a whole history.
    """
    ends = samples.agg(F.min("sample").alias("lo"), F.max("sample").alias("hi")).first()
    if ends["lo"] is None:
        return samples.select("sample", F.lit(0).cast("long").alias("amount"))
    width = (ends["hi"] - ends["lo"]) // blocks + 1
    placed = samples.withColumn("block", F.floor((F.col("sample") - F.lit(ends["lo"])) / width))
    last = placed.groupBy("device", "block").agg(F.max_by("counter", "sample").alias("counter"))  # ``blocks`` rows a device
    carried = last.select("device", "block", F.lag("counter").over(Window.partitionBy("device").orderBy("block")).alias("carried"))
    inside = F.lag("counter").over(Window.partitionBy("device", "block").orderBy("sample"))
    stepped = placed.select("device", "block", "sample", "counter", inside.alias("earlier")).join(carried, ["device", "block"])
    step = F.col("counter") - F.coalesce("earlier", "carried")
    return stepped.select("sample", step.alias("d")).where("d is not null").groupBy("sample").agg(F.sum("d").alias("amount"))
