"""Breadth-first search with the frontier as bitmaps: no sender is shuffled or joined row by row.

A bitmap holds 32,768 ids in 4 KB. The frontier and all visited ids are tables of
bitmaps, broadcast after their rows have been counted; an edge is followed if its
source's bit is set and its target's is not, and the next frontier's bitmaps are
made by a partial aggregate, so what is shuffled is at most one bitmap a task and
32,768 ids. The edges lie in two tables, by stretch of the source and of the
target: a small frontier reads the stretches in which it has a bit (top-down), a
large one those in which an id is not yet visited (bottom-up).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.delta import Stretches, StretchStore
from graphloom.plans.storage import cut_at, remove
from graphloom.plans.superstep import ROWS_A_TASK, Run

IDS, BITMAP_BYTES, BROADCAST_BYTES = 1 << 15, 4096, 64 << 20
BOTTOM_UP = 4  # times the frontier reaches what is left


def bucket(vertex: Column) -> Column:
    return F.shiftright(vertex, 15)


def bit_set(bitmap: Column, vertex: Column) -> Column:
    """Whether the vertex's bit is set; false without a bitmap."""
    place = vertex.bitwiseAND(IDS - 1)
    byte = F.ascii(F.decode(F.substring(bitmap, F.shiftright(place, 3).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    mask = F.call_function("shiftleft", F.lit(1), place.bitwiseAND(7).cast("int"))
    return F.coalesce(byte.bitwiseAND(mask) > 0, F.lit(False))


def bitmaps(ids: DataFrame, vertex: str) -> DataFrame:
    """(bucket, bits) of a column of ids."""
    return ids.groupBy(bucket(F.col(vertex)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(vertex) + 1)).alias("bits"))


def _renamed(maps: DataFrame, to: str, bits: int) -> DataFrame:
    part = F.shiftright("bucket", max(0, bits - 15)) if bits >= 15 else F.col("bucket")
    return maps.where("bucket >= 0").select(F.col("bucket").alias(f"{to}_bucket"), F.col("bits").alias(f"{to}_bits"), part.alias(f"{to}_part"))


def bfs_bitmaps(graph: Graph, start: int, most_bytes: int = BROADCAST_BYTES) -> Run:
    """Hops from ``start`` as ``programs.bfs`` gives them; ``Run.log`` has the vertices of each level.

    The two sets take n / 4 bytes together at most; if that is over ``most_bytes``, ``programs.bfs`` does the work.
    """
    from graphloom.operators.programs import bfs

    if graph.n / 4 > most_bytes:
        return bfs(graph, start)
    if not 0 <= start < graph.n:
        raise ValueError(f"start vertex {start} is outside 0 .. {graph.n - 1}")
    spark = graph.edges.sparkSession
    edges = graph.edges.where(F.col("src").between(0, graph.n - 1) & F.col("tgt").between(0, graph.n - 1)).select("src", "tgt")
    parts = Stretches(graph.n, graph.n)
    if parts.bits < 15:  # a stretch holds whole bitmaps
        parts.bits = 15
    width = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), edges.count() // ROWS_A_TASK))
    forward = StretchStore(edges, parts, width)
    back: StretchStore | None = None
    frontier, at = cut_at(bitmaps(spark.range(start, start + 1), "id"), "frontier")
    visited, visited_at = frontier, None
    levels, log, reached, size = [(0, frontier, at)], [(0, 1, 0.0)], 1, 1
    while size:
        down = size * BOTTOM_UP < graph.n - reached
        if not down and back is None:
            back = StretchStore(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")), parts, width)
        own = F.broadcast(_renamed(frontier, "f", parts.bits))
        seen = F.broadcast(_renamed(visited, "v", parts.bits))
        if down:
            sent = forward.edges.join(own, (F.col("part") == F.col("f_part")) & (bucket(F.col("src")) == F.col("f_bucket"))).where(bit_set(F.col("f_bits"), F.col("src")))
            new = sent.join(seen, bucket(F.col("tgt")) == F.col("v_bucket"), "left").where(~bit_set(F.col("v_bits"), F.col("tgt"))).select("tgt")
        else:
            waiting = back.edges.join(seen, bucket(F.col("src")) == F.col("v_bucket"), "left").where(~bit_set(F.col("v_bits"), F.col("src")))
            new = waiting.join(own, bucket(F.col("tgt")) == F.col("f_bucket")).where(bit_set(F.col("f_bits"), F.col("tgt"))).select(F.col("src").alias("tgt"))
        frontier, at = cut_at(bitmaps(new, "tgt"), "frontier")
        size = frontier.agg(F.sum(F.bitmap_count("bits"))).first()[0] or 0
        if size:
            levels.append((len(levels), frontier, at))
            both, after = cut_at(visited.union(frontier).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")), "visited")
            remove(spark, visited_at)
            visited, visited_at = both, after
            reached += size
            log.append((len(log), size, 0.0 if down else 1.0))
    return Run(_levels(spark.range(graph.n), levels), len(log), log, True)


def _levels(ids: DataFrame, levels: list) -> DataFrame:
    """(id, value): levels read from bit slices, one bitmap for each binary digit of a level and one for all."""
    rows = None
    for k, maps, _ in levels:
        one = maps.select("bucket", "bits", F.lit(k).alias("level"))
        rows = one if rows is None else rows.union(one)
    digits = max(1, (len(levels) - 1).bit_length())
    slices = [F.bitmap_or_agg(F.when(F.col("level").bitwiseAND(1 << d) > 0, F.col("bits"))).alias(f"s{d}") for d in range(digits)]
    wide = rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("seen"), *slices)
    met = ids.join(wide, bucket(F.col("id")) == F.col("bucket"), "left")
    value = sum((F.when(bit_set(F.col(f"s{d}"), F.col("id")), F.lit(1 << d)).otherwise(0) for d in range(digits)), F.lit(0))
    return met.select("id", F.when(bit_set(F.col("seen"), F.col("id")), value.cast("long")).alias("value"))
