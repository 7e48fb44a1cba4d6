"""Weak components by contraction: rounds grow with the logarithm of the longest path, not with the path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.storage import cut_at, remove


def _hooked(pairs: DataFrame) -> DataFrame:
    """(v, p): each end of an edge with the least of itself and its neighbours."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("p")), F.struct(F.col("b").alias("v"), F.col("a").alias("p")))).alias("e")).select("e.*")
    return ends.groupBy("v").agg(F.min("p").alias("p")).select("v", F.least("v", "p").alias("p"))


def _jumped(tree: DataFrame, name: str) -> tuple[DataFrame, str, int]:
    """``tree`` with every pointer at its root, its place, and the number of jumps: each doubles how far a pointer reaches."""
    spark = tree.sparkSession
    now, path = cut_at(tree, name)
    jumps = 0
    while True:
        up = now.select(F.col("v").alias("_v"), F.col("p").alias("_p")).where("_v != _p")  # a root is where it is
        open_ends = now.where("v != p").join(up, F.col("p") == F.col("_v"), "left_semi").limit(1)
        if open_ends.isEmpty():
            return now, path, jumps
        new, after = cut_at(now.join(up, F.col("p") == F.col("_v"), "left").select("v", F.coalesce("_p", "p").alias("p")), name)
        remove(spark, path)
        now, path, jumps = new, after, jumps + 1


def weak_components(graph: Graph) -> tuple[DataFrame, list[tuple[int, int]]]:
    """((id, value), rounds): the least id of each vertex's weak component, and of each contraction (edges, jumps).

    A vertex points at its least neighbour, or at itself if it is less; pointers descend, so they make trees. Pointer
    jumping brings every vertex to its root, and the edges between different roots are the next, smaller graph: each of
    its vertices but local minima goes, so at least half of those that have edges. The rounds' trees are put together
    from the last, smallest one back. Repeated edges and loops don't matter; edges with a null end are none.
    """
    spark = graph.edges.sparkSession
    sound = graph.edges.where(F.col("src").between(0, graph.n - 1) & F.col("tgt").between(0, graph.n - 1) & (F.col("src") != F.col("tgt")))
    pairs, at = cut_at(sound.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct(), "pairs")
    trees, rounds = [], []
    while edges := pairs.count():
        tree, path, jumps = _jumped(_hooked(pairs), "tree")
        trees.append((tree, path))
        rounds.append((edges, jumps))
        own, other = (tree.select(F.col("v").alias(f"_{x}"), F.col("p").alias(f"_r{x}")) for x in "ab")
        moved = pairs.join(own, F.col("a") == F.col("_a")).join(other, F.col("b") == F.col("_b")).where("_ra != _rb")
        pairs, after = cut_at(moved.select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b")).distinct(), "pairs")
        remove(spark, at)
        at = after
    ids = spark.range(graph.n)
    if not trees:
        return ids.select("id", F.col("id").alias("value")), rounds
    labels, path = trees.pop()
    while trees:
        tree, before = trees.pop()
        last = labels.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
        labels, after = cut_at(tree.join(last, F.col("p") == F.col("_v"), "left").select("v", F.coalesce("_p", "p").alias("p")), "tree")
        remove(spark, before)
        remove(spark, path)
        path = after
    return ids.join(labels, F.col("id") == F.col("v"), "left").select("id", F.coalesce("p", "id").alias("value")), rounds
