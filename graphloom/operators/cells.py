"""Triangles without a wedge table: vertices in colours, a task for each three of them.

Each vertex has one of p colours by hash. The edges between two colours are a cell
of a triangular grid, and a triangle lies in the three cells of its corners'
colours. A task gets the cells of one triple of colours, about 6 / p^2 of all
edges and of each hub's 2 / p, and finds its triangles there by itself; so an
edge is sent p times at most, whatever the degrees are, where a plan by wedges
sends the square of each degree.

With more than ``FEW`` colours each vertex also has the set of its neighbours'
colours, and an edge is sent only to the triples whose third colour both of its
ends have a neighbour of: some d * d / p of them for ends of degree d.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.hashing import mix64
from graphloom.graph import Graph
from graphloom.operators.programs import undirected
from graphloom.plans.storage import cut

EDGES_A_TASK, WEDGES = 1_000_000, 1 << 21
FEW, WORD = 16, 63  # colours without sets; colours in a long of a set


def _local(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The triangles of some distinct edges a < b, in stretches: from the corner of least degree, a stretch of ``WEDGES`` at a time."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, m = len(ids), len(a)
    rank = np.empty(n, np.int64)
    rank[np.argsort(np.bincount(ends, minlength=n), kind="stable")] = np.arange(n)
    x, y = rank[ends[:m]], rank[ends[m:]]
    u, v = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    keys, back = u * n + v, np.argsort(rank)
    last = np.searchsorted(u, u, "right")  # where each edge's source ends
    wedges = last - np.arange(m) - 1  # partners behind it
    upto = np.cumsum(wedges)
    at = 0
    while at < m:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WEDGES, "right")))
        times = wedges[at:end]
        one = np.repeat(np.arange(at, end), times)
        other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times)
        wanted = v[one] * n + v[other]
        place = np.minimum(np.searchsorted(keys, wanted), m - 1)
        closed = keys[place] == wanted
        yield tuple(ids[back[c]] for c in (u[one[closed]], v[one[closed]], v[other[closed]]))
        at = end


def _with_sets(pairs: DataFrame, p: int, words: int) -> DataFrame:
    """(a, b, w0, w1, ...): the colours that both ends have neighbours of, a bit each; edges without any are left out."""

    def colour(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            seen = (mix64(np.concatenate([b, a])) % np.uint64(p)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"v": np.concatenate([a, b]), "word": (seen // WORD).astype(np.int32), "bit": np.int64(1) << (seen % WORD)})

    ends = pairs.mapInArrow(colour, "v long, word int, bit long")
    sets = cut(ends.groupBy("v").agg(*[F.coalesce(F.bit_or(F.when(F.col("word") == k, F.col("bit"))), F.lit(0)).alias(f"w{k}") for k in range(words)]), "sets")
    for end in "ab":
        pairs = pairs.join(sets.select(F.col("v").alias(end), *[F.col(f"w{k}").alias(f"{end}{k}") for k in range(words)]), end)
    shared = pairs.select("a", "b", *[F.col(f"a{k}").bitwiseAND(F.col(f"b{k}")).alias(f"w{k}") for k in range(words)])
    return shared.where(" or ".join(f"w{k} != 0" for k in range(words)))


def triangle_cells(graph: Graph, edges_a_task: int = EDGES_A_TASK, colours: int | None = None) -> DataFrame:
    """(a, b, c), a < b < c: each triangle of distinct vertices once; loops, repeated edges and directions don't matter."""
    pairs = cut(undirected(graph).where("a is not null and b is not null"), "pairs")
    p = colours or max(1, math.ceil(math.sqrt(6 * pairs.count() / edges_a_task)))

    words = -(-p // WORD) if p > FEW else 0
    if words:
        pairs = _with_sets(pairs, p, words)

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            if words:
                shared = np.stack([batch.column(f"w{k}").to_numpy() for k in range(words)])
                edge, third = np.nonzero((shared[np.arange(p) // WORD].T >> (np.arange(p) % WORD)) & 1)
            else:
                edge, third = np.repeat(np.arange(len(a)), p), np.tile(np.arange(p), len(a))
            x, y = ((mix64(c) % np.uint64(p)).astype(np.int64)[edge] for c in (a, b))
            colours = np.sort(np.stack([x, y, third]), axis=0)
            cell = (colours[0] * p + colours[1]) * p + colours[2]
            yield pa.RecordBatch.from_pydict({"cell": cell, "a": a[edge], "b": b[edge]})

    def find(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        for corners in _local(table.column("a").to_numpy(), table.column("b").to_numpy()):
            corners = np.sort(np.stack(corners), axis=0)
            colours = np.sort((mix64(corners.ravel()) % np.uint64(p)).astype(np.int64).reshape(3, -1), axis=0)
            own = (colours[0] * p + colours[1]) * p + colours[2] == cell  # others are found in the cells of their colours
            for k in range(3):
                out[k].append(corners[k][own])
        return pa.table({n: np.concatenate(c) for n, c in zip("abc", out)})

    width = max(int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    sent = pairs.mapInArrow(spread, "cell long, a long, b long").repartition(width, "cell")
    return sent.groupBy("cell").applyInArrow(find, "a long, b long, c long")


def triangle_count(graph: Graph, **options) -> DataFrame:
    return triangle_cells(graph, **options).agg(F.count("*").alias("triangles"))
