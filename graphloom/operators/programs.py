"""The vertex programs and their runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans.storage import cut
from graphloom.plans.superstep import NARROW, Run, VertexProgram, run

DAMPING = 0.85


def pagerank_program(threshold: float = 0.01) -> VertexProgram:
    """r0 = 1; r = 0.15 + 0.85 * sum of r / out_degree over in-edges; not normalised.

    Every vertex sends each round; a vertex counts as active if its rank moved by over ``threshold``.
    """
    rank = F.lit(1 - DAMPING) + F.lit(DAMPING) * F.coalesce("m_r", F.lit(0.0))
    return VertexProgram(
        "pagerank",
        init=lambda: {"rank": F.lit(1.0), "active": F.lit(True)},
        message=lambda: {"r": F.col("s_rank") / F.col("s_out_degree")},
        combine={"r": "sum"},
        apply=lambda: {"rank": rank, "active": F.abs(rank - F.col("rank")) > threshold},
    )


def pagerank(graph: Graph, rounds: int = 20, threshold: float = 0.01, **options) -> Run:
    return run(graph, pagerank_program(threshold), rounds, **options)


def _least(name: str, init: Column, active: Column, message: Column) -> VertexProgram:
    """Programs that spread a least value along edges; null is "not reached"."""
    better = F.col("m_x").isNotNull() & (F.col("value").isNull() | (F.col("m_x") < F.col("value")))
    return VertexProgram(
        name,
        init=lambda: {"value": init, "active": active},
        message=lambda: {"x": message},
        combine={"x": "min"},
        apply=lambda: {"value": F.when(better, F.col("m_x")).otherwise(F.col("value"))},
        active=lambda: better,
        frontier=True,
        quiet=True,
    )


def bfs_program(start: int) -> VertexProgram:
    at = F.col("id") == start
    return _least("bfs", F.when(at, F.lit(0).cast("long")), at, F.col("s_value") + 1)


def _inside(graph: Graph, start: int) -> None:
    if not 0 <= start < graph.n:
        raise ValueError(f"start vertex {start} is outside 0 .. {graph.n - 1}")


def bfs(graph: Graph, start: int = 100, max_rounds: int | None = None, **options) -> Run:
    """Hops from ``start``; null where it doesn't reach."""
    _inside(graph, start)
    return run(graph, bfs_program(start), max_rounds, **options)


def sssp_program(start: int) -> VertexProgram:
    at = F.col("id") == start
    return _least("sssp", F.when(at, F.lit(0.0)), at, F.col("s_value") + F.col("weight"))


def sssp(graph: Graph, start: int = 100, max_rounds: int | None = None, **options) -> Run:
    """Least path weight from ``start``; needs a weight column, weights not negative."""
    _inside(graph, start)
    if max_rounds is None and not graph.edges.where("weight < 0").isEmpty():  # a cycle of them would never settle
        raise ValueError("negative weights")
    return run(graph, sssp_program(start), max_rounds, **options)


def sssp_buckets(graph: Graph, start: int = 100, delta: float | None = None, narrow: int = NARROW) -> Run:
    """``sssp`` by delta-stepping: vertices send in the order of their distance, by buckets of ``delta``.

    A bucket's vertices send until few are left that changed; these wait for the next one (``superstep.Turns``). So a
    vertex that gets a shorter path later has mostly not sent yet. ``delta`` is twice the mean weight unless given.
    ``Run.counts`` has the messages and changed rows of each round.
    """
    _inside(graph, start)
    weights = graph.edges.agg(F.min("weight").alias("least"), F.avg("weight").alias("mean")).first()
    if (weights["least"] or 0) < 0:
        raise ValueError("negative weights")
    return run(graph, replace(sssp_program(start), order=("value", delta or 2 * (weights["mean"] or 0.5))), None, narrow=narrow)


def cc_program() -> VertexProgram:
    return _least("cc", F.col("id"), F.lit(True), F.col("s_value"))


def cc(graph: Graph, max_rounds: int | None = None, directed: bool = True, **options) -> Run:
    """Least id among the vertices that reach each one; weak components with ``directed=False``."""
    return run(graph if directed else graph.symmetrized(), cc_program(), max_rounds, **options)


def spmv_program(index: str = "target", x: Column | None = None, weighted: bool = False) -> VertexProgram:
    """One round: y(v) = sum of a(u, v) * x(v or u) over in-edges; with ``index`` "target" an edge reads its target's x."""
    a = F.col("weight") if weighted else F.lit(1.0)
    own = F.col("id").cast("double") if x is None else x
    return VertexProgram(
        "spmv",
        init=lambda: {"x": own, "y": F.lit(0.0)},
        message=lambda: {"y": a * F.col("t_x" if index == "target" else "s_x")},
        combine={"y": "sum"},
        apply=lambda: {"x": F.col("x"), "y": F.coalesce("m_y", F.lit(0.0))},
        target=("x",) if index == "target" else (),
        degrees=False,
    )


def spmv(graph: Graph, index: str = "target", x: Column | None = None, weighted: bool = False) -> DataFrame:
    """(id, y): y(v) = sum of a(u, v) * x(v or u) over in-edges, with x(i) = i unless given as a column of ``id``."""
    return run(graph, spmv_program(index, x, weighted), 1).state.select("id", "y")


def undirected(graph: Graph) -> DataFrame:
    """(a, b), a < b: distinct pairs, no loops."""
    return graph.edges.where("src != tgt").select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct()


def _oriented(graph: Graph) -> DataFrame:
    """(a, b) from the end of lower degree to the other: no vertex has more than sqrt(2 |E|) out-edges, so hubs make few wedges."""
    pairs = cut(undirected(graph), "pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    da, db = degree.select(F.col("v").alias("a"), F.col("d").alias("da")), degree.select(F.col("v").alias("b"), F.col("d").alias("db"))
    both = pairs.join(da, "a").join(db, "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return cut(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b")), "oriented")


def triangles(graph: Graph) -> DataFrame:
    """(a, b, c): each undirected triangle once."""
    e = _oriented(graph)
    wedges = e.alias("x").join(e.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b"))).select(F.col("x.a").alias("a"), F.col("x.b").alias("p"), F.col("y.b").alias("q"))
    closing = e.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    return wedges.join(closing, ["p", "q"]).select("a", F.col("p").alias("b"), F.col("q").alias("c"))


def triangle_count(graph: Graph) -> DataFrame:
    return triangles(graph).agg(F.count("*").alias("triangles"))


def triangles_per_vertex(graph: Graph) -> DataFrame:
    counted = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("v")).groupBy("v").agg(F.count("*").alias("t"))
    ids = graph.edges.sparkSession.range(graph.n)
    return ids.join(counted, ids["id"] == counted["v"], "left").select("id", F.coalesce("t", F.lit(0)).alias("triangles"))


def wedges_per_vertex(graph: Graph) -> DataFrame:
    """(id, wedges): pairs of distinct neighbours."""
    degree = undirected(graph).select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    ids = graph.edges.sparkSession.range(graph.n)
    d = F.coalesce("d", F.lit(0))
    return ids.join(degree, ids["id"] == degree["v"], "left").select("id", (d * (d - 1) / 2).cast("long").alias("wedges"))


MINHASH_PRIME = 2147483647


def triangles_minhash(graph: Graph, hashes: int = 8) -> DataFrame:
    """(id, estimate): T(v) = sum over neighbours u of Z / (Z + m) * (d(u) + d(v)) / 2, Z the number of equal minima of hashed neighbour sets."""
    pairs = cut(undirected(graph), "pairs")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # (factor * neighbour + shift) mod a prime: equal minima are as likely as the sets are alike
    minima = [F.min((F.lit(48271 * (j + 1)) * F.col("b") + F.lit(11 * j + 7)) % F.lit(MINHASH_PRIME)).alias(f"h{j}") for j in range(hashes)]
    sketch = cut(both.groupBy("a").agg(F.count("*").alias("d"), *minima).select("a", "d", F.array(*[f"h{j}" for j in range(hashes)]).alias("h")), "sketch")
    u, v = sketch.select(F.col("a"), F.col("d").alias("da"), F.col("h").alias("ha")), sketch.select(F.col("a").alias("b"), F.col("d").alias("db"), F.col("h").alias("hb"))
    z = F.size(F.filter(F.zip_with("ha", "hb", lambda x, y: x == y), lambda same: same))
    scored = both.join(u, "a").join(v, "b").select("a", (z / (z + F.lit(hashes)) * (F.col("da") + F.col("db")) / 2).alias("t"))
    summed = scored.groupBy("a").agg(F.sum("t").alias("t"))
    ids = graph.edges.sparkSession.range(graph.n)
    return ids.join(summed, ids["id"] == summed["a"], "left").select("id", F.coalesce("t", F.lit(0.0)).alias("estimate"))


def belief_program(rounds: int, prior0: Column | None = None) -> VertexProgram:
    """A two-state model: rounds alternate EMIT, p(v) = product of p(u), and ABSORB, m(v) = sum of w * prior(v) * p(u) / p(v);
    the last round is CONVERGED, belief(v) ~ prior(v) * product of m(u), normalised. Products are kept as sums of logarithms (l0, l1)."""
    p0 = F.lit(0.5) if prior0 is None else prior0
    both, kept = (0, 1), lambda *names: {n: F.col(n) for n in names}

    def start() -> dict[str, Column]:
        return {"q0": p0, "q1": 1 - p0, **{n: F.lit(0.0) for n in ("l0", "l1", "m0", "m1")}}

    def emit() -> dict[str, Column]:
        return kept("q0", "q1", "m0", "m1") | {f"l{k}": F.coalesce(f"m_x{k}", f"l{k}") for k in both}

    def absorb() -> dict[str, Column]:
        return kept("q0", "q1", "l0", "l1") | {f"m{k}": F.coalesce(F.col(f"m_x{k}") * F.col(f"q{k}") / F.exp(f"l{k}"), F.lit(0.0)) for k in both}

    def converged() -> dict[str, Column]:
        score = [F.when(F.col(f"m_least{k}") <= 0, F.lit(float("-inf"))).otherwise(F.ln(F.col(f"q{k}")) + F.coalesce(F.col(f"m_x{k}"), F.lit(0.0))) for k in both]
        top = F.greatest(*score)
        e0, e1 = (F.exp(s - top) for s in score)
        return {f"belief{k}": F.when(top == F.lit(float("-inf")), 0.0).otherwise(e / (e0 + e1)) for k, e in enumerate((e0, e1))}

    def program(message, combine, apply) -> VertexProgram:
        return VertexProgram("bp", start, message, combine, apply, degrees=False)

    emitting = program(lambda: {f"x{k}": F.col(f"s_l{k}") for k in both}, {"x0": "sum", "x1": "sum"}, emit)
    absorbing = program(lambda: {f"x{k}": F.col("weight") * F.exp(f"s_l{k}") for k in both}, {"x0": "sum", "x1": "sum"}, absorb)
    ending = program(
        lambda: {f"x{k}": F.ln(F.col(f"s_m{k}")) for k in both} | {f"least{k}": F.col(f"s_m{k}") for k in both},
        {"x0": "sum", "x1": "sum", "least0": "min", "least1": "min"},
        converged,
    )

    def turn(number: int, state: DataFrame) -> VertexProgram:
        return ending if number + 1 == rounds else absorbing if number % 2 else emitting

    return VertexProgram("bp", start, emitting.message, emitting.combine, emitting.apply, degrees=False, before_round=turn)


def belief_propagation(graph: Graph, rounds: int, prior0: Column | None = None, **options) -> DataFrame:
    """(id, belief0, belief1) after ``rounds`` rounds of ``belief_program``."""
    if not rounds:
        return graph.edges.sparkSession.range(graph.n).select("id", F.lit(0.5).alias("belief0"), F.lit(0.5).alias("belief1"))
    return run(graph, belief_program(rounds, prior0), rounds, **options).state.select("id", "belief0", "belief1")


def nearest(x: Column, centroids: list[float]) -> Column:
    """Index of the nearest centroid; ties go to the lowest."""
    best, at = F.abs(x - F.lit(centroids[0])), F.lit(0)
    gaps = [F.abs(x - F.lit(c)) for c in centroids]
    for k, gap in enumerate(gaps[1:], 1):
        at = F.when(gap < best, F.lit(k)).otherwise(at)
        best = F.least(best, gap)
    return at


def kmeans_1d(points: DataFrame, column: str, centroids: list[float], rounds: int) -> tuple[DataFrame, list[float]]:
    """``points`` with ``cluster`` after ``rounds`` of Lloyd's steps, and the centroids; an empty cluster keeps its own."""
    centroids = [float(c) for c in centroids]
    for _ in range(rounds):
        means = points.groupBy(nearest(F.col(column), centroids).alias("k")).agg(F.avg(column).alias("m")).collect()  # one row per centroid
        for r in means:
            if r["m"] is not None:
                centroids[r["k"]] = r["m"]
    return points.withColumn("cluster", nearest(F.col(column), centroids)), centroids
