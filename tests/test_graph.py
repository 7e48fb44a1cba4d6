"""The six-edge graph, the path graph and small brute-force checks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph, decode_ids, encode_ids
from graphloom.operators import programs
from graphloom.plans import superstep
from graphloom.plans.storage import keep_round
from graphloom.plans.superstep import VertexProgram, ranges_of, run

SIX = [(0, 1), (3, 1), (0, 2), (1, 2), (1, 3), (3, 0)]


def graph(spark, edges, n, weights=None):
    rows = [(s, t, float(weights[k]) if weights else 1.0) for k, (s, t) in enumerate(edges)]
    return Graph(spark.createDataFrame(rows, "src long, tgt long, weight double"), n)


def values(done, name="value"):
    return [r[name] for r in done.state.orderBy("id").collect()]


def test_degrees(spark):
    rows = graph(spark, SIX, 4).degrees().orderBy("id").collect()
    assert [(r.in_degree, r.out_degree) for r in rows] == [(1, 2), (2, 2), (2, 0), (1, 2)]


@pytest.mark.parametrize("rounds, expected", [(1, [0.575, 1.0, 1.0, 0.575]), (2, [0.394375, 0.63875, 0.819375, 0.575]), (20, [0.28784124, 0.41017537, 0.44666148, 0.32432735])])
def test_pagerank(spark, rounds, expected):
    got = values(programs.pagerank(graph(spark, SIX, 4), rounds), "rank")
    assert all(math.isclose(a, b, abs_tol=1e-7) for a, b in zip(got, expected))


def test_min_programs(spark):
    g = graph(spark, SIX, 4)
    assert values(programs.bfs(g, 0)) == [0, 1, 1, 2]
    assert values(programs.cc(g)) == [0, 0, 0, 0]
    assert [r.y for r in programs.spmv(g).orderBy("id").collect()] == [0, 2, 4, 3]
    assert programs.triangle_count(g).first()[0] == 2


@pytest.mark.parametrize("split", [1, 2, 100])
def test_hubs_are_dealt_out(spark, split):
    edges = [(0, k) for k in range(1, 12)] + [(k, 0) for k in range(1, 12)] + [(3, 4)]
    g = graph(spark, edges, 13)
    assert values(programs.bfs(g, 2, split=split)) == [1, 2, 0] + [2] * 9 + [None]
    plain = values(programs.pagerank(g, 4), "rank")
    assert all(math.isclose(a, b) for a, b in zip(values(programs.pagerank(g, 4, split=split), "rank"), plain))


def test_path_keeps_what_it_found(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)], 4)
    done = programs.bfs(g, 0)
    assert values(done) == [0, 1, 2, 3] and done.rounds == 4
    assert values(run(g, programs.bfs_program(0), 2)) == [0, 1, 2, None]
    assert done.lines()[0].startswith("Round Time for iteration 0 ")
    with pytest.raises(ValueError):
        programs.bfs(g, 4)


def test_paths_of_over_a_thousand_hops(spark, tmp_path):
    """Round 1000 of a path of 1005 hops, kept, is gone on from until nobody is active."""
    n, at = 1006, 1001  # vertex at is the frontier after round 1000
    g = graph(spark, [(k, k + 1) for k in range(n - 1)], n)
    for name, call, value in (("bfs", programs.bfs, "id"), ("sssp", programs.sssp, "cast(id as double)"), ("cc", lambda g, _, **o: programs.cc(g, **o), "cast(0 as long)")):
        rest = "id" if name == "cc" else "null"
        kept = g.vertices().selectExpr("id", "in_degree", "out_degree", f"case when id <= {at} then {value} else {rest} end as value", f"id = {at} as active")
        path = f"file://{tmp_path}/{name}"
        keep_round(kept, path, name, 1000)
        done = call(g, 0, checkpoint=path)
        assert values(done) == ([0] * n if name == "cc" else list(range(n))) and done.settled


def test_bounds_are_told(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)], 4)
    assert programs.bfs(g, 0).settled is True and programs.bfs(g, 0, 2).settled is False and programs.bfs(g, 0, 0).settled is False
    assert programs.pagerank(g, 1).settled is None
    with pytest.raises(ValueError):
        run(g, programs.pagerank_program(), None)
    with pytest.raises(ValueError):
        programs.sssp(graph(spark, [(0, 1), (1, 0)], 2, [1, -2]), 0)


def test_programs_may_read_the_target(spark):
    """SpMV with either index, and a message that divides by the target's in-degree."""
    random.seed(4)
    edges = [(random.randrange(20), random.randrange(20)) for _ in range(70)]
    weights = [random.randrange(1, 9) for _ in edges]
    g = graph(spark, edges, 20, weights)
    for index, end in (("target", 1), ("source", 0)):
        truth = [0.0] * 20
        for e, w in zip(edges, weights):
            truth[e[1]] += w * e[end]
        assert [r.y for r in programs.spmv(g, index, weighted=True).orderBy("id").collect()] == truth
    shares = VertexProgram(
        "shares",
        init=lambda: {"value": F.lit(0.0)},
        message=lambda: {"x": 1 / F.col("t_in_degree")},
        combine={"x": "sum"},
        apply=lambda: {"value": F.col("value") + F.coalesce("m_x", F.lit(0.0))},
        target=("in_degree",),
    )
    got = values(run(g, shares, 3))
    reached = {t for _, t in edges}
    assert all(math.isclose(x, 3.0 if v in reached else 0.0) for v, x in enumerate(got))


def test_pagerank_tells_who_moved(spark):
    """After each round the vertices whose rank moved by more than the threshold, by hand."""
    rank, moved, out = [1.0] * 4, [], [2, 2, 0, 2]
    for _ in range(6):
        new = [0.15 + 0.85 * sum(rank[s] / out[s] for s, t in SIX if t == v) for v in range(4)]
        moved.append(sum(abs(a - b) > 0.05 for a, b in zip(new, rank)))
        rank = new
    done = programs.pagerank(graph(spark, SIX, 4), 6, threshold=0.05)
    assert [a for _, a, _ in done.log] == moved and len(set(moved)) > 1
    assert [tuple(r)[:2] for r in done.metrics(spark).orderBy("round").collect()] == list(enumerate(moved))


def test_rounds_by_hand(spark):
    """Programs given round by round: emit, absorb, emit, converged."""
    random.seed(7)
    edges = [(random.randrange(8), random.randrange(8)) for _ in range(24)]
    weights = [random.choice([0.5, 0.8, 0.9]) for _ in edges]
    prior, n = [(v % 4 + 1) / 6 for v in range(8)], 8
    beliefs = []
    for q in (prior, [1 - p for p in prior]):
        l, m = [0.0] * n, [0.0] * n
        incoming = [[k for k, e in enumerate(edges) if e[1] == v] for v in range(n)]
        for number in range(4):
            if number % 2 == 0:
                l = [sum(l[edges[k][0]] for k in incoming[v]) if incoming[v] else l[v] for v in range(n)]
            elif number < 3:
                m = [sum(weights[k] * math.exp(l[edges[k][0]]) for k in incoming[v]) * q[v] / math.exp(l[v]) for v in range(n)]
        beliefs.append([q[v] * math.prod(m[edges[k][0]] for k in incoming[v]) for v in range(n)])
    got = programs.belief_propagation(graph(spark, edges, n, weights), 4, (F.pmod("id", F.lit(4)) + 1) / 6).orderBy("id").collect()
    for r, a, b in zip(got, *beliefs):
        assert math.isclose(r.belief0, a / (a + b) if a + b else 0.0, abs_tol=1e-9)


@pytest.mark.parametrize("stretches, most, expected", [([], 4, []), ([5], 4, [(5, 5)]), ([1, 2, 3, 9], 4, [(1, 3), (9, 9)]), ([1, 5, 6, 20, 40], 2, [(1, 20), (40, 40)]), ([3, 1], 1, [(1, 3)])])
def test_ranges_hold_all_stretches(stretches, most, expected):
    assert ranges_of(stretches, most) == expected


def test_small_frontiers_read_few_edges(spark, monkeypatch):
    """A long path, of which each round reads one stretch: same hops as with all edges."""
    n = 600
    edges = [(k, k + 1) for k in range(n - 1)] + [(5, 400)]
    seen = []
    plain = superstep._among
    monkeypatch.setattr(superstep, "_among", lambda e, stretches, bits: seen.append(plain(e, stretches, bits) is e) or plain(e, stretches, bits))
    done = programs.bfs(graph(spark, edges, n), 580, narrow=0)
    assert values(done) == [None] * 580 + list(range(20)) and seen[0] and not any(seen[1:-1])


def test_activity_may_be_reduced(spark, tmp_path):
    """Vertices that hear from an active source or point at an active target, and the round's table."""
    heard = VertexProgram(
        "heard",
        init=lambda: {"value": F.lit(False), "active": F.col("id") == 3},
        message=lambda: {"s": F.col("s_active"), "t": F.col("t_active")},
        combine={"s": "any", "t": "all"},
        apply=lambda: {"value": F.coalesce("m_s", F.lit(False)), "active": F.coalesce("m_s", F.lit(False))},
        target=("active",),
    )
    done = run(graph(spark, SIX, 4), heard, 2)
    assert values(done) == [False, True, True, True] and [a for _, a, _ in done.log] == [2, 3]
    done.write_metrics(spark, f"{tmp_path}/rounds")
    assert spark.read.csv(f"{tmp_path}/rounds", header=True).count() == 2


def test_old_states_go(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    programs.pagerank(graph(spark, SIX, 4), 5, checkpoint=path)
    assert sorted(p.name for p in (tmp_path / "kept").iterdir()) == ["pagerank-00000003", "pagerank-00000004"]


def test_sssp_and_weak_components(spark):
    random.seed(5)
    edges = [(random.randrange(30), random.randrange(30)) for _ in range(60)]
    weights = [random.randrange(1, 20) for _ in edges]
    g = graph(spark, edges, 30, weights)
    best = {0: 0.0}
    for _ in range(30):
        for (s, t), w in zip(edges, weights):
            if s in best and best[s] + w < best.get(t, math.inf):
                best[t] = best[s] + w
    assert values(programs.sssp(g, 0)) == [best.get(v) for v in range(30)]
    label = list(range(30))
    for _ in range(30):
        for s, t in edges:
            label[s] = label[t] = min(label[s], label[t])
    assert values(programs.cc(g, directed=False)) == label


def test_triangles_against_brute_force(spark):
    random.seed(2)
    edges = [(random.randrange(15), random.randrange(15)) for _ in range(60)]
    near = {frozenset(e) for e in edges if e[0] != e[1]}
    expected = {(a, b, c) for a in range(15) for b in range(a) for c in range(b) if {frozenset((a, b)), frozenset((a, c)), frozenset((b, c))} <= near}
    g = graph(spark, edges, 15)
    assert programs.triangle_count(g).first()[0] == len(expected)
    per = {r.id: r.triangles for r in programs.triangles_per_vertex(g).collect()}
    assert per == {v: sum(v in t for t in expected) for v in range(15)}


def test_dictionary_round_trip(spark):
    rows = [(0, 1, 2), (1, 3, 2), (2, 1, 4), (3, 2, 4), (4, 2, 3), (5, 3, 1)]
    edges = spark.createDataFrame(rows, "pos long, src long, tgt long")
    known = {r.id: r.orig_id for r in encode_ids(edges).collect()}
    assert known == {0: 1, 1: 2, 2: 3, 3: 4}
    g, ids = Graph.from_original_ids(edges)
    back = decode_ids(g.degrees().select("id", "in_degree"), ids)
    assert {r.orig_id: r.in_degree for r in back.collect()} == {1: 1, 2: 2, 3: 1, 4: 2}


def test_vertex_count_defaults(spark):
    none = spark.createDataFrame([], "src long, tgt long")
    assert Graph.from_dataframe(none).n == 0 and Graph.from_dataframe(none).degrees().count() == 0
    assert Graph.from_dataframe(spark.createDataFrame([(0, 0)], "src long, tgt long")).n == 1


def test_out_of_bounds_edges_raise(spark):
    with pytest.raises(Exception, match="out of bounds"):
        graph(spark, [(0, 9)], 4).checked().edges.collect()


def test_resume(spark, tmp_path):
    g = graph(spark, SIX, 4)
    whole = values(programs.pagerank(g, 6), "rank")
    path = f"file://{tmp_path}/kept"
    programs.pagerank(g, 3, checkpoint=path)
    again = programs.pagerank(g, 6, checkpoint=path)
    assert [k for k, _, _ in again.log] == [3, 4, 5]
    assert all(math.isclose(a, b) for a, b in zip(values(again, "rank"), whole))


def test_kmeans_ties_and_empty_clusters(spark):
    points = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (10.0,)], "x double")
    assigned = points.select("x", programs.nearest(F.col("x"), [0.0, 2.0]).alias("k")).orderBy("x")
    assert [r.k for r in assigned.collect()] == [0, 0, 1, 1]
    _, centroids = programs.kmeans_1d(points, "x", [0.0, 2.0, 99.0], 5)
    assert centroids[2] == 99.0 or centroids[2] == 10.0


def test_belief_normalised(spark):
    rows = programs.belief_propagation(graph(spark, SIX, 4), 3).collect()
    assert all(math.isclose(r.belief0 + r.belief1, 1.0) for r in rows)
