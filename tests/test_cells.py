import random

import pytest

from graphloom.graph import Graph
from graphloom.operators import cells, programs


def graph(spark, edges, n):
    return Graph(spark.createDataFrame(edges, "src long, tgt long"), n)


def by_hand(edges):
    near = {frozenset(e) for e in edges if None not in e and e[0] != e[1]}
    ids = sorted({v for e in near for v in e})
    return sorted((a, b, c) for i, a in enumerate(ids) for j, b in enumerate(ids[i + 1 :], i + 1) if frozenset((a, b)) in near for c in ids[j + 1 :] if frozenset((a, c)) in near and frozenset((b, c)) in near)


@pytest.mark.parametrize("colours", [1, 2, 5])
def test_every_triangle_once(spark, monkeypatch, colours):
    monkeypatch.setattr(cells, "WEDGES", 37)
    rng = random.Random(colours)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(220)] + [(1 << 40, 3), (3, 5), (5, 1 << 40), (None, 3), (2, 2)]
    got = sorted(map(tuple, cells.triangle_cells(graph(spark, edges, 40), colours=colours).collect()))
    assert got == by_hand(edges)


def test_none(spark):
    assert cells.triangle_count(graph(spark, [], 3)).first()[0] == 0
    assert cells.triangle_cells(graph(spark, [(0, 1), (1, 2)], 3)).collect() == []


def shuffled_rows(df):
    df.collect()
    found = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


def test_dense_graphs_shuffle_less_than_wedges(spark):
    """Sixty hubs that all know each other, and some thousand vertices that know a few hubs."""
    rng = random.Random(2)
    edges = [(a, b) for a in range(60) for b in range(a)] + [(v, h) for v in range(60, 1500) for h in rng.sample(range(60), 6)]
    g = graph(spark, edges, 1500)
    own, wedges = cells.triangle_cells(g, colours=3), programs.triangles(g)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled_rows(own) < shuffled_rows(wedges)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert own.count() == wedges.count()


@pytest.mark.parametrize("colours", [17, 63, 64, 130])
def test_every_triangle_once_by_sets_of_colours(spark, colours):
    rng = random.Random(colours)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(300)] + [(0, k) for k in range(1, 60)] + [(1 << 40, 3), (3, 5), (5, 1 << 40), (None, 3), (2, 2)]
    got = sorted(map(tuple, cells.triangle_cells(graph(spark, edges, 60), colours=colours).collect()))
    assert got == by_hand(edges)
    assert cells.triangle_cells(graph(spark, [(0, 1), (1, 2)], 3), colours=colours).collect() == []


def test_edges_go_where_both_ends_have_a_neighbour(spark):
    """Of 600 edges with 60 colours, sent 36,000 times to all triples, few are sent more often than their triangles need."""
    rng = random.Random(8)
    edges = [(v, (v + 1 + rng.randrange(280)) % 300) for v in range(300) for _ in range(2)]
    sent = cells.triangle_cells(graph(spark, edges, 300), colours=60)
    assert shuffled_rows(sent) < 6000
