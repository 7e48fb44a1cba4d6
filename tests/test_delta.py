"""Rounds in proportion to their frontier, stored edges, and what is built on them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import components, frontiers, programs, tiling
from graphloom.plans import delta, superstep
from graphloom.plans.superstep import run


def graph(spark, edges, n, weights=None):
    rows = [(*e, float(w)) for e, w in zip(edges, weights)] if weights else edges
    return Graph(spark.createDataFrame(rows, "src long, tgt long" + (", weight double" if weights else "")), n)


def values(df, name="value"):
    return [r[name] for r in df.select("id", name).orderBy("id").collect()]


def hops(edges, n, start):
    out, front, k = {start: 0}, {start}, 0
    while front:
        k += 1
        front = {t for s, t in edges if s in front and 0 <= t < n and t not in out}
        out |= dict.fromkeys(front, k)
    return [out.get(v) for v in range(n)]


def shortest(edges, weights, n, start):
    best = {start: 0.0}
    for _ in range(n):
        for (s, t), w in zip(edges, weights):
            if s in best and best[s] + w < best.get(t, math.inf):
                best[t] = best[s] + w
    return [best.get(v) for v in range(n)]


def least(edges, n):
    label = list(range(n))
    for _ in range(n):
        for s, t in edges:
            label[s] = label[t] = min(label[s], label[t])
    return label


def some_edges(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)], [rng.randrange(0, 30) for _ in range(m)]


@pytest.mark.parametrize("narrow", [0, 12, 250_000])
def test_both_kinds_of_rounds_agree(spark, monkeypatch, narrow):
    """Wide, narrow and mixed runs; several stretches and a log of several levels."""
    monkeypatch.setattr(delta, "STRETCH_ROWS", 20)
    monkeypatch.setattr(delta, "MERGED", 2)
    edges, weights = some_edges(3, 60, 110)
    g = graph(spark, edges, 60, weights)
    done = programs.bfs(g, edges[0][0], narrow=narrow)
    assert values(done.state) == hops(edges, 60, edges[0][0]) and done.settled
    kinds = {narrow for *_, narrow in done.counts}
    assert kinds == ({False} if narrow == 0 else {True, False} if narrow == 12 else {True})
    assert not done.state.where("active").count()
    if narrow == 12:
        assert values(programs.sssp(g, edges[0][0], narrow=narrow).state) == shortest(edges, weights, 60, edges[0][0])


def test_a_round_writes_what_changes(spark):
    """A long path with a few branches: each round's rows are those that a search by hand reaches then."""
    n = 24
    edges = [(k, k + 1) for k in range(n - 1)] + [(2, 16), (2, 17), (3, 2)]
    seen = []
    done = programs.bfs(graph(spark, edges, n), 0, on_round=lambda k, state: seen.append(state.where("value is not null").count()))
    by_hand = hops(edges, n, 0)
    assert values(done.state) == by_hand
    assert [w for _, _, w, _ in done.counts] == [by_hand.count(k + 1) for k in range(len(done.counts))]
    assert [m for _, m, _, _ in done.counts] == [sum(by_hand[s] == k for s, _ in edges) for k in range(len(done.counts))]
    assert seen == [sum(h <= k + 1 for h in by_hand) for k in range(len(seen))]
    assert [r.written for r in done.metrics(spark).orderBy("round").collect()] == [w for _, _, w, _ in done.counts]


@pytest.mark.parametrize("narrow", [0, 12, 250_000])
def test_counters_do_not_depend_on_the_kind_of_round(spark, narrow):
    edges, _ = some_edges(3, 60, 110)
    start = edges[0][0]
    done, by_hand = programs.bfs(graph(spark, edges, 60), start, narrow=narrow), hops(edges, 60, start)
    rows = [(r.round, r.active, r.messages, r.written) for r in done.metrics(spark).orderBy("round").collect()]
    assert rows == [(k, by_hand.count(k + 1), sum(by_hand[s] == k for s, _ in edges), by_hand.count(k + 1)) for k in range(max(x for x in by_hand if x is not None) + 1)]


def test_a_bound_ends_a_run(spark):
    edges = [(k, k + 1) for k in range(9)]
    done = run(graph(spark, edges, 10), programs.bfs_program(0), 4)
    assert values(done.state) == [0, 1, 2, 3, 4] + [None] * 5 and done.settled is False and done.state.where("active").count() == 1


@pytest.mark.parametrize("edges, n", [([], 3), ([(0, 9), (0, -1), (0, 1), (None, 1), (1, None)], 3), ([(0, 0)], 1)])
def test_odd_edges(spark, edges, n):
    g = graph(spark, edges, n)
    want = [0, 1 if (0, 1) in edges else None, None][:n]
    assert values(programs.bfs(g, 0).state) == want
    assert values(frontiers.bfs_bitmaps(g, 0).state) == want
    assert values(components.weak_components(g)[0]) == [0, 0 if (0, 1) in edges else 1, 2][:n]


def files_read(df):
    """Files that the scans below a plan have read, in the order of the plan."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().executedPlan().executeCollect()
    found = []

    def walk(node):
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)
    return found


def test_only_the_frontiers_stretches_are_read(spark, monkeypatch):
    monkeypatch.setattr(delta, "STRETCH_ROWS", 10)
    edges, _ = some_edges(5, 640, 2000)
    stretches = delta.Stretches(640, 640)
    store = delta.StretchStore(spark.createDataFrame(edges, "src long, tgt long"), stretches, 1)
    named = spark.createDataFrame([(3,), (4,), (600,)], "s_id long")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sent = store.sent(named)
        assert sorted((r.src, r.tgt) for r in sent.collect()) == sorted(e for e in edges if e[0] in (3, 4, 600))
        assert files_read(sent) == [len({3 >> stretches.bits, 600 >> stretches.bits})]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_a_run_over_tiles_reads_active_ones(spark, tmp_path, monkeypatch):
    edges, n = [(k, k + 1) for k in range(255)] + [(0, 255), (3, 200)], 256
    path = f"file://{tmp_path}/stored"
    g = graph(spark, edges, n)
    tiling.store_tiles(tiling.tiled(g.edges, n, 16), path, n, buckets=32)
    store = delta.TileStore(spark, path)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sent = store.sent(spark.createDataFrame([(17,), (18,), (3,)], "s_id long"))
        assert sorted((r.src, r.tgt) for r in sent.collect()) == [(3, 4), (3, 200), (17, 18), (18, 19)]
        files = store.tiles.select("tile_bucket", F.input_file_name().alias("file"), "src").distinct()
        buckets = [r.tile_bucket for r in files.where("src in (3, 17, 18)").select("tile_bucket").distinct().collect()]
        own, every = files.where(F.col("tile_bucket").isin(buckets)).select("file").distinct().count(), files.select("file").distinct().count()
        assert files_read(sent)[0] == own < every / 2  # those in the buckets of active tiles, no other
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    stored = Graph(store.all_edges(), n)
    assert values(run(stored, programs.bfs_program(3), None, tiles=path).state) == hops(edges, n, 3)


def test_buckets_of_distance(spark):
    edges, weights = some_edges(9, 30, 100)
    g = graph(spark, edges, 30, weights)
    want = shortest(edges, weights, 30, edges[0][0])
    assert values(programs.sssp_buckets(g, edges[0][0], 12.0).state) == want
    assert values(programs.sssp_buckets(g, edges[0][0], narrow=0).state) == want
    with pytest.raises(ValueError):
        programs.sssp_buckets(graph(spark, [(0, 1)], 2, [-1]), 0)


def test_buckets_send_less(spark):
    """Jumps of random length along a line, the kind of graph on which a search by rounds sends again and again."""
    rng = random.Random(4)
    edges = [(v, v + 1 + rng.randrange(20)) for v in range(160) for _ in range(3)]
    edges = [e for e in edges if e[1] < 160]
    weights = [rng.randrange(1, 200) for _ in edges]
    g = graph(spark, edges, 160, weights)
    rounds, buckets = programs.sssp(g, 0), programs.sssp_buckets(g, 0)
    assert values(rounds.state) == values(buckets.state)
    assert sum(m for _, m, _, _ in buckets.counts) < sum(m for _, m, _, _ in rounds.counts)


@pytest.mark.parametrize("narrow", [0, 12, 250_000])
def test_few_left_of_a_bucket_wait(spark, narrow):
    """Many narrow buckets take little more rounds than a search by rounds, which takes 16, and held vertices outlast a change of the kind of round."""
    rng = random.Random(4)
    edges = [(v, v + 1 + rng.randrange(20)) for v in range(160) for _ in range(3)]
    edges = [e for e in edges if e[1] < 160]
    weights = [rng.randrange(1, 200) for _ in edges]
    done = programs.sssp_buckets(graph(spark, edges, 160, weights), 0, 20.0, narrow)
    assert values(done.state) == shortest(edges, weights, 160, 0) and done.settled
    assert len(done.counts) < 32 and {kind for *_, kind in done.counts} == ({False} if narrow == 0 else {True, False} if narrow == 12 else {True})
    assert sum(m for _, m, _, _ in done.counts) < 643  # those of the search by rounds


def test_turns(spark):
    turns = superstep.Turns(("value", 10.0), 4096)
    turns.look(100, 0, [3.0, 14.0, 14.0, 57.0], 57.0)  # 4096 / 1024 are fewer than a quarter
    assert (turns.bound, turns.held) == (10.0, True)
    turns.look(100, 25, [9.0, 14.0, 14.0, 57.0], 57.0)
    assert turns.bound == turns.sent == 10.0 and turns.held
    turns.look(5, 1, [9.0, 14.0, 57.0, 57.0], 57.0)
    assert (turns.sent, turns.bound, turns.held, turns.behind) == (10.0, 60.0, False, True)
    turns.look(2, 0, [math.nan] * 4, math.nan)
    assert math.isnan(turns.bound) and not turns.held


def test_weak_components(spark):
    edges, _ = some_edges(11, 80, 70)
    labels, rounds = components.weak_components(graph(spark, edges, 80))
    assert values(labels) == least(edges, 80) and rounds


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_long_path_takes_few_rounds(spark, shuffled):
    n = 10_000
    place = list(range(n))
    if shuffled:
        random.Random(6).shuffle(place)
    ends = spark.createDataFrame([(place[k], place[k + 1]) for k in range(n - 1)], "src long, tgt long")
    labels, rounds = components.weak_components(Graph(ends, n))
    assert labels.where("value = 0").count() == n and len(rounds) <= 20 and max(j for _, j in rounds) <= 20


@pytest.mark.parametrize("seed, m", [(1, 60), (2, 700)])
def test_bitmaps(spark, monkeypatch, seed, m):
    """Over several bitmaps, top-down and bottom-up."""
    rng = random.Random(seed)
    n = 100_000
    used = rng.sample(range(n), 50)
    edges = [(rng.choice(used), rng.choice(used)) for _ in range(m)]
    done = frontiers.bfs_bitmaps(graph(spark, edges, n), edges[0][0])
    assert values(done.state) == hops(edges, n, edges[0][0])
    monkeypatch.setattr(frontiers, "BOTTOM_UP", 10_000_000)
    up = frontiers.bfs_bitmaps(graph(spark, edges, n), edges[0][0])
    assert values(up.state) == values(done.state) and all(way == 1.0 for _, _, way in up.log[1:])
    plain = frontiers.bfs_bitmaps(graph(spark, edges, n), edges[0][0], most_bytes=0)
    assert values(plain.state) == values(done.state)


def test_bits(spark):
    ids = [0, 1, 7, 8, 32767, 32768, 65535, 65536, 99999]
    maps = frontiers.bitmaps(spark.createDataFrame([(i,) for i in ids * 2], "id long"), "id")
    met = spark.range(100_001).join(maps, frontiers.bucket(F.col("id")) == F.col("bucket"), "left")
    assert [r.id for r in met.where(frontiers.bit_set(F.col("bits"), F.col("id"))).orderBy("id").collect()] == ids
