import math
import os

import numpy as np
import pytest

from graphloom.llm import neighbours


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")


def rows_of(vectors, start=0):
    return [(start + k, [float(x) for x in v], 0, "clash") for k, v in enumerate(np.asarray(vectors, np.float32))]


def by_hand(rows, k, every):
    """Brute force: {query: [(vec_id, score)]} over the rows that take part."""
    sound = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in sound:
        if q % every == 0:
            best = {}
            for i, y in sound:
                if i != q:
                    best[i] = max(best.get(i, -math.inf), float((x * y).sum()))
            old = out.get(q, {})
            out[q] = {i: max(s, old.get(i, -math.inf)) for i, s in best.items()}
    return {q: sorted(b.items(), key=lambda p: (-p[1], p[0]))[:k] for q, b in out.items() if b}


def lists(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_everything_is_found_if_all_is_asked_for(spark):
    rng = np.random.default_rng(1)
    rows = rows_of(rng.standard_normal((150, 8)) * rng.uniform(0.1, 3, (150, 1)))
    rows += [(200 + k, rows[0][1], 0, "") for k in range(40)]  # copies, more than a list is long
    rows += [(300, rows[3][1], 0, ""), (301, [-x for x in rows[3][1]], 0, ""), rows[5], rows[5]]
    rows += [(400, None, 0, ""), (401, [0.0] * 8, 0, ""), (402, [math.nan] + [1.0] * 7, 0, ""), (403, [math.inf] + [1.0] * 7, 0, ""), (None, [1.0] * 8, 0, ""), (404, [None] + [1.0] * 7, 0, ""), (420, [-0.0, 1.0] * 4, 0, ""), (421, [0.0, 1.0] * 4, 0, "")]
    got = lists(neighbours.nearest(table(spark, rows + [(405, [1.0], 0, "")]), k=6, every=20, recall=1.0).collect())
    want = by_hand(rows, 6, 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in want.items():
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        hits += len(set(found) & set(got[q]))
    assert hits == sum(map(len, want.values()))


def test_fewer_than_asked_for(spark):
    got = neighbours.nearest(table(spark, rows_of([[1, 0], [0, 1], [1, 1]])), k=20, every=1).collect()
    assert lists(got) == {0: [(2, 1.0), (1, 0.0)], 1: [(2, 1.0), (0, 0.0)], 2: [(0, 1.0), (1, 1.0)]}


@pytest.mark.parametrize("rows", [[], [(0, None, 0, "")], [(1, [1.0, 2.0], 0, "")], [(0, [1.0, 2.0], 0, "")]])
def test_nobody_to_find(spark, rows):
    assert neighbours.nearest(table(spark, rows)).collect() == []


def test_clusters_need_few_candidates(spark, monkeypatch):
    """Nodes cut into shares, queries that ascend above their node and such that stay below, against brute force."""
    monkeypatch.setattr(neighbours, "NODE_ROWS", 64)
    monkeypatch.setattr(neighbours, "SHARE_ROWS", 50)
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((40, 24))
    v = centers[rng.integers(0, 40, 1500)] + 0.2 * rng.standard_normal((1500, 24))
    v[:500] = centers[0] + 0.2 * rng.standard_normal((500, 24))  # a third in one cluster
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = rows_of(v)
    got, want = lists(neighbours.nearest(table(spark, rows), k=10).collect()), by_hand(rows, 10, 20)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_strings():
    forest = neighbours.Forest(6, 1.0)
    planes, v = forest.planes(), np.random.default_rng(3).standard_normal((20, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    a, b = forest.keys(v, planes, False), forest.keys(v, planes, True)
    assert (a == b).mean() > 0.99 and a.max() < 1 << forest.bits
    x, y = np.array([0b1011, 5, 0]), np.array([0b1000, 5, 8])
    assert neighbours.shared_prefix(x, y, 4).tolist() == [2, 4, 0]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_recall_of_the_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = lists(neighbours.query(spark, path).collect()), by_hand(rows, 20, 20)
    assert got.keys() == want.keys()
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
