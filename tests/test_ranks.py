"""Order statistics by value ranges against sorting."""

import math
import random

from pyspark.sql import functions as F

from graphloom.operators.ranks import order_values


def by_hand(values, p):
    own = sorted(values)
    at = p * (len(own) - 1)
    low, high = own[math.floor(at)], own[math.ceil(at)]
    return low if at == math.floor(at) else low + (at - math.floor(at)) * (high - low)


def test_groups_with_ties_and_wild_values(spark):
    rng = random.Random(3)
    groups = {
        "ties": [float(rng.randrange(4)) for _ in range(301)],
        "wild": [rng.choice([1, -1]) * 10.0 ** rng.randrange(-20, 20) for _ in range(200)],
        "close": [1e9 + k * 1e-6 for k in range(50)],
        "one": [7.5],
        "two": [-1.0, 2.0],
        "ends": [-1.7e308, 1.7e308, 0.0],
        None: [float(k) for k in range(20)],
    }
    rows = [(g, v) for g, own in groups.items() for v in own] + [("ties", None), ("ties", math.nan), ("none", None)]
    rng.shuffle(rows)
    fractions = [0.0, 0.1, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(rows, "`g.x` string, v double").repartition(3)
    got = {(r["g.x"], r.p): r.value for r in order_values(df, ["g.x"], F.col("v"), fractions).collect()}
    assert got.keys() == {(g, p) for g in groups for p in fractions}
    for (g, p), value in got.items():
        assert value == by_hand(groups[g], p) or math.isclose(value, by_hand(groups[g], p), rel_tol=1e-12), (g, p)


def test_without_groups_and_rows(spark):
    df = spark.range(1001)
    assert [(r.p, r.value) for r in order_values(df, [], F.col("id"), [0.25, 0.5]).orderBy("p").collect()] == [(0.25, 250.0), (0.5, 500.0)]
    assert order_values(df.limit(0), [], F.col("id"), [0.5]).collect() == []
