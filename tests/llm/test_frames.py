import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import frames


def plan(df):
    return df._jdf.queryExecution().toString()


def test_sides_are_broadcast_by_their_bytes(spark):
    keys = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    big = spark.range(1000).withColumnRenamed("id", "k")
    assert "ResolvedHint (strategy=broadcast)" in plan(big.join(frames.small(keys), F.col("k") == F.col("id")))
    assert "ResolvedHint (strategy=broadcast)" not in plan(big.join(frames.small(keys, limit=100_000), F.col("k") == F.col("id")))
    assert frames.small(keys.limit(0), limit=0).count() == 0


@pytest.mark.parametrize("least", [200, 3, 10**6])
def test_hot_keys_join_alike(spark, monkeypatch, least):
    """As a plain join, with any number of keys hot."""
    monkeypatch.setattr(frames, "LEAST_HOT", least)
    rng = random.Random(1)
    rows = [(rng.randrange(30) if rng.random() < 0.5 else 7, k) for k in range(800)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k long, v long")
    groups = df.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("m"))
    key = lambda r: (r.k, r.v, r.n, r.m)
    got = sorted(map(key, frames.beside_group(df, "k", groups, "n", 801).collect()))
    assert got == sorted(map(key, df.join(groups, "k").collect()))


def test_batch_size_is_put_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), frames.arrow_rows(spark, 7):
        assert spark.conf.get(name) == "7"
        raise KeyError
    assert spark.conf.get(name) == before
