import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.arith import is_close, nearly_equal, split_paths
from graphloom.operators import analysis
from graphloom.sources import edge_files, readers


def pairs(df):
    return sorted((r.src, r.tgt) for r in df.collect())


def test_delimited(spark, tmp_path):
    for name, mark in readers.DELIMITERS.items():
        path = tmp_path / name
        path.write_text(f"1{mark}2{mark}9\n3{mark}4\n")
        assert pairs(readers.read_delimited(spark, str(path), name)) == [(1, 2), (3, 4)]


def test_binary(spark, tmp_path):
    edges = [(k, k * 3 % 7) for k in range(100)]
    (tmp_path / "e.bin").write_bytes(np.array(edges, "<i4").tobytes())
    assert pairs(readers.read_binary(spark, str(tmp_path), 7)) == sorted(edges)
    assert pairs(readers.read_binary(spark, str(tmp_path), 7, whole_file=100)) == sorted(edges)
    packed = readers.packed_pairs(spark.createDataFrame(edges, "src long, tgt long")).collect()
    assert sorted(map(tuple, np.frombuffer(b"".join(bytes(r.data) for r in packed), "<i4").reshape(-1, 2).tolist())) == sorted(edges)


def test_throughput_over_blocks(spark):
    """Differences over the borders of blocks, and over blocks without samples, by hand."""
    rows = [("a", t, t * t) for t in (0, 1, 2, 50, 51, 99)] + [("b", t, 7 * t) for t in range(30, 60)] + [("c", 5, 1)]
    samples = spark.createDataFrame(rows, "device string, sample long, counter long")
    truth = {}
    for device in "abc":
        own = sorted((t, c) for d, t, c in rows if d == device)
        for (_, c0), (t, c) in zip(own, own[1:]):
            truth[t] = truth.get(t, 0) + c - c0
    for blocks in (1, 7, 1024):
        assert {r["sample"]: r.amount for r in analysis.disk_throughput(samples, blocks).collect()} == truth
    assert analysis.disk_throughput(samples.limit(0)).count() == 0


def test_text_forms(spark):
    lines = spark.createDataFrame([("1 2 5 6",), ("7 0",), (" 3 1  4 ",)], "value string")
    assert pairs(readers.adjacency_edges(lines)) == [(1, 5), (1, 6), (3, 4)]
    lines = spark.createDataFrame([("# a b",), ("1\t2",), ("3  4 x",), ("",)], "value string")
    assert pairs(readers.commented_edges(lines)) == [(1, 2), (3, 4)]


def test_result_round_trip(spark, tmp_path):
    known = spark.createDataFrame([(0, 1), (1, 2), (10, 100)], "id long, orig_id long")
    values = spark.createDataFrame([(0, 0.5), (10, 2.0)], "id long, value double")
    readers.write_result(values, str(tmp_path / "r"), known=known)
    assert sorted(map(tuple, readers.read_result(spark, str(tmp_path / "r")).collect())) == [(1, 0.5), (100, 2.0)]
    readers.write_noop(values)


def test_comparisons(spark):
    row = spark.range(1).select(nearly_equal(F.lit(1.23456), F.lit(1.23459)).alias("a"), nearly_equal(F.lit(1.2345), F.lit(1.2346)).alias("b"), is_close(F.lit(1.0), F.lit(1.00009)).alias("c"), is_close(F.lit(1.0), F.lit(1.001)).alias("d"), split_paths(F.lit("/a:/b:")).alias("p")).first()
    assert tuple(row) == (True, False, True, False, ["/a", "/b"])
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "id long, value double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.1)], "id long, value double")
    assert sorted(r.id for r in analysis.compare_results(a, b, ["id"]).collect()) == [2, 3]


def test_log_and_disk(spark):
    lines = spark.createDataFrame([("x", f"Round Time for iteration {k} {ms:.3f}msec") for k, ms in enumerate((1.0, 3.0, 8.0))] + [("x", "other")], "run string, line string")
    r = analysis.log_stats(lines).first()
    assert (r.rounds, r.median, r.mean, r.total) == (3, 3.0, 4.0, 12.0) and math.isclose(r.deviation, 2.943920288775949)
    samples = spark.createDataFrame([("a", 0, 1), ("a", 1, 5), ("b", 0, 2), ("b", 1, 3), ("b", 2, 9)], "device string, sample long, counter long")
    assert sorted(map(tuple, analysis.disk_throughput(samples).collect())) == [(1, 5), (2, 6)]


def test_density_counts_empty_cells(spark):
    edges = spark.createDataFrame([(0, 0), (0, 1), (3, 3)], "src long, tgt long")
    r = analysis.grid_density(edges, 4, 2).first()
    assert (r.least, r.greatest, r["mean"], r.median) == (0, 2, 0.75, 0.5) and math.isclose(r.deviation, math.sqrt((4 + 1) / 4 - 0.75**2))


def test_edge_files(spark, tmp_path):
    """Round trips over several files and ranges, with wide ids and weights; a job that fails leaves nothing."""
    edge_files.register(spark)
    edges = [(k, k * 3 % 7) for k in range(100)]
    df, path = spark.createDataFrame(edges, "src long, tgt long"), f"file://{tmp_path}/plain"
    df.repartition(3).write.format("edge_files").mode("append").save(path)
    read = lambda **more: spark.read.format("edge_files").options(**more).load(path)
    assert pairs(read()) == pairs(read(split_bytes=50)) == sorted(edges) and read(split_bytes=50).rdd.getNumPartitions() > 10
    data = np.concatenate([np.fromfile(f, "<i4") for f in (tmp_path / "plain").glob("part-*")]).reshape(-1, 2)
    assert sorted(map(tuple, data.tolist())) == sorted(edges) and sorted(map(tuple, pairs(readers.read_binary(spark, path)))) == sorted(edges)
    df.limit(1).write.format("edge_files").mode("append").save(path)
    assert read().count() == 101
    bad = spark.createDataFrame([(1, 2), (1 << 33, 3)], "src long, tgt long").repartition(2)
    for rows in (bad, spark.createDataFrame([(None, 3)], "src long, tgt long")):
        with pytest.raises(Exception, match="beyond 32 bits|without src"):
            rows.write.format("edge_files").mode("append").save(path)
    assert read().count() == 101
    df.limit(2).write.format("edge_files").mode("overwrite").save(path)
    assert read().count() == 2
    wide = spark.createDataFrame([(1 << 33, (1 << 62) + 1, 0.5)], "src long, tgt long, weight double")
    wide.write.format("edge_files").options(bits=64, weighted=True).mode("append").save(f"file://{tmp_path}/wide")
    assert [tuple(r) for r in spark.read.format("edge_files").options(bits=64, weighted=True).load(f"file://{tmp_path}/wide").collect()] == [(1 << 33, (1 << 62) + 1, 0.5)]
    (tmp_path / "none").mkdir()
    assert spark.read.format("edge_files").load(f"file://{tmp_path}/none").count() == 0
    (tmp_path / "odd.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="within a record"):
        spark.read.format("edge_files").load(f"file://{tmp_path}/odd.bin").count()
