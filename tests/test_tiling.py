"""Golden tables of the traversals, tiles and run-length offsets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import arith, hashing
from graphloom.operators import tiling
from graphloom.sources import rmat

HILBERT = [[0, 1, 14, 15], [3, 2, 13, 12], [4, 7, 8, 11], [5, 6, 9, 10]]  # rows are y


def grid(spark, n):
    return spark.range(n).select(F.col("id").alias("x")).crossJoin(spark.range(n).select(F.col("id").alias("y")))


def test_traversals(spark):
    rows = grid(spark, 4).select("x", "y", tiling.hilbert_xy2d(F.col("x"), F.col("y"), 4).alias("h"), tiling.column_first(F.col("x"), F.col("y"), 4).alias("c"), tiling.row_first(F.col("x"), F.col("y"), 4).alias("r")).collect()
    for r in rows:
        assert (r.h, r.c, r.r) == (HILBERT[r.y][r.x], r.x * 4 + r.y, r.y * 4 + r.x)


@pytest.mark.parametrize("n", [1, 2, 8, 32])
def test_hilbert_inverse(spark, n):
    placed = grid(spark, n).withColumn("d", tiling.hilbert_xy2d(F.col("x"), F.col("y"), n))
    x, y = tiling.hilbert_d2xy(F.col("d"), n)
    assert placed.where((x != F.col("x")) | (y != F.col("y"))).count() == 0
    assert placed.select("d").distinct().count() == n * n


@pytest.mark.parametrize("n", [4096, 8192, 1 << 16])
def test_hilbert_of_large_grids(spark, n):
    """Cells that differ in the upper bits alone have places of their own, and steps along the curve are to a neighbour."""
    half = n // 2
    cells = spark.createDataFrame([(a + dx, b + dy) for a in (0, 5, 77) for b in (0, 3, half - 1) for dx in (0, half) for dy in (0, half)], "x long, y long")
    placed = cells.withColumn("d", tiling.hilbert_xy2d(F.col("x"), F.col("y"), n))
    x, y = tiling.hilbert_d2xy(F.col("d"), n)
    assert placed.where((x != F.col("x")) | (y != F.col("y"))).count() == 0 and placed.select("d").distinct().count() == 36
    nx, ny = tiling.hilbert_d2xy(F.col("d") + 1, n)
    assert placed.where(F.col("d") + 1 < n * n).where(F.abs(nx - F.col("x")) + F.abs(ny - F.col("y")) != 1).count() == 0


def test_rle_offsets():
    runs = [2, 1, 0, 2]
    expected = {0: (0, 0), 1: (0, 1), 2: (1, 0), 3: (2, 0), 65537: (2, 65534), 65538: (2, 65535), 65539: (3, 0), 65540: (3, 1)}
    assert {k: tiling.rle_offset(runs, k) for k in expected} == expected


def test_grid_sizing():
    assert tiling.grid_sizing(41_652_230, 4) == {"cell_rows": 1024, "meta_rows": 16, "stores_per_manager_row": 8}
    assert tiling.tiles_per_engine(10, 4) == [3, 3, 2, 2]


def test_cells_and_flags(spark):
    row = spark.range(1).select(tiling.cell(F.lit(4194304), tiling.META_SIDE).alias("c"), tiling.cell(F.lit(4194303), tiling.META_SIDE).alias("b"), arith.bool_array_bytes(F.lit(100)).alias("bytes"), arith.flag_place(F.lit(8))[0].alias("byte"), arith.flag_place(F.lit(8))[1].alias("bit"), *[arith.log2_up(F.lit(x)).alias(f"l{x}") for x in (1, 2, 3, 1024, 1025)], arith.int_ceil(F.lit(4097), 4096).alias("up")).first()
    assert tuple(row) == (1, 0, 13, 1, 0, 0, 1, 2, 10, 11, 8192)


def test_pack_tiles_bounds(spark):
    edges = spark.createDataFrame([(s, t) for s in range(20) for t in range(10)], "src long, tgt long")
    packs = tiling.packed_tiles(tiling.tiled(edges, 32, 4), 2, 6)
    worst = packs.groupBy("pack").agg(F.countDistinct("src").alias("s"), F.countDistinct("tgt").alias("t")).agg(F.max(F.greatest("s", "t"))).first()[0]
    assert worst <= 6 and packs.count() == 200


@pytest.mark.parametrize("ranges", [1, 3])
def test_packs_by_hand(spark, ranges):
    """Edge by edge along the traversal, in each range."""
    random.seed(3)
    edges = spark.createDataFrame([(random.randrange(64), random.randrange(64)) for _ in range(700)], "src long, tgt long")
    tiles = tiling.tiled(edges, 64, 8)
    got = sorted(tuple(r) for r in tiling.packed_tiles(tiles, ranges, 9).select("tile_id", "src", "tgt", "pack").collect())
    part = {r.tile_id: r.part for r in tiling.equal_ranges(tiles.groupBy("tile_id").agg(F.count("*").alias("edges")), ranges).collect()}
    truth, number, sources, targets, before = [], 0, set(), set(), None
    for t, s, g in sorted((r.tile_id, r.src, r.tgt) for r in tiles.collect()):
        if part[t] != before:
            before, number, sources, targets = part[t], 0, set(), set()
        if len(sources | {s}) > 9 or len(targets | {g}) > 9:
            number, sources, targets = number + 1, set(), set()
        sources.add(s), targets.add(g)
        truth.append((t, s, g, (part[t] << 32) + number))
    assert got == truth and len(set(part.values())) == ranges


def test_rebalance_and_index(spark, tmp_path):
    edges = spark.createDataFrame([(s, (s * 7) % 64) for s in range(64)], "src long, tgt long")
    tiles = tiling.tiled(edges, 64, 8)
    dealt = tiling.rebalanced(tiling.tile_stats(tiles), 3).orderBy("rank").collect()
    assert [r.engine for r in dealt] == [k % 3 for k in range(len(dealt))] and [r.tile_id for r in dealt] == sorted(r.tile_id for r in dealt)
    tiling.write_tiles(tiles, str(tmp_path / "tiles"), 4)
    some = [dealt[0].tile_id, dealt[-1].tile_id]
    assert tiling.read_tiles(spark, str(tmp_path / "tiles"), some, 4).count() == tiles.where(F.col("tile_id").isin(some)).count()


def test_rmat(spark):
    import numpy as np

    src, tgt = rmat.rmat_ends(np.arange(10), 16)
    assert list(zip(src.tolist(), tgt.tolist())) == [(0, 10), (0, 2), (0, 2), (7, 8), (0, 2), (0, 0), (0, 8), (5, 8), (0, 0), (7, 1)]
    assert hashing.mix64(np.array([0, 1])).tolist() == [8589871327573335185, 17963551004036540514]
    rows = rmat.rmat_edges(spark, 1024, 20000).groupBy((F.col("src") >= 512).alias("s"), (F.col("tgt") >= 512).alias("t")).count().collect()
    shares = {(r.s, r.t): r["count"] / 20000 for r in rows}
    assert [round(shares[k], 3) for k in ((False, False), (False, True), (True, False), (True, True))] == [0.571, 0.190, 0.190, 0.049]
    with pytest.raises(ValueError):
        rmat.rmat_ends(np.arange(3), 12)


def test_rmat_by_area(spark):
    area, drawn = (100, 300, 512, 700), []
    src, tgt = rmat.rmat_ends(np.arange(20000), 1024)
    inside = (src >= 100) & (src < 300) & (tgt >= 512) & (tgt < 700)
    own = rmat.rmat_ends(np.arange(20000), 1024, area=area, drawn=drawn)
    assert own[0].tolist() == src[inside].tolist() and own[1].tolist() == tgt[inside].tolist()
    assert len(drawn) == 10 and sum(drawn) < 0.3 * 10 * 20000 and drawn[-1] < 2 * inside.sum() + 50
    rows = spark.createDataFrame([(5,), (None,), (7,), (7,)], "k int")
    assert sorted(map(tuple, rmat.rmat_of(rows, 1024, "k").collect())) == sorted(zip(*(x[[5, 7, 7]].tolist() for x in (src, tgt))))
    assert rmat.rmat_edges(spark, 1024, 300, area=(0, 0, 0, 0)).count() == 0
