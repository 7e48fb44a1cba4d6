"""Grid cells, traversal orders and tiles of an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE_SIDE, META_SIDE, STRIPE, CELLS_PER_META = 65536, 1 << 22, 1024, 64


def _bits(side: int) -> int:
    if side < 1 or side & (side - 1):
        raise ValueError("a side must be a power of two")
    return side.bit_length() - 1


def cell(vertex: Column, side: int = TILE_SIDE) -> Column:
    return F.shiftright(vertex, _bits(side))


def stripe_partition(vertex: Column, parts: int, stripe: int = STRIPE) -> Column:
    return F.pmod(F.floor(vertex / stripe), F.lit(parts)).cast("long")


def next_power_of_two(x: int) -> int:
    return 1 << max(0, (x - 1).bit_length())


def grid_sizing(n: int, managers: int = 1) -> dict[str, int]:
    """Rows of cells and of meta cells for n vertices, and stores per row of managers."""
    rows = next_power_of_two(-(-n // TILE_SIDE))
    meta = -(-rows // CELLS_PER_META)
    side = max(1, int(managers**0.5))
    return {"cell_rows": rows, "meta_rows": meta, "stores_per_manager_row": -(-meta // side)}


def row_first(x: Column, y: Column, n: int) -> Column:
    return y * n + x


def column_first(x: Column, y: Column, n: int) -> Column:
    return x * n + y


def hilbert_xy2d(x: Column, y: Column, n: int) -> Column:
    """Place of (x, y) on the Hilbert curve over an n by n grid, n a power of two."""
    sides = F.array(*[F.lit(1 << k).cast("long") for k in reversed(range(_bits(n)))]) if n > 1 else F.array().cast("array<bigint>")

    def step(acc: Column, s: Column) -> Column:
        rx, ry = acc["x"].bitwiseAND(s) > 0, acc["y"].bitwiseAND(s) > 0
        quadrant = F.when(rx & ry, 2).when(rx, 3).when(ry, 1).otherwise(0)
        inner_x, inner_y = acc["x"].bitwiseAND(s - 1), acc["y"].bitwiseAND(s - 1)
        # lower quadrants swap the axes; the right one is mirrored as well
        new_x = F.when(ry, inner_x).when(rx, s - 1 - inner_y).otherwise(inner_y)
        new_y = F.when(ry, inner_y).when(rx, s - 1 - inner_x).otherwise(inner_x)
        return F.struct(new_x.alias("x"), new_y.alias("y"), (acc["d"] + s * s * quadrant).alias("d"))

    return F.aggregate(sides, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d")), step, lambda acc: acc["d"])


def hilbert_d2xy(d: Column, n: int) -> tuple[Column, Column]:
    sides = F.array(*[F.lit(1 << k).cast("long") for k in range(_bits(n))]) if n > 1 else F.array().cast("array<bigint>")

    def step(acc: Column, s: Column) -> Column:
        quadrant = F.pmod(acc["t"], F.lit(4))
        rx, ry = quadrant >= 2, (quadrant == 1) | (quadrant == 2)
        turned_x = F.when(ry, acc["x"]).when(rx, s - 1 - acc["y"]).otherwise(acc["y"])
        turned_y = F.when(ry, acc["y"]).when(rx, s - 1 - acc["x"]).otherwise(acc["x"])
        return F.struct(
            (turned_x + F.when(rx, s).otherwise(F.lit(0))).alias("x"), (turned_y + F.when(ry, s).otherwise(F.lit(0))).alias("y"), F.shiftright(acc["t"], 2).alias("t")
        )

    zero = F.lit(0).cast("long")
    done = lambda name: F.aggregate(sides, F.struct(zero.alias("x"), zero.alias("y"), d.cast("long").alias("t")), step, lambda acc: acc[name])
    return done("x"), done("y")


def tiled(edges: DataFrame, n: int, side: int = TILE_SIDE, traversal: str = "hilbert") -> DataFrame:
    """Edges with cell_row, cell_column and tile_id, the cell's place in the traversal; cells are tiles by themselves."""
    rows = next_power_of_two(-(-n // side))
    x, y = cell(F.col("src"), side), cell(F.col("tgt"), side)
    order = {"hilbert": hilbert_xy2d, "column_first": column_first, "row_first": row_first}[traversal]
    return edges.withColumn("cell_row", x).withColumn("cell_column", y).withColumn("tile_id", order(F.col("cell_row"), F.col("cell_column"), rows))


def tile_stats(tiles: DataFrame) -> DataFrame:
    """(tile_id, edges, sources, targets, use_rle): run-length encoding pays where edges are twice the targets."""
    counted = tiles.groupBy("tile_id").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("tgt").alias("targets"))
    return counted.withColumn("use_rle", F.col("edges") >= 2 * F.col("targets"))


def rle_runs(tiles: DataFrame) -> DataFrame:
    """(tile_id, tgt, run): edges of a tile sorted by target are runs of equal targets."""
    return tiles.groupBy("tile_id", "tgt").agg(F.count("*").alias("run"))


def sorted_tiles(tiles: DataFrame, parts: int) -> DataFrame:
    """Tiles dealt by id, edges by target and source within each."""
    return tiles.repartition(parts, "tile_id").sortWithinPartitions("tile_id", "tgt", "src")


def write_tiles(tiles: DataFrame, path: str, buckets: int = 64) -> None:
    bucketed = tiles.withColumn("tile_bucket", F.pmod(F.col("tile_id"), F.lit(buckets)))
    sorted_tiles(bucketed, buckets).write.mode("overwrite").partitionBy("tile_bucket").parquet(path)


def read_tiles(spark, path: str, tile_ids: list[int] | None = None, buckets: int = 64) -> DataFrame:
    """Tiles, or the active ones alone: their buckets are the only folders read."""
    rows = spark.read.parquet(path)
    if tile_ids is not None:
        rows = rows.where(F.col("tile_bucket").isin(sorted({t % buckets for t in tile_ids})) & F.col("tile_id").isin(list(tile_ids)))
    return rows


def store_tiles(tiles: DataFrame, path: str, n: int, buckets: int = 64) -> None:
    """The tiles under ``path``/tiles and their vertex index under ``path``/index, as ``superstep.run(tiles=path)`` reads them.

    The index, (src, tile_id, tile_bucket), lies in stretches of sources as a run's state does.
    """
    from graphloom.plans.delta import Stretches

    write_tiles(tiles, f"{path}/tiles", buckets)
    kept = read_tiles(tiles.sparkSession, f"{path}/tiles")
    stretches = Stretches(n, n)
    index = kept.select("src", "tile_id", F.col("tile_bucket").cast("int").alias("tile_bucket")).distinct()
    placed = index.withColumn("part", stretches.of(F.col("src")).cast("int")).withColumn("bits", F.lit(stretches.bits))
    placed.repartition(max(1, n // 1_000_000), "part").sortWithinPartitions("part", "src").write.mode("overwrite").partitionBy("part").parquet(f"{path}/index")


def vertex_tiles(tiles: DataFrame) -> DataFrame:
    """(src, tiles): the tiles in which a vertex is a source, sorted."""
    return tiles.groupBy("src").agg(F.sort_array(F.collect_set("tile_id")).alias("tiles"))


def tiles_per_target(tiles: DataFrame) -> DataFrame:
    """(tgt, tile_count)"""
    return tiles.groupBy("tgt").agg(F.countDistinct("tile_id").alias("tile_count"))


def active_tiles(frontier: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct tiles of the frontier's (id) vertices by the index (src, tiles)."""
    return index.join(frontier, index["src"] == frontier["id"], "left_semi").select(F.explode("tiles").alias("tile_id")).distinct()


def local_ids(tiles: DataFrame, end: str = "src", order: str = "pos") -> DataFrame:
    """(tile_id, vertex, local_id): rank of a vertex in its tile by first appearance."""
    first = tiles.groupBy("tile_id", F.col(end).alias("vertex")).agg(F.min(order).alias("at"))
    return first.select("tile_id", "vertex", (F.row_number().over(Window.partitionBy("tile_id").orderBy("at", "vertex")) - 1).cast("long").alias("local_id"))


def engine_of(tile: Column, engines: int) -> tuple[Column, Column]:
    """(engine, tile's number there)"""
    return F.pmod(tile, F.lit(engines)).cast("long"), F.floor(tile / engines).cast("long")


def tiles_per_engine(tiles: int, engines: int) -> list[int]:
    return [tiles // engines + (k < tiles % engines) for k in range(engines)]


def rebalanced(stats: DataFrame, engines: int) -> DataFrame:
    """Tiles dealt round-robin by name over the engines: (tile_id, rank, engine)."""
    from graphloom.graph import dense_rank_by

    return dense_rank_by(stats.select("tile_id"), "tile_id", "rank").select("tile_id", "rank", F.pmod("rank", F.lit(engines)).cast("long").alias("engine"))


RANGE_EDGES, LEAST_RANGES = 1_000_000, 4


def packed_tiles(tiles: DataFrame, ranges: int | None = None, max_vertices: int = TILE_SIDE) -> DataFrame:
    """Edges with ``pack``, tiles grown along the traversal: a new one starts where distinct sources or targets would exceed ``max_vertices``.

    Sequential within a contiguous range of the traversal, so boundaries depend on the number of ranges, a million edges
    each and four at least unless given; ``equal_ranges`` says where they lie. Packs are numbered within their range,
    which is in the upper half of the number.
    """
    ranges = ranges or max(LEAST_RANGES, tiles.count() // RANGE_EDGES)
    parts = equal_ranges(tiles.groupBy("tile_id").agg(F.count("*").alias("edges")), ranges)
    width = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tiles.select("tile_id", "src", "tgt").join(parts, "tile_id").repartition(max(width, ranges), "part")

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, part = _Pack(max_vertices), None
        for batch in it:
            own, src, tgt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "src", "tgt"))
            numbers = np.empty(batch.num_rows, np.int64)
            cuts = np.flatnonzero(np.diff(own, prepend=own[:1] - 1)).tolist() if len(own) else []
            for a, b in zip(cuts, [*cuts[1:], len(own)]):
                if own[a] != part:
                    grown, part = _Pack(max_vertices), int(own[a])
                numbers[a:b] = (part << 32) + grown.add(src[a:b], tgt[a:b])
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("tile_id", "src", "tgt")} | {"pack": pa.array(numbers)})

    return rows.sortWithinPartitions("part", "tile_id", "src", "tgt").mapInArrow(pack, "tile_id long, src long, tgt long, pack long")


class _Pack:
    """A tile that grows by stretches of edges: how many distinct sources and targets it would have after each."""

    def __init__(self, most: int):
        self.most, self.number = most, 0
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def add(self, src: np.ndarray, tgt: np.ndarray) -> np.ndarray:
        """The tile's number for each edge."""
        out, at = np.empty(len(src), np.int64), 0
        while at < len(src):
            ends = (src[at : at + 4 * self.most], tgt[at : at + 4 * self.most])
            over = len(ends[0])
            for held, values in zip(self.held, ends):
                first = np.zeros(len(values), bool)
                first[np.unique(values, return_index=True)[1]] = True
                sizes = len(held) + np.cumsum(first & ~np.isin(values, held))
                over = min(over, int(np.searchsorted(sizes, self.most, "right")))
            out[at : at + over] = self.number
            self.held = [np.union1d(held, values[:over]) for held, values in zip(self.held, ends)]
            if over < len(ends[0]):
                self.number, self.held = self.number + 1, [x[:0] for x in self.held]
            at += over
        return out


def equal_ranges(stats: DataFrame, parts: int) -> DataFrame:
    """(tile_id, part): contiguous ranges of the traversal with about as many edges each.

    A running sum in two steps: over blocks of 1024 tiles, then within each.
    """
    block = F.shiftright("tile_id", 10)
    placed = stats.withColumn("block", block)
    sums = placed.groupBy("block").agg(F.sum("edges").alias("e"))
    total = sums.agg(F.sum("e")).first()[0] or 1
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per 1024 tiles
    bases = sums.select("block", F.coalesce(F.sum("e").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("block").orderBy("tile_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("base") + F.coalesce(F.sum("edges").over(within), F.lit(0))
    return placed.join(bases, "block").select("tile_id", F.floor(at * parts / total).cast("long").alias("part"))


def rle_offset(runs: list[int], start: int) -> tuple[int, int]:
    """(run, offset in it) of the edge number ``start``; a stored 0 means 65536."""
    for k, run in enumerate(runs):
        size = run or 65536
        if start < size:
            return k, start
        start -= size
    raise ValueError("beyond the last run")


def in_area(src: Column, tgt: Column, rows: tuple[int, int], columns: tuple[int, int]) -> Column:
    """Whether an edge lies in a rectangle of vertex ids; ends are exclusive."""
    return (src >= rows[0]) & (src < rows[1]) & (tgt >= columns[0]) & (tgt < columns[1])
