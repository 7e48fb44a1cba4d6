"""The library's own queries over the driver's tables, and their SQL.

The graphs, each of every row of its table: G_cust has an edge o_custkey -> o_orderkey % |customer| per order, G_sp an edge
supplier -> part per line item. G_jump has the orders as vertices and two edges from each to a later one, a jump of at
most a twelfth of all orders that the customer or the price gives: long paths, unreached vertices and many labels. G_star
has an edge from each customer to each of its orders: as many components as customers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import arith, hashing
from graphloom.graph import Graph, decode_ids, encode_ids
from graphloom.operators import analysis, cells, components, frontiers, programs, ranks, tiling
from graphloom.plans.delta import TileStore
from graphloom.plans.storage import place
from graphloom.plans.superstep import run
from graphloom.sources import edge_files, readers, rmat

SIDE = 128  # of a grid cell, small enough for the small graphs to have many
START = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_graph(spark: SparkSession, sf_dir: str) -> Graph:
    n = _table(spark, sf_dir, "customer").count()
    orders = _table(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_custkey").alias("src"), F.pmod("o_orderkey", F.lit(n)).alias("tgt"), (F.col("o_totalprice") / 1000).alias("weight"), F.col("o_orderkey").alias("pos"))
    return Graph(edges, n)


def jump_graph(spark: SparkSession, sf_dir: str) -> Graph:
    orders = _table(spark, sf_dir, "orders")
    n = orders.count()
    most = max(1, n // 12)
    jumps = F.array(F.col("o_custkey"), F.floor("o_totalprice").cast("long"))
    ends = orders.select(F.col("o_orderkey").alias("src"), (F.col("o_totalprice") / 1000).alias("weight"), F.explode(jumps).alias("jump"))
    edges = ends.select("src", (F.col("src") + 1 + F.col("jump") % most).alias("tgt"), "weight")
    return Graph(edges.where(F.col("tgt") < n), n).checked()


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    customers, orders = _table(spark, sf_dir, "customer").count(), _table(spark, sf_dir, "orders")
    return Graph(orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + customers).alias("tgt")), customers + orders.count()).checked()


def supplier_graph(spark: SparkSession, sf_dir: str) -> Graph:
    suppliers, parts = _table(spark, sf_dir, "supplier").count(), _table(spark, sf_dir, "part").count()
    items = _table(spark, sf_dir, "lineitem")
    return Graph(items.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + suppliers).alias("tgt"), F.col("l_quantity").alias("weight")), suppliers + parts)


_N = "(SELECT count(*) FROM customer)"
_EDGES = f"SELECT o_custkey AS src, o_orderkey % {_N} AS tgt, o_totalprice / 1000 AS weight, o_orderkey AS pos FROM orders"
_ORDERS = "(SELECT count(*) FROM orders)"
_JUMP = f"""SELECT src, src + 1 + jump % greatest(1, {_ORDERS} // 12) AS tgt, weight FROM (
    SELECT o_orderkey AS src, o_custkey AS jump, o_totalprice / 1000 AS weight FROM orders UNION ALL
    SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT), o_totalprice / 1000 FROM orders) WHERE src + 1 + jump % greatest(1, {_ORDERS} // 12) < {_ORDERS}"""
_JUMP_IDS = f"SELECT range AS id FROM range({_ORDERS})"
_STAR = f"SELECT o_custkey AS src, o_orderkey + {_N} AS tgt FROM orders"
_STAR_IDS = f"SELECT range AS id FROM range({_N} + {_ORDERS})"
_SP = "SELECT l_suppkey AS src, l_partkey + (SELECT count(*) FROM supplier) AS tgt, l_quantity AS weight FROM lineitem"
_IDS = f"SELECT range AS id FROM range({_N})"
_DEGREES = "SELECT id, count(s.src) AS out_degree FROM v LEFT JOIN e s ON s.src = id GROUP BY id"
_PAIRS = "SELECT DISTINCT least(src, tgt) AS a, greatest(src, tgt) AS b FROM e WHERE src <> tgt"


def _with(edges: str = _EDGES, more: str = "", ids: str = _IDS) -> str:
    return f"WITH RECURSIVE e AS MATERIALIZED ({edges}), v AS MATERIALIZED ({ids}){more} "


def _pagerank_sql(rounds: int) -> str:
    return _with(more=f""", o AS MATERIALIZED (SELECT src, count(*) AS d FROM e GROUP BY src), r AS (
        SELECT 0 AS k, id, 1.0::DOUBLE AS rank FROM v UNION ALL
        SELECT k + 1, v.id, 0.15 + 0.85 * coalesce(s, 0) FROM (SELECT DISTINCT k FROM r) c CROSS JOIN v
        LEFT JOIN (SELECT e.tgt, sum(r.rank / o.d) AS s FROM r JOIN e ON e.src = r.id JOIN o ON o.src = r.id GROUP BY e.tgt) m ON m.tgt = v.id
        WHERE k < {rounds})""") + f"SELECT id, round(rank, 6) AS rank FROM r WHERE k = {rounds}"


def _least_sql(edges: str, first: str, step: str, value: str, ids: str = _IDS) -> str:
    """A fixpoint by repeated relaxation; the recursive table keeps one row per vertex."""
    return _with(edges, f""", r(v, x) USING KEY (v) AS (
        {first} UNION
        SELECT n.tgt, n.x FROM (SELECT e.tgt, min({step}) AS x FROM r JOIN e ON e.src = r.v GROUP BY e.tgt) n
        LEFT JOIN recurring.r c ON c.v = n.tgt WHERE c.x IS NULL OR n.x < c.x)""", ids) + f"SELECT id, {value} AS value FROM v LEFT JOIN r ON r.v = id"


def _tile_sql(edges: str = _EDGES, n: str = _N) -> str:
    """Edges with cells and their place on the Hilbert curve, unrolled over 12 levels (4096 x 4096 cells at most)."""
    rows = f"(SELECT CAST(2 ** ceil(log2(ceil({n} / {SIDE}.0))) AS BIGINT))"
    sql = f"SELECT src, tgt, pos, src // {SIDE} AS cell_row, tgt // {SIDE} AS cell_column, src // {SIDE} AS x, tgt // {SIDE} AS y, 0::BIGINT AS d, {rows} AS side FROM ({edges})"
    for k in reversed(range(12)):
        s = 1 << k
        rx, ry = f"(x & {s}) > 0", f"(y & {s}) > 0"
        live = f"{s} < side"
        mx, my = f"(x & {s - 1})", f"(y & {s - 1})"
        sql = (
            f"SELECT src, tgt, pos, cell_row, cell_column, side, CASE WHEN NOT {live} THEN x WHEN {ry} THEN {mx} WHEN {rx} THEN {s - 1} - {my} ELSE {my} END AS x, "
            f"CASE WHEN NOT {live} THEN y WHEN {ry} THEN {my} WHEN {rx} THEN {s - 1} - {mx} ELSE {mx} END AS y, "
            f"d + CASE WHEN {live} THEN {s * s} * (CASE WHEN {rx} AND {ry} THEN 2 WHEN {rx} THEN 3 WHEN {ry} THEN 1 ELSE 0 END) ELSE 0 END AS d FROM ({sql})"
        )
    return f"SELECT src, tgt, pos, cell_row, cell_column, d AS tile_id FROM ({sql})"


def _tiles(spark: SparkSession, sf_dir: str, traversal: str = "hilbert") -> DataFrame:
    g = customer_graph(spark, sf_dir)
    return tiling.tiled(g.edges, g.n, SIDE, traversal)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def _values(done, name: str = "value") -> DataFrame:
    return done.state.select("id", F.col(name))


def _prior() -> Column:
    return (F.pmod("id", F.lit(9)) + 1) / 10


def _kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, centroids = programs.kmeans_1d(_table(spark, sf_dir, "customer"), "c_acctbal", [0.0, 2500.0, 5000.0, 7500.0], 3)
    return points.groupBy("cluster").agg(F.count("*").alias("members"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


def _minhash_sql(m: int = 8) -> str:
    minima = ", ".join(f"min(({48271 * (j + 1)} * b + {11 * j + 7}) % {programs.MINHASH_PRIME}) AS h{j}" for j in range(m))
    z = " + ".join(f"(x.h{j} = y.h{j})::INT" for j in range(m))
    return _with(more=f""", p AS MATERIALIZED ({_PAIRS}), ends AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        s AS MATERIALIZED (SELECT a, count(*) AS d, {minima} FROM ends GROUP BY a)""") + f"""SELECT id, round(coalesce(t, 0), 6) AS estimate FROM v LEFT JOIN (
        SELECT a, sum(z / (z + {m}.0) * (dx + dy) / 2) AS t FROM (SELECT ends.a AS a, {z} AS z, x.d AS dx, y.d AS dy FROM ends JOIN s x ON x.a = ends.a JOIN s y ON y.a = ends.b) GROUP BY a) ON a = id"""


def _assign_sql(column: str, centers: str) -> str:
    """Nearest of the centers' (k, c), ties to the lowest k."""
    return f"SELECT c_custkey, {column} AS x, (SELECT k FROM {centers} ORDER BY abs({column} - c), k LIMIT 1) AS k FROM customer"


def _kmeans_sql(rounds: int) -> str:
    sql = "WITH c0 AS MATERIALIZED (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 2500.0), (2, 5000.0), (3, 7500.0)) t(k, c))"
    for t in range(rounds):
        sql += f", a{t} AS MATERIALIZED ({_assign_sql('c_acctbal', f'c{t}')}), c{t + 1} AS MATERIALIZED (SELECT c{t}.k, coalesce(m, c) AS c FROM c{t} LEFT JOIN (SELECT k, avg(x) AS m FROM a{t} GROUP BY k) n ON n.k = c{t}.k)"
    return sql + f", z AS ({_assign_sql('c_acctbal', f'c{rounds}')}) SELECT k AS cluster, count(*) AS members, round(avg(x), 4) AS mean FROM z GROUP BY k"


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-time lines made from the events: one run per type."""
    events = _table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("run"), F.concat(F.lit("Round Time for iteration "), F.col("event_id"), F.lit(" "), F.round(F.abs("value"), 3).cast("decimal(20,3)"), F.lit("msec")).alias("line"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("device"), F.col("l_orderkey").alias("sample"), F.col("l_quantity").cast("long").alias("counter")).groupBy("device", "sample").agg(F.max("counter").alias("counter"))


def _adjacency(g: Graph) -> DataFrame:
    lines = g.edges.groupBy("src").agg(F.count("*").alias("d"), F.array_sort(F.collect_list("tgt")).alias("t"))
    text = lines.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("d").cast("string"), F.array_join(F.transform("t", lambda x: x.cast("string")), " ")).alias("value"))
    return readers.adjacency_edges(text)


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BFS from a vertex behind which few lie."""
    g = jump_graph(spark, sf_dir)
    return _values(programs.bfs(g, g.n - g.n // 20 - 1))


def _over_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``bfs_sparse`` over tiles and their index in the shared folder, of which a round reads the active ones."""
    g = jump_graph(spark, sf_dir)
    path = place(spark, "tiles")
    tiling.store_tiles(tiling.tiled(g.edges, g.n, SIDE), path, g.n)
    return _values(run(Graph(TileStore(spark, path).all_edges(), g.n), programs.bfs_program(g.n - g.n // 20 - 1), None, tiles=path))


def _pack_sql(most: int) -> str:
    """A pack begins at the first edge of its range, and where one end's distinct vertices since the last begin would be over ``most``."""
    return f"""WITH RECURSIVE t AS MATERIALIZED ({_tile_sql()}), c AS (SELECT tile_id, count(*) AS edges FROM t GROUP BY tile_id),
        p AS (SELECT tile_id, CAST(floor((sum(edges) OVER (ORDER BY tile_id) - edges) * (SELECT greatest({tiling.LEAST_RANGES}, count(*) // {tiling.RANGE_EDGES}) FROM t) / (sum(edges) OVER ())) AS BIGINT) AS part FROM c),
        o AS (SELECT part, tile_id, src, tgt, row_number() OVER (PARTITION BY part ORDER BY tile_id, src, tgt) AS k FROM t JOIN p USING (tile_id)),
        e AS MATERIALIZED (SELECT *, coalesce(lag(k) OVER (PARTITION BY part, src ORDER BY k), 0) AS ks, coalesce(lag(k) OVER (PARTITION BY part, tgt ORDER BY k), 0) AS kt FROM o),
        r AS (SELECT part, 1::BIGINT AS number, 1::BIGINT AS first FROM e GROUP BY part UNION ALL
            SELECT part, number + 1, min(k) FROM (SELECT r.part, r.number, e.k, sum((ks < first)::INT) OVER (PARTITION BY r.part ORDER BY e.k) AS s, sum((kt < first)::INT) OVER (PARTITION BY r.part ORDER BY e.k) AS g
                FROM r JOIN e ON e.part = r.part AND e.k >= r.first) WHERE s > {most} OR g > {most} GROUP BY part, number)
        SELECT tile_id, src, tgt, part * 4294967296 + max(number) - 1 AS pack FROM (SELECT e.*, r.number FROM e JOIN r ON r.part = e.part AND r.first <= e.k) GROUP BY tile_id, src, tgt, part, k"""


_POWER = f"(SELECT CAST(2 ** ceil(log2(greatest(1, {_N}))) AS BIGINT))"
_WRAP = "18446744073709551616::HUGEINT"  # 2**64


def _mixed_sql(rows: str, column: str, keep: str) -> str:
    """The 64-bit mixing steps of one column, a query a step, in 128-bit integers cut to 64 bits; ``keep`` names the others."""
    for k, (c, s) in enumerate(zip(hashing.MIX64, hashing.SHIFT64)):
        x, left, right = column, f"({column} * {1 << s}::HUGEINT)", f"({column} // {1 << s}::HUGEINT)"
        if k in (0, 2, 4):
            new = f"({x} + {c}::HUGEINT + {left} % {_WRAP}) % {_WRAP}"
        elif k == 3:
            new = f"xor(({x} + {c}::HUGEINT) % {_WRAP}, {left} % {_WRAP})"
        else:
            new = f"xor(xor({x}, {c}::HUGEINT), {right})"
        rows = f"SELECT {keep}, {new} AS {column} FROM ({rows})"
    return rows


def _through_files(spark: SparkSession, edges: DataFrame, **options) -> DataFrame:
    """``edges`` written as binary files to the shared folder and read back."""
    path = place(edge_files.register(spark), "edges")
    edges.write.format("edge_files").options(path=path, **options).mode("append").save()
    return spark.read.format("edge_files").options(path=path, split_bytes=1 << 16, **options).load()


def _wide(g: Graph) -> DataFrame:
    """Edges whose ends need more than 32 bits."""
    return g.edges.select((F.col("src") + (1 << 33)).alias("src"), (F.col("tgt") * (1 << 20) + (1 << 40)).alias("tgt"), F.col("weight").cast("float").alias("weight"))


def _side(spark: SparkSession, sf_dir: str) -> int:
    """The power of two that holds all customers."""
    return tiling.next_power_of_two(_table(spark, sf_dir, "customer").count())


def _rmat(spark: SparkSession, sf_dir: str, in_area: bool = False) -> DataFrame:
    """An edge for each order, its key the index, over as many vertices as customers; or those from the second quarter of ids to the third."""
    n = _side(spark, sf_dir)
    area = (n // 4, n // 2, n // 2, n // 2 + n // 4) if in_area else None
    return rmat.rmat_of(_table(spark, sf_dir, "orders"), n, "o_orderkey", area=area)


def _rmat_sql() -> str:
    a, b, c = (repr(float(x)) for x in np.cumsum(rmat.SHARES))
    key = int(hashing.mix64(np.array([rmat.SEED], np.uint64))[0])
    factor = lambda more: f"((2 * range + {more})::HUGEINT * {key}::HUGEINT) % {_WRAP}"
    seeds = f"SELECT range AS i, {factor(0)} AS draw, {factor(1)} AS stride FROM (SELECT o_orderkey AS range FROM orders)"
    seeds = _mixed_sql(_mixed_sql(seeds, "draw", "i, stride"), "stride", "i, draw")
    drawn = _mixed_sql("SELECT i, draw, stride, src, tgt, half, draw AS h FROM r WHERE half > 0", "h", "i, draw, stride, src, tgt, half")
    share = f"h::DOUBLE / {float(2**64 - 1)!r}"
    return f"""WITH RECURSIVE r AS (SELECT i, draw, stride, 0::BIGINT AS src, 0::BIGINT AS tgt, {_POWER} // 2 AS half FROM ({seeds}) UNION ALL
        SELECT i, (draw + stride) % {_WRAP}, stride, src + CASE WHEN x >= {b} THEN half ELSE 0 END, tgt + CASE WHEN x >= {c} OR (x >= {a} AND x < {b}) THEN half ELSE 0 END, half // 2
        FROM (SELECT *, {share} AS x FROM ({drawn}))) SELECT src, tgt FROM r WHERE half = 0"""


def _reached_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles to read for the vertices within two hops of the start."""
    reached = run(customer_graph(spark, sf_dir), programs.bfs_program(START), 2).state.where("value is not null")
    return tiling.active_tiles(reached, tiling.vertex_tiles(_tiles(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    cust = customer_graph
    return {
        "graph_edges": lambda s, d: cust(s, d).edges.select("src", "tgt"),
        "degrees": lambda s, d: cust(s, d).degrees(),
        "degrees_multigraph": lambda s, d: supplier_graph(s, d).degrees(),
        "vertex_count": lambda s, d: analysis.distinct_vertices(cust(s, d).edges),
        "id_dictionary": lambda s, d: encode_ids(cust(s, d).edges),
        "id_decode": lambda s, d: decode_ids(encode_ids(cust(s, d).edges).select("id", (F.col("id") * 2).alias("value")), encode_ids(cust(s, d).edges)),
        "bounds_check": lambda s, d: cust(s, d).checked().edges.select("src", "tgt", "pos"),
        "symmetrize": lambda s, d: cust(s, d).symmetrized().edges.groupBy("src", "tgt").agg(F.count("*").alias("edges")),
        "pagerank_1": lambda s, d: _rounded(_values(programs.pagerank(cust(s, d), 1), "rank"), "rank"),
        "pagerank_5": lambda s, d: _rounded(_values(programs.pagerank(cust(s, d), 5), "rank"), "rank"),
        "pagerank_20": lambda s, d: _rounded(_values(programs.pagerank(cust(s, d), 20), "rank"), "rank"),
        "bfs": lambda s, d: _values(programs.bfs(cust(s, d), START)),
        "bfs_deep": lambda s, d: _values(programs.bfs(jump_graph(s, d), START)),
        "bfs_sparse": _late,
        "bfs_tiles": _over_tiles,
        "round_counters": lambda s, d: programs.bfs(jump_graph(s, d), START).metrics(s).drop("milliseconds"),
        "bfs_bitmaps": lambda s, d: _values(frontiers.bfs_bitmaps(cust(s, d), START)),
        "bfs_bitmaps_deep": lambda s, d: _values(frontiers.bfs_bitmaps(jump_graph(s, d), START)),
        "sssp_buckets": lambda s, d: _rounded(_values(programs.sssp_buckets(jump_graph(s, d), START)), "value"),
        "components_star": lambda s, d: components.weak_components(star_graph(s, d))[0],
        "components_whole": lambda s, d: components.weak_components(cust(s, d))[0],
        "components_jump": lambda s, d: components.weak_components(jump_graph(s, d))[0],
        "components_suppliers": lambda s, d: components.weak_components(supplier_graph(s, d))[0],
        "bfs_3_rounds": lambda s, d: _values(run(cust(s, d), programs.bfs_program(START), 3)),
        "sssp": lambda s, d: _rounded(_values(programs.sssp(jump_graph(s, d), START)), "value"),
        "cc": lambda s, d: _values(programs.cc(jump_graph(s, d))),
        "cc_weak": lambda s, d: _values(programs.cc(star_graph(s, d), directed=False)),
        "sssp_whole": lambda s, d: _rounded(_values(programs.sssp(cust(s, d), START)), "value"),
        "cc_whole": lambda s, d: _values(programs.cc(cust(s, d))),
        "cc_weak_whole": lambda s, d: _values(programs.cc(cust(s, d), directed=False)),
        "cc_suppliers": lambda s, d: _values(programs.cc(supplier_graph(s, d))),
        "cc_weak_suppliers": lambda s, d: _values(programs.cc(supplier_graph(s, d), directed=False)),
        "spmv_target": lambda s, d: programs.spmv(cust(s, d)),
        "spmv_source": lambda s, d: programs.spmv(cust(s, d), "source"),
        "spmv_weighted": lambda s, d: _rounded(programs.spmv(supplier_graph(s, d), "source", weighted=True), "y"),
        "triangles": lambda s, d: programs.triangle_count(cust(s, d)),
        "triangle_cells": lambda s, d: cells.triangle_cells(cust(s, d), edges_a_task=20_000),
        "triangles_per_vertex": lambda s, d: programs.triangles_per_vertex(cust(s, d)),
        "wedges": lambda s, d: programs.wedges_per_vertex(cust(s, d)),
        "triangles_minhash": lambda s, d: _rounded(programs.triangles_minhash(cust(s, d)), "estimate"),
        "belief_propagation": lambda s, d: _rounded(programs.belief_propagation(cust(s, d), 3, _prior()), "belief0", "belief1"),
        "belief_propagation_5": lambda s, d: _rounded(programs.belief_propagation(cust(s, d), 5, _prior()), "belief0", "belief1"),
        "kmeans_assign": lambda s, d: _table(s, d, "customer").select("c_custkey", programs.nearest(F.col("c_acctbal"), [0.0, 2500.0, 5000.0, 7500.0]).alias("k")),
        "kmeans_3": _kmeans,
        "active_sources": lambda s, d: _values(run(cust(s, d), programs.bfs_program(START), 2)).agg(F.count("value").alias("reached")),
        "active_tiles": _reached_tiles,
        "grid_cells": lambda s, d: _tiles(s, d).groupBy("cell_row", "cell_column").agg(F.count("*").alias("edges")),
        "stripe_partition": lambda s, d: cust(s, d).degrees().groupBy(tiling.stripe_partition(F.col("id"), 4, 128).alias("part")).agg(F.count("*").alias("vertices")),
        "hilbert_index": lambda s, d: _tiles(s, d).select("cell_row", "cell_column", "tile_id").distinct(),
        "row_first": lambda s, d: _tiles(s, d, "row_first").groupBy("tile_id").agg(F.count("*").alias("edges")),
        "column_first": lambda s, d: _tiles(s, d, "column_first").groupBy("tile_id").agg(F.count("*").alias("edges")),
        "tile_stats": lambda s, d: tiling.tile_stats(_tiles(s, d)),
        "rle_runs": lambda s, d: tiling.rle_runs(_tiles(s, d)).groupBy("run").agg(F.count("*").alias("runs")),
        "vertex_tiles_by_source": lambda s, d: tiling.vertex_tiles(_tiles(s, d)).select("src", F.size("tiles").cast("long").alias("tile_count"), F.array_join(F.transform("tiles", lambda t: t.cast("string")), ",").alias("tiles")),
        "vertex_tile_count_by_target": lambda s, d: tiling.tiles_per_target(_tiles(s, d)),
        "local_ids": lambda s, d: tiling.local_ids(_tiles(s, d)),
        "engine_of_tile": lambda s, d: _tiles(s, d).select("tile_id").distinct().select("tile_id", tiling.engine_of(F.col("tile_id"), 4)[0].alias("engine"), tiling.engine_of(F.col("tile_id"), 4)[1].alias("number")),
        "rebalance": lambda s, d: tiling.rebalanced(tiling.tile_stats(_tiles(s, d)), 4),
        "equal_ranges": lambda s, d: tiling.equal_ranges(tiling.tile_stats(_tiles(s, d)), 8),
        "target_area": lambda s, d: cust(s, d).edges.where(tiling.in_area(F.col("src"), F.col("tgt"), (10, 500), (20, 90))).groupBy("src").agg(F.count("*").alias("edges")),
        "pack_tiles": lambda s, d: tiling.packed_tiles(_tiles(s, d), max_vertices=256),
        "hash_weights": lambda s, d: cust(s, d).edges.select("src", "tgt", F.round(arith.hash_weight(F.col("src"), F.col("tgt")), 9).alias("weight")),
        "constant_values": lambda s, d: readers.constant_values(cust(s, d).degrees()),
        "adjacency_edges": lambda s, d: _adjacency(jump_graph(s, d)),
        "adjacency_edges_whole": lambda s, d: _adjacency(cust(s, d)),
        "compare_results": lambda s, d: _rounded(analysis.compare_results(programs.spmv(cust(s, d)).withColumnRenamed("y", "value"), programs.spmv(cust(s, d), "source").withColumnRenamed("y", "value"), ["id"], digits=4), "a", "b", digits=4),
        "compare_results_relative": lambda s, d: analysis.compare_results(programs.spmv(cust(s, d)).withColumnRenamed("y", "value"), programs.spmv(cust(s, d), "source").withColumnRenamed("y", "value"), ["id"], digits=None, relative=0.1).agg(F.count("*").alias("differing")),
        "compare_labels": lambda s, d: analysis.compare_labels(_table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("label")), _table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.pmod("c_nationkey", F.lit(5)).alias("label"))),
        "canonical_labels": lambda s, d: analysis.canonical_labels(_table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("label"))),
        "distribution_stats": lambda s, d: _rounded(analysis.distribution_stats(tiling.tile_stats(_tiles(s, d)), F.col("edges")), "mean", "deviation"),
        "tile_percentiles": lambda s, d: _rounded(analysis.percentiles(tiling.tile_stats(_tiles(s, d)), F.col("edges")), "value"),
        "price_percentiles": lambda s, d: _rounded(ranks.order_values(_table(s, d, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), [0.05, 0.25, 0.5, 0.75, 0.99]), "value", digits=4),
        "price_median": lambda s, d: _rounded(ranks.order_values(_table(s, d, "lineitem"), [], F.col("l_extendedprice"), [0.5]), "value", digits=4),
        "grid_density": lambda s, d: _rounded(analysis.grid_density(cust(s, d).edges, cust(s, d).n, SIDE), "mean", "deviation"),
        "log_stats": lambda s, d: _rounded(analysis.log_stats(_log_lines(s, d)), "median", "mean", "deviation", "total", digits=4),
        "disk_throughput": lambda s, d: analysis.disk_throughput(_samples(s, d)),
        "binary_edges": lambda s, d: _through_files(s, cust(s, d).edges.select("src", "tgt")),
        "binary_edges_wide": lambda s, d: _rounded(_through_files(s, _wide(cust(s, d)), bits=64, weighted=True), "weight", digits=2),
        "rmat_edges": _rmat,
        "rmat_degrees": lambda s, d: Graph(_rmat(s, d), _side(s, d)).degrees(),
        "rmat_area": lambda s, d: _rmat(s, d, True),
    }


def oracle_sql() -> dict[str, str]:
    e, n = _with(), _N
    tiles = f"WITH t AS MATERIALIZED ({_tile_sql()}) "
    sp_n = "(SELECT count(*) FROM supplier) + (SELECT count(*) FROM part)"
    sp_ids, both_ways = f"SELECT range AS id FROM range({sp_n})", "SELECT src, tgt FROM ({e}) UNION ALL SELECT tgt, src FROM ({e})"
    degrees = "SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM v LEFT JOIN (SELECT tgt, count(*) AS i FROM e GROUP BY tgt) a ON a.tgt = id LEFT JOIN (SELECT src, count(*) AS o FROM e GROUP BY src) b ON b.src = id"
    first = "d AS MATERIALIZED (SELECT orig_id, row_number() OVER (ORDER BY place) - 1 AS id FROM (SELECT orig_id, min(place) AS place FROM (SELECT src AS orig_id, 2 * pos AS place FROM e UNION ALL SELECT tgt, 2 * pos + 1 FROM e) GROUP BY orig_id))"
    bfs_first, bfs_value = f"SELECT {START}::BIGINT, 0::BIGINT", "x"
    tri = f", p AS MATERIALIZED ({_PAIRS}), t AS MATERIALIZED (SELECT x.a AS a, x.b AS b, y.b AS c FROM p x JOIN p y ON y.a = x.b JOIN p z ON z.a = x.a AND z.b = y.b)"
    spmv = "SELECT id, coalesce(y, 0)::DOUBLE AS y FROM v LEFT JOIN (SELECT tgt, sum({x}) AS y FROM e GROUP BY tgt) m ON m.tgt = id"
    both = "a AS (SELECT id, coalesce(y, 0)::DOUBLE AS y FROM v LEFT JOIN (SELECT tgt, sum(tgt) AS y FROM e GROUP BY tgt) m ON m.tgt = id), b AS (SELECT id, coalesce(y, 0)::DOUBLE AS y FROM v LEFT JOIN (SELECT tgt, sum(src) AS y FROM e GROUP BY tgt) m ON m.tgt = id)"
    rmat_edges = _rmat_sql()
    bfs_deep = _least_sql(_JUMP, bfs_first, "r.x + 1", bfs_value, _JUMP_IDS)
    bfs_sparse = _least_sql(_JUMP, f"SELECT {_ORDERS} - {_ORDERS} // 20 - 1, 0::BIGINT", "r.x + 1", bfs_value, _JUMP_IDS)
    bfs = _least_sql(_EDGES, bfs_first, "r.x + 1", bfs_value)
    sssp = _least_sql(_JUMP, f"SELECT {START}::BIGINT, 0.0::DOUBLE", "r.x + e.weight", "round(x, 6)", _JUMP_IDS)
    weak = {k: _least_sql(both_ways.format(e=edges), "SELECT id, id FROM v", "r.x", "x", ids) for k, edges, ids in (("star", _STAR, _STAR_IDS), ("whole", _EDGES, _IDS), ("jump", _JUMP, _JUMP_IDS), ("suppliers", _SP, sp_ids))}
    # emitted products are of ones, so later rounds absorb the same again: true for any odd number of rounds from three on
    beliefs = _with(more=", q AS (SELECT id, (id % 9 + 1) / 10.0 AS q0 FROM v), m AS MATERIALIZED (SELECT id, q0, coalesce(w, 0) * q0 AS m0, coalesce(w, 0) * (1 - q0) AS m1 FROM q LEFT JOIN (SELECT tgt, sum(weight) AS w FROM e GROUP BY tgt) ON tgt = id), b AS (SELECT q.id, ln(q0) + coalesce(x0, 0) AS a0, ln(1 - q0) + coalesce(x1, 0) AS a1 FROM q LEFT JOIN (SELECT tgt, sum(ln(m0)) AS x0, sum(ln(m1)) AS x1 FROM e JOIN m ON m.id = src GROUP BY tgt) ON tgt = q.id)") + "SELECT id, round(1 / (1 + exp(a1 - a0)), 6) AS belief0, round(1 / (1 + exp(a0 - a1)), 6) AS belief1 FROM b"
    return {
        "bfs_tiles": bfs_sparse,
        "round_counters": bfs_deep.split("SELECT id, x AS value")[0]
        + "SELECT k AS round, (SELECT count(*) FROM r WHERE x = k + 1) AS active, (SELECT count(*) FROM e JOIN r ON r.v = e.src WHERE r.x = k) AS messages, (SELECT count(*) FROM r WHERE x = k + 1) AS written FROM (SELECT DISTINCT x AS k FROM r)",
        "bfs_bitmaps": bfs,
        "bfs_bitmaps_deep": bfs_deep,
        "sssp_buckets": sssp,
        **{f"components_{k}": text for k, text in weak.items()},
        "binary_edges": f"SELECT src, tgt FROM ({_EDGES})",
        "binary_edges_wide": f"SELECT src + 8589934592 AS src, tgt * 1048576 + 1099511627776 AS tgt, round(weight::FLOAT::DOUBLE, 2) AS weight FROM ({_EDGES})",
        "pack_tiles": _pack_sql(256),
        "rmat_edges": rmat_edges,
        "rmat_degrees": f"WITH e AS MATERIALIZED ({rmat_edges}), v AS (SELECT range AS id FROM range({_POWER})) " + degrees,
        "rmat_area": f"SELECT src, tgt FROM ({rmat_edges}), (SELECT {_POWER} AS n) WHERE src >= n // 4 AND src < n // 2 AND tgt >= n // 2 AND tgt < n // 2 + n // 4",
        "graph_edges": f"SELECT src, tgt FROM ({_EDGES})",
        "degrees": e + degrees,
        "degrees_multigraph": f"WITH e AS ({_SP}), v AS (SELECT range AS id FROM range({sp_n})) " + degrees,
        "vertex_count": e + "SELECT count(DISTINCT x) AS vertices FROM (SELECT src AS x FROM e UNION ALL SELECT tgt FROM e)",
        "id_dictionary": _with(more=f", {first}") + "SELECT id, orig_id FROM d",
        "id_decode": _with(more=f", {first}") + "SELECT orig_id, id * 2 AS value FROM d",
        "bounds_check": e + "SELECT src, tgt, pos FROM e",
        "symmetrize": e + "SELECT src, tgt, count(*) AS edges FROM (SELECT src, tgt FROM e UNION ALL SELECT tgt, src FROM e) GROUP BY src, tgt",
        "pagerank_1": _pagerank_sql(1),
        "pagerank_5": _pagerank_sql(5),
        "pagerank_20": _pagerank_sql(20),
        "bfs": bfs,
        "bfs_deep": bfs_deep,
        "bfs_sparse": bfs_sparse,
        "bfs_3_rounds": _with(more=f", r AS (SELECT {START}::BIGINT AS v, 0::BIGINT AS x UNION SELECT e.tgt, r.x + 1 FROM r JOIN e ON e.src = r.v WHERE r.x < 3)") + "SELECT id, min(x) AS value FROM v LEFT JOIN r ON r.v = id GROUP BY id",
        "sssp": sssp,
        "cc": _least_sql(_JUMP, "SELECT id, id FROM v", "r.x", "x", _JUMP_IDS),
        "cc_weak": weak["star"],
        "sssp_whole": _least_sql(_EDGES, f"SELECT {START}::BIGINT, 0.0::DOUBLE", "r.x + e.weight", "round(x, 6)"),
        "cc_whole": _least_sql(_EDGES, "SELECT id, id FROM v", "r.x", "x"),
        "cc_weak_whole": weak["whole"],
        "cc_suppliers": _least_sql(_SP, "SELECT id, id FROM v", "r.x", "x", sp_ids),
        "cc_weak_suppliers": weak["suppliers"],
        "adjacency_edges_whole": f"SELECT src, tgt FROM ({_EDGES})",
        "spmv_target": e + spmv.format(x="tgt"),
        "spmv_source": e + spmv.format(x="src"),
        "spmv_weighted": f"WITH e AS ({_SP}), v AS (SELECT range AS id FROM range({sp_n})) SELECT id, round(coalesce(y, 0), 6)::DOUBLE AS y FROM v LEFT JOIN (SELECT tgt, sum(weight * src) AS y FROM e GROUP BY tgt) m ON m.tgt = id",
        "triangles": _with(more=tri) + "SELECT count(*) AS triangles FROM t",
        "triangle_cells": _with(more=tri) + "SELECT a, b, c FROM t",
        "triangles_per_vertex": _with(more=tri) + "SELECT id, coalesce(k, 0) AS triangles FROM v LEFT JOIN (SELECT x, count(*) AS k FROM (SELECT a AS x FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY x) ON x = id",
        "wedges": _with(more=f", p AS MATERIALIZED ({_PAIRS})") + "SELECT id, coalesce(d * (d - 1) // 2, 0) AS wedges FROM v LEFT JOIN (SELECT x, count(*) AS d FROM (SELECT a AS x FROM p UNION ALL SELECT b FROM p) GROUP BY x) ON x = id",
        "triangles_minhash": _minhash_sql(),
        "belief_propagation": beliefs,
        "belief_propagation_5": beliefs,
        "kmeans_assign": "WITH c AS (SELECT * FROM (VALUES (0, 0.0), (1, 2500.0), (2, 5000.0), (3, 7500.0)) t(k, c)) SELECT c_custkey, k FROM (" + _assign_sql("c_acctbal", "c") + ")",
        "kmeans_3": _kmeans_sql(3),
        "active_sources": _with(more=f", r AS (SELECT {START}::BIGINT AS v, 0::BIGINT AS x UNION SELECT e.tgt, r.x + 1 FROM r JOIN e ON e.src = r.v WHERE r.x < 2)") + "SELECT count(DISTINCT v) AS reached FROM r",
        "active_tiles": _with(more=f", t AS MATERIALIZED ({_tile_sql()}), r AS (SELECT {START}::BIGINT AS v, 0::BIGINT AS x UNION SELECT e.tgt, r.x + 1 FROM r JOIN e ON e.src = r.v WHERE r.x < 2)") + "SELECT DISTINCT tile_id FROM t WHERE src IN (SELECT v FROM r)",
        "grid_cells": tiles + "SELECT cell_row, cell_column, count(*) AS edges FROM t GROUP BY ALL",
        "stripe_partition": f"SELECT (id // 128) % 4 AS part, count(*) AS vertices FROM ({_IDS}) GROUP BY part",
        "hilbert_index": tiles + "SELECT DISTINCT cell_row, cell_column, tile_id FROM t",
        "row_first": tiles + f"SELECT cell_column * (SELECT CAST(2 ** ceil(log2(ceil({n} / {SIDE}.0))) AS BIGINT)) + cell_row AS tile_id, count(*) AS edges FROM t GROUP BY 1",
        "column_first": tiles + f"SELECT cell_row * (SELECT CAST(2 ** ceil(log2(ceil({n} / {SIDE}.0))) AS BIGINT)) + cell_column AS tile_id, count(*) AS edges FROM t GROUP BY 1",
        "tile_stats": tiles + "SELECT tile_id, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT tgt) AS targets, count(*) >= 2 * count(DISTINCT tgt) AS use_rle FROM t GROUP BY tile_id",
        "rle_runs": tiles + "SELECT run, count(*) AS runs FROM (SELECT tile_id, tgt, count(*) AS run FROM t GROUP BY ALL) GROUP BY run",
        "vertex_tiles_by_source": tiles + "SELECT src, count(*) AS tile_count, string_agg(tile_id::VARCHAR, ',' ORDER BY tile_id) AS tiles FROM (SELECT DISTINCT src, tile_id FROM t) GROUP BY src",
        "vertex_tile_count_by_target": tiles + "SELECT tgt, count(DISTINCT tile_id) AS tile_count FROM t GROUP BY tgt",
        "local_ids": tiles + "SELECT tile_id, src AS vertex, row_number() OVER (PARTITION BY tile_id ORDER BY min(pos), src) - 1 AS local_id FROM t GROUP BY tile_id, src",
        "engine_of_tile": tiles + "SELECT DISTINCT tile_id, tile_id % 4 AS engine, tile_id // 4 AS number FROM t",
        "rebalance": tiles + "SELECT tile_id, row_number() OVER (ORDER BY tile_id) - 1 AS rank, (row_number() OVER (ORDER BY tile_id) - 1) % 4 AS engine FROM (SELECT DISTINCT tile_id FROM t)",
        "equal_ranges": tiles + "SELECT tile_id, CAST(floor((sum(edges) OVER (ORDER BY tile_id) - edges) * 8 / (sum(edges) OVER ())) AS BIGINT) AS part FROM (SELECT tile_id, count(*) AS edges FROM t GROUP BY tile_id)",
        "target_area": e + "SELECT src, count(*) AS edges FROM e WHERE src >= 10 AND src < 500 AND tgt >= 20 AND tgt < 90 GROUP BY src",
        "hash_weights": e + "SELECT src, tgt, round(((src % 1000003) * 1103515245 + (tgt % 1000003) * 69069 + 12345) % 2147483648 / 4294967296.0, 9) AS weight FROM e",
        "constant_values": e + "SELECT id, 0.5::DOUBLE AS value FROM v",
        "adjacency_edges": f"SELECT src, tgt FROM ({_JUMP})",
        "compare_results": _with(more=f", {both}") + "SELECT a.id AS id, a.y AS a, b.y AS b FROM a JOIN b ON a.id = b.id WHERE a.y <> b.y",
        "compare_results_relative": _with(more=f", {both}") + "SELECT count(*) AS differing FROM a JOIN b ON a.id = b.id WHERE NOT abs(a.y - b.y) <= 0.1 * greatest(abs(a.y), abs(b.y))",
        "compare_labels": "SELECT count(*) FILTER (c_nationkey IS DISTINCT FROM c_nationkey % 5) AS differing, count(DISTINCT c_nationkey) AS labels_a, count(DISTINCT c_nationkey % 5) AS labels_b FROM customer",
        "canonical_labels": "SELECT c_custkey AS id, min(c_custkey::VARCHAR) OVER (PARTITION BY c_nationkey) AS label FROM customer",
        "distribution_stats": tiles + "SELECT min(k)::DOUBLE AS least, max(k)::DOUBLE AS greatest, round(avg(k), 6) AS mean, round(stddev_pop(k), 6) AS deviation, median(k)::DOUBLE AS median FROM (SELECT count(*) AS k FROM t GROUP BY tile_id)",
        "tile_percentiles": tiles + "SELECT unnest([10, 20, 30, 40, 50, 60, 70, 80, 90]) AS p, round(unnest(quantile_cont(k::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])), 6) AS value FROM (SELECT count(*) AS k FROM t GROUP BY tile_id)",
        "price_percentiles": " UNION ALL ".join(f"SELECT l_returnflag, {p}::DOUBLE AS p, round(quantile_cont(l_extendedprice::DOUBLE, {p}), 4) AS value FROM lineitem GROUP BY l_returnflag" for p in (0.05, 0.25, 0.5, 0.75, 0.99)),
        "price_median": "SELECT 0.5::DOUBLE AS p, round(median(l_extendedprice::DOUBLE), 4) AS value FROM lineitem",
        "grid_density": tiles + f", r AS (SELECT CAST(ceil({n} / {SIDE}.0) AS BIGINT) AS rows), g AS (SELECT i.range AS x, j.range AS y FROM r, range((SELECT rows FROM r)) i, range((SELECT rows FROM r)) j), k AS (SELECT x, y, count(t.src) AS k FROM g LEFT JOIN t ON cell_row = x AND cell_column = y GROUP BY x, y) SELECT min(k) AS least, max(k) AS greatest, round(avg(k), 6) AS mean, median(k)::DOUBLE AS median, round(stddev_pop(k), 6) AS deviation FROM k",
        "log_stats": "SELECT event_type AS run, count(*) AS rounds, round(median(v), 4) AS median, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS deviation, round(sum(v), 4) AS total FROM (SELECT event_type, round(abs(value), 3)::DOUBLE AS v FROM events) GROUP BY event_type",
        "disk_throughput": "WITH s AS (SELECT l_linenumber AS device, l_orderkey AS sample, max(l_quantity::BIGINT) AS counter FROM lineitem GROUP BY ALL) SELECT sample, sum(d)::BIGINT AS amount FROM (SELECT sample, counter - lag(counter) OVER (PARTITION BY device ORDER BY sample) AS d FROM s) WHERE d IS NOT NULL GROUP BY sample",
    }
