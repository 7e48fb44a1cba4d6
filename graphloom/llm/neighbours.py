"""Nearest vectors by inner product from a forest of hash prefixes.

A tree gives each vector a string of ``BITS`` bits, the sides of as many random
hyperplanes on which it lies; the more alike two directions, the longer the
prefix that they share. Inner products become directions by one more component:
sqrt(most - |v|^2) for a vector that is found, 0 for one that is asked for.

A tree's strings are sorted arrays, cut into nodes by their first bits and, where
a node is large, by hash into shares. A query descends in every tree to its node
and finds by binary search how many strings share each prefix length with its
own. Then it ascends in all trees at once, from the longest match towards the
root, until the trees together hold ``wanted`` candidates; these are scored where
they lie, as products of matrices, and the best of each node are put together.
No candidate of the depth at which a query stops is left out, however many.

``wanted`` is fitted: up to ``SAMPLE`` of the queries are compared with every
vector, and it is the least number with which these find ``recall`` of their
neighbours. Equal vectors are one entry that stands for all its ids, so copies
are neither compared with each other nor a hot node.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.frames import shuffle_width, tables, written

NEAREST, EVERY, RECALL = 20, 20, 0.95
TREES, BITS, SEED = 16, 48, 7
SAMPLE = 256
NODE_ROWS, SHARE_ROWS, DIRECTORY_BITS = 4096, 65_536, 14  # a directory of at most TREES * 2**14 counts
CHUNK = 2048


class Forest(NamedTuple):
    """The hyperplanes, and the first bits by which nodes are cut."""

    dims: int
    most: float  # the greatest squared length
    trees: int = TREES
    bits: int = BITS
    node_bits: int = 0
    seed: int = SEED

    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.dims + 1, self.trees * self.bits))

    def keys(self, vectors: np.ndarray, planes: np.ndarray, asked: bool) -> np.ndarray:
        """Each vector's string in each tree, as a number."""
        out = np.empty((len(vectors), self.trees), np.int64)
        weights = 2.0 ** np.arange(self.bits - 1, -1, -1)
        for at in range(0, len(vectors), CHUNK):
            v = vectors[at : at + CHUNK]
            rest = np.zeros(len(v)) if asked else np.sqrt(np.maximum(0.0, self.most - np.square(v).sum(axis=1)))
            sides = (np.column_stack([v, rest]) @ planes > 0).astype(np.float64)
            out[at : at + CHUNK] = (sides.reshape(len(v), self.trees, self.bits) @ weights).astype(np.int64)
        return out

    def node(self, keys: np.ndarray) -> np.ndarray:
        return keys >> (self.bits - self.node_bits)


def shared_prefix(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return bits - np.frexp((a ^ b).astype(np.float64))[1]


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims) for a in arrays]
    return np.concatenate(parts) if parts else np.zeros((0, dims))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def entries(vectors: DataFrame, vec_id: str, vector: str, k: int) -> DataFrame:
    """(c, v, low, members): the distinct vectors that take part, with their k + 1 least ids."""
    v = F.col(f"`{vector}`")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast(_element(vectors, vector))))
    alike = Window.partitionBy("h", "v").orderBy("id")
    least = rows.withColumn("h", F.xxhash64("v")).withColumn("r", F.dense_rank().over(alike)).where(F.col("r") <= k + 1)
    found = least.groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("members"))  # k + 1 ids at most
    return found.select(F.monotonically_increasing_id().alias("c"), "v", F.get("members", F.lit(0)).alias("low"), "members", "h")


def _element(vectors: DataFrame, vector: str) -> str:
    kind = vectors.select(F.col(f"`{vector}`")).schema[0].dataType.elementType.simpleString()
    return kind if kind in ("float", "double") else "double"


def _sampled(rows: DataFrame, asked: DataFrame, forest: Forest, k: int, recall: float) -> int:
    """The least number of candidates, counted tree by tree, with which a sample of ``asked`` finds ``recall`` of its neighbours."""
    sample = asked.select("c", "v").orderBy(F.xxhash64("v", F.lit(SEED)), "c").limit(SAMPLE).collect()  # SAMPLE vectors
    own, points = np.array([r["c"] for r in sample]), np.array([r["v"] for r in sample], np.float64).reshape(-1, forest.dims)
    span = forest.bits + 1

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = forest.planes()
        asked_keys = forest.keys(points, planes, True)
        seen = np.zeros((len(points), span), np.int64)
        best, depth = np.zeros((0, len(points))), np.zeros((0, len(points)), np.int64)
        place = np.arange(len(points)) * span
        for batch in it:
            all_ids, all_vectors = batch.column("c").to_numpy(), _matrix(batch.column("v"), forest.dims)
            for at in range(0, len(all_ids), CHUNK):
                v = all_vectors[at : at + CHUNK]
                keys, deepest = forest.keys(v, planes, False), np.zeros((len(v), len(points)), np.int64)
                for t in range(forest.trees):
                    shared = shared_prefix(keys[:, t, None], asked_keys[None, :, t], forest.bits)
                    seen += np.bincount((shared + place).ravel(), minlength=seen.size).reshape(seen.shape)
                    np.maximum(deepest, shared, out=deepest)
                score = np.where(all_ids[at : at + CHUNK, None] == own, -np.inf, v @ points.T)
                best, depth = np.concatenate([best, score]), np.concatenate([depth, deepest])
                top = np.argsort(-best, axis=0, kind="stable")[:k]
                best, depth = np.take_along_axis(best, top, 0), np.take_along_axis(depth, top, 0)
        q = np.broadcast_to(np.arange(len(points)), best.shape)
        some = best > -np.inf
        yield pa.RecordBatch.from_pydict({"q": q[some], "depth": depth[some], "score": best[some], "n": np.zeros(int(some.sum()), np.int64)})
        q, d = np.nonzero(seen)
        yield pa.RecordBatch.from_pydict({"q": q, "depth": d, "score": pa.nulls(len(q), pa.float64()), "n": seen[q, d]})

    found = written(rows.select("c", "v").mapInArrow(compare, "q long, depth long, score double, n long"), "sampled")
    counts = np.zeros((len(points), span), np.int64)
    for r in found.where("score is null").groupBy("q", "depth").agg(F.sum("n").alias("n")).collect():  # SAMPLE * span rows at most
        counts[r["q"], r["depth"]] = r["n"]
    counts = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # candidates with a prefix as long at least
    hits = np.zeros((len(points), span))
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    for r in found.where("score is not null").withColumn("r", first).where(F.col("r") <= k).collect():  # SAMPLE * k rows
        hits[r["q"], r["depth"]] += 1
    hits = hits[:, ::-1].cumsum(axis=1)[:, ::-1]
    share = np.where(hits[:, :1] > 0, hits / np.maximum(hits[:, :1], 1), 1.0)

    def reached(wanted: int) -> float:
        stop = np.where(counts >= wanted, np.arange(span), 0).max(axis=1)
        return float(share[np.arange(len(points)), stop].mean())

    tried = np.unique(counts)
    low, high = 0, len(tried) - 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if reached(int(tried[mid])) >= recall else (mid + 1, high)
    return int(tried[low]) if reached(int(tried[low])) >= recall else int(tried[-1]) + 1


def _directory(rows: DataFrame, forest: Forest) -> np.ndarray:
    """Vectors by tree and node: trees * 2**node_bits counts, at most trees * 2**DIRECTORY_BITS."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, held = forest.planes(), np.zeros((forest.trees, 1 << forest.node_bits), np.int64)
        for batch in it:
            nodes = forest.node(forest.keys(_matrix(batch.column("v"), forest.dims), planes, False))
            for t in range(forest.trees):
                held[t] += np.bincount(nodes[:, t], minlength=held.shape[1])
        tree, node = np.nonzero(held)
        yield pa.RecordBatch.from_pydict({"tree": tree, "node": node, "n": held[tree, node]})

    out = np.zeros((forest.trees, 1 << forest.node_bits), np.int64)
    for r in rows.select("v").mapInArrow(count, "tree long, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).collect():
        out[r["tree"], r["node"]] = r["n"]
    return out


def _dealt(rows: DataFrame, forest: Forest, shares: np.ndarray, names: list[str]) -> DataFrame:
    """Each vector once a tree, with its node, its share of it and its string."""

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = forest.planes()
        for whole in it:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                keys = forest.keys(_matrix(batch.column("v"), forest.dims), planes, False)
                tree = np.tile(np.arange(forest.trees), len(keys))
                flat = keys.ravel()
                node = forest.node(flat)
                row = np.repeat(np.arange(len(keys)), forest.trees)
                share = (batch.column("c").to_numpy()[row] * 0x9E3779B1 >> 16) % shares[tree, node]
                own = [batch.column(n).take(pa.array(row)) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (tree, node, share, flat)] + own, ["tree", "node", "share", "key", *names])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.select("c", "v", *[n for n in names if n not in ("c", "v")]).mapInArrow(deal, "tree long, node long, share long, key long" + (f", {kinds}" if names else ""))


def _routed(asked: DataFrame, forest: Forest, shares: np.ndarray, names: list[str]) -> DataFrame:
    """Each query once a tree, node and share: its own node's, or all below the prefix of ``depth`` bits where that is shorter."""

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = forest.planes()
        for whole in it:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                keys = forest.keys(_matrix(batch.column("v"), forest.dims), planes, True)
                above = np.maximum(0, forest.node_bits - batch.column("depth").to_numpy()) if "depth" in names else np.zeros(len(keys), np.int64)
                for t in range(forest.trees):
                    times = 1 << above
                    row = np.repeat(np.arange(len(keys)), times)
                    node = (forest.node(keys[:, t]) >> above << above)[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    many = shares[t, node]
                    row, node = np.repeat(row, many), np.repeat(node, many)
                    share = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    own = [batch.column(n).take(pa.array(row)) for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(row), t), node, share, keys[row, t])] + own, ["tree", "node", "share", "key", *names])

    kinds = ", ".join(f"{n} {asked.schema[n].dataType.simpleString()}" for n in names)
    return asked.mapInArrow(route, f"tree long, node long, share long, key long, {kinds}")


def _stops(rows: DataFrame, asked: DataFrame, forest: Forest, directory: np.ndarray, shares: np.ndarray, wanted: int, meet) -> DataFrame:
    """``asked`` with ``depth``, the longest prefix at which all trees together hold ``wanted`` vectors (0 if there are not as many)."""
    sums = np.concatenate([np.zeros((forest.trees, 1), np.int64), directory.cumsum(axis=1)], axis=1)
    deep, span = forest.node_bits, forest.bits + 1

    def count(queries: pa.Table, own: pa.Table) -> pa.Table:
        key, out = _numbers(queries, "key"), {}
        held = np.sort(_numbers(own, "key"))
        for d in range(span):
            rest = forest.bits - d
            if d >= deep:
                out[d] = np.searchsorted(held, ((key >> rest) + 1) << rest) - np.searchsorted(held, key >> rest << rest)
            elif len(key) and queries.column("share")[0].as_py() == 0:  # once a tree
                tree, node, above = queries.column("tree")[0].as_py(), forest.node(key), deep - d
                out[d] = sums[tree, ((node >> above) + 1) << above] - sums[tree, node >> above << above]
            else:
                out[d] = np.zeros(len(key), np.int64)
        return pa.table({"q": queries.column("q"), **{f"n{d}": pa.array(x, pa.int64()) for d, x in out.items()}})

    counted = meet(_routed(asked, forest, shares, ["q"]), _dealt(rows, forest, shares, []), count, "q long, " + ", ".join(f"n{d} long" for d in range(span)))
    total = counted.groupBy("q").agg(*[F.sum(f"n{d}").alias(f"n{d}") for d in range(span)])
    depth = F.greatest(*[F.when(F.col(f"n{d}") >= wanted, F.lit(d)).otherwise(0) for d in range(span)]).cast("long")
    return asked.join(total.select("q", depth.alias("depth")), "q")


def _scored(forest: Forest, k: int):
    """Queries of a node against its vectors: the k + 1 best of each by exact score, ties by least id."""

    def best(queries: pa.Table, own: pa.Table) -> pa.Table:
        q, key, depth, asked = _numbers(queries, "q"), _numbers(queries, "key"), _numbers(queries, "depth"), _matrix(queries.column("v"), forest.dims)
        order = np.argsort(_numbers(own, "key"), kind="stable")
        held, c, low, v = _numbers(own, "key")[order], _numbers(own, "c")[order], _numbers(own, "low")[order], _matrix(own.column("v"), forest.dims)[order]
        rest = forest.bits - np.maximum(depth, forest.node_bits)
        first, last = np.searchsorted(held, key >> rest << rest), np.searchsorted(held, ((key >> rest) + 1) << rest)
        found: list[list[np.ndarray]] = [[], [], [], []]
        for a, b in sorted(set(zip(first.tolist(), last.tolist()))):  # queries that ask for one stretch of the sorted array
            if a == b:
                continue
            these = np.flatnonzero((first == a) & (last == b))
            for at in range(0, len(these), 256):
                some = these[at : at + 256]
                rough = asked[some] @ v[a:b].T
                n = min(k + 1, b - a)
                edge = np.partition(rough, b - a - n, axis=1)[:, b - a - n]
                row, column = np.nonzero(rough >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None])
                exact = np.multiply(asked[some][row], v[a:b][column]).sum(axis=1)
                sort = np.lexsort((low[a:b][column], -exact, row))
                row, column, exact = row[sort], column[sort], exact[sort]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                kept = place < n
                for out, x in zip(found, (q[some][row], c[a:b][column], low[a:b][column], exact)):
                    out.append(x[kept])
        empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table({n: np.concatenate([e, *x]) for n, e, x in zip(("q", "c", "low", "score"), empty, found)})

    return best


def nearest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST, every: int = EVERY, recall: float = RECALL, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` its ``k`` nearest ids found, by inner product in
    double precision, ties to the smaller id; all others if there are fewer.

    Vectors that are null, zero, hold a null or a number that is not finite, or have another length than most, take no
    part, nor do rows without an id. Rows alike count once; an id with several vectors can be found and asked for by each
    and is listed once, by its best. An empty table gives none; other columns are not read.
    """
    spark, width = vectors.sparkSession, shuffle_width(vectors.sparkSession)
    rows = written(entries(vectors, vec_id, vector, k), "vectors")
    ids = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("query_id"), F.col(f"`{vector}`").alias("_v")).where(F.col("query_id") % every == 0)
    ids = ids.withColumn("_v", F.transform("_v", lambda x: x + F.lit(0).cast(_element(vectors, vector)))).withColumn("_h", F.xxhash64("_v"))
    ids = written(ids.join(rows.select("c", "h", "v"), (F.col("_h") == F.col("h")) & (F.col("_v") == F.col("v"))).select("query_id", F.col("c").alias("q")).distinct(), "asked-ids")
    asked = written(rows.join(ids.select("q").distinct(), F.col("c") == F.col("q"), "left_semi").select(F.col("c").alias("q"), "c", "v"), "asked")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = rows.agg(F.count("*").alias("n"), F.max(square).alias("most"), F.max(F.size("v")).alias("dims")).first()
    if not size["n"] or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    bits = min(DIRECTORY_BITS, max(0, (size["n"] // NODE_ROWS).bit_length()))
    forest = Forest(size["dims"], size["most"], trees, BITS, bits, seed)
    wanted = _sampled(rows, asked, forest, k, recall)
    directory = _directory(rows, forest)
    shares = np.maximum(1, -(-directory // SHARE_ROWS))

    def meet(queries: DataFrame, own: DataFrame, met, schema: str) -> DataFrame:
        by = lambda df: df.repartition(width, "tree", "node", "share").groupBy("tree", "node", "share")
        return by(queries).cogroup(by(own)).applyInArrow(met, schema)

    stops = written(_stops(rows, asked.select("q", "v"), forest, directory, shares, wanted, meet), "stops")
    found = meet(_routed(stops, forest, shares, ["q", "depth", "v"]), _dealt(rows, forest, shares, ["c", "low", "v"]), _scored(forest, k), "q long, c long, low long, score double")
    order = [F.desc("score"), "low"]
    best = found.distinct().withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("r") <= k + 1)
    each = best.join(rows.select(F.col("c").alias("_c"), "members"), F.col("c") == F.col("_c")).select("q", "score", F.explode("members").alias("vec_id"))
    each = each.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    first = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    lists = ids.join(written(first, "nearest"), "q").where("query_id != vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: each twentieth id against all embeddings."""
    return nearest(tables(spark, sf_dir, "embeddings"))
