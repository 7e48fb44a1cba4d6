"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Every document becomes the set of its hashed word ``n``-grams and 128 MinHash
   values of it; documents with equal sets (copies) become one class.
2. Bands of four values bring together classes that may be similar. Buckets that
   are too large for one task are cut into blocks, and blocks meet pairwise.
3. Within a bucket pairs are compared a few MinHash values at a time. After each
   step a pair is dropped if, given its matches so far, the posterior probability
   that its similarity reaches the threshold is below ``tolerance`` (uniform
   prior, so the posterior is a Beta distribution). What is left forms clusters.
4. A cluster's pairs are verified exactly on their n-gram sets, again block by
   block. Links are counted where they are found and only chains of linked
   classes leave a task, so a group of m near copies costs no m**2 rows; that
   they are counted takes m**2 comparisons, and a set is sent to as many tasks as
   its cluster has blocks: of 512 sets up to 16 blocks, then of 2,048 or 16 MB.

Four values a band and 32 bands miss a pair at the threshold 0.8 with probability
5e-8, and the default tolerance adds about as little.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.frames import beside_group, shuffle_width, small, tables, written
from graphloom.llm.words import ALNUM_WORDS, Words, batches, lower_ascii, mix64, utf8

N, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
HASHES, BAND = 128, 4
STEPS = (16, 32, 64, 128)
BUCKET_BLOCK = 8192  # classes of a bucket's block: 2 MB of signatures
BLOCK, BLOCK_BYTES = 2048, 16 << 20  # sets of a cluster's block
FINER, FINER_BLOCKS = 4, 16  # blocks are a quarter of that while there are no more than 16, so that many tasks share the work
_U = np.uint64
_PRIMES = mix64(np.arange(1, 2 * HASHES + 1, dtype=_U))
_FACTOR = (_PRIMES[:HASHES] >> _U(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (_PRIMES[HASHES:] >> _U(32)).astype(np.uint32)


def _sets(batch: pa.RecordBatch, column: str, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words, but not none, is one gram."""
    data, offsets = utf8(batch.column(column))
    words = Words(lower_ascii(data), offsets, ALNUM_WORDS)
    grams, _ = words.windows(n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            seed = mix64(np.array([b - a], dtype=_U))
            for h in words.hashes[a:b]:
                seed = mix64(seed * _U(0x9E3779B97F4A7C15) + h)
            out.append(seed)
        else:
            out.append(np.zeros(0, _U))
    return out


def _minhash(grams: np.ndarray) -> np.ndarray:
    """128 values of 16 bits; two sets agree in one with probability J + (1 - J) / 65536."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    small = (grams >> _U(32)).astype(np.uint32)
    for at in range(0, len(small), 2048):
        part = small[at : at + 2048]
        low = np.minimum(low, (part[None, :] * _FACTOR[:, None] + _SHIFT[:, None]).min(axis=1))
    return (mix64(low) >> _U(48)).astype(np.uint16)


def _key(grams: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        mixed = mix64(grams + _U(0x632BE59BD9B4E019))
        return int(mix64(np.array([mixed.sum() + _U(len(grams))], _U)).view(np.int64)[0]), int(np.bitwise_xor.reduce(mixed, initial=_U(0)).astype(_U).view(np.int64))


def signatures(documents: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(_id, v, w, size, sig): v and w are a 128-bit key of the n-gram set, size its size."""

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "_text"):
            sets = _sets(batch, "_text", n)
            keys = [_key(s) for s in sets]
            yield pa.RecordBatch.from_pydict(
                {
                    "_id": batch.column("_id"),
                    "v": pa.array([k[0] for k in keys], pa.int64()),
                    "w": pa.array([k[1] for k in keys], pa.int64()),
                    "size": pa.array([len(s) for s in sets], pa.int64()),
                    "sig": pa.array([_minhash(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                }
            )

    rows = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    return rows.mapInArrow(make, f"_id {dict(rows.dtypes)['_id']}, v long, w long, size long, sig binary")


def least_matches(threshold: float, tolerance: float, steps: tuple[int, ...] = STEPS) -> dict[int, int]:
    """For each number of values compared, the fewest matches that keep a pair: P(J >= threshold | matches) >= tolerance."""
    out = {}
    for n in steps:
        for m in range(n + 1):
            # the tail of Beta(m+1, n-m+1) beyond t is P(Binomial(n+1, t) <= m)
            tail = sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))
            if tail >= tolerance:
                out[n] = m
                break
    return out


def _survive(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Rows of which a and b are kept after all steps."""
    at = np.arange(len(a))
    matches, done = np.zeros(len(a), np.int64), 0
    for n, enough in least.items():
        matches = matches + (a[at, done:n] == b[at, done:n]).sum(axis=1)
        keep = matches >= enough
        at, matches, done = at[keep], matches[keep], n
        if not len(at):
            break
    return at


def _groups(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by ``keys``, many at a time: (rows, where groups begin and the last one ends)."""
    rest: pa.Table | None = None
    for batch in it:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        cuts = _cuts(table, keys)
        if len(cuts) > 1:
            yield table.slice(0, int(cuts[-1])), cuts
        rest = table.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        yield rest, np.append(_cuts(rest, keys), rest.num_rows)


def _cuts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _blocked(rows: DataFrame, member: str, blocks: Column) -> DataFrame:
    """Rows with (lo, hi): a group of ``blocks`` blocks is cut by hash, and a row is in every pair of its block with another or itself."""
    n = blocks.cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(11)), n).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("*", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi")).drop("_other")


def _bands(classes: DataFrame) -> DataFrame:
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            quads = np.ascontiguousarray(sigs).view(_U)  # four 16-bit values each
            seeds = mix64(np.arange(1, quads.shape[1] + 1, dtype=_U))
            bands = mix64(mix64(quads.reshape(-1)).reshape(quads.shape) ^ seeds[None, :])
            v = np.repeat(batch.column("v").to_numpy(), quads.shape[1])
            yield pa.RecordBatch.from_pydict({"band": pa.array(bands.reshape(-1).view(np.int64)), "v": pa.array(v)})

    return classes.where(F.col("sig").isNotNull()).select("v", "sig").mapInArrow(cut, "band long, v long")


def _candidate_edges(classes: DataFrame, least: dict[int, int], block: int) -> DataFrame:
    """(u, v): pairs of classes, or chains of them, that the pruning leaves."""
    bands = _bands(classes)
    full = bands.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    shared = beside_group(bands, "band", full, "m", classes.count() * HASHES // BAND)
    met = _blocked(shared, "v", F.ceil(F.col("m") / block))
    with_sig = met.select("band", "lo", "hi", "v").join(classes.select("v", "sig"), "v")
    dealt = with_sig.repartition(shuffle_width(classes.sparkSession), "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "v")

    def prune(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _groups(it, ["band", "lo", "hi"]):
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            v, sizes = table.column("v").to_numpy(), np.diff(cuts)
            of = np.repeat(np.arange(len(sizes)), sizes)
            left, right = [], []
            small = sizes <= 8
            for d in range(1, 8):  # pairs within small groups, all groups at once
                a = np.flatnonzero((of[:-d] == of[d:]) & small[of[:-d]])
                kept = a[_survive(sigs[a], sigs[a + d], least)]
                left.append(v[kept]), right.append(v[kept + d])
            for g in np.flatnonzero(~small):
                rows = np.arange(cuts[g], cuts[g + 1])
                while len(rows):  # grow one cluster: whatever survives against a member belongs to it
                    grown, rows = rows[:1], rows[1:]
                    while len(grown) and len(rows):
                        head, grown = grown[0], grown[1:]
                        hit = _survive(np.broadcast_to(sigs[head], (len(rows), HASHES)), sigs[rows], least)
                        if len(hit):
                            left.append(np.full(len(hit), v[head])), right.append(v[rows[hit]])
                            grown = np.concatenate([grown, rows[hit]])
                            rows = np.delete(rows, hit)
            yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(left)), "v": pa.array(np.concatenate(right))})

    return dealt.mapInArrow(prune, "u long, v long")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    if m <= 4:
        out = np.zeros((m, m), np.float32)
        for i in range(m):
            for j in range(i + 1, m):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    rows, columns = rows[keep], number[inverse[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out, width = np.zeros((m, m), np.float32), 2048
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(columns, [at, at + width])
        dense = np.zeros((m, width), np.float32)
        dense[rows[lo:hi], columns[lo:hi] - at] = 1
        out += dense @ dense.T
    return out


def _verified(documents: DataFrame, doc_id: str, text: str, n: int, threshold: float, classes: DataFrame, clusters: DataFrame, block: int) -> DataFrame:
    """(v, links, root): for each class and block pair, its links (weighted by copies) there and the least class chained to it."""
    spark = documents.sparkSession
    # a cluster's least class is in it too
    members = clusters.union(clusters.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("v"), F.col("v").alias("cluster"))
    known = written(classes.select("v", "rep", "copies", "size").join(members, "v"), "members")
    m = F.count("*")
    parts = F.greatest(m / block, F.least(m * FINER / block, F.lit(FINER_BLOCKS)), F.sum("size") * 8 / BLOCK_BYTES)
    blocks = known.groupBy("cluster").agg(F.ceil(parts).alias("blocks"))
    large = small(written(blocks.where("blocks > 1"), "large"))
    needed = written(known.join(large, "cluster", "left").drop("size").fillna(1, ["blocks"]), "needed")
    rows = documents.select(F.col(f"`{doc_id}`").alias("rep"), F.col(f"`{text}`").cast("string").alias("_text"))
    sent = small(needed)
    source = rows.join(sent, rows["rep"].eqNullSafe(sent["rep"])).select("v", "copies", "cluster", "blocks", "_text")

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "_text"):
            sets = _sets(batch, "_text", n)
            own = pa.array([_key(s)[0] for s in sets], pa.int64())
            out = {c: batch.column(c) for c in ("v", "copies", "cluster", "blocks")} | {"grams": pa.array([s.tobytes() for s in sets], pa.binary())}
            import pyarrow.compute as pc

            yield pa.RecordBatch.from_pydict(out).filter(pc.equal(own, batch.column("v")))  # rows that share an id

    sets = source.mapInArrow(read, "v long, copies long, cluster long, blocks long, grams binary")
    dealt = _blocked(sets, "v", F.col("blocks")).repartition(shuffle_width(spark), "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "_own", "v")

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _groups(it, ["cluster", "lo", "hi"]):
            ids, copies, own = (table.column(c).to_numpy() for c in ("v", "copies", "_own"))
            lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
            grams = table.column("grams")
            out_v, out_links, out_root = [], [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                at = a + np.unique(ids[a:b], return_index=True)[1]  # rows that repeat are one class
                if len(at) < 2:
                    continue
                parts = [np.frombuffer(grams[int(k)].as_py(), _U) for k in at]
                linked = _linked(parts, threshold, own[at] if lo[a] != hi[a] else None)
                v = ids[at]
                out_v.append(v), out_links.append(_counted(linked, copies[at])), out_root.append(_roots(linked, v))
            if out_v:
                v, links, root = np.concatenate(out_v), np.concatenate(out_links), np.concatenate(out_root)
                hit = links > 0
                yield pa.RecordBatch.from_pydict({"v": pa.array(v[hit]), "links": pa.array(links[hit].astype(np.int64)), "root": pa.array(root[hit])})

    return dealt.mapInArrow(verify, "v long, links long, root long")


def _linked(sets: list[np.ndarray], threshold: float, own: np.ndarray | None) -> np.ndarray:
    """Which sets are similar; with ``own``, the block of each, only between different blocks."""
    common, sizes = _common(sets), np.array([len(p) for p in sets], np.float64)
    out = np.zeros(common.shape, bool)
    for a in range(0, len(sets), 256):  # some rows at a time: temporaries stay small
        part = common[a : a + 256].astype(np.float64)
        out[a : a + 256] = part >= threshold * (sizes[a : a + 256, None] + sizes[None, :] - part) - 1e-9
        if own is not None:
            out[a : a + 256] &= own[a : a + 256, None] != own[None, :]
    np.fill_diagonal(out, False)
    return out


def _counted(linked: np.ndarray, copies: np.ndarray) -> np.ndarray:
    return np.concatenate([(linked[a : a + 256] * copies[None, :]).sum(axis=1) for a in range(0, len(copies), 256)])


def _roots(linked: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least v reachable from each row."""
    root = v.copy()
    left = np.ones(len(v), bool)
    for k in np.argsort(v):
        if left[k]:
            left[k], front = False, np.array([k])
            while len(front):
                root[front] = v[k]
                front = np.flatnonzero(linked[front].any(axis=0) & left)
                left[front] = False
    return root


def similarity_classes(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, bucket_block: int = BUCKET_BLOCK
) -> DataFrame:
    """One row per row of ``documents``: id, class_id (least id of all rows chained to it by links), n_links (other rows
    with Jaccard similarity >= ``threshold``, copies included), n_copies (rows with the same n-grams) and rep_id (the least id among those).

    Words are runs of ASCII letters (lower-cased), digits and anything beyond ASCII. Texts without words, null ones
    included, have no n-grams, no links, and each is a class by itself. Columns that aren't named are not read. An
    empty table gives no rows.
    """
    sigs = written(signatures(documents, doc_id, text, n), "signatures")
    classes = written(sigs.where("size > 0").groupBy("v", "w").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig")), "classes")
    clusters = components(_candidate_edges(classes, least_matches(threshold, tolerance), bucket_block), "clusters")
    found = written(_verified(documents, doc_id, text, n, threshold, classes, clusters, block), "verified")
    chained = components(found.select(F.col("v").alias("u"), F.col("root").alias("v")), "chained")
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    roots = chained.select(F.col("u").alias("v"), F.col("v").alias("root"))
    whole = classes.select("v", "w", "rep", "copies").join(links, "v", "left").join(roots, "v", "left")
    whole = written(whole.select("v", "w", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "v").alias("root")), "linked")
    class_ids = whole.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("n"))
    whole = beside_group(whole, "root", class_ids, "n", classes.count()).select("v", "w", "rep", "copies", "links", "class_id")
    out = sigs.select("_id", "v", "w", "size").join(whole, ["v", "w"], "left")
    return out.select(
        F.col("_id").alias(doc_id),
        F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("_id")).alias("class_id"),
        F.when(F.col("size") > 0, F.col("links") + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"),
        F.when(F.col("size") > 0, F.col("rep")).otherwise(F.col("_id")).alias("rep_id"),
    )


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``documents``, all columns, with the least id of each class of near duplicates alone; rows alike in id and text become one. Texts without words stay."""
    found = similarity_classes(documents, doc_id, text, **options)
    kept = found.where(F.col(f"`{doc_id}`").eqNullSafe(F.col("class_id"))).select(F.col(f"`{doc_id}`").alias("_kept")).distinct()
    rows = documents.withColumn("_text_hash", F.xxhash64(F.col(f"`{text}`").cast("string")))
    rows = rows.join(kept, rows[f"`{doc_id}`"].eqNullSafe(kept["_kept"]), "left_semi")
    return rows.dropDuplicates([doc_id, "_text_hash"]).drop("_text_hash")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document with its class of near duplicates and its number of links."""
    return similarity_classes(tables(spark, sf_dir, "documents"))
