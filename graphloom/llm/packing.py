"""Mixture-controlled packing: deficit round-robin over source queues.

A source's queue is the stream of its documents' tokens, cut into grains of
``grain`` tokens. Each round grants every source a quantum of ``weight x window``
tokens on top of the deficit it carries, and serves as many whole grains as that
allows; rounds follow each other without a gap and every ``window`` tokens of the
stream are one sequence. How much a source has been served after k rounds is
floor(k x quantum), so any grain's place follows from its number in its queue by
integer arithmetic: deficits carry across windows and partitions without any
task waiting for another. A source that runs dry leaves the round, and the
weights of the rest are scaled up (a new phase). Tails under one grain follow at
the end, so only the last sequence of all is short.

Ids are written once to the shared folder, each row with its partition and its
offset among that partition's tokens of the source; the offsets of partitions in
the queues are running sums over one row per source and partition.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.frames import arrow_rows, tables, written
from graphloom.llm.tokens import encoder, texts
from graphloom.llm.words import batches

WINDOW, GRAIN, END_ID, MAX_QUEUES = 1024, 128, 0, 1024
ARROW_ROWS = 1000
MAX_BASES = 200_000  # rows of a queue's name, a partition and a number


def tokenized(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", end_id: int = END_ID, max_queues: int = MAX_QUEUES, weighted: Iterable[str] = ()) -> DataFrame:
    """(id, queue, part, local, n_tokens, ids binary): each row's ids as unsigned little-endian 32-bit values with
    ``end_id`` last, and where they begin among its partition's tokens of its queue.

    A queue is a source, null being one of its own. Of more than ``max_queues`` sources those in ``weighted`` (queue
    names, as in ``packed``) and the largest, half of all queues together, keep their own; the small rest share the other
    queues by hash. Written to the shared folder, so partitions stay as they are.
    """

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, done = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches(it, "_text", 1 << 20):
            ids = [x + end for x in coder.encode(texts(batch.column("_text")))]
            counts = [len(x) // 4 for x in ids]
            local = []
            for queue, n in zip(batch.column("_queue").to_pylist(), counts):
                local.append(done[queue])
                done[queue] += n
            yield pa.RecordBatch.from_pydict(
                {
                    "_id": batch.column("_id"),
                    "_queue": batch.column("_queue"),
                    "part": pa.array([part] * len(ids), pa.int32()),
                    "local": pa.array(local, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                }
            )

    known = documents.select(F.col(source).cast("string").alias("s")).distinct().limit(max_queues + 1).count()
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    queue = name
    if known > max_queues:
        own = list(dict.fromkeys(weighted))
        size = F.sum(F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)) + 1)
        largest = documents.select(name.alias("name"), F.col(f"`{text}`")).where(~F.col("name").isin(own)).groupBy("name").agg(size.alias("size")).orderBy(F.desc("size"), "name")
        own += [r["name"] for r in largest.limit(max(0, max_queues // 2 - len(own))).collect()]
        queue = F.when(name.isin(own), name).otherwise(F.pmod(F.xxhash64(name), F.lit(max(1, max_queues - len(own)))).cast("string"))
    rows = documents.select(F.col(f"`{doc_id}`").alias("_id"), queue.alias("_queue"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    with arrow_rows(documents.sparkSession, ARROW_ROWS):
        return written(rows.mapInArrow(encode, f"_id {kind}, _queue string, part int, local long, n_tokens long, ids binary"), "tokens")


class Plan:
    """Places of grains: phases with, per source in the order of ``queues``, the first grain and the number of grains."""

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None, window: int, grain: int):
        self.queues = sorted(totals)
        self.window, self.grain, self.per_window = window, grain, window // grain
        self.number = {q: k for k, q in enumerate(self.queues)}
        grains = [totals[q] // grain for q in self.queues]
        tails = [totals[q] % grain for q in self.queues]
        self.grains = np.array(grains, np.int64)
        self.tail_at = sum(grains) * grain + np.cumsum([0, *tails])[:-1].astype(np.int64) if grains else np.zeros(0, np.int64)
        shares = [grains[k] if weights is None else max(0.0, float(weights.get(q, 0.0))) for k, q in enumerate(self.queues)]
        self.phases: list[tuple[int, np.ndarray, np.ndarray]] = []  # first slot, first grain and grains of each source
        left, taken, slot = list(grains), [0] * len(grains), 0
        while any(left):
            active = [k for k, n in enumerate(left) if n]
            if not any(shares[k] > 0 for k in active):  # what has no weight comes last, in proportion
                shares = [float(n) for n in left]
            active = [k for k in active if shares[k] > 0]
            rounds = min(left[k] / shares[k] for k in active)
            take = [0] * len(grains)
            for k in active:
                take[k] = min(left[k], int(shares[k] * rounds))
                if left[k] / shares[k] <= rounds:
                    take[k] = left[k]
            self.phases.append((slot, np.array(taken, np.int64), np.array(take, np.int64)))
            for k, n in enumerate(take):
                taken[k] += n
                left[k] -= n
            slot += sum(take)

    def places(self, source: np.ndarray, number: np.ndarray) -> np.ndarray:
        """First address of grain ``number`` of each ``source`` (indices); the grain after the last is the tail."""
        out = np.where(number >= self.grains[source], self.tail_at[source], 0)
        for slot, first, count in self.phases:
            mine = np.flatnonzero((number >= first[source]) & (number < first[source] + count[source]))
            for part in np.array_split(mine, max(1, len(mine) * len(count) // 2_000_000 + 1)):
                if len(part):
                    out[part] = (slot + self._round_robin(source[part], number[part] - first[source[part]], count)) * self.grain
        return out

    def _round_robin(self, source: np.ndarray, i: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Slot within the phase of the i-th grain of each source: quantum_s = per_window * count_s / sum(count)."""
        total, per = int(count.sum()), self.per_window
        mine = count[source]
        turn = -muldiv(-(i + 1), np.int64(total), per * mine) - 1  # the round in which it is served
        before = np.minimum(muldiv(turn[:, None] * per, count[None, :], np.int64(total)), count[None, :])
        after = np.minimum(muldiv((turn[:, None] + 1) * per, count[None, :], np.int64(total)), count[None, :])
        earlier = np.arange(len(count))[None, :] < source[:, None]
        return before.sum(axis=1) + ((after - before) * earlier).sum(axis=1) + i - before[np.arange(len(i)), source]


def muldiv(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """floor(a * b / c) in 64-bit integers, whatever the product: c over 0 and under 2**61, the result under 2**61.

    The quotient of extended floats is off by little; what it is off by is known from the product modulo 2**64.
    """
    with np.errstate(over="ignore"):
        if abs(a).max(initial=0) * float(abs(b).max(initial=0)) < 2**62:
            return a * b // c
        q = np.floor(a.astype(np.longdouble) * b.astype(np.longdouble) / c.astype(np.longdouble)).astype(np.int64)
        return q + (a * b - q * c) // c


def packed(tokens: DataFrame, doc_id: str = "doc_id", window: int = WINDOW, grain: int = GRAIN, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per piece of a row of ``tokenized``: id, start (its ids before the piece), length, ids_crc32, doc_tokens,
    sequence_id, offset, queue.

    ``weights`` gives target token shares by queue ("=" and the source's name; "null" for null); one that matches no queue
    is an error (name it to ``tokenized`` as ``weighted``). Without it each queue's share of all tokens is its target: for
    a shared queue the sum of its sources' shares. Every id lies in exactly one piece, whatever the weights. An empty table gives no rows; a row with
    a null or empty text has its end id alone.
    """
    if window % grain:
        raise ValueError("a window must hold whole grains")
    by_part = tokens.groupBy("_queue", "part").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("_queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("_queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if bases.count() <= MAX_BASES:  # else a shuffle joins them
        bases = F.broadcast(bases)
    totals = {r["_queue"]: r["n"] for r in by_part.groupBy("_queue").agg(F.sum("n").alias("n")).collect()}
    if totals and (lost := sorted(set(weights or ()) - set(totals))):
        raise ValueError(f"weights that match no queue: {lost}")
    plan = Plan(totals, weights, window, grain)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 2000):
                yield _pieces(whole.slice(at, 2000), plan)

    kind = dict(tokens.dtypes)["_id"]
    rows = tokens.join(bases, ["_queue", "part"]).select("_id", "_queue", (F.col("base") + F.col("local")).alias("at"), "n_tokens", "ids")
    out = rows.mapInArrow(cut, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")
    return out.withColumnRenamed("_id", doc_id)


def _pieces(batch: pa.RecordBatch, plan: Plan) -> pa.RecordBatch:
    grain, window = plan.grain, plan.window
    at = batch.column("at").to_numpy(zero_copy_only=False)
    n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
    names = batch.column("_queue")
    source = np.array([plan.number[q] for q in names.to_pylist()], np.int64)
    # a piece for each grain that a document touches; what lies beyond the whole grains is the tail
    first, last = at // grain, (at + n - 1) // grain
    counts = last - first + 1
    doc = np.repeat(np.arange(len(at)), counts)
    number = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin, end = np.maximum(number * grain, at[doc]), np.minimum((number + 1) * grain, at[doc] + n[doc])
    address = plan.places(source[doc], number) + begin - number * grain
    length, start = end - begin, begin - at[doc]
    # only a tail can reach over the end of a window
    over = address % window + length - window
    wide = np.flatnonzero(over > 0)
    if len(wide):
        doc, start = np.append(doc, doc[wide]), np.append(start, start[wide] + length[wide] - over[wide])
        address = np.append(address, address[wide] + length[wide] - over[wide])
        length[wide] -= over[wide]
        length = np.append(length, over[wide])
        order = np.lexsort((start, doc))
        doc, start, address, length = doc[order], start[order], address[order], length[order]
    # neighbours in one window are one piece
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (address[1:] != address[:-1] + length[:-1]) | (address[1:] // window != address[:-1] // window)
    heads = np.flatnonzero(fresh)
    length = np.add.reduceat(length, heads)
    doc, start, address = doc[heads], start[heads], address[heads]
    ids = [memoryview(x) for x in batch.column("ids").to_pylist()]
    crc = [zlib.crc32(ids[d][s * 4 : (s + m) * 4]) for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist())]
    rows = pa.array(doc)
    return pa.RecordBatch.from_pydict(
        {
            "_id": batch.column("_id").take(rows),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": pa.array(n[doc], pa.int64()),
            "sequence_id": pa.array(address // window, pa.int64()),
            "offset": pa.array(address % window, pa.int64()),
            "queue": names.take(rows),
        }
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all documents packed into sequences of 1024 tokens."""
    import public_tokenizers

    return packed(tokenized(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
