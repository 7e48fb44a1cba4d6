"""Token-ID output in coded blocks, and its way back.

Documents are ranged by id and sorted, tokenised, and cut into blocks of whole
documents; each block is coded by itself (``coder``) and written as one row of a
Parquet table: (part, block, doc_ids, lengths, n_ids, index_crc32, payload).
Parquet gives the rows Spark's commit protocol and its readers on any store; the
payload is the file format, with its own header and checksum. ``part`` is the
least id of a range and ``block`` a running number in it, so blocks are told
apart by what they hold, whatever tasks wrote them. In the order of (part, block,
document) ids ascend. ``index_crc32`` covers all other columns but the payload.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.coder import decode_block, encode_block
from graphloom.llm.frames import shuffle_width, small, tables, written
from graphloom.llm.tokens import encoder, texts
from graphloom.llm.words import batches

BLOCK_IDS = 1 << 21
END_ID = 1


def _index_crc(part: int | None, block: int, names: list[int | None], lengths: np.ndarray, n_ids: int) -> int:
    known = np.array([x is not None for x in names], np.uint8)
    numbers = np.array([x or 0 for x in names], "<i8")
    return zlib.crc32(b"".join([repr((part, block, n_ids)).encode(), known.tobytes(), numbers.tobytes(), np.asarray(lengths, "<i8").tobytes()]))


def coded(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS, lane: int = 128) -> DataFrame:
    """The rows of the block table, in memory order; write them as Parquet, over as many or few tasks as you like.

    ``end_id`` closes each document. Null texts count as empty; repeated ids stay, next to each other, and null ids come
    first; a document over ``block_ids`` is a block alone. ``doc_id`` must be an integer column.
    """
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    ranged = rows.repartitionByRange(shuffle_width(documents.sparkSession), "_id").sortWithinPartitions("_id")

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, number = encoder(tokenizer), None, 0
        end = np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def block() -> pa.RecordBatch:
            stream = np.frombuffer(b"".join(ids), "<u4")
            lengths = [len(x) // 4 for x in ids]
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int64()),
                    "block": pa.array([number], pa.int32()),
                    "doc_ids": pa.array([names], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "n_ids": pa.array([len(stream)], pa.int64()),
                    "index_crc32": pa.array([_index_crc(part, number, names, lengths, len(stream))], pa.int64()),
                    "payload": pa.array([encode_block(stream, lane)], pa.binary()),
                }
            )

        fresh = True
        for batch in batches(it, "_text"):
            for name, x in zip(batch.column("_id").to_pylist(), tokens.encode(texts(batch.column("_text")))):
                if fresh:
                    part, fresh = name, False  # ranges don't share an id
                x += end
                if ids and size + len(x) // 4 > block_ids:
                    yield block()
                    ids, names, size, number = [], [], 0, number + 1
                ids.append(x)
                names.append(name)
                size += len(x) // 4
        if ids:
            yield block()

    return ranged.mapInArrow(encode, "part long, block int, doc_ids array<long>, lengths array<long>, n_ids long, index_crc32 long, payload binary")


def decoded(blocks: DataFrame, doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Read a block table back: id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the
    ids (binary, unsigned little-endian 32-bit). A block that differs from what was written raises ValueError."""
    heads = blocks.select("part", "block", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy(F.col("part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # one row per range: no more than shuffle partitions
    total = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = heads.join(total, F.col("part").eqNullSafe(F.col("p")))
    starts = placed.select(F.col("part").alias("p"), F.col("block").alias("b"), (F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("base"))

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                part, number, n_ids, base = (batch.column(c)[k].as_py() for c in ("part", "block", "n_ids", "base"))
                lengths = np.array(batch.column("lengths")[k].as_py(), np.int64)
                if _index_crc(part, number, batch.column("doc_ids")[k].as_py(), lengths, n_ids) != batch.column("index_crc32")[k].as_py():
                    raise ValueError("damaged block index")
                data = decode_block(batch.column("payload")[k].as_py()).astype("<u4").tobytes()
                edges = np.concatenate([[0], np.cumsum(lengths)])
                if not edges[-1] == n_ids == len(data) // 4:
                    raise ValueError("a block's index is not its payload's")
                view = memoryview(data)
                cuts = [view[a * 4 : b * 4] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                out = {
                    "_id": batch.column("doc_ids")[k].values,
                    "start": pa.array(edges[:-1] + base, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([bytes(c) for c in cuts], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    found = blocks.join(small(starts), F.col("part").eqNullSafe(F.col("p")) & (F.col("block") == F.col("b")))
    rows = found.select("part", "block", "n_ids", "base", "index_crc32", "doc_ids", "lengths", "payload")
    docs = rows.mapInArrow(decode, "_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    return docs.withColumnRenamed("_id", doc_id)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: encode all documents, write the coded blocks, read them back."""
    import public_tokenizers

    made = coded(tables(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return decoded(written(made, "blocks"))
