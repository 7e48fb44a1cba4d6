"""Substring dedup: Rabin-Karp hashes of every window of ``window`` words, counted in Spark.

Documents are dealt by hash into chunks of about a megabyte. Each chunk hashes
all its windows, keeps its distinct hashes sorted (the map-side count) and
sends them, seven bytes each, by leading bits to hash buckets. A bucket counts
its hashes over all chunks and answers every chunk with one bit per hash:
repeated or not. The chunk, whose documents come from the same exchange, hashes
its windows again, reads the bits in the same order and merges the repeated
windows into maximal removal intervals. A window repeated a billion times is one
entry per chunk, so no key is hot, and neither pairs nor positions are moved.

Windows are told apart by 64-bit hashes: among n windows about n**2 / 2**65
pairs are expected to collide (0.0006 for 150 million windows).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.frames import shuffle_width, tables
from graphloom.llm.words import SPACE_WORDS, Words, utf8

WINDOW = 35
CHUNK_BYTES = 1 << 20
BUCKET_WINDOWS = 500_000


def _distinct(table: pa.Table, window: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's words, its window starts, and of the window hashes: distinct values, inverse and counts."""
    words = Words(*utf8(table.column("_text")), SPACE_WORDS)
    hashes, ok = words.windows(window)
    at = np.flatnonzero(ok)
    values, inverse, counts = np.unique(hashes[at], return_inverse=True, return_counts=True)
    return words, at, values, inverse, counts


def _cuts(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that occur, where each begins and the last one ends) of sorted hashes."""
    bucket = (values >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[first], np.append(first, len(values))


def _short(values: np.ndarray) -> bytes:
    """Seven of eight bytes: the leading byte is known from the bucket."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _long(data: bytes) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(-1, 7)
    whole = np.zeros((len(part), 8), np.uint8)
    whole[:, :7] = part
    return whole.view("<u8").reshape(-1)


def repeated_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``documents``: id, n_words, n_removed, removed (maximal word intervals) and kept_text (the
    kept words joined by one space); ``keep`` carries more columns through.

    A word is removed if a window that covers it, all within its document, occurs at another start anywhere in the
    input, the same document and repeated rows included. Null texts and texts under ``window`` words lose nothing;
    a null text has no words and an empty kept_text. Columns that aren't named are not read.
    """
    spark = documents.sparkSession
    keep = keep or []
    size = documents.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    width = shuffle_width(spark)
    chunks = max(width, math.ceil(size / CHUNK_BYTES))
    bits = min(40, max(8, math.ceil(math.log2(max(1, size / 6 / BUCKET_WINDOWS)))))
    source = documents.select(
        F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`").alias(f"_keep_{k}") for k, c in enumerate(keep)]
    ).withColumn("_chunk", F.pmod(F.xxhash64("_id", "_text"), F.lit(chunks)))

    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("_chunk")[0].as_py()
        _, _, values, _, counts = _distinct(table, window)
        buckets, cuts = _cuts(values, bits)
        parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        return pa.table(
            {
                "bucket": pa.array(buckets, pa.int64()),
                "chunk": pa.array([chunk] * len(parts), pa.int64()),
                "hashes": pa.array([_short(values[a:b]) for a, b in parts], pa.binary()),
                "twice": pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in parts], pa.binary()),
            }
        )

    def count(table: pa.Table) -> pa.Table:
        parts = [_long(x) for x in table.column("hashes").to_pylist()]
        lengths = [len(p) for p in parts]
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(table.column("twice").to_pylist(), lengths)])
        together = np.concatenate(parts)
        _, inverse, counts = np.unique(together, return_inverse=True, return_counts=True)
        again = (counts > 1)[inverse] | (twice > 0)
        cuts = np.cumsum(lengths)[:-1]
        answers = [np.packbits(p).tobytes() if p.any() else None for p in np.split(again, cuts)]
        found = pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "again": pa.array(answers, pa.binary())})
        return found.filter(pa.array([a is not None for a in answers]))

    def finish(table: pa.Table, bits_table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in out_schema})
        words, at, values, inverse, _ = _distinct(table, window)
        buckets, cuts = _cuts(values, bits)
        answer = dict(zip(bits_table.column("bucket").to_pylist(), bits_table.column("again").to_pylist()))
        again = np.zeros(len(values), bool)
        for b, lo, hi in zip(buckets.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            if (x := answer.get(b)) is not None:
                again[lo:hi] = np.unpackbits(np.frombuffer(x, np.uint8), count=hi - lo)
        starts = at[again[inverse]]
        edges = np.zeros(len(words.hashes) + 1, np.int64)
        edges[starts] += 1
        np.subtract.at(edges, starts + window, 1)
        covered = np.cumsum(edges[:-1]) > 0
        turns = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
        begin, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        removed, texts, gone = [], [], []
        for d in range(table.num_rows):
            a, b = int(words.first[d]), int(words.first[d + 1])
            raw = words.data[int(words.offsets[d]) : int(words.offsets[d + 1])].tobytes().split()
            lo, hi = np.searchsorted(end, a, "right"), np.searchsorted(begin, b)
            mine = [(max(int(x), a) - a, min(int(y), b) - a) for x, y in zip(begin[lo:hi], end[lo:hi])]
            for x, y in reversed(mine):
                del raw[x:y]
            removed.append([{"start": x, "end": y} for x, y in mine])
            gone.append(sum(y - x for x, y in mine))
            texts.append(b" ".join(raw))
        kept = {c: table.column(c) for c in table.column_names if c == "_id" or c.startswith("_keep_")}
        made = {"n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "removed": pa.array(removed, spans), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())}
        return pa.table(kept | made)

    from pyspark.sql.pandas.types import to_arrow_schema

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kept_ddl = ", ".join(f"{c} {k}" for c, k in source.dtypes if c not in ("_text", "_chunk"))
    out_ddl = f"{kept_ddl}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"
    out_schema = to_arrow_schema(_parse(out_ddl))
    sent = source.groupBy("_chunk").applyInArrow(send, "bucket long, chunk long, hashes binary, twice binary")
    answers = sent.groupBy("bucket").applyInArrow(count, "bucket long, chunk long, again binary")
    out = source.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, out_ddl)
    names = {"_id": doc_id, **{f"_keep_{k}": c for k, c in enumerate(keep)}}
    return out.select(*[F.col(c).alias(names.get(c, c)) for c in out.columns])


def _parse(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the words of every document that lie in no repeated window of 35 words."""
    found = repeated_spans(tables(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
