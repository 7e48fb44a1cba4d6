"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

The words of each benchmark item (ASCII letters lower-cased, runs of ASCII
digits, letters and anything beyond ASCII) give windows of ``n`` words; an item
with fewer words, but not none, is one window. The windows' 64-bit rolling
hashes are sent to every task, documents are scanned window by window, and each
hash hit is verified by comparing the words themselves.

Only a set of bounded size is broadcast: beyond ``max_windows`` the benchmark is
cut by hash into blocks of that size, the documents are scanned once per block,
and the hits of the blocks are merged by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.frames import tables, written
from graphloom.llm.words import ALNUM_WORDS, Words, batches, lower_ascii, utf8

WINDOW = 10
MAX_WINDOWS = 500_000
_FILTER_BITS = 22


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """(length int, hash long, item string, words binary): the distinct windows of all items."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "t"):
            data, offsets = utf8(batch.column("t"))
            words = Words(lower_ascii(data), offsets, ALNUM_WORDS)
            ids = batch.column("i")
            out = {"length": [], "hash": [], "item": [], "words": []}
            for d in range(batch.num_rows):
                a, b = int(words.first[d]), int(words.first[d + 1])
                size = min(n, b - a)
                for w in range(a, b - size + 1) if size else ():
                    out["length"].append(size)
                    out["words"].append(words.text(w, w + size))
                    out["item"].append(ids[d].as_py())
                    out["hash"].append(0)
            for size in set(out["length"]):
                hashes = words.windows(size)[0].view(np.int64)
                at = [k for k, x in enumerate(out["length"]) if x == size]
                starts = [
                    w
                    for d in range(batch.num_rows)
                    if min(n, int(words.counts[d])) == size
                    for w in range(int(words.first[d]), int(words.first[d + 1]) - size + 1)
                ]
                for k, w in zip(at, starts):
                    out["hash"][k] = int(hashes[w])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("length", pa.int32()), ("hash", pa.int64()), ("item", pa.string()), ("words", pa.binary())]))

    source = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    return source.mapInArrow(cut, "length int, hash long, item string, words binary").distinct()


class _Index:
    """What a task needs of one block of windows."""

    def __init__(self, rows: list):
        self.items: list[str | None] = []
        numbers: dict[str | None, int] = {}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.exact: dict[tuple[int, int], dict[bytes, list[int]]] = {}
        for r in rows:
            k = numbers.setdefault(r["item"], len(numbers))
            self.exact.setdefault((r["length"], r["hash"]), {}).setdefault(bytes(r["words"]), []).append(k)
        self.items = list(numbers)
        for size in {r["length"] for r in rows}:
            hashes = np.unique(np.array([r["hash"] for r in rows if r["length"] == size], dtype=np.int64).view(np.uint64))
            near = np.zeros(1 << _FILTER_BITS, bool)
            near[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.by_length[size] = (hashes, near)


def _scan(index: _Index, words: Words) -> tuple[list[np.ndarray], list[set[int]]]:
    """Per text: covered words (indices from 0 in the text) as runs, and the items hit."""
    n_docs = len(words.counts)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
    items: list[set[int]] = [set() for _ in range(n_docs)]
    for size, (hashes, near) in index.by_length.items():
        found, ok = words.windows(size)
        at = np.flatnonzero(near[(found >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] & ok)
        if not len(at):
            continue
        slot = np.minimum(np.searchsorted(hashes, found[at]), len(hashes) - 1)
        at = at[hashes[slot] == found[at]]
        docs = np.searchsorted(words.first, at, "right") - 1
        for w, d in zip(at.tolist(), docs.tolist()):
            same = index.exact[size, int(found[w : w + 1].view(np.int64)[0])].get(words.text(w, w + size))
            if same:
                items[d].update(same)
                a = w - int(words.first[d])
                runs[d].append((a, a + size))
    return [_merge(r) for r in runs], items


def _merge(runs: list[tuple[int, int]]) -> np.ndarray:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
    clean: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``documents``: id, n_words, n_hit, hits (word intervals), items (ids that occur), and
    with ``clean`` also clean_text: the text without the hit words, from each run's first to its last byte.

    ``keep`` carries more columns through. Null or empty texts have no words and no hits; rows that repeat are scanned
    like any others; an empty benchmark hits nothing; items without words have no window; an item with a null id counts
    in ``items`` as a null; other columns of either table are not read.
    """
    spark = documents.sparkSession
    windows = written(benchmark_windows(benchmark, item_id, item_text, n), "windows")
    blocks = max(1, -(-windows.count() // max_windows))
    names = {"_id": doc_id, **{f"_keep_{k}": c for k, c in enumerate(keep or [])}}
    kept = [F.col(f"`{c}`").alias(f"_keep_{k}") for k, c in enumerate(keep or [])]
    source = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"), *kept)
    if blocks == 1:
        sent = spark.sparkContext.broadcast([r.asDict() for r in windows.collect()])
        found = source.mapInArrow(_scanner(sent, clean), _out_schema(source, clean))
    else:
        keyed = source.withColumn("_row", F.xxhash64("_id", "_text"))
        parts = []
        for block in range(blocks):
            sent = spark.sparkContext.broadcast([r.asDict() for r in windows.where(F.pmod("hash", F.lit(blocks)) == block).collect()])
            scanned = keyed.select("_row", "_text")
            parts.append(scanned.mapInArrow(_scanner(sent, False), _out_schema(scanned, False)).where("n_hit > 0"))
        hits = reduce(DataFrame.union, parts).groupBy("_row").agg(
            F.flatten(F.collect_set("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
        )
        met = keyed.join(hits, "_row", "left").drop("_row")
        found = met.mapInArrow(_merger(clean), _out_schema(source, clean))
    return found.select(*[F.col(c).alias(names.get(c, c)) for c in found.columns])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _out_schema(source: DataFrame, clean: bool) -> str:
    kept = "".join(f"{c} {k}, " for c, k in source.dtypes if c != "_text")
    return kept + "n_words long, n_hit long, hits array<struct<start:long,end:long>>, items array<string>" + (", clean_text string" if clean else "")


def _found(batch: pa.RecordBatch, words: Words, runs: list[np.ndarray], items: list[list[str | None]], raw: np.ndarray, clean: bool) -> pa.RecordBatch:
    out = {c: batch.column(c) for c in batch.schema.names if c not in ("_text", "hits", "items")} | {
        "n_words": pa.array(words.counts, pa.int64()),
        "n_hit": pa.array([int((r[:, 1] - r[:, 0]).sum()) for r in runs], pa.int64()),
        "hits": pa.array([[{"start": a, "end": b} for a, b in r.tolist()] for r in runs], _SPANS),
        "items": pa.array(items, pa.list_(pa.string())),
    }
    if clean:
        texts = batch.column("_text").to_pylist()
        for d, r in enumerate(runs):
            if len(r):
                texts[d] = _without(raw, words, d, r).decode()
        out["clean_text"] = pa.array(texts, pa.string())
    return pa.RecordBatch.from_pydict(out)


def _scanner(sent, clean: bool):
    """Texts against one block of windows."""
    held: list[_Index] = []

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(_Index(sent.value))
        index = held[0]
        for batch in batches(it, "_text"):
            raw, offsets = utf8(batch.column("_text"))
            words = Words(lower_ascii(raw), offsets, ALNUM_WORDS)
            runs, items = _scan(index, words)
            yield _found(batch, words, runs, [sorted((index.items[k] for k in s), key=str) for s in items], raw, clean)

    return scan


def _merger(clean: bool):
    """Texts beside the hits that all blocks found in them."""

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "_text"):
            raw, offsets = utf8(batch.column("_text"))
            words = Words(lower_ascii(raw), offsets, ALNUM_WORDS, hashed=False)
            runs = [_merge([(h["start"], h["end"]) for h in hits or []]) for hits in batch.column("hits").to_pylist()]
            yield _found(batch, words, runs, [sorted(x or [], key=str) for x in batch.column("items").to_pylist()], raw, clean)

    return merge


def _without(raw: np.ndarray, words: Words, d: int, runs: np.ndarray) -> bytes:
    base, at, end, out = int(words.first[d]), int(words.offsets[d]), int(words.offsets[d + 1]), []
    for a, b in runs.tolist():
        out.append(raw[at : int(words.starts[base + a])].tobytes())
        at = int(words.ends[base + b - 1])
    out.append(raw[at:end].tobytes())
    return b"".join(out)


def decontaminated(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_share: float = 0.5, **options) -> DataFrame:
    """``documents``, all columns, with hit passages cut out of their texts; those of whose words at least ``drop_share`` are hit go.

    Rows without a hit, null texts included, stay as they are.
    """
    columns = documents.columns
    names = {c: f"_c{k}" for k, c in enumerate(columns)}  # apart from the results' names
    apart = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    own_id, own_text = names[doc_id], names[text]
    found = find_contamination(apart, benchmark, own_id, own_text, clean=True, keep=[n for n in names.values() if n not in (own_id, own_text)], **options)
    few = (F.col("n_hit") == 0) | (F.col("n_hit") < drop_share * F.col("n_words"))
    return found.where(few).select(*[F.col("clean_text" if c == text else n).alias(c) for c, n in names.items()])


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every document against every benchmark item."""
    found = find_contamination(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
