"""Edge lists in and results out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = {"tab": "\t", "space": " ", "comma": ",", "semicolon": ";"}


def read_delimited(spark: SparkSession, path: str, delimiter: str = "tab", weighted: bool = False) -> DataFrame:
    """edges(src, tgt[, weight]) from text with one edge a line; further columns are ignored, there is no header.

    What is no number in a line is null; an edge with a null end is none to any operator of the library.
    """
    schema = "src long, tgt long" + (", weight double" if weighted else "")
    return spark.read.schema(schema).csv(path, sep=DELIMITERS.get(delimiter, delimiter), enforceSchema=True, mode="PERMISSIVE")


PAIR_BYTES = 8
WHOLE_FILE = 128 << 20


def read_binary(spark: SparkSession, path: str, edges_per_row: int = 1 << 20, whole_file: int = WHOLE_FILE) -> DataFrame:
    """edges(src, tgt) from files of little-endian 32-bit pairs.

    A file of up to ``whole_file`` bytes is one task's; larger ones are split as Hadoop splits fixed-length records, a
    record being a pair. Paths are any that Spark reads; where ``pyarrow.fs`` knows them too, ``edge_files`` needs no row
    for each pair.
    """

    def edges(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(pairs), edges_per_row):
            part = pairs[at : at + edges_per_row].astype(np.int64)
            yield pa.RecordBatch.from_pydict({"src": np.ascontiguousarray(part[:, 0]), "tgt": np.ascontiguousarray(part[:, 1])})

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for content in batch.column(0):
                yield from edges(np.frombuffer(content.as_buffer(), "<i4").reshape(-1, 2))

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield from edges(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(-1, 2))

    files = spark.read.format("binaryFile").load(path)
    out = files.where(F.col("length") <= whole_file).select("content").mapInArrow(split, "src long, tgt long")
    large = [r["path"] for r in files.where(F.col("length") > whole_file).select("path").collect()]
    for one in large:
        records = spark.sparkContext.binaryRecords(one.replace(",", "\\,"), PAIR_BYTES).map(lambda r: (r,))
        out = out.union(spark.createDataFrame(records, "pair binary").mapInArrow(join, "src long, tgt long"))
    return out


def adjacency_edges(lines: DataFrame, column: str = "value") -> DataFrame:
    """edges(src, tgt) from lines "v degree t1 t2 ..."; lines with degree 0 give none."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    targets = F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))
    return lines.where(F.get(parts, F.lit(1)).cast("long") > 0).select(F.get(parts, F.lit(0)).cast("long").alias("src"), F.explode(F.transform(targets, lambda t: t.cast("long"))).alias("tgt"))


def commented_edges(lines: DataFrame, column: str = "value") -> DataFrame:
    """edges(src, tgt) from white-space separated lines, those that begin with # left out."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    return lines.where(~F.startswith(F.col(column), F.lit("#")) & (F.trim(column) != "")).select(F.get(parts, F.lit(0)).cast("long").alias("src"), F.get(parts, F.lit(1)).cast("long").alias("tgt"))


def packed_pairs(edges: DataFrame) -> DataFrame:
    """(data): partitions' edges as binary pairs, the way ``read_binary`` reads them."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            pairs = np.stack([batch.column("src").to_numpy(), batch.column("tgt").to_numpy()], axis=1).astype("<i4")
            yield pa.RecordBatch.from_pydict({"data": pa.array([pairs.tobytes()], pa.binary())})

    return edges.select("src", "tgt").mapInArrow(pack, "data binary")


def write_result(values: DataFrame, path: str, value: str = "value", known: DataFrame | None = None) -> None:
    """Text lines "id value", with original ids where a dictionary (id, orig_id) is given."""
    rows = values if known is None else values.join(known, "id").select(F.col("orig_id").alias("id"), value)
    rows.select("id", value).write.mode("overwrite").csv(path, sep=" ")


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, value double").csv(path, sep=" ")


def write_noop(df: DataFrame) -> None:
    """Run a plan for its time alone."""
    df.write.format("noop").mode("overwrite").save()


def constant_values(ids: DataFrame, value: float = 0.5) -> DataFrame:
    """Constant inputs for benchmarks of one part of a round."""
    return ids.select("id", F.lit(value).alias("value"))
