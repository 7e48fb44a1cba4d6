"""Binary edge files as a data source of Spark: ``spark.read.format("edge_files")``, ``df.write.format("edge_files")``.

A file is a run of records, little endian: source and target as signed integers of
``bits`` (32 or 64) bits and, with ``weighted``, a 32-bit float. Reading is planned
in ranges of ``split_bytes`` that end between records, of any number of files, and
hands Arrow batches over. A writing task has one file in a folder of its own; the
files move to the target when all tasks are done, and go if one fails, so a reader
sees all of a job or nothing (a task that outlives its failed job may leave its
folder, which begins with "_" and is not read). Paths are any that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SPLIT_BYTES, BATCH_EDGES = 128 << 20, 1 << 18


def _record(options: dict) -> np.dtype:
    bits = options.get("bits", "32")
    if bits not in ("32", "64"):
        raise ValueError(f"ids of {bits} bits; 32 or 64 are known")
    kind = f"<i{int(bits) // 8}"
    return np.dtype([("src", kind), ("tgt", kind)] + ([("weight", "<f4")] if options.get("weighted", "false").lower() == "true" else []))


def _files(store: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [info]
    found = store.get_file_info(fs.FileSelector(path))
    return sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    path: str
    first: int  # records
    count: int


class EdgeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.record = options["path"], _record(options)
        self.split = max(1, int(options.get("split_bytes", SPLIT_BYTES)) // self.record.itemsize)

    def partitions(self) -> list[Range]:
        store, path = fs.FileSystem.from_uri(self.uri)
        out = []
        for f in _files(store, path):
            if f.size % self.record.itemsize:
                raise ValueError(f"{f.path} ends within a record")
            records = f.size // self.record.itemsize
            out += [Range(f.path, at, min(self.split, records - at)) for at in range(0, records, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        store, _ = fs.FileSystem.from_uri(self.uri)
        with store.open_input_file(partition.path) as file:
            file.seek(partition.first * self.record.itemsize)
            left = partition.count
            while left:
                n = min(left, BATCH_EDGES)
                rows = np.frombuffer(file.read(n * self.record.itemsize), self.record)
                if len(rows) != n:
                    raise EOFError(f"{partition.path} became shorter")
                yield pa.RecordBatch.from_pydict({k: rows[k].astype(np.float64 if k == "weight" else np.int64) for k in self.record.names})
                left -= n


@dataclass
class Written(WriterCommitMessage):
    name: str
    edges: int


class EdgeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.uri, self.record, self.overwrite = options["path"], _record(options), overwrite
        self.job = uuid.uuid4().hex
        missing = set(self.record.names) - set(schema.names)
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        store, path = fs.FileSystem.from_uri(self.uri)
        return store, path, f"{path}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, folder = self._place()
        store.create_dir(folder)
        name, edges = f"part-{self.job}-{uuid.uuid4().hex}.bin", 0
        with store.open_output_stream(f"{folder}/{name}") as file:
            for batch in iterator:
                rows = np.empty(batch.num_rows, self.record)
                for k in self.record.names:
                    column = batch.column(k)
                    if column.null_count:
                        raise ValueError(f"an edge without {k}")
                    values = column.to_numpy(zero_copy_only=False)
                    limits = np.iinfo(self.record[k]) if k != "weight" else None
                    if limits and len(values) and not limits.min <= values.min() <= values.max() <= limits.max:
                        raise OverflowError(f"an id beyond {limits.bits} bits")
                    rows[k] = values
                file.write(rows.tobytes())
                edges += len(rows)
        return Written(name, edges)

    def commit(self, messages: list[Written | None]) -> None:
        store, path, folder = self._place()
        store.create_dir(path)
        old = _files(store, path) if self.overwrite else []
        for m in messages:
            if m and m.edges:
                store.move(f"{folder}/{m.name}", f"{path}/{m.name}")
        for f in old:
            store.delete_file(f.path)
        self.abort(messages)
        with store.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        store, _, folder = self._place()
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class EdgeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edge_files"

    def schema(self) -> str:
        return "src long, tgt long" + (", weight double" if "weight" in _record(self.options).names else "")

    def reader(self, schema: StructType) -> EdgeReader:
        return EdgeReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> EdgeWriter:
        return EdgeWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session."""
    spark.dataSource.register(EdgeFiles)
    return spark
