"""Cuts in the lineage that outlive executors: tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or in a local session where that is unset (tests) one made here."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_at(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path there."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return cut_at(df, name)[0]


def remove(spark: SparkSession, path: str | None) -> None:
    """Delete a table that nothing reads any more."""
    if path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def resume(spark: SparkSession, path: str, name: str) -> tuple[int, DataFrame] | None:
    """The last complete round that ``keep_round`` left under ``path``: (round, state)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(conf)
    if not store.exists(folder):
        return None
    rounds = []
    for status in store.listStatus(folder):
        entry = status.getPath()
        if entry.getName().startswith(f"{name}-") and store.exists(jvm.org.apache.hadoop.fs.Path(entry, "_SUCCESS")):
            rounds.append(int(entry.getName().rsplit("-", 1)[1]))
    if not rounds:
        return None
    return max(rounds), spark.read.parquet(f"{path}/{name}-{max(rounds):08d}")


def keep_round(state: DataFrame, path: str, name: str, number: int) -> None:
    state.write.mode("overwrite").parquet(f"{path}/{name}-{number:08d}")


def drop_round(spark: SparkSession, path: str, name: str, number: int) -> None:
    remove(spark, f"{path}/{name}-{number:08d}")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Checkpoints:
    """Checkpoints of a loop in folders of their own under the shared one; only the last two are kept."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.before = spark.sparkContext.getCheckpointDir()
        self.kept: list[str] = []

    def checkpoint(self, df: DataFrame) -> DataFrame:
        self.kept.append(f"{self.folder}/{len(self.kept)}-{uuid.uuid4().hex}")
        self.spark.sparkContext.setCheckpointDir(self.kept[-1])
        out = df.checkpoint()
        if len(self.kept) > 2:
            remove(self.spark, self.kept.pop(0))
        return out

    def close(self) -> None:
        """Put the session's own checkpoint folder back."""
        if self.kept:
            self.spark.sparkContext.setCheckpointDir(self.before.rsplit("/", 1)[0] if self.before else shared_folder(self.spark))
