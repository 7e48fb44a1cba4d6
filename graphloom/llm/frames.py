"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.storage import cut as written  # noqa: F401  the operators' name for it

BROADCAST_BYTES = 64 << 20
LEAST_HOT, MOST_HOT = 200, 100_000


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if its rows, measured, take at most ``limit`` bytes; else Spark joins it by shuffle."""
    texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    size = F.lit(16 + 16 * len(df.columns))
    for c in texts:
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def beside_group(rows: DataFrame, key: str, groups: DataFrame, size: str, total: int) -> DataFrame:
    """``rows`` joined to ``groups``, one row a key (a long), whose column ``size`` says how many rows each key has; ``total`` is their sum.

    Keys with over 200 rows and a 100,000th of all, 100,000 of them at most, are joined by broadcast, and their rows
    spread by hash in the shuffle that joins the others, which then meets no key with many rows.
    """
    limit, names = max(LEAST_HOT, total // MOST_HOT), [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > limit).select(key, *[F.col(c).alias(f"_hot_{c}") for c in names])
    cold = groups.where(F.col(size) <= limit).select(F.col(key).alias("_cold"), *[F.col(c).alias(f"_cold_{c}") for c in names])
    is_hot = F.col(f"_hot_{size}").isNotNull()
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("_spread", F.when(is_hot, F.xxhash64(*rows.columns)).otherwise(F.col(key)))
    met = marked.join(cold, F.col("_spread") == F.col("_cold"), "left").where(is_hot | F.col("_cold").isNotNull())
    return met.select(*rows.columns, *[F.when(is_hot, F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in names])


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run inside: texts of a whole default batch can be tens of megabytes in either process."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def safe_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores added if the frame has such a column already."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def crc_bucket(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n
