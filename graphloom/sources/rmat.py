"""R-MAT edges: a pure function of (seed, index), so any partition can make its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.hashing import mix64

#: Quadrant shares (single precision), and the seed.
SHARES = (float(np.float32(0.57)), float(np.float32(0.19)), float(np.float32(0.19)))
SEED = 2


Area = tuple[int, int, int, int]  # least source, its end, least target, its end; ends are exclusive


def rmat_ends(index: np.ndarray, n: int, seed: int = SEED, shares: tuple[float, float, float] = SHARES, area: Area | None = None, drawn: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges ``index``: one draw a level decides the quadrant, the topmost level's first.

    With an ``area`` those within it alone, in the order of ``index``: an edge is dropped at the level at which its
    quadrant leaves the area, and draws no more. ``drawn`` gets the number of draws of each level.
    """
    if n < 1 or n & (n - 1):
        raise ValueError("the number of vertices must be a power of two")
    one, two = np.uint64(1), np.uint64(2)
    bounds = np.cumsum(shares)
    with np.errstate(over="ignore"):
        i = index.astype(np.uint64)
        key = mix64(np.array([seed], np.uint64))[0]
        draw, stride = mix64(two * i * key), mix64((two * i + one) * key)
        src, tgt = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        half = n // 2
        while True:
            if area is not None:
                side = max(1, 2 * half)  # of the quadrant that an edge is in
                inside = (src < area[1]) & (src + side > area[0]) & (tgt < area[3]) & (tgt + side > area[2])
                src, tgt, draw, stride = src[inside], tgt[inside], draw[inside], stride[inside]
            if not half:
                return src, tgt
            if drawn is not None:
                drawn.append(len(src))
            r = mix64(draw).astype(np.float64) / float(2**64 - 1)
            quadrant = np.searchsorted(bounds, r, side="right")  # 0 to 3; beyond the third bound is the last
            src += half * (quadrant >= 2)
            tgt += half * (quadrant % 2)
            draw, half = draw + stride, half // 2


def rmat_of(indices: DataFrame, n: int, index: str = "id", seed: int = SEED, area: Area | None = None) -> DataFrame:
    """edges(src, tgt) of the integer column ``index``, one each or those within ``area``; null indices have none."""

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in it:
            src, tgt = rmat_ends(part.column(0).to_numpy(), n, seed, area=area)
            yield pa.RecordBatch.from_pydict({"src": src, "tgt": tgt})

    rows = indices.select(F.col(f"`{index}`").cast("long").alias("index")).where("index is not null")
    return rows.mapInArrow(make, "src long, tgt long")


def rmat_edges(spark: SparkSession, n: int, m: int, seed: int = SEED, partitions: int | None = None, area: Area | None = None) -> DataFrame:
    """edges(src, tgt): ``m`` edges over ``n`` vertices, or those of them within ``area``."""
    return rmat_of(spark.range(0, m, 1, partitions) if partitions else spark.range(m), n, seed=seed, area=area)
