"""Small integer and comparison functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_up(x: Column) -> Column:
    """Bits needed for x - 1: the least k with 2**k >= x."""
    return F.when(x <= 1, F.lit(0)).otherwise(F.length(F.conv((x - 1).cast("string"), 10, 2))).cast("int")


def int_ceil(x: Column, to: int) -> Column:
    """x rounded up to a multiple of a power of two."""
    return (F.ceil(x / to) * to).cast("long")


def bool_array_bytes(count: Column) -> Column:
    return F.ceil(count / 8).cast("long")


def flag_place(index: Column) -> tuple[Column, Column]:
    """(byte, bit) of a flag."""
    return F.floor(index / 8).cast("long"), F.pmod(index, F.lit(8)).cast("int")


def nearly_equal(a: Column, b: Column, digits: int = 4) -> Column:
    """Equal when cut after ``digits`` decimals."""
    scale = F.lit(float(10**digits))
    cut = lambda x: F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale))
    return cut(a) == cut(b)


def is_close(a: Column, b: Column, relative: float = 1e-4) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


def split_paths(paths: Column) -> Column:
    """A ":"-separated list, empty parts left out."""
    return F.filter(F.split(paths, ":"), lambda p: p != "")


def hash_weight(src: Column, tgt: Column) -> Column:
    """A deterministic weight in [0, 0.5) from an edge's ends: a linear congruential step over a 31-bit mask."""
    mixed = F.pmod(F.pmod(src, F.lit(1000003)) * 1103515245 + F.pmod(tgt, F.lit(1000003)) * 69069 + 12345, F.lit(1 << 31))
    return mixed / F.lit(float(1 << 32))
