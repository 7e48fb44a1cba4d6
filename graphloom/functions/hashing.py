"""64-bit integer mixing with wrap-around, which SQL arithmetic does not have: Arrow UDFs over numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType

# The constants and shifts of the six mixing steps.
MIX64 = (0x7ED55D166BEF7A1D, 0xC761C23C510FA2DD, 0x165667B183A9C0E1, 0xD3A2646CAB3487E3, 0xFD7046C5EF9AB54C, 0xB55A4F090DD4A67B)
SHIFT64 = (12, 9, 59, 49, 3, 32)
MIX32 = (0x7ED55D16, 0xC761C23C, 0x165667B1, 0xD3A2646C, 0xFD7046C5, 0xB55A4F09)
SHIFT32 = (12, 19, 5, 9, 3, 16)


def _mix(x: np.ndarray, kind: type, constants: tuple[int, ...], shifts: tuple[int, ...]) -> np.ndarray:
    """Steps by turns: add and shifted sum; xor and right-shifted xor; the fourth adds, then xors."""
    add = [kind(c) for c in constants]
    by = [kind(s) for s in shifts]
    with np.errstate(over="ignore"):
        for k in range(6):
            if k in (0, 2, 4):
                x = x + add[k] + (x << by[k])
            elif k == 3:
                x = (x + add[k]) ^ (x << by[k])
            else:
                x = x ^ add[k] ^ (x >> by[k])
    return x


def mix64(x: np.ndarray) -> np.ndarray:
    return _mix(x.astype(np.uint64), np.uint64, MIX64, SHIFT64)


def mix32(x: np.ndarray) -> np.ndarray:
    return _mix(x.astype(np.uint32), np.uint32, MIX32, SHIFT32)


@pandas_udf(LongType())
def hash64(x: pd.Series) -> pd.Series:
    """The 64-bit hash, as a signed number."""
    return pd.Series(mix64(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))


@pandas_udf(LongType())
def hash32(x: pd.Series) -> pd.Series:
    return pd.Series(mix32(x.to_numpy(np.int64) & 0xFFFFFFFF).astype(np.int64))


@pandas_udf(DoubleType())
def hash_double(x: pd.Series) -> pd.Series:
    """The 64-bit hash as a share of the largest."""
    return pd.Series(mix64(x.to_numpy(np.int64).view(np.uint64)).astype(np.float64) / float(2**64 - 1))
