"""Vectorised word scanning over Arrow string columns.

A batch of texts is read as one UTF-8 byte buffer plus offsets, so a word is
found, hashed and windowed by numpy without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT_BYTES = 1 << 20
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply, xor, shift)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def coefficients(start: int, n: int) -> np.ndarray:
    """Odd pseudo-random factors for positions start .. start+n-1."""
    return mix64(np.arange(start + 1, start + n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def byte_table(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes that belong to words; ``excluded`` holds inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


#: Words are runs of anything but space and the ASCII white space 0x09-0x0D.
SPACE_WORDS = byte_table([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of ASCII digits and letters and of everything beyond ASCII.
ALNUM_WORDS = byte_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Words:
    """Words of some texts: byte ``starts``/``ends``, ``hashes``, and ``first[d]:first[d+1]`` as the words of text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True):
        self.data, self.offsets = data, offsets
        starts, ends, hashes = [], [], []
        for lo, hi in _segments(data, offsets, table):
            s, e, h = _scan(data, offsets, table, lo, hi, hashed)
            starts.append(s), ends.append(e), hashes.append(h)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.starts, self.ends, self.hashes = join(starts, np.int64), join(ends, np.int64), join(hashes, _U)
        self.first = np.searchsorted(self.starts, offsets)
        # an empty text at the end of the buffer starts where the buffer ends
        self.counts = np.diff(self.first)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the window at each word, whether it lies within one text); polynomial rolling hash."""
        n = len(self.hashes)
        ok = np.zeros(n, bool)
        if n < length:
            return np.zeros(n, _U), ok
        last = np.repeat(self.first[1:], self.counts)
        ok[:] = np.arange(n) + length <= last
        out = np.zeros(n, _U)
        rolled = roll(self.hashes, length)
        out[: len(rolled)] = rolled
        return mix64(out), ok

    def text(self, start: int, end: int) -> bytes:
        """Words start .. end-1, joined by one space."""
        data = self.data
        return b" ".join(data[a:b].tobytes() for a, b in zip(self.starts[start:end], self.ends[start:end]))


def roll(tokens: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hashes sum(t[i+k] * base**(length-1-k)) mod 2**64 of all windows, by doubling."""
    done, out = 0, None
    power, block, size = base, tokens.astype(_U, copy=False), 1
    rest = length
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out, done = block, size
                else:  # the collected part stands in front of this block
                    n = len(tokens) - done - size + 1
                    out = out[:n] * _U(power) + block[done : done + n]
                    done += size
            rest >>= 1
            if rest:
                n = len(block) - size
                if n <= 0:
                    return np.zeros(0, _U)
                block = block[:n] * _U(power) + block[size:]
                power, size = power * power % (1 << 64), size * 2
    return out[: len(tokens) - length + 1]


def _segments(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about SEGMENT_BYTES that cut no word."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + SEGMENT_BYTES)
        if hi < n:
            cut = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            if cut > lo:
                hi = cut
            else:  # one long text: cut at a byte between words
                step = hi
                while step < n:
                    gap = np.flatnonzero(~table[data[step : step + 65536]])
                    if len(gap):
                        step += int(gap[0])
                        break
                    step += 65536
                after = int(offsets[np.searchsorted(offsets, lo, "right")])
                hi = min(n, step, after) if after > lo else min(n, step)
        yield lo, hi
        lo = hi


def _scan(data, offsets, table, lo, hi, hashed):
    part = data[lo:hi]
    inside = table[part]
    bounds = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo
    before = np.empty(len(part), bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[bounds[bounds < len(part)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(part), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[bounds[bounds > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    if not hashed or not len(starts):
        return starts + lo, ends + lo, np.zeros(len(starts), _U)
    longest = int((ends - starts).max())
    factor = coefficients(0, longest)
    sizes = ends - starts
    place = np.arange(int(sizes.sum()), dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    place -= np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        values = (part[inside].astype(_U) + _U(1)) * factor[place]
        hashes = np.add.reduceat(values, first) + sizes.astype(_U)
    return starts + lo, ends + lo, mix64(hashes)


def batches(it: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, one row at least."""
    for batch in it:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, end - at)
            at = end
