"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block is cut into lanes of equal length that are coded side by side, a step at
a time, by one shared model, so numpy does each step for all lanes at once; the
decoder sees the same lanes and so learns the same model.

The model mixes three predictions of the next id. Order 0 is an adaptive
frequency table. Orders 1 and 2 each predict one id, the one that followed their
context before; how much weight that prediction gets is learned, per confidence
state, from how often it was right. The interval of an id in [0, 4096 * total0)
is its order-0 share times w0, plus w1 or w2 times total0 where it is predicted.
All arithmetic is in integers. A 64-bit carry-less range coder (after Subbotin)
turns the intervals into 16-bit words.

Block layout (little endian): magic "GLC1", ids u32, alphabet u32, lane length
u32, lanes u32, CRC-32 of the ids as u32 values, bytes of the packed lane sizes u32,
CRC-32 of all that and the packed lane sizes u32, lane sizes in words (u32, zlib), then the lanes' words (u16).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"GLC1"
LANE = 256
_HEAD = struct.Struct("<4s6I")
_U = np.uint64
_TOP, _BOT, _WORD = _U(1 << 48), _U(1 << 40), _U(16)
_ONE, _ONE_BITS = 1 << 12, 12
_MOST = 4000  # of 4096, so that order 0 keeps a share
_STATES = 16
_ORDER2_BITS = 18
_STEP = 32
_LIMIT = 1 << 22


class _Order:
    """Predictions of one context order: ``table`` holds id * 16 + confidence; how often each confidence was right is counted."""

    def __init__(self, size: int):
        self.table = np.zeros(size, np.int32)
        self.seen, self.right = np.full(_STATES, 4, np.int64), np.zeros(_STATES, np.int64)

    def look(self, context: np.ndarray) -> np.ndarray:
        """Predicted ids; ``share`` is the weight that each deserves."""
        self.context = context
        packed = self.table[context]
        self.guess, self.sure = packed >> 4, packed & 15
        self.share = np.minimum((self.right << _ONE_BITS) // self.seen, _MOST).astype(np.int32)[self.sure]
        return self.guess

    def learn(self, x: np.ndarray, hit: np.ndarray, counted: np.ndarray | None) -> None:
        key = self.sure * 2 + hit
        if counted is not None:
            key += counted * (2 * _STATES)
        tally = np.bincount(key, minlength=4 * _STATES)[: 2 * _STATES].reshape(_STATES, 2)
        self.seen += tally.sum(axis=1)
        self.right += tally[:, 1]
        kept = (self.guess << 4) + np.where(hit, np.minimum(self.sure + 1, _STATES - 1), self.sure >> 1)
        self.table[self.context] = np.where(hit | (self.sure > 0), kept, x << 4)


class _Model:
    def __init__(self, alphabet: int, lanes: int):
        self.count = np.ones(alphabet, np.int64)
        self.cum = np.zeros(alphabet + 1, np.int64)
        self.one, self.two = _Order(alphabet), _Order(1 << _ORDER2_BITS)
        self.before1, self.before2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self, n: int) -> None:
        """Predictions and weights for the first ``n`` lanes."""
        np.cumsum(self.count, out=self.cum[1:])
        self.total = int(self.cum[-1])
        last = self.before1[:n]
        self.a = self.one.look(last)
        self.b = self.two.look(((self.before2[:n] * 0x9E3779B1 + last * 0x85EBCA6B) >> 7) & ((1 << _ORDER2_BITS) - 1))
        w2 = self.two.share
        w1 = ((_ONE - w2) * self.one.share >> _ONE_BITS) * (self.a != self.b)
        self.w0 = (_ONE - w1 - w2).astype(np.int64)
        self.extra1, self.extra2 = w1 * np.int64(self.total), w2 * np.int64(self.total)

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.w0 * self.cum[x] + self.extra2 * (self.b < x) + self.extra1 * (self.a < x)
        size = self.w0 * self.count[x] + self.extra2 * (self.b == x) + self.extra1 * (self.a == x)
        return low, size

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, their intervals' lows and sizes) in which ``v`` lies; only what neither order predicted is searched."""
        low, size = self.interval(self.b)
        low_a, size_a = self.interval(self.a)
        end, end_a = low + size, low_a + size_a
        in_b, in_a = (v >= low) & (v < end), (v >= low_a) & (v < end_a)
        x = self.b.astype(np.int64)
        for out, other in ((x, self.a), (low, low_a), (size, size_a)):
            np.copyto(out, other, where=in_a)
        at = np.flatnonzero(~(in_a | in_b))
        if len(at):
            w0, extra1, extra2 = self.w0[at], self.extra1[at], self.extra2[at]
            beyond = extra2 * (v[at] >= end[at]) + extra1 * (v[at] >= end_a[at])
            share = ((v[at] - beyond) // w0).astype(np.int32)
            order = np.argsort(share)  # searching in order is faster by more than the sort takes
            found = np.empty(len(at), np.int64)
            found[order] = np.searchsorted(self.cum.astype(np.int32), share[order], "right") - 1
            x[at], low[at], size[at] = found, w0 * self.cum[found] + beyond, w0 * self.count[found]
        return x, low, size

    def learn(self, x: np.ndarray) -> None:
        n = len(x)
        hit2 = x == self.b
        self.two.learn(x, hit2, None)
        self.one.learn(x, x == self.a, hit2)  # counts where order 2 was wrong
        np.add.at(self.count, x, _STEP)
        if self.total > _LIMIT:
            self.count = (self.count + 1) >> 1
        self.before2[:n] = self.before1[:n]
        self.before1[:n] = x


def _due(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes that must give out or take in a word; narrows a range that straddles a carry."""
    settled = (low ^ (low + span)) < _TOP
    small = span < _BOT
    small &= ~settled
    if small.any():
        span[small] = (~low[small] + _U(1)) & (_BOT - _U(1))
        settled |= small
    return np.flatnonzero(settled)


def encode_block(ids: np.ndarray, lane: int = LANE) -> bytes:
    """``ids``: integers from 0; may be empty."""
    ids = np.ascontiguousarray(ids, dtype=np.int64)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    if not len(ids):
        return _headed(_HEAD.pack(MAGIC, 0, 0, lane, 0, crc, 0), b"")
    lanes, alphabet = -(-len(ids) // lane), int(ids.max()) + 1
    grid = np.zeros(lanes * lane, np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, lane).T)
    short = len(ids) - (lanes - 1) * lane  # the last lane may be shorter
    model = _Model(alphabet, lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U)
    out, place = np.zeros((lanes, 2 * lane + 32), np.uint16), np.zeros(lanes, np.int64)
    with np.errstate(over="ignore"):
        for step in range(min(lane, len(ids))):
            n = lanes if step < short else lanes - 1
            x = grid[step, :n]
            model.predict(n)
            at, size = model.interval(x)
            unit = span[:n] // _U(_ONE * model.total)
            low[:n] += unit * at.astype(_U)
            span[:n] = unit * size.astype(_U)
            l, s = low[:n], span[:n]
            while len(due := _due(l, s)):
                shown = l[due]
                out[due, place[due]] = (shown >> _U(48)).astype(np.uint16)
                place[due] += 1
                l[due] = shown << _WORD
                s[due] <<= _WORD
                if place.max() >= out.shape[1] - 16:
                    out = np.concatenate([out, np.zeros_like(out)], axis=1)
            model.learn(x)
        for _ in range(4):
            out[np.arange(lanes), place] = (low >> _U(48)).astype(np.uint16)
            place += 1
            low <<= _WORD
    sizes = zlib.compress(place.astype("<u4").tobytes(), 1)
    body = out[np.arange(out.shape[1]) < place[:, None]].astype("<u2").tobytes()
    return _headed(_HEAD.pack(MAGIC, len(ids), alphabet, lane, lanes, crc, len(sizes)), sizes) + body


def _headed(head: bytes, sizes: bytes) -> bytes:
    return head + struct.pack("<I", zlib.crc32(head + sizes)) + sizes


def decode_block(block: bytes) -> np.ndarray:
    """The block's ids; ValueError if it is damaged."""
    if len(block) < _HEAD.size + 4 or block[:4] != MAGIC:
        raise ValueError("not a coded block")
    _, n_ids, alphabet, lane, lanes, crc, packed = _HEAD.unpack_from(block)
    head, sizes_at = block[: _HEAD.size], _HEAD.size + 4
    if struct.unpack_from("<I", block, _HEAD.size)[0] != zlib.crc32(head + block[sizes_at : sizes_at + packed]):
        raise ValueError("damaged header")
    if not n_ids:
        return np.zeros(0, np.int64)
    sizes = np.frombuffer(zlib.decompress(block[sizes_at : sizes_at + packed]), "<u4").astype(np.int64)
    body = block[sizes_at + packed :]
    if len(body) % 2:
        raise ValueError("damaged block")
    data = np.frombuffer(body, "<u2")
    if len(sizes) != lanes or sizes.sum() != len(data):
        raise ValueError("damaged lane sizes")
    data = np.concatenate([data, np.zeros(8, np.uint16)]).astype(_U)
    place = np.cumsum(sizes) - sizes
    grid = np.zeros((lane, lanes), np.int64)
    short = n_ids - (lanes - 1) * lane
    model = _Model(alphabet, lanes)
    low, span, code = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U), np.zeros(lanes, _U)
    with np.errstate(over="ignore"):
        for _ in range(4):
            code = (code << _WORD) | data[place]
            place += 1
        for step in range(min(lane, n_ids)):
            n = lanes if step < short else lanes - 1
            model.predict(n)
            unit = span[:n] // _U(_ONE * model.total)
            v = np.minimum((code[:n] - low[:n]) // np.maximum(unit, _U(1)), _U(_ONE * model.total - 1)).astype(np.int64)
            x, at, size = model.find(v)
            low[:n] += unit * at.astype(_U)
            span[:n] = unit * size.astype(_U)
            l, s, c = low[:n], span[:n], code[:n]
            while len(due := _due(l, s)):
                c[due] = (c[due] << _WORD) | data[np.minimum(place[due], len(data) - 1)]
                place[due] += 1
                l[due] <<= _WORD
                s[due] <<= _WORD
                if not s[due].all():
                    raise ValueError("damaged block")
            model.learn(x)
            grid[step, :n] = x
    ids = grid.T.reshape(-1)[:n_ids]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum does not match")
    return ids
