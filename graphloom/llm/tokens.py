"""Token ids of whole texts by a public tokenizer file, with a bounded cache of the pieces between spaces.

Two schemes of splitting are known; both split a text at white space before they
merge, so the ids of a text are those of its pieces put together. A batch of
texts is cut into pieces, hashed, looked up and put together by numpy; each
worker encodes a piece once while it stays in the cache. A new piece of Latin
letters, with ASCII punctuation behind them or not, goes straight to the
tokenizer's merge model, as the splitting is known for it; other new pieces go
through the whole tokenizer, and so do texts with unusual white space, texts that
hold one of the file's added tokens, and all texts if the file splits in another
way than the two. Pieces are told apart by 64-bit hashes within one worker's
cache: two of a million cached pieces and a billion looked up ones are mixed up
with probability 0.00005.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa

from graphloom.llm.words import coefficients, mix64

CACHE_ENTRIES, UNIT_ENTRIES = 600_000, 50_000
_HEAD = "\0"
#: White space other than space and line feed, and the mark of a text's first piece.
_OTHER = re.compile("[\0\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PLAIN = re.compile(r"([\0\n]?)([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)\Z")


#: The normalizers, pre-tokenizers and marks of a word's end of the two known schemes.
_KEPT = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None)
_DROPPED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "</w>",
)


def hidden_bytes() -> dict[int, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for 256 onwards."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


_LETTERS = hidden_bytes()


class Cache:
    """Open-addressed table from 64-bit hashes to runs in a pool of ids."""

    def __init__(self, entries: int):
        self.entries = entries
        self.clear(0)

    def clear(self, coming: int) -> None:
        """Empty, with room for ``coming`` entries in any case."""
        self.bits = max(10, (2 * max(self.entries, coming)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.pool, self.used = np.zeros(4096, np.uint32), 0
        self.starts, self.sizes, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where it is new."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        at = np.arange(len(hashes))
        while len(at):
            held = self.keys[slot]
            hit = held == hashes[at]
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (held != 0)
            at, slot = at[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """New distinct hashes and their ids."""
        n, flat = len(hashes), np.frombuffer(b"".join(ids), "<u4")
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.count + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[self.count : self.count + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.count : self.count + n] = sizes
        number = np.arange(self.count, self.count + n)
        self.used, self.count = self.used + len(flat), self.count + n
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(slot):
            free, first = np.unique(slot, return_index=True)
            first = first[self.keys[free] == 0]
            self.keys[slot[first]], self.values[slot[first]] = hashes[first], number[first]
            left = np.ones(len(slot), bool)
            left[first] = False
            hashes, number, slot = hashes[left], number[left], (slot[left] + 1) & ((1 << self.bits) - 1)


def _scheme(rules: dict) -> str | None:
    """How a tokenizer file splits: "kept" for byte-level merges, where a space belongs to the piece after it; "dropped" where white space never gets an id; None for any other way."""
    model, added = rules["model"], rules.get("added_tokens") or []
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or any(t[k] for t in added for k in ("normalized", "lstrip", "rstrip", "single_word")):
        return None
    found = (rules.get("normalizer"), rules.get("pre_tokenizer"), model.get("end_of_word_suffix"))
    return "kept" if found == _KEPT else "dropped" if found == _DROPPED else None


class Encoder:
    """``encode(texts)`` gives little-endian unsigned 32-bit ids, those of the library's ``encode(text, add_special_tokens=False)``.

    With ``plain_special`` a special token's string in a text is text like any other.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES, plain_special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_special
        rules = json.loads(self.tokenizer.to_str())
        self.scheme = _scheme(rules)
        self.kept = self.scheme == "kept"
        self.added = [t["content"] for t in rules.get("added_tokens") or [] if not (plain_special and t["special"])]
        self.cache = Cache(cache_entries)
        self.merge = self.tokenizer.model.tokenize
        self.units: dict[str, bytes] = {}  # ids of what the merge model saw: words come with many marks behind them
        self.feed = self.whole("\n") if self.kept else b""

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _unusual(self, text: str) -> bool:
        """Whether the pieces between spaces and line feeds don't have ids of their own, or can't be told apart."""
        if self.scheme is None or any(t in text for t in self.added):
            return True
        if not self.kept:
            return "\0" in text
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] == "\n" or text[-1] in " \n":
            return True
        return _OTHER.search(text) is not None

    def _shown(self, piece: str) -> str:
        """What the piece looks like in its text."""
        if not self.kept:
            return piece
        return piece[1:] if piece[:1] in (_HEAD, "\n") else " " + piece

    def _run(self, text: str) -> bytes:
        """Ids of a text that is one unit to the merge model."""
        found = self.units.get(text)
        if found is None:
            shown = text.replace(" ", "Ġ") if text.isascii() else text.encode().decode("latin-1").translate(_LETTERS)
            if len(self.units) >= UNIT_ENTRIES:
                self.units.clear()
            found = self.units[text] = array("I", [t.id for t in self.merge(shown)]).tobytes()
        return found

    def _letters(self, lead: str, letters: str) -> bytes:
        if not self.kept:
            return self._run(letters.lower())
        return self._run(letters if lead else " " + letters)

    def _learn(self, piece: str) -> bytes:
        if not piece:
            return b""
        plain = _PLAIN.match(piece)
        if not plain:
            ids = self.whole(self._shown(piece))
            return self.feed + ids if self.kept and piece[0] == "\n" else ids
        lead, letters, marks = plain.groups()
        if letters and marks:
            ids = self._letters(lead, letters) + self._run(marks)
        else:
            ids = self._letters(lead, letters or marks) if letters or marks else b""
        return self.feed + ids if lead == "\n" else ids

    def _look(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces between the spaces of ``data``, where each piece's begin and the last one's end)."""
        spaces = np.flatnonzero(data == 0x20)
        starts, ends = np.concatenate([[0], spaces + 1]), np.append(spaces, len(data))
        sizes = ends - starts
        place = np.arange(len(data) + 1) - np.repeat(starts, sizes + 1)
        values = np.append(data, np.uint8(0x20)).astype(np.uint64)
        values[ends] = 0
        with np.errstate(over="ignore"):
            values *= coefficients(0, int(sizes.max()) + 1)[place]
            hashes = mix64(np.add.reduceat(values, starts) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        entry = self.cache.find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            if self.cache.count + len(distinct) > self.cache.entries:
                new = np.arange(len(hashes))
                distinct, first = np.unique(hashes, return_index=True)
                self.cache.clear(len(distinct))
            raw = data.tobytes()
            self.cache.add(distinct, [self._learn(raw[a:b].decode()) for a, b in zip(starts[new[first]].tolist(), ends[new[first]].tolist())])
            entry[new] = self.cache.find(hashes[new])
        counts = self.cache.sizes[entry].astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(counts)])
        ids = self.cache.pool[np.repeat(self.cache.starts[entry] - edges[:-1], counts) + np.arange(edges[-1])]
        return ids, edges

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        usual: list[str] = []
        for text in texts:
            if not text or self._unusual(text):
                out.append(self.whole(text) if text else b"")
            else:
                usual.append(_HEAD + text.replace("\n", " \n") if self.kept else text.replace("\n", " "))
                out.append(None)
        if usual:
            ids, edges = self._look(np.frombuffer(" ".join(usual).encode(), np.uint8))
            at = np.cumsum([0, *[t.count(" ") + 1 for t in usual]])
            cuts = iter(zip(edges[at[:-1]].tolist(), edges[at[1:]].tolist()))
            raw = memoryview(ids.astype("<u4").tobytes())
            for k, known in enumerate(out):
                if known is None:
                    a, b = next(cuts)
                    out[k] = bytes(raw[a * 4 : b * 4])
        return out


_held: dict[tuple, Encoder] = {}


def encoder(path: str, cache_entries: int = CACHE_ENTRIES, plain_special: bool = False) -> Encoder:
    """One encoder per worker."""
    key = (path, cache_entries, plain_special)
    if key not in _held:
        _held.clear()
        _held[key] = Encoder(path, cache_entries, plain_special)
    return _held[key]


def texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]
