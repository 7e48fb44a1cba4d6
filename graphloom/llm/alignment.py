"""Alignment of two tokenizers' ids over a corpus: which tokens of one stand for which of the other.

Byte offsets at which tokens of both sides end cut a text into groups; the tokens
of a group are linked, each of one side to each of the other. How many documents
hold an id pair linked is counted corpus-wide:

* every task tokenises its documents, keeps each document's distinct pairs with
  their multiplicity (a table in the shared folder), and counts them, so that a
  pair in every document is one entry a task;
* the ids of the left side are dealt over stripes; a stripe's ids by all ids of
  the right side are one dense block of counters, of ``block_bytes`` at most, into
  which ``np.add.at`` puts the tasks' counts as they stream by. A row's maximum is
  the best count of its left id;
* the links are dealt by stripe too and meet the block there. A stripe with more
  than ``links_a_task`` links is dealt out as several, each with a copy of the
  block, so an id that holds a third of all links is no single task's.

What leaves a stripe are sums per document, put together by a partial aggregate.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from graphloom.llm import tokens
from graphloom.llm.frames import shuffle_width, tables, written
from graphloom.llm.words import batches

BLOCK_BYTES, LINKS_A_TASK = 1 << 25, 2_000_000
MANY = 64  # links of a group from which its ids are counted before they are paired
HELD_PAIRS = 1 << 21
BATCH_BYTES = 1 << 20
_SEPARATORS = (b",", b"|", b";")


class Side:
    """The bytes that a tokenizer's ids stand for."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(entries), np.uint8)

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of some ids, of under 2 GB."""
        sizes = self.sizes[ids]
        places = np.repeat((self.starts[ids] - np.cumsum(sizes) + sizes).astype(np.int32), sizes)
        places += np.arange(len(places), dtype=np.int32)
        return self.pool[places]


def _left_side(encoder: tokens.Encoder) -> Side:
    bytes_of = {chr(tokens.hidden_bytes().get(b, b)): bytes([b]) for b in range(256)}
    entries = [b""] * encoder.vocabulary()
    for token, k in encoder.tokenizer.get_vocab(with_added_tokens=True).items():
        entries[k] = b"".join(bytes_of.get(c, c.encode()) for c in token)
    return Side(entries)


def _right_side(pieces) -> Side:
    def entry(k: int) -> bytes:
        piece = pieces.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(k) else piece.replace("▁", " ").encode()

    return Side([entry(k) for k in range(pieces.get_piece_size())])


class PieceEncoder(tokens.Encoder):
    """``encode(texts)`` of a sentencepiece model, with a cache of what stands between spaces and line feeds.

    That is exact where no piece holds a space behind another character or a line feed, and characters stay as they are;
    both are looked up, and a model for which they don't hold encodes whole texts.
    """

    def __init__(self, path: str, cache_entries: int = tokens.CACHE_ENTRIES):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size())]
        inside = any("▁" in name.lstrip("▁") or "\n" in name for name in names)
        probes = ["ﬁ Å ① ㌔ ｶﾞ ´ \u0301x e\u0301 \u00ad\u200b\ufeff ½ ﷺ", "a  b\tc\r\n d\u00a0e\u3000f "]
        side = _right_side(self.pieces)
        changed = any(side.decoded(np.array(self.pieces.encode(p))).tobytes() != (" " + p).encode() for p in probes)
        self.scheme = None if inside or changed else "kept"
        self.kept, self.cache = True, tokens.Cache(cache_entries)

    def vocabulary(self) -> int:
        return self.pieces.get_piece_size()

    def whole(self, text: str) -> bytes:
        return np.array(self.pieces.encode(text), "<u4").tobytes()

    def _unusual(self, text: str) -> bool:
        return self.scheme is None or "\0" in text or "▁" in text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n\n", " \n", "\n "))

    def _learn(self, piece: str) -> bytes:
        if piece[0] == "\n":  # the model puts a space in front, which nothing joins with a line feed
            return self.whole(piece)[4:]
        return self.whole(piece[1:] if piece[0] == "\0" else piece)


class Aligner:
    """Tokens, groups and links of batches of texts."""

    def __init__(self, left: str, right: str):
        self.encoder, self.pieces = tokens.encoder(left, plain_special=True), PieceEncoder(right)
        self.sides = _left_side(self.encoder), _right_side(self.pieces.pieces)
        self.sizes = tuple(len(s.sizes) for s in self.sides)
        self.shown = [f"{k}".encode() + sep for k in range(max(self.sizes)) for sep in _SEPARATORS]

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(whether each text has tokens, their ids on either side, how many a text, bytes before each text and in all)."""
        whole = [" " + t if t else "" for t in texts]
        raw = [w.encode() for w in whole]
        lengths = np.array([len(r) for r in raw], np.int64)
        found = self.encoder.encode(whole), self.pieces.encode(texts)
        ids = [np.frombuffer(b"".join(own), "<u4").astype(np.int64) for own in found]
        counts = [np.array([len(x) // 4 for x in own], np.int64) for own in found]
        good = lengths > 0
        data = np.frombuffer(b"".join(raw), np.uint8)
        for side, own, n in zip(self.sides, ids, counts):
            made = np.add.reduceat(np.append(side.sizes[own], 0), np.minimum(np.cumsum(n) - n, len(own))) if len(n) else n
            good &= (n > 0) & (made == lengths)
        while True:  # once more if texts of equal length differ
            kept = [own[np.repeat(good, n)] for own, n in zip(ids, counts)]
            wanted = data[np.repeat(good, lengths)]
            there = np.cumsum(np.where(good, lengths, 0))
            wrong = np.concatenate([np.flatnonzero(side.decoded(own) != wanted) for side, own in zip(self.sides, kept)])
            if not len(wrong):
                return good, kept, [np.where(good, n, 0) for n in counts], np.concatenate([[0], there])
            good = good.copy()
            good[np.searchsorted(there, np.unique(wrong), "right")] = False

    def align(self, texts: list[str]) -> Aligned:
        return Aligned(self, *self.tokens(texts))


class Aligned:
    """Groups and links of one batch. Groups are numbered through the batch; ``first[k]``: each group's first token of side k."""

    def __init__(self, by: Aligner, good: np.ndarray, ids: list[np.ndarray], counts: list[np.ndarray], edges: np.ndarray):
        self.by, self.good, self.ids, self.counts, self.docs = by, good, ids, counts, len(good)
        ends = [np.cumsum(side.sizes[own]) for side, own in zip(by.sides, ids)]
        self.last = [_among(mine, other) for mine, other in (ends, ends[::-1])]
        self.group = [np.cumsum(x) - x for x in self.last]
        self.groups = int(self.last[0].sum())
        self.size = [np.bincount(g, minlength=self.groups) for g in self.group]
        self.first = [np.concatenate([[0], np.cumsum(s)]) for s in self.size]
        where = np.searchsorted(edges, ends[0][self.last[0]], "left") - 1  # the document of each group
        self.doc = where
        links = self.size[0] * self.size[1]
        self.n_groups = np.bincount(where, minlength=self.docs)
        self.n_links = np.bincount(where, weights=links, minlength=self.docs).astype(np.int64)
        self.links = links

    def digests(self, text: bool = False) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each text, or its SHA-256; '' without tokens."""
        (a, b), (ga, gb) = self.ids, self.group
        row = np.empty(len(a) + len(b), np.int64)
        row[np.arange(len(a)) + self.first[1][ga]] = 3 * a + self.last[0]
        row[np.arange(len(b)) + self.first[0][gb + 1]] = 3 * b + 2 * self.last[1]
        edges = np.concatenate([[0], np.cumsum(self.counts[0] + self.counts[1])]).tolist()
        shown, out = self.by.shown.__getitem__, []
        for lo, hi in zip(edges, edges[1:]):
            line = b"".join(map(shown, row[lo:hi].tolist()))[:-1]
            out.append(line.decode() if text else hashlib.sha256(line).hexdigest() if hi > lo else "")
        return out

    def pairs(self, stripes: Stripes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each document: (document, code, links)."""
        many = self.links > MANY
        few = ~many[self.group[0]]
        a, ga = self.ids[0][few], self.group[0][few]
        times = self.size[1][ga]
        before = np.cumsum(times) - times
        partner = np.repeat(self.first[1][ga] - before, times) + np.arange(int(times.sum()))
        keys = [np.repeat(self.doc[ga] * stripes.codes + stripes.code(a, 0), times) + self.ids[1][partner]]
        weights = [np.ones(len(keys[0]), np.int64)]
        for g in np.flatnonzero(many).tolist():
            (x, nx), (y, ny) = (np.unique(own[f[g] : f[g + 1]], return_counts=True) for own, f in zip(self.ids, self.first))
            keys.append((self.doc[g] * stripes.codes + stripes.code(x, 0)[:, None] + y[None]).ravel())
            weights.append((nx[:, None] * ny[None]).ravel())
        if len(keys) == 1:
            found, links = np.unique(keys[0], return_counts=True)
        else:
            found, place = np.unique(np.concatenate(keys), return_inverse=True)
            links = np.zeros(len(found), np.int64)
            np.add.at(links, place, np.concatenate(weights))
        return found // stripes.codes, found % stripes.codes, links.astype(np.int64)


def _among(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of ``mine`` occur in ``other``; both ascend and end alike."""
    return other[np.searchsorted(other, mine)] == mine if len(mine) else np.zeros(0, bool)


class Stripes:
    """Left ids dealt over stripes: id k is row k // n of stripe k % n. A pair's code puts stripe, row and right id together."""

    def __init__(self, left: int, right: int, block_bytes: int = BLOCK_BYTES):
        self.left, self.right = left, right
        self.n = max(1, min(left, math.ceil(left * right * 8 / block_bytes)))
        self.rows = -(-left // self.n)
        self.block = self.rows * right  # counters of a stripe
        self.codes = self.n * self.block

    def code(self, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        return (a % self.n) * self.block + (a // self.n) * self.right + b

    def cut(self, codes: np.ndarray) -> tuple[list[int], list[int]]:
        """(stripes that occur in ascending codes, where each begins and the last one ends)"""
        stripe = codes // self.block
        first = np.flatnonzero(np.diff(stripe, prepend=-1))
        return stripe[first].tolist(), [*first.tolist(), len(codes)]


_held: dict[tuple[str, str], Aligner] = {}


def aligner(left: str, right: str) -> Aligner:
    """One per worker."""
    if (left, right) not in _held:
        _held.clear()
        _held[left, right] = Aligner(left, right)
    return _held[left, right]


def stripes_of(left: str, right: str, block_bytes: int = BLOCK_BYTES) -> Stripes:
    by = aligner(left, right)
    return Stripes(*by.sizes, block_bytes)


def _binary(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def aligned(documents: DataFrame, left: str, right: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, with_groups: bool = False) -> DataFrame:
    """(``doc_id``, n_a, n_b, n_groups, n_links, groups_sha256[, groups], codes, links) of every row.

    ``left`` is a byte-level file of the tokenizers library, ``right`` a sentencepiece model; ``codes`` and ``links``
    (little-endian, 64 and 32 bits) are the distinct id pairs of the text and their occurrences.
    """
    rows = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    names = ["_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else []), "codes", "links"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, stripes = aligner(left, right), stripes_of(left, right, block_bytes)
        for batch in batches(it, "_text", BATCH_BYTES):
            found = by.align(tokens.texts(batch.column("_text")))
            doc, codes, links = found.pairs(stripes)
            cuts = np.searchsorted(doc, np.arange(found.docs + 1)).tolist()
            columns = [pa.array(x, pa.int64()) for x in (*found.counts, found.n_groups, found.n_links)]
            columns += [pa.array(found.digests(), pa.string())] + ([pa.array(found.digests(True), pa.string())] if with_groups else [])
            for values, kind in ((codes, "<i8"), (links, "<u4")):
                columns.append(pa.array([_binary(values[a:b], kind) for a, b in zip(cuts, cuts[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], names)

    kind = documents.select(F.col(f"`{doc_id}`")).schema[0].dataType
    schema = StructType([StructField("_id", kind)])
    for name in names[1:]:
        schema = schema.add(name, "binary" if name in ("codes", "links") else "string" if name.startswith("groups") else "long")
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", doc_id)


def _codes(column: pa.Array, kind: str = "<i8") -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(codes), return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, place, np.concatenate(counts))
    return found, out


def counted(rows: DataFrame, stripes: Stripes) -> DataFrame:
    """(stripe, entries, codes, counts, best): one row a stripe, its pairs in ascending order, in how many documents each is linked, and the greatest count of the pair's left id."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = [np.zeros(0, np.int64)]
        counts: list[np.ndarray] = [np.zeros(0, np.int64)]
        held = distinct = 0

        def out() -> pa.RecordBatch:
            names, cuts = stripes.cut(codes[0])
            parts = [[_binary(x[a:b], "<i8") for a, b in zip(cuts, cuts[1:])] for x in (codes[0], counts[0])]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *[pa.array(p, pa.binary()) for p in parts]], ["stripe", "codes", "counts"])

        for batch in it:
            for own in _codes(batch.column("codes")):
                codes.append(own)
                counts.append(np.ones(len(own), np.int64))
                held += len(own)
            if held > HELD_PAIRS:
                (one, n), held = _summed(codes, counts), 0
                codes, counts, distinct = [one], [n], len(one)
                if distinct > HELD_PAIRS:
                    yield out()
                    codes, counts = [one[:0]], [n[:0]]
        one, n = _summed(codes, counts)
        codes, counts = [one], [n]
        if len(one):
            yield out()

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, np.zeros(stripes.block, np.int64)

        def out() -> pa.RecordBatch:
            best = block.reshape(stripes.rows, stripes.right).max(axis=1)
            place = np.flatnonzero(block)
            values = (place + at * stripes.block, block[place], best[place // stripes.right])
            found = [pa.array([at], pa.int32()), pa.array([int(values[1].sum())], pa.int64()), *[pa.array([_binary(v, "<i8")], pa.binary()) for v in values]]
            block[place] = 0
            return pa.RecordBatch.from_arrays(found, ["stripe", "entries", "codes", "counts", "best"])

        for batch in it:
            for stripe, codes, counts in zip(batch.column("stripe").to_pylist(), _codes(batch.column("codes")), _codes(batch.column("counts"))):
                if stripe != at:
                    if at is not None:
                        yield out()
                    at = stripe
                np.add.at(block, codes - at * stripes.block, counts)
        if at is not None:
            yield out()

    parts = rows.select("codes").mapInArrow(partial, "stripe int, codes binary, counts binary")
    dealt = parts.repartition(shuffle_width(rows.sparkSession), "stripe").sortWithinPartitions("stripe")
    return dealt.mapInArrow(blocks, "stripe int, entries long, codes binary, counts binary, best binary")


def best_partners(blocks: DataFrame, stripes: Stripes) -> DataFrame:
    """(a, b, count): each left id's right ids with its greatest count, ties included."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for codes, counts, best in zip(*[_codes(batch.column(c)) for c in ("codes", "counts", "best")]):
                top = counts == best
                stripe, place = np.divmod(codes[top], stripes.block)
                a = place // stripes.right * stripes.n + stripe
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, place % stripes.right, counts[top])], ["a", "b", "count"])

    return blocks.select("codes", "counts", "best").mapInArrow(run, "a long, b long, count long")


class Turns:
    """Deals each stripe's pieces over its shares by turns; ``first``, one of its own for every task, as a task may have a single piece of a stripe."""

    def __init__(self, shares: dict[int, int], first: int):
        self.shares, self.first, self.taken = shares, first, {}

    def share(self, stripe: int) -> int:
        turn = self.taken[stripe] = self.taken.get(stripe, self.first) + 1
        return turn % self.shares.get(stripe, 1)


def scored(rows: DataFrame, blocks: DataFrame, stripes: Stripes, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """(_row, n_best, count_sum) of ``rows``, (_row, codes, links), that have links."""
    shares = {r["stripe"]: -(-r["entries"] // links_a_task) for r in blocks.select("stripe", "entries").collect()}  # a number a stripe
    dealt = {k: n for k, n in shares.items() if n > 1}

    def strip(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = Turns(dealt, TaskContext.get().partitionId())
        for batch in batches(it, "codes", 8 * BATCH_BYTES):
            codes, links = _codes(batch.column("codes")), _codes(batch.column("links"), "<u4")
            sizes = [len(c) for c in codes]
            flat, n = np.concatenate(codes), np.concatenate(links)
            row = np.repeat(batch.column("_row").to_numpy(), sizes)
            order = np.argsort(flat // stripes.block, kind="stable")
            flat, n, row = flat[order], n[order], row[order]
            names, cuts = stripes.cut(flat)
            out: dict[str, list] = {k: [] for k in ("stripe", "share", "rows", "sizes", "codes", "links")}
            for name, a, b in zip(names, cuts, cuts[1:]):
                step = max(1, links_a_task // 8) if name in dealt else b - a
                for lo in range(a, b, step):
                    hi = min(b, lo + step)
                    first = np.flatnonzero(np.diff(row[lo:hi], prepend=-1))
                    values = (name, turns.share(name), _binary(row[lo:hi][first], "<i8"), _binary(np.diff(np.append(first, hi - lo)), "<u4"), _binary(flat[lo:hi] - name * stripes.block, "<u4"), _binary(n[lo:hi], "<u4"))
                    for k, v in zip(out, values):
                        out[k].append(v)
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds)], list(out))

    def meet(own: pa.Table, block: pa.Table) -> pa.Table:
        counts, best = np.zeros(stripes.block, np.int64), np.zeros(stripes.rows, np.int64)
        base = block.column("stripe")[0].as_py() * stripes.block
        for codes, n, top in zip(*[_codes(block.column(c)) for c in ("codes", "counts", "best")]):
            counts[codes - base] = n
            best[(codes - base) // stripes.right] = top
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]  # a share may have no links
        for row, size, codes, links in zip(_codes(own.column("rows")), *[_codes(own.column(c), "<u4") for c in ("sizes", "codes", "links")]):
            first = np.cumsum(size, dtype=np.int64) - size
            n = links.astype(np.int64)
            held = counts[codes]
            out[0].append(row)
            out[1].append(np.add.reduceat(n * (held == best[codes // stripes.right]), first))
            out[2].append(np.add.reduceat(n * held, first))
        return pa.table({k: np.concatenate(v) for k, v in zip(("_row", "n_best", "count_sum"), out)})

    width = shuffle_width(rows.sparkSession)
    links = rows.where(F.octet_length("codes") > 0).mapInArrow(strip, "stripe int, share int, rows binary, sizes binary, codes binary, links binary")
    many = F.greatest(F.ceil(F.col("entries") / links_a_task), F.lit(1)).cast("int")
    copies = blocks.select("stripe", F.explode(F.sequence(F.lit(0), many - 1)).alias("share"), "codes", "counts", "best")
    by = lambda df: df.repartition(width, "stripe", "share").groupBy("stripe", "share")
    sums = by(links).cogroup(by(copies)).applyInArrow(meet, "_row long, n_best long, count_sum long")
    return sums.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def token_alignment(documents: DataFrame, left: str, right: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, links_a_task: int = LINKS_A_TASK, with_groups: bool = False) -> DataFrame:
    """(``doc_id``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) of every row.

    ``left`` reads a space and the text, ``right`` the text, to which it adds that space. Null and empty texts, and those
    that either tokenizer does not give back byte by byte, have no tokens: zeros and ''. Rows alike are documents of
    their own and count each; a null id is kept; other columns are left out; an empty table gives none.
    """
    stripes = stripes_of(left, right, block_bytes)
    rows = aligned(documents, left, right, doc_id, text, block_bytes, with_groups)
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    blocks = written(counted(rows, stripes), "stripes")
    sums = scored(rows.select("_row", "codes", "links"), blocks, stripes, links_a_task)
    kept = [f"`{doc_id}`", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else [])]
    known = rows.select(F.col("_row").alias("_own"), *kept)
    zero = F.lit(0).cast("long")
    met = known.join(sums, known["_own"] == sums["_row"], "left")
    return met.select(*kept[:5], F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), *kept[5:])


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all documents, byte-level ids against sentence pieces."""
    import public_tokenizers

    return token_alignment(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
