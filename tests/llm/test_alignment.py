import collections
import hashlib
import os
import random

import numpy as np
import pytest

from graphloom.llm import alignment
from graphloom.llm.frames import arrow_rows, written
from tests.llm.cases import ROWS, documents, empty

public_tokenizers = pytest.importorskip("public_tokenizers")
LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = [
    (20, "<|endoftext|> is text, <s> too </s> <unk> <0x41>", "en", "a"),
    (21, "▁a mark of the other side", "en", "a"),
    (22, "\0 null and \r\n lines\t\ttabs   spaces  ", "en", "a"),
    (23, "🙂🙂 é́ 中文 한국어 العربية", "en", "a"),
    (24, "the the the the the cat", "en", "a"),
    (None, "the cat without an id", "en", "a"),
    (25, "antidisestablishmentarianism!!!???...,,,;;;" * 30, "en", "a"),
    (26, "á" * 700 + "ﷺ" * 300, "en", "a"),
    (27, "9" * 3000, "en", "a"),
]


def by_hand(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by the libraries, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(LEFT)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    shown = sorted({*range(33, 127), *range(161, 173), *range(174, 256)})
    of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    found = []
    for i, t, *_ in rows:
        whole = (" " + (t or "")).encode()
        a, b = (left.encode(" " + t, add_special_tokens=False).ids, right.encode(t)) if t else ([], [])
        ab = [bytes(of[c] for c in left.id_to_token(x)) for x in a]
        bb = [bytes([int(right.id_to_piece(x)[3:5], 16)]) if right.is_byte(x) else right.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(ab) != whole or b"".join(bb) != whole:
            found.append((i, [], [], []))
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 400 else _running(parts)
        ea, eb = ends(ab), ends(bb)
        both = set(ea) & set(eb)
        groups, x, y = [], 0, 0
        for e in sorted(both):
            g = ([], [])
            while x < len(a) and ea[x] <= e:
                g[0].append(a[x])
                x += 1
            while y < len(b) and eb[y] <= e:
                g[1].append(b[y])
                y += 1
            groups.append(g)
        found.append((i, a, b, groups))
    counts = collections.Counter()
    for _, _, _, groups in found:
        counts.update({(p, q) for x, y in groups for p in x for q in y})
    best = collections.defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = []
    for i, a, b, groups in found:
        links = [(p, q) for x, y in groups for p in x for q in y]
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[pq] == best[pq[0]] for pq in links), sum(counts[pq] for pq in links), line))
    return sorted(out, key=repr), counts, best


def _running(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


@pytest.fixture(scope="module")
def wanted():
    return by_hand(ROWS + MORE)


@pytest.mark.parametrize("block_bytes, links_a_task", [(1 << 25, 2_000_000), (1 << 22, 40)])
def test_against_the_libraries(spark, wanted, block_bytes, links_a_task):
    df = alignment.token_alignment(documents(spark, ROWS + MORE).repartition(3), LEFT, RIGHT, block_bytes=block_bytes, links_a_task=links_a_task, with_groups=True)
    got = df.collect()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == wanted[0]
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got)
    assert {r.doc_id for r in got if r.n_a == 0} == {0, 1, 21}


def test_one_piece_of_each_stripe_a_batch(spark):
    """As in large tables, of which a batch has all stripes: the pieces of a stripe go to all of its shares."""
    rows = [(k, "the cat") for k in range(12)]
    with arrow_rows(spark, 1):
        df = alignment.token_alignment(documents(spark, [(*r, "en", "a") for r in rows]).coalesce(1), LEFT, RIGHT, links_a_task=6, with_groups=True)
        got = sorted(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) for r in df.collect())
    assert got == sorted(by_hand(rows)[0])
    for tasks, pieces in ((12, 1), (1, 12), (4, 3)):
        all_turns = [alignment.Turns({5: 3, 7: 2}, k) for k in range(tasks)]
        dealt = collections.Counter((stripe, turns.share(stripe)) for turns in all_turns for _ in range(pieces) for stripe in (5, 7, 9))
        assert dealt == {(5, 0): 4, (5, 1): 4, (5, 2): 4, (7, 0): 6, (7, 1): 6, (9, 0): 12}


def test_shares_without_links(spark):
    stripes = alignment.stripes_of(LEFT, RIGHT)
    rows = written(alignment.aligned(documents(spark, [(k, "the cat", "en", "a") for k in range(12)]), LEFT, RIGHT).selectExpr("doc_id as _row", "codes", "links"))
    sums = alignment.scored(rows.where("_row = 3"), written(alignment.counted(rows, stripes)), stripes, links_a_task=2)
    assert [tuple(r) for r in sums.collect()] == [(3, 2, 24)]


def test_best_partners(spark, wanted):
    stripes = alignment.stripes_of(LEFT, RIGHT)
    blocks = alignment.counted(alignment.aligned(documents(spark, ROWS + MORE), LEFT, RIGHT), stripes)
    _, counts, best = wanted
    assert sorted(map(tuple, alignment.best_partners(blocks, stripes).collect())) == sorted((*pq, n) for pq, n in counts.items() if best[pq[0]] == n)


def test_pairs_are_counted_in_rounds(spark, wanted, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 50)
    stripes = alignment.stripes_of(LEFT, RIGHT)
    rows = [alignment.aligner(LEFT, RIGHT).align([t or "" for _, t, *_ in ROWS + MORE]).pairs(stripes)]
    assert sum(len(r[1]) for r in rows) == sum(wanted[1].values())


def test_many_links_in_a_group(spark, wanted, monkeypatch):
    """Groups are counted id by id, or pair by pair, with one result."""
    by, stripes = alignment.aligner(LEFT, RIGHT), alignment.stripes_of(LEFT, RIGHT)
    texts = [t or "" for _, t, *_ in ROWS + MORE]
    plain = by.align(texts).pairs(stripes)
    monkeypatch.setattr(alignment, "MANY", 0)
    assert all((x == y).all() for x, y in zip(plain, by.align(texts).pairs(stripes)))


def test_cached_pieces_are_the_librarys():
    by, rng = alignment.PieceEncoder(RIGHT), random.Random(1)
    parts = ["a", "the", "\n", " ", "\t", "é", "▁", "<s>", "\u0301", "中", "x1", "!!", "\u00a0", "🙂", "\r", "ing", "\0", "’", "ab▁c"]
    texts = [sep.join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for sep in ("", " ") for _ in range(3000)]
    assert by.scheme == "kept"
    assert [np.frombuffer(x, "<u4").tolist() for x in by.encode(texts)] == by.pieces.encode(texts)


def test_an_empty_table(spark):
    assert alignment.token_alignment(empty(spark), LEFT, RIGHT).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_the_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = by_hand([(r.doc_id, r.text) for r in rows])[0]
    got = alignment.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == sorted((*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in want)
