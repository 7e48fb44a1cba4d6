import collections
import functools
import json
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import blocks, coder, components, frames, jaccard, packing, pages
from graphloom.llm.tokens import Encoder
from graphloom.llm.words import ALNUM_WORDS, SPACE_WORDS, Words, roll
from tests.llm.cases import ROWS, documents, empty, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TABLES = "/root/testdata/sf0.01"


def grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


@given(st.lists(st.text("ab é\n\t\x0b.Z9", max_size=30), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words(texts):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    buffer = np.frombuffer(b"".join(data), np.uint8)
    for table, pattern in ((SPACE_WORDS, r"[^\x20\x09-\x0D]+"), (ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        found = Words(buffer, offsets, table)
        for d, t in enumerate(texts):
            a, b = found.first[d], found.first[d + 1]
            own = [bytes(buffer[x:y]).decode() for x, y in zip(found.starts[a:b], found.ends[a:b])]
            assert own == re.findall(pattern, t)


def test_rolling_hash():
    t = np.arange(50, dtype=np.uint64) * np.uint64(77)
    for n in (1, 2, 5, 10, 35, 50):
        got = roll(t, n, 31).tolist()
        assert got == [sum(int(t[k + j]) * 31 ** (n - 1 - j) for j in range(n)) % 2**64 for k in range(50 - n + 1)]
    assert len(roll(t, 51)) == 0


# 3


def near_rows():
    rng = random.Random(4)
    rows = []
    for g in range(12):
        words = prose(1000 + g, 120).split()
        for k in range(rng.randrange(1, 9)):
            changed = list(words)
            for _ in range(rng.randrange(0, 5)):
                changed[rng.randrange(len(changed))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed), "en", "a"))
    rows += [(len(rows) + k, rows[k * 3][1], "en", "a") for k in range(6)]
    return rows + [(500, "short text", "en", "a"), (501, "Short, TEXT!", "en", "a"), (502, None, "en", "a"), (503, "", "en", "a"), (504, "...", "en", "a"), (505, prose(3, 20000), "en", "a"), (506, prose(3, 20000) + " end", "en", "a")]


@pytest.mark.parametrize("block, hot", [(2048, 200), (3, 2)])
def test_jaccard(spark, monkeypatch, block, hot):
    monkeypatch.setattr(frames, "LEAST_HOT", hot)
    rows = near_rows()
    got = {r.doc_id: r for r in jaccard.similarity_classes(documents(spark, rows), block=block, bucket_block=block).collect()}
    sets = {i: grams(t) for i, t, *_ in rows}
    links, parent = collections.Counter(), {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (top(i), links[i]) for i in sets}
    kept = jaccard.one_of_each(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if top(i) == i) and kept.columns == documents(spark).columns


@pytest.mark.skipif(not os.path.exists(f"{TABLES}/documents.parquet"), reason="no tables")
def test_jaccard_recall_on_a_whole_table(spark):
    """Links of every document whose id is divisible by 50, each against all documents by hand: none missed, none made up."""
    df = spark.read.parquet(f"{TABLES}/documents.parquet")
    got = {r.doc_id: r for r in jaccard.similarity_classes(df).collect()}
    sets = {r.doc_id: grams(r.text) for r in df.select("doc_id", "text").collect()}
    asked = [i for i in sets if i % 50 == 0]
    for i in asked:
        mine = sets[i]
        near = [j for j, x in sets.items() if j != i and mine and x and len(mine & x) >= 0.8 * len(mine | x) - 1e-9]
        assert got[i].n_links == len(near) and {got[j].class_id for j in near} <= {got[i].class_id}
    assert len(asked) > 10 and sum(got[i].n_links > 0 for i in got) > 10


def test_jaccard_edges(spark):
    got = jaccard.similarity_classes(documents(spark))
    assert got.count() == len(ROWS)
    assert {r.doc_id: r.n_links for r in got.collect() if r.doc_id in (0, 1, 2, 4, 5, 6)} == {0: 0, 1: 0, 2: 0, 4: 3, 5: 3, 6: 3}
    assert jaccard.similarity_classes(empty(spark)).count() == 0
    assert jaccard.one_of_each(documents(spark)).where("doc_id = 5").count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard.least_matches(0.8, 1e-6)
    assert least == dict(sorted(least.items())) and all(m < 0.8 * n for n, m in least.items())


@pytest.mark.parametrize("hub", [200, 3])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(frames, "LEAST_HOT", hub)
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(400, k) for k in range(401, 460)]
    label = {v: v for e in edges for v in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(v, v) == x for v, x in label.items())
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 5 and 7


@functools.cache
def tokenizer(path):
    return Tokenizer.from_file(path)


def library(path, text):
    return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_is_the_tokenizer(path):
    rng = random.Random(3)
    texts = ["", "a  b", " a", "a ", "\n", "a\n\nb", "a \n b\nc", "x\ty", "a|b | c ||", "it's we'll", "123 45\n7", "|", "a\0b", "***a***b", "ÀÉ×÷ß ÿÿ ª", "x\n***\ny..", "<|endoftext|> x", "İx Σας"]
    texts += ["hello <|endoftext|> world", "<|startoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>", "<|endoftext"]
    texts += ["".join(rng.choice("aé .,'*\n 1Zß|") for _ in range(40)) for _ in range(500)] + [t for _, t, *_ in ROWS if t]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", " ", "\n", "word", "Word's", "é", "12", "|>", " <"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(10000)]
    one, plain = Encoder(path, cache_entries=50), tokenizer(path)
    truth = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert one.scheme and one.encode(texts) == truth
    assert [one.encode([t])[0] for t in texts] == truth


def test_other_tokenizers_are_not_guessed(tmp_path):
    """A file that splits in another way goes through the library whole."""
    rules = json.loads(Tokenizer.from_file(BYTES).to_str())
    rules["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(rules))
    one = Encoder(str(path))
    texts = ["plain words here", " x", "", "a\nb"]
    assert one.scheme is None and one.encode(texts) == [library(str(path), t) for t in texts]


def ids_by_hand(path, end, rows):
    return [(i, np.append(np.frombuffer(library(path, t or ""), "<u4"), np.uint32(end)).astype("<u4")) for i, t, *_ in rows]


@pytest.mark.parametrize("weights", [None, {"=a": 5.0, "=b": 1.0}, {"=a": 0.0}])
def test_packing(spark, weights):
    rows = ROWS + [(100 + k, prose(k, 50 + k), "en", "abc"[k % 3]) for k in range(40)]
    rows = [r for k, r in enumerate(rows) if k != 6]
    got = packing.packed(packing.tokenized(documents(spark, rows), BYTES), weights=weights).collect()
    truth = dict(ids_by_hand(BYTES, 0, rows))
    places, pieces = [], collections.defaultdict(list)
    for r in got:
        ids = truth[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.offset + r.length <= 1024
        pieces[r.doc_id].append((r.start, r.length))
        places.append((r.sequence_id * 1024 + r.offset, r.length))
    for parts, size in ((sorted(places), sum(map(len, truth.values()))), *((sorted(p), len(truth[i])) for i, p in pieces.items())):
        at = 0
        for a, n in parts:
            assert a == at
            at += n
        assert at == size
    assert set(pieces) == set(truth)


def test_packing_keeps_proportions():
    plan = packing.Plan({"=a": 128 * 700, "=b": 128 * 200, "=c": 128 * 100 + 5}, None, 1024, 128)
    slots = {}
    for k, n in enumerate(plan.grains):
        at = plan.places(np.full(n, k), np.arange(n)) // 128
        slots |= dict.fromkeys(at.tolist(), k)
    assert sorted(slots) == list(range(1000))
    for upto in range(8, 1000, 8):  # after every window each source is within a grain or so of its share
        counts = collections.Counter(slots[s] for s in range(upto))
        assert all(abs(counts[k] - upto * share) <= 3 for k, share in enumerate((0.7, 0.2, 0.1)))


@given(st.lists(st.tuples(st.integers(-(2**45), 2**45), st.integers(0, 2**45), st.integers(1, 2**50)), min_size=1, max_size=50))
@settings(max_examples=200, deadline=None)
def test_products_beyond_64_bits(rows):
    rows = [(a, b, c) for a, b, c in rows if abs(a * b // c) < 2**60] or [(1, 1, 1)]
    a, b, c = (np.array(x, np.int64) for x in zip(*rows))
    assert packing.muldiv(a, b, c).tolist() == [x * y // z for x, y, z in rows]


def test_packing_of_more_tokens_than_there_are():
    """Places in a plan of 10**13 tokens: all different, in order, and about where the shares put them."""
    plan = packing.Plan({"=a": 9 * 10**12, "=b": 10**12 + 77}, None, 1024, 128)
    for source, share in ((0, 0.9), (1, 0.1)):
        number = np.arange(plan.grains[source] // 2, plan.grains[source] // 2 + 50)
        at = plan.places(np.full(50, source), number)
        assert (np.diff(at) >= 128).all() and abs(at[0] * share - number[0] * 128) < 1024 * 4


def test_packing_edges(spark):
    assert packing.packed(packing.tokenized(empty(spark), BYTES)).count() == 0
    many = packing.packed(packing.tokenized(documents(spark), BYTES, max_queues=1))
    assert many.select("queue").distinct().count() == 1 and many.select("doc_id").distinct().count() == len({r[0] for r in ROWS})


def test_packing_of_many_sources(spark):
    """Over the bound the largest and the weighted sources keep their queues, and the largest its share of every window."""
    rows = [(k, prose(k, 60), "en", "hot" if k % 2 else f"s{k}") for k in range(120)]
    df = documents(spark, rows)
    got = packing.packed(packing.tokenized(df, BYTES, max_queues=4)).collect()
    queues = {r.queue for r in got}
    assert "=hot" in queues and 2 <= len(queues) <= 4
    hot = {r.doc_id for r in got if r.queue == "=hot"}
    assert hot == {k for k, *_, s in rows if s == "hot"}
    windows = collections.Counter()
    for r in got:
        windows[r.sequence_id] += r.length * (r.queue == "=hot")
    share = sum(windows.values()) / sum(r.length for r in got)
    assert all(abs(windows[w] - 1024 * share) <= 2 * 128 for w in range(max(windows) - 1))
    tokens = packing.tokenized(df, BYTES, max_queues=4, weighted=["=s2", "=s4"])
    first = min(packing.packed(tokens, weights={"=s2": 1.0, "=s4": 1.0}).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert first.doc_id in (2, 4)
    with pytest.raises(ValueError, match="=s6"):
        packing.packed(tokens, weights={"=s6": 1.0})


@pytest.mark.parametrize("size", [0, 1, 5, 127, 128, 129, 1000, 20000])
@pytest.mark.parametrize("kind", ["same", "few", "many"])
def test_coder_round_trip(size, kind):
    ids = np.random.default_rng(size).integers(0, {"same": 1, "few": 5, "many": 60000}[kind], size)
    made = coder.encode_block(ids, 128)
    assert (coder.decode_block(made) == ids).all()
    assert kind == "many" or len(made) < 200 + size


def test_coder_notices_damage():
    ids = np.random.default_rng(1).integers(0, 3000, 5000)
    block = coder.encode_block(ids)
    for at in list(range(0, 32)) + list(range(40, len(block), 997)):
        damaged = bytearray(block)
        damaged[at] ^= 0x15
        if at < 32:
            with pytest.raises(ValueError):
                coder.decode_block(bytes(damaged))
        else:
            try:
                assert (coder.decode_block(bytes(damaged)) == ids).all()
            except ValueError:
                pass


@pytest.mark.parametrize("block_ids", [1 << 20, 300])
def test_block_files(spark, block_ids, tmp_path):
    path = str(tmp_path / "blocks")
    blocks.coded(documents(spark), WORDS, block_ids=block_ids).write.parquet(path)
    got = sorted(blocks.decoded(spark.read.parquet(path), with_ids=True).collect(), key=lambda r: r.start)
    truth = sorted(ids_by_hand(WORDS, 1, ROWS), key=lambda r: r[0])
    at = 0
    for r, (i, ids) in zip(got, truth, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)


def test_blocks_stand_by_what_they_hold(spark, tmp_path):
    """Written by one task, as by many, with null ids too; a changed index is noticed."""
    rows = ROWS + [(None, "no id", "en", "a")]
    path = str(tmp_path / "one")
    blocks.coded(documents(spark, rows), WORDS, block_ids=300).coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    got = sorted(blocks.decoded(table).collect(), key=lambda r: r.start)
    truth = sorted(ids_by_hand(WORDS, 1, rows), key=lambda r: -1 if r[0] is None else r[0])
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(x), zlib.crc32(x.tobytes())) for i, x in truth]
    assert [r.start for r in got] == np.cumsum([0, *[len(x) for _, x in truth]])[:-1].tolist()
    longer = F.transform("lengths", lambda n, k: F.when(k == 0, n + 1).otherwise(n))
    for changed in (table.withColumn("lengths", longer), table.withColumn("doc_ids", F.transform("doc_ids", lambda i: i + 1)), table.withColumn("n_ids", F.col("n_ids") + 1)):
        with pytest.raises(Exception, match="damaged block index"):
            blocks.decoded(changed).collect()


def test_block_files_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    blocks.coded(empty(spark), WORDS).write.parquet(path)
    assert blocks.decoded(spark.read.parquet(path)).count() == 0


# 6


def page(k, host_text, body):
    return f'<!DOCTYPE html><html><head><title>t{k}</title><script>var t="</p>";</script></head><body><nav><ul><li>Home<li>{host_text}</ul></nav><div class="ad">buy {k}</div><article><h1>Head {k}</h1>{body}</article><aside>more {k}</aside><footer>&copy; {host_text}</footer>'


def test_main_text(spark):
    rows = [(k, f"http://h{k % 3}.org/{k}?x", page(k, f"host{k % 3}", f"<p><b>Some &amp; text {k}.<br><p>two\n  lines é{k}<form><p>name</form><div class=comments><p>nice</div><p>end")) for k in range(12)]
    rows += [(20, "http://alone.net/", page(20, "x", "<p>only page")), (21, None, None), (22, "not a url", ""), (23, "http://h0.org/", "plain text &lt; more"), (24, "http://h0.org/", "<div>" * 3000 + "deep"), (0, "http://h0.org/0?x", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("old")).withColumn("_slot", F.lit("clash"))
    got = pages.extract(df)
    assert sorted(got.columns) == sorted(df.columns) and got.count() == len(rows)
    text = {r.page_id: r.text for r in got.collect()}
    for k in range(12):
        assert text[k] == f"Head {k}\nSome & text {k}.\ntwo lines é{k}\nend"
    assert (text[20], text[21], text[22], text[23], text[24]) == ("Head 20\nonly page", "", "", "plain text < more", "deep")
    slots = pages.wrappers(df).collect()
    assert {r.slot for r in slots if r.host in ("h0.org", "h1.org", "h2.org")} == {"html/body/article"}
    assert pages.extract(df.limit(0)).count() == 0


def test_wrapper_finds_unnamed_content(spark):
    """Neither article nor main: the slot is where pages differ most."""
    body = "<html><body><div class=top>Site name and a long constant slogan that never changes at all</div><div class=mid>{}</div><div class=low>All rights reserved by the constant company</div></body></html>"
    rows = [(k, "http://w.org/", body.format(f"<p>Story {k} begins</p><p>{prose(k, 30)}</p>")) for k in range(8)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Story {k} begins\n{prose(k, 30)}" for k in range(8)}


LAYOUT = "<html><body><div class=top><p>Site of {host}</p><p>A slogan that stays the same</p></div><div class=mid><p>Published by the staff of {host}</p>{body}<p>Thank you for reading, come back soon</p></div><div class=low><p>All rights reserved</p></div></body></html>"


def wrapped_rows():
    """30 pages of three hosts without an article element; the content container holds two paragraphs that are equal on all pages of a host, before and after those that vary."""
    rows, truth = [], {}
    for k in range(30):
        host = f"h{k % 3}.org"
        own = [f"Story {k} begins", prose(k, 25 + k), *[prose(100 * k + j, 12) for j in range(k % 4)]]
        if k % 5 == 0:
            own.append("Shared by a few pages alone")
        rows.append((k, f"https://{host}/{k}", LAYOUT.format(host=host, body="".join(f"<p>{x}</p>" for x in own))))
        truth[k] = own
    return rows, truth


def template_by_hand(rows):
    """Texts at one path on nearly all pages of a host, counted page by page."""
    seen = collections.defaultdict(collections.Counter)
    pages_of = collections.Counter()
    for _, url, html in rows:
        host, (_, found) = url.split("/")[2], pages.parse(html)
        pages_of[host] += 1
        seen[host].update({(pages._path(n), t) for n, t in found})
    return {h: {x for x, n in c.items() if n >= 0.8 * pages_of[h]} for h, c in seen.items()}


def test_wrapper_against_brute_force(spark):
    rows, truth = wrapped_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.host: r for r in pages.wrappers(df, aligned=7).collect() if r.host}
    by_hand = template_by_hand(rows)
    for host, r in found.items():
        assert r.slot == "html/body/div.mid"
        keys = {pages.text_key(path, zlib.crc32(t.encode())) for path, t in by_hand[host]}
        assert set(np.frombuffer(r.template, "<i8").tolist()) == keys
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert got == {k: "\n".join(own) for k, own in truth.items()}
    assert all(got[k] != pages.main_text(html, []) for k, _, html in rows)  # the wrapper decides


def test_pages_that_a_host_repeats_keep_their_text(spark):
    """Copies of one article, told apart by an advert alone."""
    rows = [(k, f"http://c.org/{k}", f"<body><div class=ad>Offer number {k} of today</div><article><h1>One</h1><p>{prose(3, 40)}</p></article></body>") for k in range(9)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"One\n{prose(3, 40)}"}


def noisy_article_rows():
    """30 pages of three hosts whose articles hold readers' comments, teasers and a notice under names that say nothing."""
    rows, truth = [], {}
    for k in range(30):
        host = f"n{k % 3}.org"
        own = [f"Story {k} begins", *[prose(50 * k + j, 30 + j) for j in range(3)], f"See also the earlier one, number {k}"]
        parts = [f"<h1>{own[0]}</h1>", *[f"<p>{t}</p>" for t in own[1:4]], f"<p>See also <a href=x>the earlier one</a>, number {k}</p>"]
        voices = "".join(f"<div class=voice><b>Reader {j}</b><span>says</span><p>{prose(1000 * k + j, 5)}</p><div class=when>day {j + k}</div></div>" for j in range(2 + k % 3))
        teasers = "".join(f"<p><a href=x>{prose(7000 + 10 * k + j, 4)}</a></p>" for j in range(3))
        body = "".join(parts) + f"<div class=zone>{voices}</div><div class=more-of-it>{teasers}</div><p>This site keeps small files on your machine</p>"
        rows.append((k, f"http://{host}/{k}", f"<html><body><div class=top>{host}</div><article>{body}</article></body></html>"))
        truth[k] = "\n".join(own)
    return rows, truth


def test_side_parts_of_articles(spark):
    """The wrapper leaves out lists of records, link lists and constant texts inside the articles; the same by hand."""
    rows, truth = noisy_article_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(df, aligned=6).collect()}
    assert got == truth
    assert all(pages.main_text(html, []) != truth[k] for k, _, html in rows)
    # by hand: at which paths records stand, and where text is mostly links
    for r in pages.wrappers(df, aligned=6).where("host is not null").collect():
        keys = set(np.frombuffer(r.template, "<i8").tolist())
        sides = {path for path in ("html/body/article/div.zone", "html/body/article/div.zone/div.voice", "html/body/article/div.it.more.of", "html/body/article") if pages.text_key(path, pages.SIDE) in keys}
        assert sides == {"html/body/article/div.zone/div.voice", "html/body/article/div.it.more.of"}


def test_sections_of_an_article_stay(spark):
    """Repeated sections without a class, definition lists, tables and lists are content."""
    body = "<article><h1>T {k}</h1>" + "".join(f"<section><h2>Part {j}</h2><p>{prose(j, 12)} {{k}}</p></section>" for j in range(4)) + "<table><tr class=r><td>a {k}<td>b</table><ul><li>one {k}<li>two</ul></article>"
    rows = [(k, f"http://s.org/{k}", body.format(k=k)) for k in range(12)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, text in got.items():
        assert all(f"{prose(j, 12)} {k}" in text for j in range(4)) and f"a {k}" in text and f"one {k}" in text


def best_matching(a, b):
    """Simple tree matching by the textbook table."""
    if a[0] != b[0]:
        return 0
    table = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
    for i, x in enumerate(a[2], 1):
        for j, y in enumerate(b[2], 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + best_matching(x, y))
    return 1 + table[-1][-1]


def test_tree_matching():
    a = ["r", [], [["a", [1, 1], []], ["b", [2, 1], [["c", [3, 1], []]]], ["d", [4, 1], []]]]
    b = ["r", [], [["b", [2, 1], [["x", [9, 1], []], ["c", [3, 1], []]]], ["d", [5, 1], []], ["a", [1, 1], []]]]
    size, pairs = pages.match(a, b)
    assert size == 4 and [x[0] for x, _ in pairs] == ["r", "b", "c", "d"]
    assert pages.match(a, ["q", [], []]) == (0, [])
    rng = random.Random(9)

    def tree(depth):
        labels = rng.sample("abcdefgh", rng.randrange(0, 7)) if depth else []
        return ["n", [], [[x, [], tree(depth - 1)[2]] for x in labels]]

    for _ in range(300):
        a, b = tree(3), tree(3)
        size, pairs = pages.match(a, b)
        assert size == best_matching(a, b) == len(pairs) and all(x[0] == y[0] for x, y in pairs)


def test_pages_of_many_siblings():
    many = "".join(f"<p>text {k}</p><div>other {k}</div>" for k in range(20000))
    one, two = (pages.skeleton(pages.parse(f"<body>{x}{many}</body>")[0]) for x in ("<p>a</p>", "<p>b</p>"))
    began = time.time()
    assert pages.match(one, two)[0] == 4
    wide = [["r", [], [[f"k{j * step % 3001}", [], []] for j in range(3001)]] for step in (1, 7)]
    assert pages.match(*wide)[0] > 1 and time.time() - began < 0.2


@pytest.mark.parametrize(
    "html, text",
    [
        ("<button-group>x</button-group><p>rest", "x\nrest"),
        ("<title-bar>a</title-bar><svg-icon></svg-icon><p>rest", "a\nrest"),
        ("<object data=x><p>fallback</p></object><p>x <math><mi>y</mi></math> z", "fallback\nx y z"),
        ("<p>a <svg><title>t</title><text>no</text></svg>b <button>no<div>in</div></button>c<p>d", "a b c\nd"),
        ("<div><button>no</div><p>yes</p><button>no</button>", "yes"),
        ("<svg>no<p>yes</p></svg>", "yes"),
        ('<div class="content no-sidebar"><article><p>body of it</p></article></div>', "body of it"),
        ("<title-bar>x</title-bar><article><p>y</p></article>", "y"),
        ('<article><div class="post-header"><h1>Title</h1></div><p>text</p></article>', "Title\ntext"),
        ('<article><p class="search-and-rescue">found</p><p data-id="share-3" data-role=nav>kept</p><p class="lead share">no</p></article>', "found\nkept"),
        ("<article><header><div><h1>Title</h1></div></header><p>text</p><section class=related-work>work</section></article>", "Title\ntext\nwork"),
        ("<article>" + "<div>" * 300 + "<p>yes</p><p class=ad>no</p><nav>no</nav>end" + "</div>" * 300 + "</article>", "yes\nend"),
        ("<p>shown<script>var a = 1", "shown"),
        ("<p>a<!-- x --!>b</p><!--> c <!---> d", "ab\nc d"),
        ("<article><header><h2>Title</h2></header><p class=alert>mind the gap</p><p>text of it</p></article>", "Title\nmind the gap\ntext of it"),
        ('<article><p>a long enough text of the article</p><div class="user-comments">nice</div><div class="reader-comments">x</div><div id=commentBody>y</div><div class="ad-slot">buy</div><div class="advert-box">b</div><div class=site-notice>n</div></article>', "a long enough text of the article"),
        ('<article class="comment-style"><p>all of the text</p></article>', "all of the text"),
        ('<article><p>text of it</p><section class=related><p>Related work is discussed here at length</p></section><section class=related><a href=x>other story</a></section></article>', "text of it\nRelated work is discussed here at length"),
        ("<div class=ad>" + "<div>" * 300 + "no" + "</div>" * 300 + "still no</div><p>after", "after"),
        ("<div class=ad>" + "<div>" * 250 + "<ul><li>no<li>no</ul>" + "</div>" * 250 + "still no</div><p>after", "after"),
    ],
)
def test_pages_are_read_to_the_end(html, text):
    assert pages.main_text(html, []) == text
