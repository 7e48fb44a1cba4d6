"""Main text of web pages by wrapper induction.

1. Each page becomes a tree of its block elements; siblings of one label are one
   repeated node that holds the texts of all. Only this skeleton (labels, hashes and
   lengths of the texts) is shuffled, by host; hosts with many pages are dealt into
   groups by hash.
2. Within a group the trees are aligned in small batches by simple tree matching.
   Texts that aligned nodes have in common are constant, the template's; other texts,
   and those of nodes in one tree alone, are varying slots.
3. Per host and node path the constant and varying texts are summed in Spark. The
   deepest container, a single element on most pages, that holds most of the varying
   text is the host's content slot. Texts that are constant at one path on nearly all pages of a host of some
   pages are its template, inside the slot too. So are sub-trees of the slot that
   vary but are no article: lists of records, that is elements of one class with the
   same fields on page after page (readers' comments, teasers), and containers whose
   text is mostly links. Hosts without two different pages take the slot of most
   hosts.
4. Each page is read again; its text is that of the slot without the template's. A
   page of which that would leave less than half is one that its host repeats, and
   keeps all. What else is no content (menus, forms, adverts, readers' comments) goes
   by its element or by a class, id or role: one that names it as a whole, or a part
   of a name (``user-comments``) for what holds less than half of the slot's text.
"""

from __future__ import annotations

import html as _html
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.frames import shuffle_width, small, tables, written
from graphloom.llm.words import batches

GROUP_PAGES, ALIGNED = 500, 24
SLOT_SHARE = 0.6
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.8, 8  # a text is template if on that share of a host's pages, that many at least
KEPT_SHARE = 0.5
RECORDS, LINKED, SIDE_SHARE = 0.5, 0.6, 0.5  # share of pages with records, of text in links; of the slot's text at most
DEEPEST = 200  # texts of elements below this depth belong to the one at it

# Elements by what they do.
_BLOCKS = set("html head body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|textarea|title|iframe"  # without an end tag they run to the end of the page
_MUTE = set("button select svg template noscript annotation annotation-xml".split())  # without an end tag they are no elements
_CONTAINERS = set("body div article main section center td form".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_RECORD_TAGS = set("div section article aside li".split())
_NOISE_TAGS = set("head nav header footer aside form menu dialog".split())
#: Whole names in class, id or role.
_NOISE_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer site-footer site-header masthead comment comments comment-list comments-area disqus disqus_thread cookie cookies cookie-notice cookie-banner consent notice notices alert popup modal newsletter subscribe share sharing social social-share share-buttons related related-posts recommended toolbar pagination pager skip login search searchbox contentinfo complementary".split())
#: Of these, what marks a container alone, and what does so if its text is mostly links.
_CONTAINER_WORDS = set("alert banner related related-posts recommended search login skip".split())
_LINK_WORDS = set("related related-posts recommended".split())
_TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figure figcaption".split())
#: Parts of names, between hyphens, underscores and changes of case.
_NOISE_PARTS = set("ad ads advert adverts advertisement advertising sponsor sponsored comment comments disqus cookie cookies notice notices newsletter".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({_RAW})(?=[\s/>])[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?][^>]*>", re.S | re.I
)
_ROLE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CLASS = re.compile(r"""(?<![\w-])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "label", "noise", "side", "parent", "depth", "kids", "texts", "links")

    def __init__(self, tag: str, label: str, role: str, parent: Node | None):
        self.tag, self.label, self.parent = tag, label, parent
        self.noise, self.side, self.links = role == "noise", role if role != "noise" else "", 0  # characters in links
        self.depth: int = parent.depth + 1 if parent is not None else 0
        self.kids: list[Node] = []
        self.texts: list[str] = []


def _noisy(tag: str, attributes: str) -> str:
    """"noise" by element or name; "links" or "part" if it is noise for its links or beside a larger part of the slot; or ''."""
    if tag in _NOISE_TAGS:
        return "noise"
    if not attributes:
        return ""
    named = " ".join("".join(m) for m in _ROLE.findall(attributes))
    found = {w for w in named.lower().split() if w in _NOISE_WORDS}
    if tag in _TEXT_TAGS:
        found -= _CONTAINER_WORDS
    if found:
        return "links" if found <= _LINK_WORDS else "noise"
    return "part" if named and any(p.lower() in _NOISE_PARTS for p in _PART.findall(named)) else ""


def _label(tag: str, attributes: str) -> str:
    found = _CLASS.search(attributes) if attributes else None
    words = sorted(set(_WORD.findall((found[1] or found[2] or found[3] or "").lower()))) if found else []
    return ".".join([tag, *words])


def parse(html: str) -> tuple[Node, list[tuple[Node, str]]]:
    """(root, blocks in page order as (innermost node, text)). Inline elements count as text unless they have a role of their own."""
    root = Node("html", "html", "", None)
    node, blocks, buffer, at = root, [], [], 0
    inline: list[tuple[str, Node]] = []
    deep: list[tuple[str, str]] = []  # open elements below DEEPEST, their role, and how many there are of each
    held: Counter[str] = Counter()
    muted: list[str] = []  # open elements whose text isn't read, and the blocks in the outermost
    inner: Counter[str] = Counter()
    ends: dict[str, int] = {}  # the last end tag of each
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = _WHITE.sub(" ", _html.unescape("".join(buffer))).strip()
            if text and not any(role == "noise" for _, role in deep):
                blocks.append((node, text))
                node.texts.append(text)
                node.links += min(linked, len(text))
            buffer.clear()
        linked = 0

    def leave(tags: set[str], within: set[str]) -> None:
        """Close the nearest open element of ``tags``, not looking beyond ``within``."""
        nonlocal node
        if any(held[t] for t in tags) or any(held[t] for t in within):
            for k in reversed(range(len(deep))):
                if deep[k][0] in tags:
                    held.subtract(t for t, _ in deep[k:])
                    del deep[k:]
                    return
                if deep[k][0] in within:
                    return
        seek = node
        while seek.parent is not None and seek.tag not in tags:
            if seek.tag in within:
                return
            seek = seek.parent
        if seek.parent is not None:
            node = seek.parent
            deep.clear()
            held.clear()

    def unmuted(tag: str, closes: bool, empty: bool) -> bool:
        """Follow a tag within a muted element; whether it ended that, being a block that can't lie in it."""
        if tag in _MUTE:
            if not closes and not empty:
                muted.append(tag)
            elif closes and tag in muted:
                while muted.pop() != tag:
                    pass
        elif tag in _BLOCKS and not closes:
            if muted[0] not in ("svg", "select") or inner["foreignobject"] > 0:
                inner[tag] += tag != "hr"
                return False
            muted.clear()
        elif tag in _BLOCKS and inner[tag] <= 0 and tag not in ("p", "html", "body"):
            muted.clear()
        elif tag in _BLOCKS or tag == "foreignobject":
            inner[tag] += -1 if closes else 1
        return tag in _BLOCKS and not muted

    for m in _TOKEN.finditer(html):
        if m.start() > at and not muted:
            buffer.append(html[at : m.start()])
            if in_link:
                linked += len(_WHITE.sub(" ", buffer[-1]).strip())
        at = m.end()
        tag = (m[3] or "").lower()
        if m[1] or not tag:
            if m[1]:
                buffer.append(" ")
            continue
        if muted and not unmuted(tag, bool(m[2]), m[4].rstrip().endswith("/")):
            continue
        if tag == "a":
            in_link = not m[2]
        if tag in _MUTE:
            buffer.append(" ")
            if tag not in ends:
                ends[tag] = max((e.start() for e in re.finditer(rf"</{tag}\s*>", html, re.I)), default=-1)
            if not m[2] and not m[4].rstrip().endswith("/") and ends[tag] >= at:
                muted.append(tag)
                inner.clear()
            continue
        if tag in _VOID and tag != "hr":
            if tag == "br":
                buffer.append(" ")
            continue
        if m[2]:
            if tag in _BLOCKS:
                flush()
                if tag not in ("html", "body"):
                    leave({tag}, {"body"})
            elif inline and any(t == tag and n is node for t, n in inline):
                flush()
                node = node.parent
                inline = [(t, n) for t, n in inline if n is not node]
            continue
        attributes = m[4]
        if tag in _BLOCKS:
            flush()
            if tag == "html":
                continue
            if tag == "body":
                node = root
            elif tag != "head":
                if tag in _CLOSES:
                    leave(*_CLOSES[tag])
                leave({"p"}, _CONTAINERS | {"table", "td", "th", "li", "blockquote"})
            if tag == "hr":
                continue
            if node.depth >= DEEPEST:
                deep.append((tag, _noisy(tag, attributes)))
                held[tag] += 1
                continue
            node.kids.append(kid := Node(tag, _label(tag, attributes), _noisy(tag, attributes), node))
            node = kid
        elif attributes and node.depth < DEEPEST and _noisy(tag, attributes) == "noise" and not attributes.rstrip().endswith("/"):
            flush()
            node.kids.append(kid := Node(tag, _label(tag, attributes), "noise", node))
            node = kid
            inline.append((tag, kid))
    if at < len(html) and not muted:
        buffer.append(html[at:])
    flush()
    return root, blocks


def skeleton(node: Node) -> list:
    """[label, own texts as hash, length, hash, length ..., kids, characters in links, records, siblings]; siblings with one label
    are one node with the texts of all. Records are siblings of one class with the same two fields at least."""
    return _merged([node])


def _merged(nodes: list[Node]) -> list:
    texts, kids = [], defaultdict(list)
    for node in nodes:
        for text in node.texts:
            texts += [crc32(text.encode("utf-8", "replace")), len(text)]
        for kid in node.kids:
            kids[kid.label].append(kid)
    return [nodes[0].label, texts, [_merged(k) for k in kids.values()], sum(n.links for n in nodes), _records(nodes), len(nodes)]


def _records(nodes: list[Node]) -> int:
    """How many siblings are records, by the fields that most of them have; 0 if fewer than two."""
    if len(nodes) < 2 or nodes[0].tag not in _RECORD_TAGS or "." not in nodes[0].label:
        return 0
    fields = Counter(tuple(sorted({k.label for k in n.kids if k.texts or k.kids})) for n in nodes)
    shape, n = fields.most_common(1)[0]
    return n if len(shape) >= 2 and n >= 2 and n >= 0.8 * len(nodes) else 0


def match(a: list, b: list) -> tuple[int, list[tuple[list, list]]]:
    """Simple tree matching of two skeletons: (size of the largest order-keeping matching, its pairs).

    Labels are different among siblings, so each kid has one counterpart at most, and the best matching of the kids is an
    increasing sequence of places with most weight: found in about as many steps as there are kids.
    """
    if a[0] != b[0]:
        return 0, []
    place = {kid[0]: k for k, kid in enumerate(b[2])}
    ends: list[int] = []  # places at which a chain ends, ascending, with ascending weights
    chains: list[tuple[int, tuple | None]] = []  # (weight, (pairs of the last kid, chain before))
    for kid in a[2]:
        k = place.get(kid[0])
        if k is None:
            continue
        size, pairs = match(kid, b[2][k])
        at = bisect_left(ends, k)
        before = chains[at - 1] if at else (0, None)
        chain = (before[0] + size, (pairs, before))
        stop = at
        while stop < len(ends) and chains[stop][0] <= chain[0]:  # later ends that weigh no more are of no use
            stop += 1
        ends[at:stop], chains[at:stop] = [k], [chain]
    found, best = [(a, b)], chains[-1] if chains else (0, None)
    size, link = 1 + best[0], best[1]
    kids = []
    while link is not None:
        kids.append(link[0])
        link = link[1][1]
    for pairs in reversed(kids):
        found += pairs
    return size, found


SIDE = -1  # in place of a text's hash: the path itself


def text_key(path: str, text_hash: int) -> int:
    """A text at a path, as 64 bits."""
    return xxhash.xxh64_intdigest(f"{path} {text_hash}") - (1 << 63)


def _vote(page: list, reference: list, sums: dict, constant: Counter) -> None:
    """Add a page's varying text, all text, text in links, records, whether it is one element, and itself by container, and the texts that it has in common with the reference."""
    common = {id(b): set(a[1][::2]) for a, b in match(reference, page)[1]}

    def walk(node: list, path: str, depth: int) -> tuple[int, int, int]:
        path = f"{path}/{node[0]}" if path else node[0]
        shared, varying, links = common.get(id(node), ()), 0, node[3]
        for text in dict.fromkeys(node[1][::2]):
            if text in shared:
                constant[path, text] += 1
        size = sum(node[1][1::2])
        for text, n in zip(node[1][::2], node[1][1::2]):
            varying += 0 if text in shared else n
        for kid in node[2]:
            own = walk(kid, path, depth + 1)
            varying, size, links = varying + own[0], size + own[1], links + own[2]
        if node[0].split(".", 1)[0] in _CONTAINERS or node[4]:
            held = sums.setdefault((path, depth), [0] * 6)
            for k, v in enumerate((varying, size, links, node[4] > 0, node[5] == 1, 1)):
                held[k] += v
        return varying, size, links

    walk(page, "", 0)


def _host(url: str | None) -> str:
    rest = (url or "").split("://", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def wrappers(pages: DataFrame, url: str = "url", html: str = "html", aligned: int = ALIGNED) -> DataFrame:
    """(host, slot, template): the path of the container that holds the content, and the ``text_key`` of each template
    text and of each path below the slot that is no content (``SIDE``), as packed 64-bit integers; the row with a null host
    has the slot of most hosts."""
    spark = pages.sparkSession
    source = pages.select(F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("t"))

    def reduce_pages(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "t"):
            trees = [json.dumps(skeleton(parse(t or "")[0])) for t in batch.column("t").to_pylist()]
            hosts = [_host(u) for u in batch.column("u").to_pylist()]
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "tree": pa.array(trees, pa.string())})

    trees = written(source.mapInArrow(reduce_pages, "host string, tree string"), "skeletons")
    counts = small(trees.groupBy("host").agg(F.count("*").alias("n")).where("n > 1"))
    salted = trees.join(counts, "host").withColumn("salt", F.pmod(F.xxhash64("tree"), F.ceil(F.col("n") / GROUP_PAGES)))
    dealt = salted.select("host", "salt", "tree").repartition(shuffle_width(spark), "host", "salt").sortWithinPartitions("host", "salt", "tree")
    counted = ("varying", "size", "links", "records", "alone", "seen")
    none = {"path": "string", "depth": "int", **dict.fromkeys(counted, "long"), "text": "long", "n": "long"}

    def align(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        key, copies = None, ""

        def emit() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            sums, constant = {}, Counter()
            for k, page in enumerate(held):
                _vote(page, held[0] if k else held[1], sums, constant)
            blank = (None,) * (1 + len(counted))
            rows = [(p, d, *v, None, None) for (p, d), v in sums.items()]
            rows += [(p, *blank, t, n) for (p, t), n in constant.items()] + [(None, *blank, None, len(held))]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.int32(), *[pa.int64()] * 8))]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rows), pa.string()), *columns], names=["host", *none])

        for batch in it:
            for host, salt, tree in zip(batch.column("host").to_pylist(), batch.column("salt").to_pylist(), batch.column("tree").to_pylist()):
                if (host, salt) != key or len(held) >= aligned:
                    yield from emit()
                    held, key = [], (host, salt)
                elif tree == copies:  # a copy has nothing to tell
                    continue
                copies = tree
                held.append(json.loads(tree))
        yield from emit()

    votes = written(dealt.mapInArrow(align, "host string, " + ", ".join(f"{c} {k}" for c, k in none.items())), "votes")
    summed = votes.where("depth is not null").groupBy("host", "path").agg(F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in counted])
    whole = summed.groupBy("host").agg(F.max("varying").alias("most"))
    slots = summed.join(whole, "host").where((F.col("most") > 0) & (F.col("varying") >= SLOT_SHARE * F.col("most")) & (2 * F.col("alone") >= F.col("seen")))
    slots = slots.groupBy("host").agg(F.max_by("path", F.struct("depth", "path")).alias("slot"))
    total = votes.where("path is null").groupBy("host").agg(F.sum("n").alias("pages"))
    texts = votes.where("text is not null").groupBy("host", "path", "text").agg(F.sum("n").alias("n"))
    # below the slot: a smaller part that is mostly links or, on many of the pages that have it, a list of records
    chosen = slots.join(summed.select("host", F.col("path").alias("slot"), F.col("size").alias("_whole")), ["host", "slot"])
    inner = summed.join(chosen, "host").join(total, "host").where(F.startswith("path", F.concat("slot", F.lit("/"))) & (F.col("size") < SIDE_SHARE * F.col("_whole")))
    side = (F.col("links") >= LINKED * F.col("size")) & (F.col("links") > 0) | (F.col("records") >= RECORDS * F.col("seen"))
    sides = inner.where(side & (F.col("seen") >= 2) & (F.col("seen") >= 0.1 * F.col("pages")) & (F.col("pages") >= TEMPLATE_PAGES)).select("host", "path", F.lit(SIDE).cast("long").alias("text"))
    often = texts.join(total, "host").where((F.col("n") >= TEMPLATE_SHARE * F.col("pages")) & (F.col("pages") >= TEMPLATE_PAGES))
    # no more than a page has texts, by 1 / TEMPLATE_SHARE
    listed = often.select("host", "path", "text").union(sides).groupBy("host").agg(F.to_json(F.collect_list(F.struct("path", "text"))).alias("texts"))

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys = [np.array(sorted(text_key(x["path"], x["text"]) for x in json.loads(t)), "<i8").tobytes() if t else b"" for t in batch.column("texts").to_pylist()]
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "slot": batch.column("slot"), "template": pa.array(keys, pa.binary())})

    own = written(slots.join(listed, "host", "full_outer").mapInArrow(pack, "host string, slot string, template binary"), "slots")
    common = own.where("slot is not null").groupBy("slot").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "slot").limit(1)
    return own.union(common.select(F.lit(None).cast("string").alias("host"), "slot", F.lit(b"").alias("template")))


def _path(node: Node) -> str:
    labels = []
    while node is not None:
        labels.append(node.label)
        node = node.parent
    return "/".join(reversed(labels))


def _aside(node: Node, whole: int) -> bool:
    """Whether a node of a region with ``whole`` characters has another role."""
    if node.noise:
        return not (node.tag == "header" and any(n.tag in _HEADINGS for n in _nodes(node)))
    if node.side == "links":
        return 2 * sum(n.links for n in _nodes(node)) >= _mass(node)
    return node.side == "part" and 2 * _mass(node) < whole


def _inside(node: Node | None, region: Node, whole: int, known: dict[int, bool]) -> bool:
    """Whether ``node`` lies in the region and in no part of it that has another role."""
    while node is not None and node is not region:
        if id(node) not in known:
            known[id(node)] = _aside(node, whole)
        if known[id(node)]:
            return False
        node = node.parent
    return node is region


def _nodes(root: Node) -> Iterator[Node]:
    yield root
    for kid in root.kids:
        yield from _nodes(kid)


def _mass(node: Node) -> int:
    return sum(map(len, node.texts)) + sum(_mass(k) for k in node.kids if not k.noise)


def _roleless(node: Node) -> bool:
    while node is not None:
        if node.noise:
            return False
        node = node.parent
    return True


def main_text(html: str, slots: list[str | None], template: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of the first of ``slots`` that the page has, else of its article or main element, else of its body, without ``template``."""
    root, blocks = parse(html)
    nodes = list(_nodes(root))
    regions: list[Node] = []
    for slot in slots:
        if slot:
            regions = [n for n in nodes if n.label == slot.rsplit("/", 1)[-1] and _path(n) == slot and (_roleless(n) or n.tag == "form")]
            if any(_mass(n) for n in regions):
                break
            regions = []
    for tag in ("article", "main", "body", "html"):
        regions = regions or [n for n in nodes if n.tag == tag and _roleless(n)]
    chosen, known = {id(n): _mass(n) for n in regions}, {}

    def within(node: Node) -> bool:
        region = node
        while region is not None and id(region) not in chosen:
            region = region.parent
        return region is not None and _inside(node, region, chosen[id(region)], known)

    def beside(node: Node) -> bool:
        """Whether the node or one above it is a path that the wrapper leaves out."""
        while node is not None:
            if id(node) not in sides:
                sides[id(node)] = text_key(_path(node), SIDE) in template
            if sides[id(node)]:
                return True
            node = node.parent
        return False

    sides: dict[int, bool] = {}

    inside: dict[int, bool] = {}
    texts = []
    for node, text in blocks:
        if id(node) not in inside:
            inside[id(node)] = within(node)
        if inside[id(node)]:
            texts.append((node, text))
    if template:
        paths = {id(n): _path(n) for n, _ in texts}
        own = [text for n, text in texts if not beside(n) and text_key(paths[id(n)], crc32(text.encode("utf-8", "replace"))) not in template]
        if sum(map(len, own)) >= KEPT_SHARE * sum(len(text) for _, text in texts):
            return "\n".join(own)
    return "\n".join(text for _, text in texts)


def extract(pages: DataFrame, url: str = "url", html: str = "html", aligned: int = ALIGNED) -> DataFrame:
    """``pages`` with ``text``: the main text, its blocks joined by line feeds; empty if there is none.

    Null html counts as empty, null urls as one host without a name. All columns stay; one named ``text`` is replaced.
    Repeated rows get the same text; an empty table gives no rows.
    """
    known = written(wrappers(pages, url, html, aligned), "wrappers")
    common = [r["slot"] for r in known.where("host is null").collect()]
    own = small(known.where("host is not null").select(F.col("host").alias("_host"), F.col("slot").alias("_slot"), F.col("template").alias("_template")))
    kept = [c for c in pages.columns if c != "text"]
    rows = pages.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(kept)], F.col(f"`{html}`").cast("string").alias("_html"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("_url"))
    host = F.lower(F.regexp_extract("_url", r"^(?:.*?://)?([^/?#]*)", 1))
    joined = rows.withColumn("_host", host).join(own, "_host", "left").drop("_host", "_url")
    from pyspark.sql.types import StringType, StructType

    hidden = ("_html", "_slot", "_template")
    schema = StructType([f for f in joined.schema.fields if f.name not in hidden]).add("_text", StringType())

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked: dict[bytes | None, frozenset[int]] = {None: frozenset()}
        for batch in batches(it, "_html"):
            found = []
            for t, slot, template in zip(*[batch.column(c).to_pylist() for c in hidden]):
                if template not in unpacked:
                    if len(unpacked) > 1000:
                        unpacked = {None: frozenset()}
                    unpacked[template] = frozenset(np.frombuffer(template, "<i8").tolist())
                found.append(main_text(t or "", [slot, *common], unpacked[template]))
            out = {c: batch.column(c) for c in batch.schema.names if c not in hidden}
            yield pa.RecordBatch.from_pydict(out | {"_text": pa.array(found, pa.string())})

    made = joined.mapInArrow(read, schema)
    return made.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(kept)], F.col("_text").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the main text of every page."""
    found = extract(tables(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
