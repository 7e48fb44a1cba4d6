"""Secret scans by a trigram inverted index, in DataFrame operations only.

A Boolean query over trigrams is derived from each rule's regular expression:
strings that every match must contain give conjunctions of their trigrams,
alternatives give disjunctions. The trigrams that occur in the queries are
indexed by the lower-cased texts that contain them: a row of the index is a
trigram, a block of documents and the sorted keys of those in the block that have
it, so a trigram that a third of all documents contain is many rows of bounded
size. Per block the lists of a rule's trigrams are intersected and united as its
query says; what is left are its candidates, which alone are verified with the
rule's pattern. Rules without mandatory trigrams (a bare hex run) are verified in
every document. Only keys are shuffled: texts stay where they are, and candidates
come to them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import spans as S
from graphloom.llm.frames import small, tables, written

try:
    from re import _constants as _ops
    from re import _parser as _parser
except ImportError:  # before Python 3.11
    import sre_constants as _ops
    import sre_parse as _parser

_MOST_STRINGS = 64
BLOCK_KEYS = 8192  # documents of a block of the index


@dataclass(frozen=True)
class Rule:
    """``pattern`` is read alike by Python and Java; ``group_length`` is the least length of group 1, ``length`` of the match."""

    name: str
    pattern: str
    length: int = 0
    group_length: int = 0


#: The base rules.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group_length=8),
    Rule("access", r"AKIA[A-Z0-9]+", length=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Public formats of well-known tokens.
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is True (anything), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if True in parts:
        return True
    needs = [set(p[1]) if p[0] == "and" else {p} for p in parts]
    parts = [p for p, n in zip(parts, needs) if not any(m < n for m in needs)]  # "a, or a and b" is "a"
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    return _any([_all([s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str) -> Query:
    """What the lower-cased trigrams of any text with a match must satisfy."""
    strings, query = _sequence(_parser.parse(pattern))
    return _all([query, _of_strings(strings)])


def _sequence(nodes) -> tuple[set[str], Query]:
    """(strings of which one ends what was read so far, what is required besides)."""
    current, needed = {""}, []
    for op, value in nodes:
        strings, query = _node(op, value)
        needed.append(query)
        if strings is not None and len(current) * len(strings) <= _MOST_STRINGS:
            current = {a + b for a, b in product(current, strings)}
        else:
            needed.append(_of_strings(current))
            current = strings if strings is not None and len(strings) <= _MOST_STRINGS else {""}
    return current, _all(needed)


def _node(op, value) -> tuple[set[str] | None, Query]:
    """(all strings that the node matches, lower-cased, or None if they are too many; what it requires)."""
    if op is _ops.LITERAL:
        return {chr(value).lower()}, True
    if op is _ops.IN and all(o is _ops.LITERAL for o, _ in value) and len(value) <= 16:
        return {chr(v).lower() for _, v in value}, True
    if op is _ops.SUBPATTERN:
        return _closed(_sequence(value[-1]), value[-1])
    if op is _ops.BRANCH:
        parts = [_closed(_sequence(p), p) for p in value[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), _any([q for _, q in parts])
        return None, _any([_all([q, _of_strings(s) if s is not None else True]) for s, q in parts])
    if op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT) or op is getattr(_ops, "POSSESSIVE_REPEAT", None):
        low, high, body = value
        strings, query = _closed(_sequence(body), body)
        if (low, high) == (0, 1) and strings is not None and query is True:
            return strings | {""}, True
        if low >= 1:
            return None, _all([query, _of_strings(strings) if strings is not None else True])
        return None, True
    if op is _ops.AT:
        return {""}, True
    return None, True


def _exact(nodes) -> bool:
    """Whether the strings that ``_sequence`` gives are all there is."""
    for op, value in nodes:
        strings, _ = _node(op, value)
        if strings is None:
            return False
    return True


def _closed(found: tuple[set[str], Query], nodes) -> tuple[set[str] | None, Query]:
    strings, query = found
    if _exact(nodes) and query is True:
        return strings, True
    return None, _all([query, _of_strings(strings)])


def trigrams(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*(trigrams(p) for p in query[1]))


def inverted_index(keyed: DataFrame, key: str, text: str, wanted: list[str], block_keys: int = BLOCK_KEYS) -> DataFrame:
    """(trigram, block, keys): the posting lists of ``wanted``, written to the shared folder. ``key`` is a long; rows that share one are one document."""
    blocks = max(1, -(-keyed.count() // block_keys))
    lowered = keyed.select(key, F.lower(text).alias("_low"))
    held = F.filter(F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(F.col("_low"), t))
    postings = lowered.select(F.explode(held).alias("trigram"), F.col(key).alias("_k"))
    lists = postings.groupBy("trigram", F.pmod("_k", F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_set("_k")).alias("keys"))
    return written(lists.sortWithinPartitions("trigram", "block"), "index")


def _listed(query: Query, lists: Column) -> Column:
    """The keys of a block that satisfy a query, from its posting lists by trigram."""
    if isinstance(query, str):
        return F.coalesce(F.element_at(lists, query), F.array().cast("array<long>"))
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, [_listed(p, lists) for p in query[1]])


def candidates(index: DataFrame, key: str, rules: dict[str, Query]) -> DataFrame:
    """(key, _rules): which rules may match a document, none of them a rule without trigrams."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    passed = F.array(*[F.struct(F.lit(name).alias("rule"), _listed(q, F.col("lists")).alias("keys")) for name, q in rules.items()])
    pairs = blocks.select(F.explode(passed).alias("p")).select("p.rule", F.explode("p.keys").alias(key))
    return pairs.groupBy(key).agg(F.collect_set("rule").alias("_rules"))


def find_secrets(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``documents`` with ``spans`` (start, rank, end, kind, match), one for each match that passes its rule's lengths.

    Matches are leftmost and non-overlapping per rule; spans of different rules may overlap. Null texts count as empty
    and have none. All columns stay; one named ``spans`` is replaced. Rows that repeat are scanned each.
    """
    queries = {r.name: trigram_query(r.pattern) for r in rules}
    indexed = {n: q for n, q in queries.items() if q is not True}
    wanted = sorted(set().union(*(trigrams(q) for q in indexed.values()))) if indexed else []
    body = S.safe(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    packed = documents.select(F.struct("*").alias("_row"), body.alias("_body"))
    # a key from every plain column: copies of a text have keys of their own, rows alike throughout share one
    plain = [F.col(f"_row.`{c}`") for c, kind in documents.dtypes if c != text and not re.match("array|map|struct|variant|void", kind)]
    keyed = packed.withColumn("_key", F.xxhash64(F.lit(7), "_body", *plain))
    rows = keyed
    if wanted:
        found = candidates(inverted_index(keyed, "_key", "_body", wanted), "_key", indexed)
        rows = keyed.join(small(written(found, "candidates")), "_key", "left")
    else:
        rows = keyed.withColumn("_rules", F.array().cast("array<string>"))
    parts = []
    for rank, rule in enumerate(rules):
        due = F.lit(True) if queries[rule.name] is True else F.coalesce(F.array_contains("_rules", rule.name), F.lit(False))

        def keep(match: Column, rule: Rule = rule) -> Column:
            long = F.length(match) >= rule.length
            return long & (F.length(F.regexp_extract(match, rule.pattern, 1)) >= rule.group_length) if rule.group_length else long

        parts.append(S.find(F.col("_body"), rule.pattern, rule.name, rank, due, keep))
    out = rows.withColumn("_spans", F.array_sort(F.concat(*parts)))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in documents.columns if c != "spans"], F.col("_spans").alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the secrets of every document."""
    base = [r.name for r in BASE_RULES]
    found = find_secrets(tables(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    kept = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select(
        "doc_id",
        *[S.count(F.col("spans"), k).alias(f"n_{k}") for k in base],
        F.sha2(S.joined(kept), 256).alias("base_sha256"),
        S.joined(F.col("spans")).alias("spans"),
    )
