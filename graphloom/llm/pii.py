"""Personal data by weak supervision, in DataFrame operations only.

Strict patterns (with checks such as Luhn's) give the base spans. What the strict
patterns match and the checks drop, and what looser patterns find (card numbers
that stand beside other digits, spelled-out addresses, addresses without a domain,
telephone numbers without a plus, long network addresses, names), are further
candidates. Regex, gazetteer and context labelers each vote yes (1), no (-1) or
nothing (0) on every candidate, base spans included. Only how often each
combination of votes and surroundings occurs goes to the driver: at most 3**6
votes by some hundred classes a kind, whatever the input. There, for each kind by
itself, expectation-maximisation (Dawid-Skene) estimates how reliable each
labeler is, and a logistic classifier is trained on the resulting soft labels. It
becomes an SQL expression that decides which candidates are spans. Base spans
stay whatever it says.

That a candidate passed the strict test is no labeler's vote: it only raises the
odds from which its estimate begins, so how reliable base spans are is an estimate
too. The two classes are even beforehand, and each counts for half in training,
however many candidates of either a table has; what a labeler is thought to do
before any votes are counted weighs in as well (``_prior``). So a candidate does
not change sides because a table is larger.

Candidates are found once: the table of them is written, learned from and read
again for the decisions.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import spans as S
from graphloom.llm.frames import tables, written

KINDS = ("email", "ip", "card", "phone", "name")
BASE_KINDS = KINDS[:4]
LABELERS = ("shape", "gazetteer", "context", "boundary", "variety", "company")
SIZES, EDGES, CUES = 4, 5, 5

# The base patterns. A match starts where a run of its first class starts, or where the match before
# ended; that is where the plain pattern's leftmost match starts, without trying every place within a run.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
# The looser patterns.
_CARD_RUN = r"(?<![0-9])[0-9]{12,19}(?![0-9])"
_CARD_GROUPS = r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"
_PLUS = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{2,4}[ .-][0-9]{3,4}(?![0-9-])"
_SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[{] ?(?:at|AT) ?[)\]}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[{] ?(?:dot|DOT) ?[)\]}]) ?[A-Za-z0-9-]{2,63}){1,4}"
_SPACED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ @ [A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{2,63}){0,4}"
_HOSTED = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?![A-Za-z0-9@]|\.[A-Za-z0-9-])"
_LONG_IP = r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
_LOCAL = r"(?<![0-9+.(/-])(?<![0-9][ /.-])\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{2,8}(?:[ .-][0-9]{2,8}){0,4}(?![0-9])"
_TITLED = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? \p{Lu}\p{L}{1,20}(?:[ -]\p{Lu}\p{L}{1,20}){0,2}"
_NAMED = r"(?<=(?:[Mm]y|[Ff]ull|[Yy]our) name is |[Nn]ame: |[Nn]amed )\p{Lu}\p{L}{1,20}(?: \p{Lu}\p{L}{1,20}){0,2}"
# Cue words and gazetteers.
_CUES = {
    "email": r"mail|contact|write|address|reach|send",
    "ip": r"\bip\b|ipv6|host|server|addr|login|client|\bfrom\b|ping",
    "card": r"card|visa|master|amex|pay|credit|debit|carte|karte|tarjeta",
    "phone": r"tel|phone|call|fax|mobile|cell|contact|dial|whatsapp|ruf|hotline",
    "name": r"dear|contact|attn|regards|name|\bby\b|\bfrom\b|signed",
}
_FOLLOWING = {
    "email": r"^[>)\]]",
    "ip": r"^(?::[0-9]{2,5}\b|/[0-9]{1,2}\b)",
    "card": r"^[ ,;(]{0,3}(?:exp|cvv|cvc|valid)",
    "phone": r"^[ ,;(]{0,3}(?:ext|x[0-9])",
    "name": r"^[ ,]{1,2}(?:said|wrote|is|was|born|ph)\b",
}
_AGAINST = r"(?:isbn|issn|order|version|release|\bver|\bv|page|pp|invoice|serial|section|chapter|model|part|item|total|score|no\.|nr\.?|#|[$€£])[ .:#]*$"
_COMPANY = r"@[a-z0-9-]+\.|\+[0-9]|[0-9]{3}[ .-][0-9]{3}"  # other personal data beside it
_KNOWN = {
    "email": r"(?i)[. )\]}](?:com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|us|eu|nl|ch|at|ca|au|jp|in|br|ru|pl|se|no|dk)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.|:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)",
    "phone": r"^(?:\+[1-9]|00[1-9]|\(?0[1-9]|\(?[2-9][0-9]{2}\)?[ .-][2-9])",
    "name": r"(?:^|[ .-])(?:"
    + "|".join(
        "John James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kevin Brian George Edward Peter Henry Jack Simon Oliver Harry "
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Emily Emma Laura Anna Julia Alice Helen Grace Olivia Sophie Claire Rachel "
        "Hans Karl Klaus Jürgen Wolfgang Stefan Andreas Markus Sabine Monika Ursula Petra Heike Jean Pierre Michel Philippe Jacques Luc Marie Isabelle Nathalie Camille Chloé "
        "José Antonio Manuel Francisco Juan Carlos Luis Miguel Javier Pedro María Carmen Ana Isabel Lucía Elena Maria Sofia Marco Giovanni Luca Giulia "
        "Smith Jones Brown Johnson Miller Davis Wilson Taylor Moore Anderson Jackson White Harris Martin Thompson Garcia Clark Lewis Walker Hall Young King Wright Green Baker "
        "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Bernard Dubois Durand Moreau Laurent Lefebvre Michel Roux Fournier "
        "García Fernández González Rodríguez López Lopez Martínez Sánchez Pérez Gómez Ruiz Díaz Torres Rossi Russo Ferrari Bianchi Romano".split()
    )
    + r")(?:$|[ .-])",
}
_DIGITS = "[^0-9]"

SPAN_FIELDS = ("start", "rank", "end", "kind", "match")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, _DIGITS, "")


def _card_passes(match: Column) -> Column:
    return (F.length(_digits(match)) <= 19) & F.call_function("luhn_check", _digits(match))


def _strict(text: Column) -> Column:
    """All matches of the base patterns in a safe text, with whether they pass their checks."""

    def checked(found: Column, passes) -> Column:
        return F.transform(found, lambda s: F.struct(*[s[c].alias(c) for c in (*SPAN_FIELDS, "before", "after")], passes(s["match"]).alias("base")))

    return F.concat(
        checked(S.find(text, _EMAIL, "email", 0, F.contains(text, F.lit("@")), context=True), lambda m: F.lit(True)),
        checked(S.find(text, _IP, "ip", 1, F.contains(text, F.lit(".")), context=True), lambda m: m.rlike(_IP_PARTS)),
        checked(S.find(text, _CARD, "card", 2, context=True), _card_passes),
        checked(S.find(text, _PHONE, "phone", 3, F.contains(text, F.lit("+")), context=True), lambda m: F.length(_digits(m)).between(9, 15)),
    )


def _loose(text: Column) -> Column:
    def any_of(*words: str) -> Column:
        return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])

    at = any_of("(at", "[at", "{at", "(AT", "[AT", "{AT", "( at", "[ at", "{ at")
    luhn = lambda m: F.call_function("luhn_check", _digits(m))
    found = F.concat(
        S.find(text, _CARD_RUN, "card", 2, keep=luhn, context=True),
        S.find(text, _CARD_GROUPS, "card", 2, keep=luhn, context=True),
        S.find(text, _SPELLED, "email", 0, at, context=True),
        S.find(text, _SPACED, "email", 0, any_of(" @ "), context=True),
        S.find(text, _HOSTED, "email", 0, any_of("@"), context=True),
        S.find(text, _LONG_IP, "ip", 1, any_of(":"), context=True),
        S.find(text, _PLUS, "phone", 3, any_of("+"), keep=lambda m: F.length(_digits(m)).between(9, 15), context=True),
        S.find(text, _LOCAL, "phone", 3, keep=lambda m: F.length(_digits(m)).between(7, 15), context=True),
        S.find(text, _TITLED, "name", 4, any_of("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr"), context=True),
        S.find(text, _NAMED, "name", 4, any_of(" name is ", "ame: ", "amed "), context=True),
    )
    return F.transform(found, lambda s: F.struct(*[s[c].alias(c) for c in (*SPAN_FIELDS, "before", "after")], F.lit(False).alias("base")))


def base_spans(text: Column) -> Column:
    """The strict spans of a non-null, safe text."""
    return F.transform(F.filter(_strict(text), lambda s: s["base"]), lambda s: F.struct(*[s[c].alias(c) for c in SPAN_FIELDS]))


def _clear(spans: Column, taken: Column) -> Column:
    """Those of ``spans`` that overlap none of ``taken``: by binary search in the taken spans of each kind, which ascend."""

    def free(s: Column, own: Column) -> Column:
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(26))])
        before = F.aggregate(steps, F.lit(0), lambda at, k: F.when((at + k <= F.size(own)) & (F.get(own, at + k - 1)["start"] < s["end"]), at + k).otherwise(at))
        return (before == 0) | (F.get(own, before - 1)["end"] <= s["start"])

    def of_kind(kind: str) -> Column:
        return F.filter(taken, lambda b: b["kind"] == kind)

    for kind in BASE_KINDS:
        own = of_kind(kind)
        spans = S.bound(F.struct(spans.alias("s"), own.alias("own")), lambda x: F.when((F.size(x["own"]) == 0) | (F.size(x["s"]) == 0), x["s"]).otherwise(F.filter(x["s"], lambda s: free(s, x["own"]))))
    return spans


def _by_kind(kind: Column, patterns: dict[str, str], value: Column) -> Column:
    out = F.lit(0)
    for name, pattern in patterns.items():
        out = F.when(kind == name, F.when(value.rlike(pattern), F.lit(1)).otherwise(F.lit(0))).otherwise(out)
    return out


def _votes(s: Column) -> Column:
    match, kind, before, after = s["match"], s["kind"], F.lower(s["before"]), F.lower(s["after"])
    digits = _digits(match)
    n = F.length(digits)
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    shape = (
        F.when(kind == "phone", F.when(n.between(9, 15), yes).when((n < 7) | (n > 15), no).otherwise(none))
        .when(kind == "card", F.when((n > 19) | ~F.call_function("luhn_check", digits), no).when(n.isin(13, 15, 16, 19), yes).otherwise(none))
        .when(kind == "ip", F.when(F.contains(match, F.lit(":")), yes).when(match.rlike(_IP_PARTS), F.when(match.rlike(r"(?:^|\.)0[0-9]"), none).otherwise(yes)).otherwise(no))
        .when(kind == "email", F.when(match.rlike(r"[. )\]}][A-Za-z]{2,12}$"), yes).when(match.rlike(r"[.) ][A-Za-z0-9-]*$"), none).otherwise(no))
        .otherwise(F.when(match.rlike(r"\p{L} \p{Lu}\p{L}+ \p{Lu}|^\p{Lu}\p{L}+ \p{Lu}"), yes).otherwise(none))
    )
    glued = F.substring(before, -1, 1).rlike(r"[\p{L}0-9_]") | after.rlike(r"^(?:[\p{L}0-9_]|[.,/-][0-9])") | (after.rlike(r"^ [0-9]") & ~((kind == "card") | F.startswith(match, F.lit("+"))))
    against = before.rlike(_AGAINST) | (kind.isin("phone", "card") & after.rlike(r"^ ?(?:€|\$|£|%|km|kg|pages|copies)"))
    cue = (_by_kind(kind, _CUES, before) == 1) | (_by_kind(kind, _FOLLOWING, after) == 1)
    distinct = F.size(F.array_distinct(F.split(F.when(kind.isin("phone", "card", "ip"), digits).otherwise(F.lower(match)), "")))
    few = F.when(kind.isin("phone", "card"), distinct <= 3).when(kind == "ip", distinct <= 1).otherwise(distinct <= 4)
    around = F.concat(before, F.lit("\n"), after)
    return F.array(
        shape,
        _by_kind(kind, _KNOWN, match),
        F.when(against, no).when(cue, yes).otherwise(none),
        F.when(glued, no).otherwise(yes),
        F.when(few, no).when(distinct >= 5, yes).otherwise(none),
        F.when(around.rlike(_COMPANY), yes).otherwise(none),
    )


def _cue(s: Column) -> Column:
    """Where cue words stand: nowhere, before, behind, on both sides, or such as speak against it."""
    kind, before, after = s["kind"], F.lower(s["before"]), F.lower(s["after"])
    places = _by_kind(kind, _CUES, before) + 2 * _by_kind(kind, _FOLLOWING, after)
    return F.when(before.rlike(_AGAINST), F.lit(4)).otherwise(places)


def _edge(c: Column) -> Column:
    """What stands beside a candidate: nothing, white space, a letter or digit, an opening or closing mark, other."""
    return F.when(c == "", F.lit(0)).when(c.rlike(r"\s"), F.lit(1)).when(c.rlike(r"[\p{L}0-9]"), F.lit(2)).when(c.rlike(r"[.,;:!?)\]}>]"), F.lit(3)).otherwise(F.lit(4))


def _size_class(match: Column) -> Column:
    n = F.length(match)
    return F.when(n < 10, F.lit(0)).when(n < 16, F.lit(1)).when(n < 25, F.lit(2)).otherwise(F.lit(3))


@dataclass(frozen=True)
class KindModel:
    """``reliability[labeler]``: P(vote is right | it votes), and of "base", P(base span is a span); the classifier's weights of votes for and against, length classes, the two edges and cue words."""

    reliability: dict[str, float]
    bias: float
    yes: tuple[float, ...]
    no: tuple[float, ...]
    sizes: tuple[float, ...]
    left: tuple[float, ...]
    right: tuple[float, ...]
    cues: tuple[float, ...]

    def score(self, votes, size: int, left: int, right: int, cue: int) -> float:
        return self.bias + sum(y if v > 0 else n if v < 0 else 0.0 for y, n, v in zip(self.yes, self.no, votes)) + self.sizes[size] + self.left[left] + self.right[right] + self.cues[cue]

    def column(self, s: Column) -> Column:
        weighed = [F.get(F.array(F.lit(n), F.lit(0.0), F.lit(y)), F.get(s["votes"], F.lit(j)) + 1) for j, (y, n) in enumerate(zip(self.yes, self.no))]
        classes = [F.get(F.array(*map(F.lit, weights)), s[c]) for weights, c in ((self.sizes, "size"), (self.left, "left"), (self.right, "right"), (self.cues, "cue"))]
        return reduce(Column.__add__, weighed + classes, F.lit(self.bias))


@dataclass(frozen=True)
class SpanModel:
    """One model a kind that had candidates; of other kinds nothing is accepted."""

    kinds: dict[str, KindModel]

    def accepts(self, s: Column) -> Column:
        out = F.lit(False)
        for kind, model in self.kinds.items():
            out = F.when(s["kind"] == kind, model.column(s) > 0).otherwise(out)
        return out


#: (votes, length class, left edge, right edge, cue words, whether base spans, how often)
Cell = tuple[tuple[int, ...], int, int, int, int, bool, int]
SEED_ODDS = 2.0  # of a base span beforehand, as a logarithm
#: How labelers are thought to vote before any are counted: P(-1, 0, 1) for spans and for others.
_USUAL = {1: (0.1, 0.3, 0.6), 0: (0.6, 0.3, 0.1)}
_CHECKSUM = {1: (0.0005, 0.2995, 0.7), 0: (0.85, 0.1, 0.05)}  # what fails Luhn's test or has a part over 255 is nearly never one
_WEAK = {1: (0.1, 0.55, 0.35), 0: (0.15, 0.65, 0.2)}


def _prior(kind: str, labeler: str) -> dict[int, tuple[float, ...]]:
    if labeler == "shape" and kind in ("card", "ip"):
        return _CHECKSUM
    return _WEAK if labeler in ("variety", "company") else _USUAL


def _estimate(kind: str, cells: list[Cell], rounds: int) -> tuple[np.ndarray, dict[str, float]]:
    """Dawid-Skene over one kind: (belief that each cell's candidates are spans, reliability of each labeler).

    The prior counts for 20 candidates of each class and a quarter of them, so that the classes cannot change places.
    """
    votes, count = np.array([c[0] for c in cells]) + 1, np.array([c[6] for c in cells], float)
    seed = np.where([c[5] for c in cells], SEED_ODDS, 0.0)
    priors = [_prior(kind, name) for name in LABELERS]
    tables = [{y: np.array(p[y]) for y in (1, 0)} for p in priors]
    belief = np.zeros(len(cells))
    for _ in range(rounds):
        odds = seed.copy()
        for j, table in enumerate(tables):
            odds += np.log(table[1][votes[:, j]] / table[0][votes[:, j]])
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved = np.abs(new - belief).max()
        belief = new
        if moved < 1e-6:
            break
        for j, prior in enumerate(priors):
            for y, mass in ((1, belief * count), (0, (1 - belief) * count)):
                found = np.bincount(votes[:, j], weights=mass, minlength=3) + (20 + mass.sum() / 4) * np.array(prior[y])
                tables[j][y] = found / found.sum()
    reliability = {}
    for j, name in enumerate(LABELERS):
        cast = votes[:, j] != 1
        right = np.where(votes[:, j] > 1, belief, 1 - belief)
        reliability[name] = float((right * count)[cast].sum() / count[cast].sum()) if cast.any() else 0.5
    own = seed > 0
    reliability["base"] = float((belief * count)[own].sum() / count[own].sum()) if own.any() else 0.5
    return belief, reliability


def _classifier(kind: str, cells: list[Cell], belief: np.ndarray, reliability: dict[str, float], steps: int) -> KindModel:
    """Logistic regression by steps on a bound of its curvature, which cannot overshoot; in it spans and others weigh the same; weights are drawn to the labelers' priors."""
    n, widths = len(LABELERS), (SIZES, EDGES, EDGES, CUES)
    votes = np.array([c[0] for c in cells])
    hot = np.concatenate([np.eye(w)[[c[k] for c in cells]] for k, w in enumerate(widths, 1)], axis=1)
    x = np.concatenate([np.ones((len(cells), 1)), votes > 0, votes < 0, hot], axis=1)
    priors = [_prior(kind, name) for name in LABELERS]
    start = np.zeros(x.shape[1])
    start[1 : 2 * n + 1] = [math.log(p[1][k] / p[0][k]) for k in (2, 0) for p in priors]
    penalty = np.array([1.0] + [0.05] * (2 * n) + [0.2] * hot.shape[1])
    count = np.array([c[6] for c in cells], float)
    yes, no = (part / max(part.sum(), 1.0) for part in (count * belief, count * (1 - belief)))
    w = start.copy()
    curve = (x * ((yes + no) / 4)[:, None]).T @ x + np.diag(penalty)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(curve, x.T @ (no * p - yes * (1 - p)) + penalty * (w - start))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    w = [round(float(v), 6) for v in w]
    cuts = np.cumsum([1, n, n, *widths])
    return KindModel(reliability, w[0], *[tuple(w[a:b]) for a, b in zip(cuts, cuts[1:])])


def fit(cells: dict[str, list[Cell]], rounds: int = 100, steps: int = 500) -> SpanModel:
    """One model for each kind with cells. The order of cells does not matter."""
    kinds = {}
    for kind, own in sorted(cells.items()):
        own = sorted(c for c in own if c[6])
        if own:
            belief, reliability = _estimate(kind, own, rounds)
            kinds[kind] = _classifier(kind, own, belief, reliability, steps)
    return SpanModel(kinds)


def with_candidates(documents: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``_row`` (all columns, or those of ``keep``), ``_base`` (spans) and ``_cands``: base and other candidates with
    votes, length class and edges."""
    held = F.struct(*[F.col(f"`{c}`") for c in (documents.columns if keep is None else keep)])
    rows = documents.select(held.alias("_row"), S.safe(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("_body"))
    rows = rows.select("_row", _strict(F.col("_body")).alias("_strict"), _loose(F.col("_body")).alias("_loose"))
    rows = rows.withColumn("_passed", F.filter("_strict", lambda s: s["base"]))
    # cards and telephone numbers of wild lengths are no candidates
    failed = F.filter("_strict", lambda s: ~s["base"] & (F.length(s["match"]) <= 40))
    others = F.when((F.size("_loose") == 0) & (F.size("_strict") == F.size("_passed")), F.col("_loose")).otherwise(_clear(F.concat(failed, F.col("_loose")), F.col("_passed")))
    voted = F.transform(
        F.concat("_passed", others),
        lambda s: F.struct(*[s[c].alias(c) for c in (*SPAN_FIELDS, "base")], _votes(s).alias("votes"), _size_class(s["match"]).alias("size"), _edge(F.substring(s["before"], -1, 1)).alias("left"), _edge(F.substring(s["after"], 1, 1)).alias("right"), _cue(s).alias("cue")),
    )
    return rows.select("_row", F.transform("_passed", lambda s: F.struct(*[s[c].alias(c) for c in SPAN_FIELDS])).alias("_base"), voted.alias("_cands"))


def learn(candidates: DataFrame) -> SpanModel:
    """Fit on every candidate of ``with_candidates``; only counts of combinations are collected."""
    cands = candidates.where(F.size("_cands") > 0).select(F.explode("_cands").alias("s"))
    cells: dict[str, list[Cell]] = defaultdict(list)
    for r in cands.groupBy("s.kind", "s.votes", "s.size", "s.left", "s.right", "s.cue", "s.base").count().collect():
        cells[r["kind"]].append((tuple(r["votes"]), r["size"], r["left"], r["right"], r["cue"], r["base"], r["count"]))
    return fit(cells)


def find_personal_data(documents: DataFrame, text: str = "text", model: SpanModel | None = None, keep: list[str] | None = None) -> DataFrame:
    """``documents`` with ``base_spans`` and ``spans`` (start, rank, end, kind, match), the latter with the accepted candidates.

    Null texts count as empty and have none. All columns stay, or those of ``keep``; those of these two names are
    replaced. Rows that repeat are scanned each; an empty table trains a model that accepts nothing. Without a ``model``
    the candidates are written to the shared folder, with the columns that stay, and learned from.
    """
    taken = ("base_spans", "spans")
    kept = [c for c in (documents.columns if keep is None else keep) if c not in taken]
    numbered = documents.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(kept)], F.col(f"`{text}`").alias("_source"))
    rows = with_candidates(numbered, "_source", [f"_c{k}" for k in range(len(kept))] or ["_source"])
    if model is None:
        rows = written(rows, "candidates")
        model = learn(rows)
    added = F.transform(F.filter("_cands", lambda s: ~s["base"] & model.accepts(s)), lambda s: F.struct(*[s[c].alias(c) for c in SPAN_FIELDS]))
    return rows.select(
        *[F.col(f"_row._c{k}").alias(c) for k, c in enumerate(kept)],
        F.array_sort("_base").alias("base_spans"),
        F.array_sort(F.concat("_base", F.array_distinct(added))).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the personal data of every document."""
    found = find_personal_data(tables(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *[S.count(F.col("base_spans"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(S.joined(F.col("base_spans")), 256).alias("base_sha256"),
        S.joined(F.col("spans")).alias("spans"),
    )
