"""Spans of regular expressions as DataFrame expressions: starts and ends in code points.

A pattern runs once over a text: each match is put between two marks, and the text
is split at them. Marks are two of Unicode's noncharacters; ``safe`` takes them out
of a text beforehand, one code point for another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,rank:int,end:int,kind:string,match:string>"
SPANS = f"array<{SPAN}>"
BEFORE, AFTER = 30, 12  # code points of context
_OPEN, _CLOSE, _OTHER = "\ufdd0", "\ufdd1", "\ufdd2"
_GROUP = 64


def no_spans() -> Column:
    return F.array().cast(SPANS)


def safe(text: Column) -> Column:
    """A text in which the marks don't occur, as long as before."""
    marked = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE))
    return F.when(marked, F.translate(text, _OPEN + _CLOSE, _OTHER * 2)).otherwise(text)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _match(part: Column) -> Column:
    return F.substring_index(part, _CLOSE, 1)


def _gap(part: Column) -> Column:
    return F.substring_index(part, _CLOSE, -1)


def _end_of(gap: Column) -> Column:
    return F.substring(gap, -BEFORE, BEFORE)


def _spans(parts: Column, kind: str, rank: int, context: bool) -> Column:
    """``parts``: what lies before the first match, then each match with what follows it. Running places are kept in
    groups, so that a text with very many matches costs little more than its length."""
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 2) / _GROUP).cast("int")), lambda g: F.struct(F.get(parts, g * _GROUP).alias("last"), F.slice(parts, g * _GROUP + 2, _GROUP).alias("own")))
    size = lambda part: F.length(part) - 1

    def place(acc: Column, g: Column) -> Column:
        total = F.aggregate(g["own"], F.lit(0), lambda n, x: n + size(x))
        return F.struct((acc["at"] + total).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def span(acc: Column, part: Column) -> Column:
        match = _match(part)
        fields = [acc["at"].alias("start"), F.lit(rank).alias("rank"), (acc["at"] + F.length(match)).alias("end"), F.lit(kind).alias("kind"), match.alias("match")]
        if context:
            fields += [_end_of(acc["gap"]).alias("before"), F.substring(_gap(part), 1, AFTER).alias("after")]
        return F.struct((acc["at"] + size(part)).alias("at"), _end_of(_gap(part)).alias("gap"), F.concat(acc["out"], F.array(F.struct(*fields))).alias("out"))

    def own(g: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), _end_of(_gap(g["last"])).alias("gap"), F.array().cast(_type(context)).alias("out"))
        return F.aggregate(g["own"], first, span, lambda acc: acc["out"])

    def placed(g: Column) -> Column:
        begun = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.flatten(F.zip_with(g, F.aggregate(g, begun, place, lambda acc: acc["out"]), own))

    return bound(groups, placed)


def _type(context: bool) -> str:
    return "array<struct<start:int,rank:int,end:int,kind:string,match:string,before:string,after:string>>" if context else SPANS


def find(text: Column, pattern: str, kind: str, rank: int, present: Column | None = None, keep: Callable[[Column], Column] | None = None, context: bool = False) -> Column:
    """All leftmost non-overlapping matches, in a ``safe`` text, of a Java pattern that cannot match the empty string.

    ``present`` is a cheap condition without which the pattern cannot match; ``keep`` filters by the matched text. With
    ``context`` spans also have ``before`` and ``after``: up to 30 and 12 code points around, no further than the next match.
    """
    none = F.array().cast(_type(context))
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))
    found = bound(F.split(marked, _OPEN, -1), lambda parts: F.when(F.size(parts) > 1, _spans(parts, kind, rank, context)).otherwise(none))
    out = found if present is None else F.when(present, found).otherwise(none)
    return out if keep is None else F.filter(out, lambda s: keep(s["match"]))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by start and then rank, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each span replaced by ``mark``; spans that overlap count as one."""
    state = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            )
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))).otherwise(text)
