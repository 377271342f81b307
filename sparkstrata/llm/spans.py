"""Regular-expression spans with code-point positions, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN_TYPE = "array<struct<start:int,end:int,value:string>>"
#: Lengths that one step of a running sum goes over; appending to an array copies it, so steps are short.
_STEP = 64


@dataclass(frozen=True)
class Rule:
    """One kind of span.

    ``pattern`` is leftmost and non-overlapping; ``keep`` sees (match, inner group) and drops failing matches without
    a retry; ``sieve`` is a cheap necessary condition on the whole text.
    """

    kind: str
    pattern: str
    sieve: Callable[[Column], Column]
    keep: Callable[[Column, Column], Column]
    group: int = 0


def running(sizes: Column) -> Column:
    """``array<int>``: the sum of all elements before each one, and of all at the end; two levels, so long arrays are fine."""
    zero = F.array(F.lit(0))

    def append(a: Column, x: Column) -> Column:
        return F.concat(a, F.array(F.element_at(a, -1) + x))

    def of(sizes: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / _STEP).cast("int")), lambda k: F.slice(sizes, k * _STEP + 1, F.lit(_STEP)))

        def with_parts(parts: Column) -> Column:
            starts = F.aggregate(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)), zero, append)
            inner = F.zip_with(parts, F.slice(starts, 1, F.size(parts)), lambda p, s: F.slice(F.aggregate(p, F.array(s), append), 1, F.size(p)))
            return F.concat(F.flatten(inner), F.array(F.element_at(starts, -1)))

        return let(parts, with_parts)

    return let(sizes, of)


def matches(text: Column, pattern: Column, group: int = 0) -> Column:
    """All matches in order, as ``array<struct<start,end,value,inner>>``; starts count code points from 0.

    The text between matches (``split``) gives the gaps, the matches give the rest; both walk the text the same way.
    """
    whole = F.regexp_extract_all(text, pattern, F.lit(0))

    def of(values: Column) -> Column:
        inner = F.regexp_extract_all(text, pattern, F.lit(group)) if group else values
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        steps = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: g + F.length(v))

        def placed(ends: Column) -> Column:
            rows = F.arrays_zip(values.alias("value"), inner.alias("inner"), F.slice(ends, 2, F.size(values)).alias("end"))
            return F.transform(rows, lambda x: F.struct((x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["inner"].alias("inner")))

        return let(running(steps), placed)

    none = F.array().cast("array<struct<start:int,end:int,value:string,inner:string>>")
    return let(whole, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(none))


def found(text: Column, rule: Rule) -> Column:
    """Kept matches of a rule in order, as ``array<struct<start,end,value>>``."""
    spans = F.filter(matches(text, F.lit(rule.pattern), rule.group), lambda x: rule.keep(x["value"], x["inner"]))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).cast(SPAN_TYPE)
    return F.coalesce(F.when(rule.sieve(text), spans), F.array().cast(SPAN_TYPE))


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans with their kind and its place in the listing order."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def joined(tagged_spans: Column) -> Column:
    """``kind:start:end`` by start, then listing order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(tagged_spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(tagged_spans: Column | str, kind: str) -> Column:
    return F.size(F.filter(tagged_spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """``text`` with each span (sorted by start) replaced by ``put`` of it; of overlapping spans the first counts."""

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), put(s))
        fits = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fits, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(spans, begin, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
