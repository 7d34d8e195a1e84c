"""Spans of regular-expression matches, from DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"
#: Matches whose offsets are summed in one go; longer lists go block by block.
BLOCK = 128


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def match_spans(text: Column, pattern: str, kind: str, order: int, shift: Column | None = None) -> Column:
    """The leftmost non-overlapping matches of a pattern that never matches
    the empty string, as an array of SPAN in order: offsets in code points,
    end exclusive, ``order`` the kind's place in its list, value the match.
    Null text has no matches.

    Between n matches lie n + 1 pieces; a match starts where the pieces and
    matches before it end."""
    gap_then_match = lambda pieces: lambda m, i: F.struct(
        F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("len"), m.alias("m"))
    first = F.lit(0) if shift is None else shift.cast("int")

    def block(pairs: Column):
        def of(k: Column) -> Column:
            before = F.aggregate(F.slice(pairs, 1, k * BLOCK), first, lambda a, p: a + p["gap"] + p["len"])
            state = F.struct(before.alias("pos"), F.array().cast(SPAN).alias("out"))

            def step(s: Column, p: Column) -> Column:
                start = s["pos"] + p["gap"]
                span = F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + p["len"]).alias("end"),
                                F.lit(kind).alias("kind"), p["m"].alias("value"))
                return F.struct((start + p["len"]).alias("pos"), F.concat(s["out"], F.array(span)).alias("out"))

            return F.aggregate(F.slice(pairs, k * BLOCK + 1, BLOCK), state, step, lambda s: s["out"])
        return of

    def spans(found: Column) -> Column:
        pairs = let(F.split(text, pattern, -1), lambda pieces: F.transform(found, gap_then_match(pieces)))
        blocks = F.sequence(F.lit(0), ((F.size(found) - 1) / BLOCK).cast("int"))
        return F.when(F.size(found) > 0, let(pairs, lambda p: F.flatten(F.transform(blocks, block(p))))).otherwise(
            F.array().cast(SPAN))

    return let(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")), spans)


def in_order(*arrays: Column) -> Column:
    """All spans by start, then by the place of their kind."""
    return F.sort_array(reduce(F.concat, arrays) if len(arrays) > 1 else arrays[0])


def span_string(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
