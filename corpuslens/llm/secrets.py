"""Secret scan: patterns of known secrets, and strings whose characters are
too evenly spread to be words.

For the second kind a window slides over every long unbroken string.  The
counts of the window's characters are kept up to date as it moves, and with
them the sum of c log2 c, from which the window's Shannon entropy follows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.spans import SPAN, count_kind, in_order, let, match_spans, span_string
from corpuslens.llm.shared import text_or_empty

# Fixed values of the task: the base patterns, and the least length of a match
# (of its second group for an assignment).  The bounds are part of the hex and
# access patterns, whose matches run to the end of a row of like characters.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex")

ADDED = "entropy"
WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}+"


@dataclass(frozen=True)
class CharClass:
    """Strings made of these characters are secret from this entropy on."""
    name: str
    pattern: str
    alphabet: str
    bits: float


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The first class that holds all of a string is its class.  The bounds lie
# between the values that a window of 20 characters can have.
CLASSES = (
    CharClass("hex", "[0-9a-f]+|[0-9A-F]+", DIGITS + "abcdefABCDEF", 2.95),
    CharClass("upper", "[0-9A-Z]+", DIGITS + UPPER, 3.55),
    CharClass("lower", "[0-9a-z]+", DIGITS + LOWER, 3.55),
    CharClass("base64", "[A-Za-z0-9+/=_-]+", UPPER + LOWER + DIGITS + "+/=_-", 3.75),
)
# Strings that are no secrets whatever their entropy: words, numbers, UUIDs,
# and those that hold a word of placeholders or a row of the alphabet.
ALLOW = (
    r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/=+]+(?:[A-Z]?[a-z]+|[A-Z]+))*+[-_/=+]*",
    r"[-+]?[0-9]+(?:[-/_=+][0-9]+)*+",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i).*(?:example|placeholder|changeme|xxxxxx|abcdefghij|0123456789).*",
)
# The last of them clears the segment of a string that holds such a word.
SEGMENT = r"(?<![A-Za-z0-9+])(?i:[A-Z0-9+]*(?:example|placeholder|changeme|xxxxxx|abcdefghij|0123456789)[A-Z0-9+]*+)"


def base_spans(text: Column) -> Column:
    """Base spans in order; a match that fails its length takes its place in
    the text all the same."""
    assign = F.filter(match_spans(text, ASSIGN, "assign", 0),
                      lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return in_order(assign, match_spans(text, ACCESS, "access", 1), match_spans(text, HEX, "hex", 2))


def _weighted(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(0.0)


def hot_stretches(value: Column, one: CharClass, window: int = WINDOW) -> Column:
    """Array of struct(first, last): where windows of at least ``one.bits``
    stand in ``value``, offsets of the first and behind the last of a row of
    such windows; windows that share or touch no character are two rows."""
    letter = lambda i: F.instr(F.lit(one.alphabet), F.substring(value, i + 1, F.lit(1)))  # noqa: E731  1-based
    count = lambda counts, k: F.get(counts, k - 1).cast("double")
    kind = "array<struct<first:int,last:int>>"
    state = F.struct(F.array_repeat(F.lit(0), len(one.alphabet)).alias("counts"), F.lit(0.0).alias("total"),
                     F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
                     F.array().cast(kind).alias("out"))
    closed = lambda s: F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"))))

    def move(s: Column, i: Column) -> Column:
        def with_letters(x: Column) -> Column:
            enters, leaves = x["enters"], x["leaves"]
            down = F.when(leaves > 0, _weighted(count(s["counts"], leaves) - 1) - _weighted(count(s["counts"], leaves))).otherwise(0.0)
            less = F.transform(s["counts"], lambda c, k: c - F.when(k + 1 == leaves, 1).otherwise(0))

            def after(held: Column) -> Column:
                up = _weighted(count(held, enters) + 1) - _weighted(count(held, enters))
                total = s["total"] + down + up
                hot = (i >= window - 1) & (F.lit(window).cast("double") * (F.log2(F.lit(float(window))) - one.bits) >= total)
                start = i - (window - 1)
                apart = hot & s["first"].isNotNull() & (start > s["last"])
                return F.struct(
                    F.transform(held, lambda c, k: c + F.when(k + 1 == enters, 1).otherwise(0)).alias("counts"),
                    total.alias("total"),
                    F.when(hot & (s["first"].isNull() | apart), start).otherwise(s["first"]).alias("first"),
                    F.when(hot, i + 1).otherwise(s["last"]).alias("last"),
                    F.when(apart, closed(s)).otherwise(s["out"]).alias("out"))
            return let(less, after)
        leaves = F.when(i >= window, letter(i - window)).otherwise(0)
        return let(F.struct(letter(i).alias("enters"), leaves.alias("leaves")), with_letters)

    return F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), state, move,
                       lambda s: F.when(s["first"].isNull(), s["out"]).otherwise(closed(s)))


def _blanked(run: Column, cuts: Column) -> Column:
    """The run's string with spaces where the spans ``cuts`` lie."""
    size = F.length(run["value"])
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(s: Column, c: Column) -> Column:
        start = F.greatest(c["start"] - run["start"], s["at"])
        end = F.greatest(F.least(c["end"] - run["start"], size), s["at"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(
            F.substring(run["value"], s["at"] + 1, start - s["at"]), F.repeat(F.lit(" "), end - start))).alias("out"))

    return F.aggregate(in_order(cuts), state, cut, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(run["value"], s["at"] + 1, size)))


def entropy_spans(text: Column, base: Column, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW[:-1],
                  segment: str = SEGMENT, window: int = WINDOW) -> Column:
    """Spans of the stretches of hot windows.  Base spans and segments with a
    word of placeholders are cut out of a string, and each remainder stands
    for itself; strings on the allow list have none."""
    allowed = f"^(?:{'|'.join(f'(?:{a})' for a in allow)})$"
    secret = lambda s: ~F.rlike(s["value"], F.lit(allowed))

    def pieces(s: Column) -> Column:
        met = F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return let(F.concat(met, match_spans(s["value"], segment, ADDED, len(KINDS), s["start"])), lambda cuts: F.when(
            F.size(cuts) == 0, F.array(s)).otherwise(match_spans(_blanked(s, cuts), CANDIDATE, ADDED, len(KINDS), s["start"])))

    runs = F.filter(match_spans(text, CANDIDATE, ADDED, len(KINDS)), secret)
    found = F.filter(F.flatten(F.transform(runs, pieces)), secret)

    def stretches(s: Column) -> Column:
        hot = F.array().cast("array<struct<first:int,last:int>>")
        for one in reversed(classes):
            hot = F.when(F.rlike(s["value"], F.lit(f"^(?:{one.pattern})$")), hot_stretches(s["value"], one, window)).otherwise(hot)
        return F.transform(hot, lambda h: F.struct(
            (s["start"] + h["first"]).alias("start"), s["ord"].alias("ord"), (s["start"] + h["last"]).alias("end"),
            s["kind"].alias("kind"), F.substring(s["value"], h["first"] + 1, h["last"] - h["first"]).alias("value")))

    return F.flatten(F.transform(found, stretches))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base and added: arrays of spans
    (start, ord, end, kind, value) in order.  What an added span would share
    with a base span is left to that.  Null and empty texts have no spans; null
    ids, repeated rows and empty tables come out as they went in."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), base_spans(text).alias("base"))
    return rows.select("doc_id", "base", entropy_spans(F.col("text"), F.col("base")).cast(SPAN).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    base, every = span_string(F.col("base")), span_string(in_order(F.col("base"), F.col("added")))
    return found.select("doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
