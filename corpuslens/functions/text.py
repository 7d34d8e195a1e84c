"""Text column expressions.  All native Spark SQL, evaluated inside
whole-stage code generation; no Python runs per row."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.constants import CLEAN_REMOVE, CLEAN_TO_SPACE

# Token: a run of letters/digits that holds at least one ASCII letter.
TOKEN_PATTERN = r"([\p{L}\p{N}]+)"
# Whitespace for word counts of the cleaned text.
NON_SPACE_RUN = r"[^ \t\n\f\r]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def combine_columns(cols: Sequence[Column | str], sep: str = ". ") -> Column:
    """B1: join text columns with ``sep``, skipping nulls (all null -> '')."""
    return F.concat_ws(sep, *[_col(c) for c in cols])


def _single_char(pattern: str) -> str | None:
    """The literal character a regex matches, if it is one literal char."""
    if len(pattern) == 1 and pattern not in r".^$|?*+()[]{}\\":
        return pattern
    if len(pattern) == 2 and pattern[0] == "\\" and not pattern[1].isalnum():
        return pattern[1]
    return None


def _fold(patterns: Sequence[str]) -> list[str]:
    """Merge runs of single-character patterns into one character class.
    Replacing each of them in turn by the same string equals one pass over
    the class, because the replacement never re-creates a matched char."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        if len(run) == 1:
            out.append(re.escape(run[0]) if _single_char(run[0]) is None else run[0])
        elif run:
            out.append("[" + "".join(re.escape(ch) for ch in run) + "]")
        run.clear()

    for p in patterns:
        ch = _single_char(p)
        if ch is not None:
            run.append(ch)
        else:
            flush()
            out.append(p)
    flush()
    return out


def clean_text(c: Column | str, remove: Sequence[str] | None = None,
               to_space: Sequence[str] | None = None, fold: bool = True) -> Column:
    """B2: ordered regex clean-up, then lower case.

    ``remove`` patterns are deleted, ``to_space`` patterns become one space,
    each in list order; then '+' -> 'plus', '*' -> '' and lower case."""
    remove = CLEAN_REMOVE if remove is None else list(remove)
    to_space = CLEAN_TO_SPACE if to_space is None else list(to_space)
    col = _col(c)
    for p in (_fold(remove) if fold else remove):
        col = F.regexp_replace(col, p, "")
    for p in (_fold(to_space) if fold else to_space):
        col = F.regexp_replace(col, p, " ")
    col = F.regexp_replace(col, r"\+", "plus")
    col = F.regexp_replace(col, r"\*", "")
    return F.lower(col)


def tokens(c: Column | str) -> Column:
    """Lower-case letter/digit runs that hold an ASCII letter."""
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_PATTERN), 1)
    return F.filter(runs, lambda t: t.rlike("[a-z]"))


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated words (empty text -> 0)."""
    return F.coalesce(F.size(F.regexp_extract_all(_col(c), F.lit(NON_SPACE_RUN), 0)), F.lit(0))


def phrase_words(c: Column | str) -> Column:
    """Number of space-separated words of a term."""
    return F.size(F.split(_col(c), " "))


def ngrams(arr: Column | str, n_min: int = 1, n_max: int = 5) -> Column:
    """All space-joined runs of n_min..n_max consecutive array items,
    shortest first, in position order."""
    if n_min < 1 or n_max < n_min:
        raise ValueError("need 1 <= n_min <= n_max")
    a = _col(arr)
    size = F.size(a)
    grams = F.flatten(F.transform(
        F.sequence(F.lit(n_min), F.least(F.lit(n_max), size)),
        lambda k: F.transform(F.sequence(F.lit(1), size - k + 1),
                              lambda i: F.array_join(F.slice(a, i, k), " "))))
    return F.when(size >= n_min, grams).otherwise(F.array().cast("array<string>"))


def s_stem(c: Column | str) -> Column:
    """S-stemmer (Harman 1991): the first matching of three plural rules.
      -ies (not -eies, -aies) -> -y;  -es (not -aes, -ees, -oes) -> -e;
      -s (not -us, -ss, and not the whole word) -> removed."""
    return _s_stem_expr(_col(c))


def _s_stem_expr(w: Column) -> Column:
    n = F.length(w)
    head3 = w.substr(F.lit(1), n - 3)
    head1 = w.substr(F.lit(1), n - 1)
    rule1 = w.endswith("ies") & ~w.endswith("eies") & ~w.endswith("aies")
    rule2 = w.endswith("es") & ~w.endswith("aes") & ~w.endswith("ees") & ~w.endswith("oes")
    rule3 = w.endswith("s") & ~w.endswith("us") & ~w.endswith("ss") & (n > 1)
    return (F.when(rule1, F.concat(head3, F.lit("y")))
            .when(rule2, head1)
            .when(rule3, head1)
            .otherwise(w))


def stem_array(arr: Column | str, stemmer: str) -> Column:
    """Stem every item of a token array with a native stemmer."""
    if stemmer == "none":
        return _col(arr)
    if stemmer == "s":
        return F.transform(_col(arr), _s_stem_expr)
    raise ValueError(f"stemmer {stemmer!r} is not a column expression; use the dictionary job")


def stem_phrase(c: Column | str, stemmer: str) -> Column:
    """Stem each space-separated word of a phrase and re-join (native stemmers)."""
    return F.array_join(stem_array(F.split(_col(c), " "), stemmer), " ")


def distinct_items(arr: Column | str) -> Column:
    """Distinct items of an array in O(n log n): sort, pair each item with
    its predecessor, keep the items that differ.  (Spark's array_distinct
    compares every pair for string items, which is quadratic on long
    documents.)  Nulls are dropped; the result is sorted."""
    s = F.array_sort(F.filter(_col(arr), lambda x: x.isNotNull()))
    prev = F.concat(F.array(F.lit(None).cast("string")), s)
    pairs = F.arrays_zip(s.alias("cur"), prev.alias("prev"))
    # the zip pads the shorter side: the last pair has no current item
    keep = F.filter(pairs, lambda p: p["cur"].isNotNull() & (p["prev"].isNull() | (p["cur"] != p["prev"])))
    return F.transform(keep, lambda p: p["cur"])


def counted_items(arr: Column | str) -> Column:
    """Distinct items of an array with their counts, as structs (item, n),
    sorted by item, in O(n log n).  Nulls are dropped."""
    held = F.array_sort(F.filter(_col(arr), lambda x: x.isNotNull()))

    def runs(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return F.transform(F.array(begins), lambda at: F.transform(at, lambda p, j: F.struct(
            F.get(s, p).alias("item"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).alias("n"))))[0]

    # the sorted array is named by a lambda, so that it is sorted once
    return F.transform(F.array(held), runs)[0]


def contains_all_words(c: Column | str, search: str, regex: bool = False) -> Column:
    """E1 predicate: every whitespace word of ``search`` occurs in the column,
    case-insensitive (Unicode).  Literal by default; ``regex=True`` treats words
    as Java regexes on the text as it is.  Null text never matches."""
    words = search.split()
    col = _col(c)
    low = F.lower(col)
    pred = col.isNotNull()
    for w in words:
        pred = pred & (col.rlike("(?iu)" + w) if regex else low.contains(w.lower()))
    return pred
