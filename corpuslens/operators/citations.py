"""H1-H8: citation analytics over a publications table and a citation edge
table ``(citing_uid, cited_uid)``.

Seeds are always a DataFrame of ids (the result of a search or any other
query), so each operation is a join, never a loop of single-id lookups."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.constants import RETRIEVE_DESC_ONLY, RETRIEVE_SORT_FIELDS, SYMBOLIC_TIME_SPANS
from corpuslens.operators.paging import TOP_ROWS, page
from corpuslens.session import stage


# Join keys over which the rows of one group are spread (H1, H7).
SALTS = 16


# ---------------------------------------------------------------- H1

def normalised_impact(pubs: DataFrame, cited_col: str, group_cols: Sequence[str],
                      out: str = "impact") -> DataFrame:
    """H1: times cited / mean times cited of the (label, year, type) group;
    null is a group value like any other.  Group means are a partial aggregate
    joined back null-safely; the rows of a group are spread over ``SALTS`` join
    keys, so that a hot group is not pulled into one task."""
    salted = pubs.withColumn("_salt", F.pmod(F.xxhash64(*pubs.columns), F.lit(SALTS)).cast("int"))
    means = (pubs.groupBy(*group_cols).agg(F.avg(cited_col).alias("_mean"))
             .select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], "_mean",
                     F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s")))
    same = F.col("_salt") == F.col("_s")
    for i, c in enumerate(group_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    j = salted.join(means, same, "left")
    return j.select(*[F.col(c) for c in pubs.columns if c != out],
                    F.when(F.col("_mean") != 0, F.col(cited_col) / F.col("_mean")).alias(out))


# ---------------------------------------------------------------- H2

def wildcard_predicate(col: Column | str, term: str) -> Column:
    """One search word or double-quoted phrase: ``*`` is any run of word
    characters, ``?`` one character, in a phrase too; it must start and end at
    word boundaries; case-insensitive."""
    c = F.col(col) if isinstance(col, str) else col
    t = term.strip()
    words = t[1:-1].split() if t.startswith('"') and t.endswith('"') and len(t) >= 2 else [t]
    body = r"\s+".join("".join(r"\w*" if ch == "*" else (r"\w" if ch == "?" else re.escape(ch)) for ch in w)
                       for w in words)
    return c.rlike(r"(?iU)\b" + body + (r"\b" if words and not words[-1].endswith("*") else ""))


def all_of(*parts):
    """A query tree's AND: words, phrases and other trees."""
    return ("all", parts)


def any_word(*parts):
    """A query tree's OR."""
    return ("any", parts)


def query_predicate(text_cols: Sequence[str], query) -> Column:
    """The predicate of a query: a word or quoted phrase that some text column
    holds, or a tree of ``all_of`` and ``any_word``."""
    if isinstance(query, str):
        return reduce(or_, [F.coalesce(wildcard_predicate(c, query), F.lit(False)) for c in text_cols])
    kind, parts = query
    return reduce(and_ if kind == "all" else or_, [query_predicate(text_cols, p) for p in parts])


def query_words(query: str) -> list[str]:
    return re.findall(r'"[^"]+"|\S+', query)


def record_search(pubs: DataFrame, text_cols: Sequence[str], query=None,
                  any_of: bool = False, years: Sequence[int] | None = None, year_col: str = "pub_year",
                  editions: Sequence[str] | None = None, edition_col: str = "edition",
                  time_span: tuple[str, str] | None = None, date_col: str = "pub_date",
                  symbolic_time_span: str | None = None, load_date_col: str = "load_date",
                  today: str | None = None) -> DataFrame:
    """H2: records whose text columns hold every (``any_of``: some) word or
    quoted phrase of the query, or that fit a tree of ``all_of`` and
    ``any_word``; with optional year set, editions and either a
    publication-date span ``(begin, end)`` or a symbolic load-date span
    (1week/2week/4week), never both."""
    if time_span is not None and symbolic_time_span is not None:
        raise ValueError("timeSpan and symbolicTimeSpan exclude each other")
    pred = F.lit(True)
    if query:
        if isinstance(query, str):
            query = (any_word if any_of else all_of)(*query_words(query))
        pred = pred & query_predicate(text_cols, query)
    if years:
        pred = pred & F.col(year_col).isin(list(years))
    if editions:
        pred = pred & F.col(edition_col).isin(list(editions))
    if time_span is not None:
        b, e = time_span
        pred = pred & F.col(date_col).between(F.to_date(F.lit(b)), F.to_date(F.lit(e)))
    if symbolic_time_span is not None:
        if symbolic_time_span not in SYMBOLIC_TIME_SPANS:
            raise ValueError(f"symbolic time span must be one of {list(SYMBOLIC_TIME_SPANS)}")
        end = F.to_date(F.lit(today)) if today else F.current_date()
        pred = pred & F.col(load_date_col).between(F.date_sub(end, SYMBOLIC_TIME_SPANS[symbolic_time_span]), end)
    return pubs.where(pred)


# ---------------------------------------------------------------- H3

def retrieve(records: DataFrame, offset: int = 1, count: int = 100, sort_field: str = "RS",
             sort_order: str = "D", field_map: dict[str, str] | None = None,
             uid_col: str = "uid", max_count: int | None = None, after: tuple | None = None,
             top_rows: int = TOP_ROWS) -> DataFrame:
    """H3: one page.  ``offset`` >= 1 is the first record, ``count`` >= 0 the
    page size (0 -> only the number of records found; ``max_count``: the
    caller's bound on it), sort by a two-letter field (A/D; relevance and
    times cited only D), ties by uid, nulls last.

    Uids are unique.  A page that ends beyond ``top_rows`` is read from the
    ranges of the order that hold it (see ``paging``).  ``after`` is the (sort
    value, uid) of the last record of the page before: the page is then found
    by a filter and only ``count`` rows are gathered."""
    if offset < 1:
        raise ValueError("offset must be >= 1")
    if count < 0 or (max_count is not None and count > max_count):
        raise ValueError(f"count must be within 0..{max_count}")
    if sort_field not in RETRIEVE_SORT_FIELDS:
        raise ValueError(f"unknown sort field {sort_field!r}")
    if sort_order not in ("A", "D") or (sort_field in RETRIEVE_DESC_ONLY and sort_order != "D"):
        raise ValueError("sort must be A or D; relevance and times cited only D")
    if count == 0:
        return records.agg(F.count(F.lit(1)).alias("records_found"))
    col = (field_map or {}).get(sort_field)
    if col is None:
        raise ValueError(f"no column mapped for sort field {sort_field!r}")
    key = F.col(col).desc_nulls_last() if sort_order == "D" else F.col(col).asc_nulls_last()
    if after is not None:
        value, uid = after
        same = F.col(col).eqNullSafe(F.lit(value)) & (F.col(uid_col) > uid)
        beyond = F.lit(False) if value is None else F.col(col).isNull() | (
            F.col(col) < value if sort_order == "D" else F.col(col) > value)
        records = records.where(same | F.coalesce(beyond, F.lit(False)))
    return page(records, list(dict.fromkeys([col, uid_col])), [key, F.asc(uid_col)], offset, count, top_rows)


def page_plan(spark, records_found: DataFrame, offset: int = 1, limit: int = 100) -> DataFrame:
    """The paged requests that cover ``records_found`` (one-row count):
    ``(page, first_record, size)`` with size = min(limit, count - first + 1)."""
    n = records_found.first()[0]
    starts = spark.range(offset, n + 1, limit).withColumnRenamed("id", "first_record")
    return starts.select(((F.col("first_record") - offset) / limit).cast("long").alias("page"),
                         "first_record",
                         F.least(F.lit(limit), F.lit(n) - F.col("first_record") + 1).alias("size"))


# ---------------------------------------------------------------- H4-H8

def _publications(pubs: DataFrame, time_span, date_col: str, editions, edition_col: str) -> DataFrame:
    if time_span is not None:
        pubs = pubs.where(F.col(date_col).between(F.to_date(F.lit(time_span[0])), F.to_date(F.lit(time_span[1]))))
    if editions:
        pubs = pubs.where(F.col(edition_col).isin(list(editions)))
    return pubs


def retrieve_by_id(pubs: DataFrame, ids: DataFrame, uid_col: str = "uid") -> DataFrame:
    """H4: records whose uid is in ``ids`` (semi join)."""
    return pubs.join(ids.select(F.col(ids.columns[0]).alias(uid_col)).distinct(), uid_col, "left_semi")


def cited_references(citations: DataFrame, seeds: DataFrame, cited: DataFrame | None = None,
                     cited_key: str = "cited_uid", offset: int = 1, count: int | None = None,
                     top_rows: int = TOP_ROWS) -> DataFrame:
    """H5: references cited by the seed records, with the cited record's
    columns when ``cited`` (keyed by ``cited_key``) is given; a page of them
    (by citing, then cited id, which tell them apart) with ``count``."""
    s = seeds.select(F.col(seeds.columns[0]).alias("citing_uid")).distinct()
    refs = citations.join(s, "citing_uid")
    if count is not None:  # the page first, then what belongs to it
        refs = page(refs, ["citing_uid", "cited_uid"], [F.asc("citing_uid"), F.asc("cited_uid")], offset, count, top_rows)
    if cited is not None:
        refs = refs.join(cited.withColumnRenamed(cited_key, "cited_uid"), "cited_uid", "left")
    return refs


def citing_articles(citations: DataFrame, seeds: DataFrame, pubs: DataFrame,
                    time_span: tuple[str, str] | None = None, date_col: str = "pub_date",
                    uid_col: str = "uid", editions: Sequence[str] | None = None,
                    edition_col: str = "edition") -> DataFrame:
    """H6: records citing a seed, optionally within a publication-date span
    and some editions."""
    s = seeds.select(F.col(seeds.columns[0]).alias("cited_uid")).distinct()
    edges = citations.join(s, "cited_uid")
    p = _publications(pubs, time_span, date_col, editions, edition_col)
    return edges.join(p.withColumnRenamed(uid_col, "citing_uid"), "citing_uid")


def related_records(citations: DataFrame, seeds: DataFrame, top_n: int | None = None,
                    pubs: DataFrame | None = None, time_span: tuple[str, str] | None = None,
                    date_col: str = "pub_date", uid_col: str = "uid", editions: Sequence[str] | None = None,
                    edition_col: str = "edition", offset: int = 1) -> DataFrame:
    """H7: records sharing cited references with each seed (bibliographic
    coupling), the parent record included.

    ``(seed_uid, related_uid, shared, n_related, rank)``; ``n_related`` is the
    total number of related records (parent excluded), ``rank`` orders by
    shared desc then uid.  ``top_n`` keeps the ranks ``offset`` ..
    ``offset + top_n - 1``; by default all are returned.  ``pubs`` restricts
    the related records to a publication-date span and to editions.

    Work is the seeds' references x the citers of each reference.  Citers are
    spread over ``SALTS`` join keys and the references repeated for each, so a
    much-cited reference is shared by as many tasks; couplings are summed
    partially and written.  The totals are a partial sum over them, and with
    ``top_n`` every task hands on its leading couplings of a seed only (while
    the last rank wanted is within Spark's bound for that, 1000 by default)."""
    s = seeds.select(F.col(seeds.columns[0]).alias("citing_uid")).distinct()
    edges = citations.select("citing_uid", "cited_uid").distinct()
    seed_refs = edges.join(s, "citing_uid").select(
        F.col("citing_uid").alias("seed_uid"), "cited_uid", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    citers = edges.select(F.col("citing_uid").alias("related_uid"), "cited_uid",
                          F.pmod(F.xxhash64("citing_uid"), F.lit(SALTS)).cast("int").alias("_s"))
    if pubs is not None:
        allowed = _publications(pubs, time_span, date_col, editions, edition_col).select(
            F.col(uid_col).alias("related_uid")).distinct()
        citers = citers.join(allowed, "related_uid", "left_semi")
    co = stage(seed_refs.join(citers, ["cited_uid", "_s"])
               .groupBy("seed_uid", "related_uid").agg(F.count(F.lit(1)).alias("shared")))
    other = (F.col("seed_uid") != F.col("related_uid")).cast("long")
    totals = co.groupBy("seed_uid").agg(F.sum(other).alias("n_related"))
    rank = F.row_number().over(Window.partitionBy("seed_uid").orderBy(F.desc("shared"), F.asc("related_uid")))
    ranked = co.withColumn("rank", rank)
    if top_n is not None:
        ranked = ranked.where(F.col("rank") <= offset + top_n - 1).where(F.col("rank") >= offset)
    return ranked.join(totals, "seed_uid").select("seed_uid", "related_uid", "shared", "n_related", "rank")


def doi_to_uid(dois: DataFrame, pubs: DataFrame, doi_col: str = "doi", uid_col: str = "uid") -> DataFrame:
    """H8: each DOI with the matching record id, the ``WOS:`` prefix removed
    (as a prefix, not as a character set); of several records with one DOI the
    smallest id; unknown DOIs get null."""
    uid = F.regexp_replace(F.col(uid_col).cast("string"), "^WOS:", "")
    p = pubs.where(F.col(doi_col).isNotNull()).groupBy(doi_col).agg(F.min(uid).alias("uid"))
    return dois.select(doi_col).join(p, doi_col, "left")
