"""How far the sources of a language differ in their words.

A group is a (lang, source).  Every kept term has a price in every group, an
integer share of the group's words; terms a group never uses have the price of
count zero.  The divergence of two groups sums a function of their two prices
over all kept terms.  That function depends on nothing but the two count levels,
so the terms are counted by pairs of levels: indicator columns (one per group
and level, a one where the term has that level) times their transpose give all
joint tables of a block of terms at once, as an exact matrix product, and every
cell of the tables is priced once."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.shared import split_lookup, stage

# Fixed values of the task: what a term is, the documents of its language that
# a kept term stands in, the scale of prices, and the terms reported.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200

#: Terms of a cell and groups of a tile, on average (they are dealt by hash).
CELL_TERMS = 4096
TILE_GROUPS = 32
#: Terms of one matrix product; a group has no more levels among them.
BLOCK_TERMS = 512
#: A counting task hands its counts on when it holds so many.
HELD = 1 << 19

# The term pattern over UTF-8, where every byte of a character beyond ASCII is
# above 0x7F; lower() of bytes lowers A-Z only.
_TERM_BYTES = re.compile(rb"[A-Za-z\x80-\xff]+")

COUNTS = "lang string, source string, term string, count long, docs long"


def _count_terms(batches):
    """Task function: (lang, source, term, count, docs) of the rows that a task
    reads, added up; and for every group a row without a term."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()

    def rows():
        out = [[], [], [], [], []]
        for (lang, source), held in counts.items():
            own = docs[lang, source]
            out[0] += [lang] * len(held)
            out[1] += [source] * len(held)
            out[2] += [t.decode(errors="replace") for t in held]
            out[3] += held.values()
            out[4] += [own[t] for t in held]
        counts.clear()
        docs.clear()
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)],
                                          ["lang", "source", "term", "count", "docs"])

    for batch in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found = _TERM_BYTES.findall(text.encode().lower())
            groups.add((lang, source))
            counts[lang, source].update(found)
            docs[lang, source].update(set(found))
        if sum(map(len, counts.values())) >= HELD:
            yield rows()
    yield rows()
    lang, source = [g[0] for g in groups], [g[1] for g in groups]
    yield pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.nulls(len(lang), pa.string()),
         pa.array([0] * len(lang), pa.int64()), pa.array([0] * len(lang), pa.int64())],
        ["lang", "source", "term", "count", "docs"])


def price(count: Column, words: Column, kept: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + 1) / (words + kept)), without rounding.  A
    lang that keeps no term has nothing to price and any price will do."""
    wide = lambda c: c.cast("decimal(20,0)")
    share = F.call_function("div", F.lit(scale).cast("decimal(10,0)") * wide(count + 1), wide(F.greatest(words + kept, F.lit(1))))
    return (share + 1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def level_table(docs: DataFrame, lang: str, source: str, text: str, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, count, in_lang, first) of the kept terms, first in
    one row of each; and (lang, source, words, entries, lang_words, kept) of
    every group.

    Tasks hand on sums; dealt by (lang, term), they are added up and set
    against their language where they are.  A term has a row per source."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(either(lang).alias("lang"), either(source).alias("source"), either(text).alias("text"))
    sums = rows.mapInArrow(_count_terms, COUNTS).repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    held = sums.select("lang", "source", "term", "count", F.sum("count").over(whole).alias("in_lang"),
                       F.sum("docs").over(whole).alias("in_docs"), (F.min("source").over(whole) == F.col("source")).alias("first"))
    held = stage(held.where(F.col("term").isNull() | (F.col("in_docs") >= least_docs)).drop("in_docs"))
    levels = held.where("term IS NOT NULL")
    sizes = levels.groupBy("lang").agg(F.sum("count").alias("lang_words"), F.count_if("first").alias("kept"))
    words = levels.groupBy("lang", "source").agg(F.sum("count").alias("words"), F.count("*").alias("entries"))
    none = F.lit(0).cast("long")
    groups = held.where("term IS NULL").select("lang", "source").join(words, ["lang", "source"], "left").join(sizes, "lang", "left")
    return levels, stage(groups.select(
        "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("words", "entries", "lang_words", "kept")]))


def _block_values(levels: np.ndarray, zero: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Divergences (left groups x right groups) over a block of terms.
    ``levels``: prices by group and term, ``zero``: the price of count zero."""
    def indicators(at: int):
        price = np.unique(levels[at])
        return (levels[at][:, None] == price).astype(np.float32), price

    columns = [indicators(i) for i in right]
    matrix, q = np.concatenate([c[0] for c in columns], axis=1), np.concatenate([c[1] for c in columns])
    starts = np.cumsum([0, *[len(c[1]) for c in columns[:-1]]])
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for row, i in enumerate(left):
        ones, p = indicators(i)
        # whole numbers below 2**24 are exact in single precision
        joint = (ones.T @ matrix).astype(np.int64)
        out[row] = np.add.reduceat((joint * ((p[:, None] - q) ** 2 // q)).sum(axis=0), starts)
    return out


def _cell_values(cell: pd.DataFrame) -> pd.DataFrame:
    """Divergence of the left groups from the right ones over the terms of a
    cell.  Rows: a group (term null, p the price of count zero, n the terms of
    the cell, of which some may be in none of its groups), or a group's term
    with its price."""
    is_head = cell.term.isna().to_numpy()
    heads, marks = cell[is_head], cell[~is_head]
    zero = heads.p.to_numpy()
    group = pd.Index(heads.source).get_indexer(marks.source)
    term, names = pd.factorize(marks.term)
    levels = np.repeat(zero[:, None], len(names), axis=1)
    levels[group, term] = marks.p.to_numpy()
    # terms of like levels side by side: blocks then have fewer of them
    levels = levels[:, np.argsort(levels.sum(axis=0), kind="stable")]
    left, right = np.flatnonzero(heads.left), np.flatnonzero(heads.right)
    nowhere = int(heads.n.iloc[0]) - len(names)
    value = nowhere * ((zero[left][:, None] - zero[right]) ** 2 // zero[right])
    # a tile by hash may have got no group
    for at in range(0, len(names) if len(left) and len(right) else 0, BLOCK_TERMS):
        value += _block_values(levels[:, at:at + BLOCK_TERMS], zero, left, right)
    source = heads.source.to_numpy()
    every = pd.DataFrame({"lang": cell.lang.iloc[0], "source": np.repeat(source[left], len(right)),
                          "item": np.tile(source[right], len(left)), "value": value.ravel()})
    return every[every.source != every["item"]]


def pair_divergence(levels: DataFrame, groups: DataFrame, cell_terms: int = CELL_TERMS,
                    tile_groups: int = TILE_GROUPS) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of groups of a lang.

    A cell is a share of the lang's terms by a tile of left and a tile of
    right groups, so what a task holds does not grow with terms or groups."""
    tiles = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / tile_groups).cast("int").alias("tiles"),
        F.greatest(F.ceil(F.max("kept") / cell_terms), F.lit(1)).cast("int").alias("shares"))
    sized = stage(groups.join(tiles, "lang").select(
        F.struct("lang", "source").alias("group"), "entries", "words", "kept", "tiles", "shares",
        F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")))
    share = F.pmod(F.xxhash64("term"), F.col("shares")).cast("int")
    marks = split_lookup(levels.select(F.struct("lang", "source").alias("group"), "term", "count", "first"), sized, "group", "entries")
    marks = marks.withColumn("share", share)
    sizes = marks.groupBy("group.lang", "share").agg(F.count_if("first").alias("n"))
    zero = F.lit(0).cast("long")
    heads = sized.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    heads = heads.join(sizes.withColumnRenamed("share", "of"), (F.col("group.lang") == F.col("lang")) & (F.col("share") == F.col("of")), "left")
    every = marks.select("group", "term", price(F.col("count"), F.col("words"), F.col("kept")).alias("p"), zero.alias("n"),
                         "tile", "tiles", "share").unionAll(heads.select(
                             "group", F.lit(None).cast("string"), price(zero, F.col("words"), F.col("kept")),
                             F.coalesce("n", zero), "tile", "tiles", "share"))
    near = every.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    at = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"))
    sides = F.when(F.col("other") == F.col("tile"), F.array(at("tile", "tile"))).otherwise(
        F.array(at("tile", "other"), at("other", "tile")))
    cells = near.select("group", "term", "p", "n", "share", "tile", F.explode(sides).alias("at")).select(
        "group.lang", "group.source", "term", "p", "n", "share", "at.i", "at.j",
        (F.col("tile") == F.col("at.i")).alias("left"), (F.col("tile") == F.col("at.j")).alias("right"))
    parts = cells.groupBy("lang", "share", "i", "j").applyInPandas(
        _cell_values, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_divergence(levels: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the ``top`` terms that a group uses
    more than its language does."""
    held = groups.select(F.struct("lang", "source").alias("group"), "entries", "words", "lang_words", "kept")
    rows = split_lookup(levels.select(F.struct("lang", "source").alias("group"), "term", "count", "in_lang"), held, "group", "entries")
    p, q = price(F.col("count"), F.col("words"), F.col("kept")), price(F.col("in_lang"), F.col("lang_words"), F.col("kept"))
    over = rows.select("group.lang", "group.source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    over = over.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    return _ranked(over, top)


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if top is None else out.where(F.col("rank") <= top)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).  Part ``pair``: each
    other source of the lang and the divergence from it; part ``term``: the
    ``top`` terms that the source uses more than the lang does.

    Null text, lang and source are empty ones, which are a lang and a source
    like others.  A group without kept terms has the price of count zero for
    all of them; in a lang without kept terms all pairs have value 0, and a
    lang of one source has no pairs.  Repeated rows count as often as they
    stand.  Equal values rank by item, bytewise.  No rows give no rows; other
    columns are not read."""
    levels, groups = level_table(docs, lang_col, source_col, text_col, least_docs)
    pairs = _ranked(pair_divergence(levels, groups))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").unionAll(named(term_divergence(levels, groups, top), "term"))
