"""E1, E2, H2 over a persistent index: searches that don't read the texts.

Two tables lie under the index's path, each in folders of hash buckets.
``postings`` has a row per token and document with the token's positions;
``grams`` has, for every distinct token, its runs of three characters (a mark at
either end), so tokens are found by any part of them.  A search reads the grams'
buckets that its words need (all of them for a word with no three characters in
a row), the postings' buckets of the tokens found, and merges the hits of all
its words in one aggregate.

Two kinds: ``spaces`` cuts the lower-cased text at white space and answers E1
(a word occurs anywhere in the text); ``words`` takes runs of word characters
and answers H2 (whole words, wildcards, phrases, trees of AND and OR)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions.text import distinct_items
from corpuslens.operators.citations import all_of, any_word, query_words
from corpuslens.session import shuffles_dropped

KINDS = ("spaces", "words")
#: Characters of a run in ``grams``, and the mark at a token's ends.
GRAM = 3
MARK = "\x01"
#: Characters of a token whose runs are cut and compared one by one.
SHORT = 64
#: Tasks over which a bucket is spread when it is written, at least.
SPREAD = 16
#: Bytes of text whose postings a task writes, about.
TASK_BYTES = 16 << 20
#: Tokens whose positions a task gathers at a time, or one document's.
BATCH_ITEMS = 1 << 20
#: Words of a phrase at most.
PHRASE_WORDS = 62
# Positions of a document's further text columns begin this far apart.
COLUMN_STEP = 1 << 40


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    kind: str
    buckets: int
    id_type: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"token string, id {self.id_type}, positions array<bigint>, bucket int").parquet(f"{self.path}/postings")

    @property
    def grams(self) -> DataFrame:
        return self.spark.read.schema("gram string, token string, bucket int").parquet(f"{self.path}/grams")


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    """The index that ``build_index`` wrote under ``path``."""
    about = spark.read.json(f"{path}/about").first()
    return SearchIndex(spark, path, about["kind"], about["buckets"], about["id_type"])


def _bucket(key: Column, buckets: int) -> Column:
    return (F.crc32(key) % buckets).cast("int")


def _bucket_of(key: str, buckets: int) -> int:
    return zlib.crc32(key.encode()) % buckets


def _items(text: Column, kind: str) -> Column:
    """The tokens of a text at their positions.  Of kind ``words``, a run of
    other characters than white space is an item too, so words that stand side
    by side are those with nothing but white space between them."""
    if kind == "spaces":
        return F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0))
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]+"), F.lit(0))


def _gather(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row per document and token with the token's positions, in order."""
    items, at = batch.column("items"), batch.column("at")
    doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(items).to_numpy(zero_copy_only=False))
    words = items.flatten().dictionary_encode()
    key = doc * max(1, len(words.dictionary)) + words.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    ends = np.append(first, len(order)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch.column("id").take(pa.array(doc[order[first]])), words.dictionary.take(words.indices.take(pa.array(order[first]))),
         pa.ListArray.from_arrays(pa.array(ends), at.flatten().take(pa.array(order)))], names=["id", "token", "positions"])


def _gather_batches(batches):
    """Task function: ``_gather`` over runs of documents of about BATCH_ITEMS."""
    for batch in batches:
        part = np.cumsum(pc.list_value_length(batch.column("items")).to_numpy(zero_copy_only=False)) // BATCH_ITEMS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                yield _gather(batch.slice(a, b - a))


def _token_rows(df: DataFrame, text_cols: Sequence[str], id_col: str, kind: str) -> DataFrame:
    """(id, token, positions) of all text columns, a row per token of a
    document, made where the document is read; rows without an id have none."""
    def placed(c: str, first: int) -> Column:
        items = F.coalesce(_items(F.col(c).cast("string"), kind), F.array().cast("array<string>"))
        return F.transform(items, lambda x, p: F.struct(x.alias("token"), (p + F.lit(first).cast("long")).alias("pos")))

    items = F.concat(*[placed(c, i * COLUMN_STEP) for i, c in enumerate(text_cols)])
    if kind == "words":
        items = F.transform(F.filter(items, lambda x: x["token"].rlike(r"(?U)^\w")), lambda x: F.struct(
            F.lower(F.upper(x["token"])).alias("token"), x["pos"].alias("pos")))
    held = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), items.alias("items"))
    held = held.select("id", F.col("items.token").alias("items"), F.col("items.pos").alias("at"))
    return held.mapInArrow(_gather_batches, T.StructType(
        [held.schema["id"], T.StructField("token", T.StringType()), T.StructField("positions", T.ArrayType(T.LongType()))]))


def _spread(df: DataFrame, text_cols: Sequence[str], buckets: int) -> tuple[int, int]:
    """Tasks over which a bucket is spread, and tasks in all: they follow the
    length of the texts, so that what a task sorts does not grow with them."""
    size = reduce(lambda x, y: x + y, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in text_cols])
    tasks = -(-int(df.agg(F.sum(size)).first()[0] or 0) // TASK_BYTES)
    return max(SPREAD, -(-4 * tasks // buckets)), tasks


def _grams(token: Column) -> Column:
    """The distinct runs of GRAM characters of the marked token."""
    marked = F.split(F.concat(F.lit(MARK), token, F.lit(MARK)), "")
    # the characters are named by a lambda, so that a long token is split once
    long = distinct_items(F.transform(F.array(marked), lambda held: F.transform(
        F.slice(held, F.lit(1), F.size(held) - (GRAM - 1)),
        lambda c, i: F.concat(c, *[F.get(held, i + j) for j in range(1, GRAM)])))[0])
    whole = F.concat(F.lit(MARK), token, F.lit(MARK))
    short = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(whole) - (GRAM - 1)), lambda i: F.substring(whole, i, GRAM)))
    return F.when(F.length(token).between(1, SHORT), short).otherwise(long)


def _write(rows: DataFrame, path: str, mode: str) -> None:
    rows.write.mode(mode).partitionBy("bucket").parquet(path)


def build_index(df: DataFrame, path: str, text_cols: Sequence[str], id_col: str = "doc_id", kind: str = "words",
                buckets: int = 64, mode: str = "overwrite") -> SearchIndex:
    """Index the text columns of ``df`` under ``path``; ``mode='append'`` adds
    documents with new ids to the index that is there, with its kind and buckets.

    Ids are unique; rows without one and null texts are not found.  A document's
    positions are gathered where it is read.  A token that stands in most documents is
    spread over SPREAD tasks and files, or more as the texts grow."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    id_type = df.schema[id_col].dataType.simpleString()
    index = open_index(df.sparkSession, path) if mode == "append" else SearchIndex(df.sparkSession, path, kind, buckets, id_type)
    if (index.kind, index.id_type) != (kind, id_type):
        raise ValueError(f"the index is of kind {index.kind!r} with ids of type {index.id_type}")
    buckets = index.buckets
    spread, tasks = _spread(df, text_cols, buckets)
    many = tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame, by: str) -> DataFrame:
        keys = ["bucket", F.pmod(F.xxhash64(by), F.lit(spread))]
        return rows.repartition(tasks, *keys) if many else rows.repartition(*keys)

    rows = _token_rows(df, text_cols, id_col, kind)
    with shuffles_dropped(df.sparkSession):
        placed = rows.select("token", "id", "positions", _bucket(F.col("token"), buckets).alias("bucket"))
        _write(dealt(placed, "id").sortWithinPartitions("bucket", "token"), f"{path}/postings", mode)
        # an index made anew has its tokens in its postings: no second look at the texts
        tokens = (rows if mode == "append" else index.postings).select("token").distinct()
        grams = tokens.select(F.explode(_grams(F.col("token"))).alias("gram"), "token").select(
            "gram", "token", _bucket(F.col("gram"), buckets).alias("bucket"))
        _write(dealt(grams, "token").sortWithinPartitions("bucket", "gram"), f"{path}/grams", mode)
    about = df.sparkSession.createDataFrame([(kind, buckets, id_type)], "kind string, buckets int, id_type string")
    about.write.mode("overwrite").json(f"{path}/about")
    return index


# ---------------------------------------------------------------- lookup

def _grams_of(pieces: Sequence[str]) -> list[str]:
    """Runs that a token must have to hold the pieces."""
    return sorted({p[i:i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})


def _tokens_with(index: SearchIndex, pieces: Sequence[str], fits: Column) -> DataFrame:
    """Distinct tokens that have all the pieces and fit the predicate."""
    wanted = _grams_of(pieces)
    if wanted:
        rows = index.grams.where(F.col("bucket").isin(sorted({_bucket_of(g, index.buckets) for g in wanted})) & F.col("gram").isin(wanted))
    else:  # look at every token, by the one run that begins with the mark
        rows = index.grams.where(F.col("gram").startswith(MARK))
    return rows.where(fits).groupBy("token").agg(F.countDistinct("gram").alias("n")).where(
        F.col("n") >= max(1, len(wanted))).select("token")


def _postings_of(index: SearchIndex, word: str) -> DataFrame:
    """(id, positions) of the tokens that fit a word of H2 (wildcards * and
    ?); a plain word is a token itself and needs no look at the grams."""
    norm = word.upper().lower()
    if "*" not in word and "?" not in word:
        return index.postings.where((F.col("bucket") == _bucket_of(norm, index.buckets)) & (F.col("token") == norm))
    pattern = "".join(r"\w*" if c == "*" else r"\w" if c == "?" else re.escape(c) for c in norm)
    marked = MARK + norm + MARK
    return _of_tokens(index, _tokens_with(index, re.split(r"[*?]+", marked), F.col("token").rlike(f"(?U)^{pattern}$")))


def _of_tokens(index: SearchIndex, tokens: DataFrame) -> DataFrame:
    """Postings of a table of tokens, from their buckets alone.  Of the tokens
    nothing but bucket numbers is collected."""
    held = tokens.select("token", _bucket(F.col("token"), index.buckets).alias("b"))
    buckets = [r["b"] for r in held.select("b").distinct().collect()]
    return index.postings.where(F.col("bucket").isin(buckets)).join(held.select("token"), "token", "left_semi")


def _phrase_hits(index: SearchIndex, words: Sequence[str]) -> DataFrame:
    """(id) of documents where the words stand side by side."""
    if len(words) == 1:
        return _postings_of(index, words[0]).select("id")
    starts = [_postings_of(index, w).select("id", F.explode("positions").alias("at")).select(
        "id", (F.col("at") - i).alias("at"), F.lit(1 << i).cast("long").alias("part")) for i, w in enumerate(words)]
    met = reduce(DataFrame.unionAll, starts).groupBy("id", "at").agg(F.bit_or("part").alias("parts"))
    return met.where(F.col("parts") == (1 << len(words)) - 1).select("id")


def _leaves(query) -> list[str]:
    return [query] if isinstance(query, str) else [x for part in query[1] for x in _leaves(part)]


def _merge(leaves: Sequence[DataFrame], predicate) -> DataFrame:
    """Ids whose hits fit: one aggregate over the hits of all leaves."""
    hits = reduce(DataFrame.unionAll, [d.select("id", F.lit(i).alias("leaf")) for i, d in enumerate(leaves)])
    flags = [F.max(F.col("leaf") == i).alias(f"_{i}") for i in range(len(leaves))]
    return hits.groupBy("id").agg(*flags).where(predicate).select("id")


def search_indexed(index: SearchIndex, search: str, id_col: str = "doc_id") -> DataFrame:
    """Ids of the documents whose text holds every white-space word of
    ``search`` (case-insensitive, literal), as ``search_ids`` finds them.  An
    index of kind ``spaces``; a search without words is refused, for it would
    find everything."""
    words = sorted({w.lower() for w in search.split()})
    if index.kind != "spaces" or not words:
        raise ValueError("needs an index of kind 'spaces' and at least one word")
    leaves = [_of_tokens(index, _tokens_with(index, [w], F.col("token").contains(w))).select("id") for w in words]
    every = reduce(and_, [F.col(f"_{i}") for i in range(len(leaves))])
    return _merge(leaves, every).withColumnRenamed("id", id_col)


def record_search_indexed(index: SearchIndex, query, any_of: bool = False, id_col: str = "uid") -> DataFrame:
    """H2's query: ids of the records that ``record_search`` finds by words,
    quoted phrases, or a tree of ``all_of`` and ``any_word``.

    An index of kind ``words``.  Words are made of word characters, ``*`` and
    ``?``; others, and a lone ``*`` within a phrase, are refused: scan for
    them.  Letters are equal when they are after upper- and lower-casing."""
    if index.kind != "words":
        raise ValueError("needs an index of kind 'words'")
    if isinstance(query, str):
        query = (any_word if any_of else all_of)(*query_words(query))
    phrases, numbers = [], {}
    for leaf in _leaves(query):
        words = leaf[1:-1].split() if len(leaf) >= 2 and leaf[0] == leaf[-1] == '"' else [leaf.strip()]
        if not words or any(not re.fullmatch(r"[\w*?]+", w) for w in words) or len(words) > PHRASE_WORDS \
                or len(words) > 1 and any(set(w) == {"*"} for w in words):
            raise ValueError(f"the index has no answer to {leaf!r}")
        if leaf not in numbers:
            numbers[leaf] = len(phrases)
            phrases.append(words)

    def fits(part) -> Column:
        if isinstance(part, str):
            return F.col(f"_{numbers[part]}")
        return reduce(and_ if part[0] == "all" else or_, [fits(p) for p in part[1]])

    return _merge([_phrase_hits(index, w) for w in phrases], fits(query)).withColumnRenamed("id", id_col)
