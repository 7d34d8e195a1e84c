"""Corpus text operators on DataFrames.

Each document is one row; everything up to the token array is a per-row
expression, so it runs where the row was read, with no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions.porter2 import stem as porter2_stem
from corpuslens.operators.skew import join_by_weight
from corpuslens.session import stage

NATIVE_STEMMERS = ("none", "s")
STEMMERS = NATIVE_STEMMERS + ("porter2",)


def require_columns(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; have {df.columns}")


def build_corpus(df: DataFrame, text_cols: Sequence[str], id_col: str = "doc_id",
                 out: str = "corpus", remove: Sequence[str] | None = None,
                 to_space: Sequence[str] | None = None) -> DataFrame:
    """B1+B2: combined, cleaned, lower-cased text column ``out``."""
    require_columns(df, id_col, *text_cols)
    return df.withColumn(out, T.clean_text(T.combine_columns(text_cols), remove, to_space))


def tokenize(df: DataFrame, col: str = "corpus", out: str = "tokens") -> DataFrame:
    """Token array of a text column."""
    require_columns(df, col)
    return df.withColumn(out, T.tokens(col))


def doc_lengths(df: DataFrame, col: str = "corpus", id_col: str = "doc_id") -> DataFrame:
    """Words per document and the scale words / mean words.

    The mean is one global aggregate (a single number to the driver)."""
    require_columns(df, id_col, col)
    lengths = df.select(id_col, T.word_count(col).alias("n_words"))
    mean = lengths.agg(F.avg("n_words")).first()[0] or 0.0
    return lengths.withColumn(
        "scale", F.when(F.lit(mean) > 0, F.col("n_words") / F.lit(mean)).otherwise(F.lit(None)))


def _porter2_batches(batches):
    for pdf in batches:
        yield pd.DataFrame({"token": pdf["token"],
                            "stem": [porter2_stem(t) for t in pdf["token"]]})


def stem_dictionary(tokens_df: DataFrame, stemmer: str, col: str = "tokens") -> DataFrame:
    """``(token, stem)`` for the *distinct* tokens of an array column.

    The Python stemmer sees each distinct token once (a small share of all
    tokens); native stemmers are column expressions."""
    words = tokens_df.select(F.explode(col).alias("token")).distinct()
    if stemmer in NATIVE_STEMMERS:
        return words.withColumn("stem", T.stem_phrase("token", stemmer)
                                if stemmer == "s" else F.col("token"))
    if stemmer == "porter2":
        return words.mapInPandas(_porter2_batches, "token string, stem string")
    raise ValueError(f"unknown stemmer {stemmer!r}; one of {STEMMERS}")


def stem_tokens(df: DataFrame, stemmer: str, col: str = "tokens", out: str = "stems",
                id_col: str = "doc_id", dictionary: DataFrame | None = None) -> DataFrame:
    """Stemmed token array per document, order kept.

    Native stemmers map the array in place.  Other stemmers, and a given
    ``dictionary`` (token, stem; tokens not in it get no stem), go through a
    table of the distinct tokens: tokens are exploded with their position,
    joined to it and re-assembled per document in position order.  The tokens
    that make up much of the text (4,096 at most, by their counts) meet their
    stem where they are; only the others are shuffled by token."""
    require_columns(df, id_col, col)
    if dictionary is None and stemmer in NATIVE_STEMMERS:
        return df.withColumn(out, T.stem_array(col, stemmer))
    dictionary = dictionary if dictionary is not None else stem_dictionary(df, stemmer, col)
    exploded = df.select(id_col, F.posexplode(col).alias("pos", "token"))
    weights = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    table = stage(dictionary.join(weights, "token"))
    stems = (join_by_weight(exploded, table, "token", "_n", "left")
             .groupBy(id_col)
             .agg(F.sort_array(F.collect_list(F.struct("pos", "stem"))).alias("_ps"))
             .select(id_col, F.col("_ps.stem").alias(out)))
    return df.join(stems, id_col, "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast("array<string>")))


def stem_terms(df: DataFrame, stemmer: str, col: str = "phrase", out: str = "stem",
               dictionary: DataFrame | None = None) -> DataFrame:
    """Stem each word of a space-separated term column (vocabulary, stop words)."""
    if stemmer in NATIVE_STEMMERS:
        return df.withColumn(out, T.stem_phrase(col, stemmer) if stemmer == "s" else F.col(col))
    with_words = df.withColumn("_w", F.split(col, " "))
    if dictionary is None:
        dictionary = stem_dictionary(with_words, stemmer, "_w")
    exploded = with_words.select(col, F.posexplode("_w").alias("pos", "token")).distinct()
    stems = (exploded.join(dictionary, "token", "left")
             .groupBy(col)
             .agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "stem")))["stem"], " ")
                  .alias(out)))
    return with_words.drop("_w").join(stems, col, "left")


def stemmed_text(df: DataFrame, col: str = "stems", out: str = "corpus_stemmed") -> DataFrame:
    """The stemmed document as one space-joined string."""
    return df.withColumn(out, F.array_join(col, " "))


def ngram_counts(df: DataFrame, col: str = "tokens", n_min: int = 1, n_max: int = 3,
                 id_col: str = "doc_id") -> DataFrame:
    """Corpus-wide n-gram counts ``(n, gram, cnt, n_docs)``; a row of
    ``df`` is a document.  A document's n-grams are counted in its row, so
    that one sum gives both counts."""
    g = df.select(F.explode(T.counted_items(T.ngrams(col, n_min, n_max))).alias("g"))
    return (g.groupBy(F.col("g.item").alias("gram"))
            .agg(F.sum("g.n").alias("cnt"), F.count(F.lit(1)).alias("n_docs"))
            .withColumn("n", T.phrase_words("gram")))


def last_rows(df: DataFrame, order_cols: str | Sequence[str], n: int) -> DataFrame:
    """The ``n`` last rows by a total order (positional tail).  Columns
    after the first break ties; rows that agree in all of them are equal to
    the caller."""
    cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    return df.orderBy(*[F.desc(c) for c in cols]).limit(n)
