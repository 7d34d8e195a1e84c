"""Keyword search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import contains_all_words


def search_rows(df: DataFrame, col: str, search: str, regex: bool = False) -> DataFrame:
    """Rows whose column holds every whitespace word of ``search``
    (case-insensitive; literal unless ``regex``).  A filter on the scanned
    column; only its not-null part can be pushed into the file reader."""
    return df.where(contains_all_words(col, search, regex))


def search_ids(df: DataFrame, col: str, search: str, id_col: str = "doc_id",
               regex: bool = False) -> DataFrame:
    """Ids of the matching rows."""
    return search_rows(df, col, search, regex).select(id_col)


def vocab_search(vocab: DataFrame, text: str, col: str = "phrase", order_col: str | None = None,
                 descending: bool = True) -> DataFrame:
    """Vocabulary terms containing ``text`` (case-sensitive substring),
    ordered by ``order_col``."""
    out = vocab.where(F.col(col).contains(text))
    if order_col:
        out = out.orderBy(F.desc(order_col) if descending else F.asc(order_col), F.asc(col))
    return out
