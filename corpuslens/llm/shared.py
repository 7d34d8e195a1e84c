"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import stage

__all__ = ["lookup", "lower_ascii", "read", "split_lookup", "stage", "text_or_empty", "worker_memo"]

# Fixed values of the task: the white space that separates words, and the
# letters that are lower-cased.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# A key is hot when it holds at least this share of the rows; so there are at
# most HOT_KEYS of them, and their rows may be broadcast.
HOT_KEYS = 4096
HOT_FLOOR = 256
SALTS = 1024


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else.  For a pure ASCII text that is what
    ``lower`` does, at a fraction of the cost of ``translate``."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lookup(big: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``big`` left-joined to ``table`` on ``key``, without a hot task.

    ``table`` has one row per key; its column ``weight`` is the number of rows
    of ``big`` with that key and ``total`` their sum.  Keys with a large share
    of the rows number HOT_KEYS at most, so those rows of ``table`` are
    broadcast; rows of ``big`` that found their key there are spread over
    salts and find nothing in the shuffled join, the rest meet their row in
    it.  Null keys match nothing."""
    values = [c for c in table.columns if c != key]
    least = max(HOT_FLOOR, -(-total // HOT_KEYS))
    hot = table.where(F.col(weight) >= least).select(
        F.col(key).alias("__hot_key"), F.struct(*values).alias("__hot"))
    cold = table.where(F.col(weight) < least).select(
        F.col(key).alias("__cold_key"), F.lit(0).alias("__cold_salt"), F.struct(*values).alias("__cold"))
    spread = F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int")
    found = F.col("__hot").isNotNull() | F.col(key).isNull()
    marked = (
        big.join(F.broadcast(hot), big[key] == F.col("__hot_key"), "left")
        .withColumn("__salt", F.when(found, spread + 1).otherwise(0))
        .withColumn("__key", F.when(~found, F.col(key)))
    )
    out = marked.join(cold, (F.col("__key") == F.col("__cold_key")) & (F.col("__salt") == F.col("__cold_salt")), "left")
    return out.select(
        *[big[c] for c in big.columns],
        *[F.coalesce(F.col("__hot"), F.col("__cold"))[v].alias(v) for v in values])


def split_lookup(big: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``big`` joined to ``table`` on ``key``: ``lookup`` for a ``big`` that is
    written already and cheap to read twice.  Rows with a hot key (HOT_KEYS of
    them at most) meet it where they are and only the rest are shuffled.  Rows
    without a row in ``table`` go; null keys match nothing."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    least = max(HOT_FLOOR, -(-total // HOT_KEYS))
    hot, cold = F.broadcast(table.where(F.col(weight) >= least)), table.where(F.col(weight) < least)
    values = [c for c in table.columns if c != key]
    rest = big.join(hot.select(key), key, "left_anti")
    return big.join(hot, key).select(*big.columns, *values).unionAll(rest.join(cold, key).select(*big.columns, *values))


def worker_memo(key, build):
    """An object that lives as long as the Python worker.  Task functions are
    shipped by value, so their own globals last for one task only."""
    home = sys.modules.setdefault("_corpuslens_worker", types.ModuleType("_corpuslens_worker"))
    held = home.__dict__.setdefault("held", {})
    if key not in held:
        held[key] = build()
    return held[key]
