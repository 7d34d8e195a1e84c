"""H3, H5: any page of a large sorted result.

The sort keys are dealt out by ranges and written with the number of their
range; the rows per range say which ranges hold the page, and only those are
read again.  So however deep the page, no task sees more than its range."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.session import stage

#: Up to this last row a page is taken from the top rows of all tasks.
TOP_ROWS = 10_000


def ranges_of_page(counts: dict[int, int], offset: int, count: int) -> tuple[list[int], int]:
    """The ranges that hold rows ``offset`` .. ``offset + count - 1`` (from 1),
    and the rows before the first of them."""
    held, before, first = [], 0, 0
    for part in sorted(counts):
        if before < offset - 1 + count and before + counts[part] >= offset:
            first = before if not held else first
            held.append(part)
        before += counts[part]
    return held, first


def page(df: DataFrame, keys: Sequence[str], order: Sequence[Column], offset: int = 1, count: int = 100,
         top_rows: int = TOP_ROWS) -> DataFrame:
    """Rows ``offset`` .. ``offset + count - 1`` of ``df`` in the order
    ``order`` over its columns ``keys``, which tell all rows apart.

    A page that ends within ``top_rows`` is the usual top-k, for which every
    task keeps that many rows; a deeper one reads the ranges that hold it.
    Both give the same rows.  Nulls may stand in any key."""
    if offset < 1 or count < 0:
        raise ValueError("offset must be >= 1 and count >= 0")
    if offset - 1 + count <= top_rows:
        return df.orderBy(*order).offset(offset - 1).limit(count)
    placed = stage(df.select(*keys).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    held, before = ranges_of_page(counts, offset, count)
    wanted = placed.where(F.col("_range").isin(held)).orderBy(*order).offset(offset - 1 - before).limit(count)
    wanted = wanted.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
    same = reduce(and_, [df[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    return df.join(wanted, same, "left_semi").orderBy(*order)
