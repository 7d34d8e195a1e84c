"""Connected components of a graph given as edges, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.shared import lookup, stage


def _least_neighbour(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v) rows with m, the least of u and its neighbours."""
    least = stage(pairs.groupBy("u").agg(F.min("v").alias("_m"), F.count("*").alias("_n")))
    return lookup(pairs, least, "u", "_n", total).select(
        "u", "v", F.least("u", "_m").alias("m"))


def _state(edges: DataFrame):
    return edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (columns a, b of one
    ordered type, no nulls); root is the least node of the component.

    Alternates the large-star and the small-star step, each one grouped
    minimum and one join, until the edges no longer change.  Nodes with many
    neighbours are handled by ``lookup``; every round is a written table, so a
    lost executor costs at most one round.  No edges: no rows."""
    now = stage(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = _state(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _least_neighbour(both, 2 * before[0]).where("v > u and v <> m").select("m", "v")
        large = stage(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # every row of large points from a node to a smaller one
        small = _least_neighbour(large, large.count())
        now = stage(
            small.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
            .unionAll(small.select(F.col("m").alias("a"), F.col("u").alias("b")))
            .where("a <> b").distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
