"""Exact deduplication against a persistent digest index.

The index is a table whose files lie in the shared folder, bucketed and sorted by digest, with one
row per text seen: its digest and keep_id, the document that stands for it.  A
new batch is reduced to one row per digest before anything is shuffled, set
against the index by a sort-merge anti-join for which the index needs no
shuffle, and what is new is appended."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.shared import lookup, lower_ascii, stage, text_or_empty
from corpuslens.session import new_path

INDEX_SCHEMA = "digest string, keep_id long"


def text_digest(text: str | Column) -> Column:
    """SHA-256 (lowercase hex) of the text with A-Z lower-cased; null as empty."""
    return F.sha2(lower_ascii(text_or_empty(text)), 256)


def _append(rows: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    out = rows.repartition(buckets, "digest").write.mode("append").format("parquet")
    out = out.option("path", path) if path else out
    out.bucketBy(buckets, "digest").sortBy("digest").saveAsTable(table)


def open_index(spark: SparkSession, table: str, buckets: int) -> DataFrame:
    """The index table, made empty in the shared folder if it isn't there yet."""
    if not spark.catalog.tableExists(table):
        _append(spark.createDataFrame([], INDEX_SCHEMA), table, buckets, new_path(spark, "digest-index"))
    return spark.table(table)


def absorb(spark: SparkSession, batch: DataFrame, table: str, buckets: int) -> None:
    """Add to the index what ``batch`` (digest, doc_id) brings that is new;
    of equal texts within the batch the largest id stands.  Running a batch
    twice adds nothing."""
    index = open_index(spark, table, buckets)
    # staged, for the optimizer would set the raw rows against the index
    ours = stage(batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id")))
    _append(ours.hint("merge").join(index.hint("merge"), "digest", "left_anti"), table, buckets)
    spark.catalog.refreshTable(table)


def dedup(docs: DataFrame, table: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          batches: int = 2, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256.

    The documents enter the index in ``batches`` of falling ids, so the entry
    that is there first is the one with the largest id.  ``table`` names a
    lasting index (texts in it from earlier runs win over new documents); by
    default a new one is made.  ``buckets``: of the index, by default as many
    as the session's shuffle partitions; a table keeps its number for life.

    Null text counts as empty.  A null id is smaller than any other; a text
    held by null ids only has keep_id null, and kept is true for its rows.
    Repeated rows (same id, equal text) are one document: each has the same
    values.  No rows give no rows; other columns of ``docs`` are not read."""
    spark = docs.sparkSession
    lasting, table = table is not None, table or f"digest_index_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                             text_digest(text_col).alias("digest")))
    cuts = [] if batches < 2 else rows.select(F.percentile_approx(
        "doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    try:
        return _met(spark, rows, cuts, table, buckets)
    finally:
        if not lasting:
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def _met(spark: SparkSession, rows: DataFrame, cuts: list[int], table: str, buckets: int) -> DataFrame:
    """The rows (doc_id, digest) with their entries, after all batches are in."""
    high = None
    for low in [*sorted(set(cuts), reverse=True), None]:
        part = rows if low is None else rows.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where((F.col("doc_id") <= high) | F.col("doc_id").isNull())
        absorb(spark, part, table, buckets)
        high = low
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    entries = stage(spark.table(table).join(sizes, "digest"))
    out = lookup(rows, entries, "digest", "group_size", rows.count())
    return out.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of equal texts the
    one with the largest id; repeated rows of it once."""
    held = dedup(docs, id_col=id_col, text_col=text_col, **options).where("kept").groupBy(
        F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_digest")).agg(
        F.count("*").alias("__copies"))
    held = stage(held)
    marked = docs.withColumn("__digest", text_digest(text_col))
    stay = marked.join(held, (F.col("__digest") == F.col("__keep_digest"))
                       & F.col(id_col).cast("long").eqNullSafe(F.col("__keep_id")))
    once = stay.where("__copies = 1")
    again = stay.where("__copies > 1").dropDuplicates(["__keep_digest"])
    return once.unionAll(again).select(*[F.col(c) for c in docs.columns])
