"""Structured Streaming use of the corpus operators.

The reference has no streaming; the text operators are stateless column
expressions, so they apply unchanged to a streaming DataFrame.  Running term
counts are Spark's built-in stateful aggregation (state kept per term in the
state store under the checkpoint folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions import text as TF
from corpuslens.operators import text as TX
from corpuslens.session import new_path


def stream_corpus(spark: SparkSession, path: str, schema: T.StructType | str, text_cols,
                  id_col: str = "doc_id", fmt: str = "parquet", max_files_per_trigger: int | None = None,
                  stemmer: str = "s") -> DataFrame:
    """Files landing under ``path`` -> streaming ``(doc_id, corpus, tokens,
    stems, n_words)``, with a stemmer that is a column expression."""
    if stemmer not in TX.NATIVE_STEMMERS:
        raise ValueError(f"a stream is stemmed by column expressions only: {TX.NATIVE_STEMMERS}")
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    df = reader.load(path)
    df = TX.build_corpus(df, list(text_cols), id_col)
    df = TX.tokenize(df).withColumn("n_words", TF.word_count("corpus"))
    df = df.select(id_col, "corpus", "tokens", "n_words")
    return TX.stem_tokens(df, stemmer, id_col=id_col)


def running_term_counts(stream: DataFrame, col: str = "stems", n_max: int = 1,
                        id_col: str = "doc_id") -> DataFrame:
    """Running ``(term, frequency, docs)`` over all documents seen so far
    (``update`` or ``complete`` output mode).  ``docs`` counts documents that
    hold the term; each document arrives once."""
    grams = stream.select(TF.ngrams(col, 1, n_max).alias("_g"))
    # one aggregation: every occurrence adds to frequency, every distinct
    # term of a row (a document) adds one document
    occ = grams.select(F.explode("_g").alias("term"), F.lit(1).alias("f"), F.lit(0).alias("d"))
    per_doc = grams.select(F.explode(TF.distinct_items("_g")).alias("term"), F.lit(0).alias("f"), F.lit(1).alias("d"))
    return occ.unionByName(per_doc).groupBy("term").agg(F.sum("f").alias("frequency"), F.sum("d").alias("docs"))


def start(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet", checkpoint: str | None = None):
    """Start a query that writes to files under ``path``.  ``append`` writes
    rows as they come; ``complete`` and ``update`` results (running counts) are
    written anew, one folder per micro-batch.  Progress is kept in the shared
    folder."""
    loc = checkpoint or new_path(df.sparkSession, "stream")
    writer = df.writeStream.option("checkpointLocation", loc)
    if mode == "append":
        return writer.format(fmt).outputMode(mode).start(path)
    return writer.outputMode(mode).foreachBatch(
        lambda rows, i: rows.write.mode("overwrite").format(fmt).save(f"{path}/batch={i}")).start()
