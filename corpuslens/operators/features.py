"""Document-topic features in long form ``(doc_id, topic_id, value)``.

Long form keeps the work relational: row norms are per-document sums,
document frequencies per-topic counts.  Dense vectors are only built for the
LSA features (``operators.svd.project``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators import postings as PO


def count_features(docs: DataFrame, topics: DataFrame, n_min: int = 1, n_max: int = 5,
                   id_col: str = "doc_id") -> DataFrame:
    """G1: ``(doc_id, n_words, topic_id, tf)`` counts of topic terms.  No n-gram
    is formed but those that share the topics' hash bits."""
    if n_min < 1:
        n_min = 1  # a zero-gram adds only empty strings, which no topic matches
    tmap = topics.select(F.col("stem").alias("term"), "topic_id")
    post = PO.near_postings(docs, topics, n_min, n_max, "stem", id_col)
    return (post.join(tmap, "term")
            .select(id_col, "n_words", "topic_id", F.col("tf").cast("double").alias("tf")))


def _row_norm(df: DataFrame, value: str, norm: str | None, id_col: str) -> DataFrame:
    if norm is None or norm == "none":
        return df
    w = Window.partitionBy(id_col)
    if norm == "l2":
        denom = F.sqrt(F.sum(F.col(value) * F.col(value)).over(w))
    elif norm == "l1":
        denom = F.sum(F.abs(F.col(value))).over(w)
    else:
        raise ValueError("norm must be 'l2', 'l1' or None")
    return df.withColumn(value, F.when(denom > 0, F.col(value) / denom).otherwise(F.lit(0.0)))


def tf_features(counts: DataFrame, norm: str | None = "l2", id_col: str = "doc_id") -> DataFrame:
    """Term frequencies with optional row norm -> ``(doc_id, topic_id, value)``.
    The window is per document; a document has at most one row per topic."""
    v = counts.select(id_col, "topic_id", F.col("tf").alias("value"))
    return _row_norm(v, "value", norm, id_col)


def idf_table(counts: DataFrame, n_docs: int, smooth: bool = True) -> DataFrame:
    """``(topic_id, df, idf)`` with idf = ln((1+N)/(1+df)) + 1 (smooth) or
    ln(N/df) + 1."""
    d = counts.groupBy("topic_id").agg(F.count(F.lit(1)).alias("df"))
    n = float(n_docs)
    idf = (F.log((F.lit(n + 1.0)) / (F.col("df") + 1.0)) + 1.0) if smooth else \
        (F.log(F.lit(n) / F.col("df")) + 1.0)
    return d.withColumn("idf", idf)


def tfidf_features(counts: DataFrame, n_docs: int, norm: str | None = "l2",
                   smooth: bool = True, id_col: str = "doc_id") -> DataFrame:
    """Tf * idf, then the row norm.  The idf table has one row per topic
    and is joined once; Spark broadcasts it below its size threshold."""
    idf = idf_table(counts, n_docs, smooth).select("topic_id", "idf")
    v = counts.join(idf, "topic_id").select(id_col, "topic_id", (F.col("tf") * F.col("idf")).alias("value"))
    return _row_norm(v, "value", norm, id_col)


# ------------------------------------------------------------- G6, G7, F10 on arrays

def l2_normalise_array(col) -> F.Column:
    """G6 on an array column: x / ||x||, zero vector stays zero."""
    c = F.col(col) if isinstance(col, str) else col
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(c, lambda x: x.cast("double") / norm)) \
        .otherwise(F.transform(c, lambda x: F.lit(0.0)))


def euclidean_distance(x, y) -> F.Column:
    """Euclidean distance of two equal-length array columns."""
    xc = F.col(x) if isinstance(x, str) else x
    yc = F.col(y) if isinstance(y, str) else y
    sq = F.zip_with(xc, yc, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, v: s + v))


def column_variances(df: DataFrame, col: str) -> DataFrame:
    """Population variance of each array component ``(dim, variance)``.
    One partial aggregate per component; components are few."""
    ex = df.select(F.posexplode(col).alias("dim", "x"))
    return ex.groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("variance"))


def explained_variance(df: DataFrame, col: str) -> DataFrame:
    """``(total_variance, n_dims)`` - the sum of column variances."""
    return column_variances(df, col).agg(F.sum("variance").alias("total_variance"),
                                         F.count(F.lit(1)).alias("n_dims"))
