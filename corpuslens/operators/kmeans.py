"""Split, k-means fit / sweep / one Lloyd step, silhouette, sizes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import stage



def hash_fraction(id_col: str, seed: int) -> F.Column:
    """Deterministic uniform [0,1) per id: first 8 hex digits of
    md5(id || ':' || seed) / 2^32 (the same value in DuckDB)."""
    h = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967296.0)


def train_test_split(df: DataFrame, test_size: float = 0.25, seed: int = 0,
                     id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """seeded hash split without replacement; stable under repartitioning."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    u = hash_fraction(id_col, seed)
    return df.where(u >= test_size), df.where(u < test_size)


def renumber_labels(pred: DataFrame, label_col: str = "label", id_col: str = "doc_id") -> DataFrame:
    """Label numbers by (size desc, smallest id) so runs compare.  ``pred``
    is read twice: pass a staged or persisted table."""
    sizes = pred.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("_m"))
    order = Window.orderBy(F.desc("_n"), F.asc("_m"))
    mapping = sizes.select(label_col, (F.row_number().over(order) - 1).alias("_new"))
    return (pred.join(mapping, label_col)
            .drop(label_col).withColumnRenamed("_new", label_col))


@dataclass
class KMeansSummary:
    numIter: int
    trainingCost: float


@dataclass
class KMeansResult:
    """What ``kmeans_fit`` found."""
    centres: np.ndarray
    summary: KMeansSummary

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)


def kmeans_fit(feats: DataFrame, k: int | None = None, seed: int = 0, max_iter: int = 300,
               features_col: str = "features", id_col: str = "doc_id", tol: float = 1e-4):
    """k-means from Spark ML's k-means|| start.  ``k`` defaults to
    int(sqrt(N)).  Returns (labels ``(id, label)``, ``KMeansResult``).  The
    rounds are the shared passes of ``sweeps``; they end when no centre moves
    by more than ``tol``, which ``summary.numIter`` below ``max_iter`` tells."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array

    from corpuslens.operators import sweeps as SW
    if k is None:
        k = max(2, int(math.sqrt(feats.count())))
    feats = feats.persist()
    start = KMeans(k=int(k), seed=seed, maxIter=0, featuresCol=features_col, predictionCol="label").fit(feats)
    points = stage(feats.select(id_col, vector_to_array(features_col).alias(features_col)))
    feats.unpersist()
    centres = np.array(start.clusterCenters(), dtype=float)  # fewer than k where fewer points differ
    rounds, cost, rest = 0, 0.0, False
    while rounds < max_iter and not rest:
        v = SW._component_sums(points, features_col, {len(centres): centres}, centres.shape[1] + 2, SW._kmeans_batch)[len(centres)]
        moved = np.where(v[:, :1] > 0, v[:, 2:] / np.maximum(v[:, :1], 1), centres)
        rest = bool(np.sqrt(((moved - centres) ** 2).sum(axis=1)).max() <= tol)
        centres, cost, rounds = moved, float(v[:, 1].sum()), rounds + 1
    pred = stage(assign_nearest(points, centres, features_col, id_col).select(id_col, "label"))
    return renumber_labels(pred, "label", id_col), KMeansResult(centres, KMeansSummary(rounds, cost))


def _assign_batches(centres: np.ndarray, vec_col: str, id_col: str):
    def run(batches):
        c = centres
        cn = (c * c).sum(axis=1)
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack([np.asarray(v, dtype=float) for v in pdf[vec_col]])
            d2 = (x * x).sum(axis=1)[:, None] - 2.0 * x @ c.T + cn[None, :]
            lab = np.argmin(d2, axis=1)
            yield pd.DataFrame({id_col: pdf[id_col].values, "label": lab.astype("int32"),
                                "dist2": np.maximum(d2[np.arange(len(lab)), lab], 0.0)})
    return run


def assign_nearest(points: DataFrame, centres: np.ndarray, vec_col: str = "embedding",
                   id_col: str = "vec_id") -> DataFrame:
    """Nearest centre per point ``(id, label, dist2)``.  The k x d centre
    matrix is bounded by k and shipped with the task; points stream through
    vectorised numpy over Arrow batches (no points x centres join)."""
    kind = points.schema[id_col].dataType.simpleString()
    return points.select(id_col, vec_col).mapInPandas(
        _assign_batches(np.asarray(centres, dtype=float), vec_col, id_col),
        f"`{id_col}` {kind}, label int, dist2 double")


def group_means(points: DataFrame, label_col: str, vec_col: str) -> DataFrame:
    """``(label, dim, mean)`` per label and component (partial aggregates)."""
    ex = points.select(label_col, F.posexplode(vec_col).alias("dim", "x"))
    return ex.groupBy(label_col, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centres_matrix(means: DataFrame, label_col: str = "label") -> tuple[np.ndarray, list]:
    """The centre table (a row per cluster and dimension) as a matrix."""
    pdf = means.toPandas()
    labels = sorted(pdf[label_col].unique().tolist())
    d = int(pdf["dim"].max()) + 1
    m = np.zeros((len(labels), d))
    pos = {l: i for i, l in enumerate(labels)}
    for l, dim, v in zip(pdf[label_col], pdf["dim"], pdf["mean"]):
        m[pos[l], int(dim)] = v
    return m, labels


def best_k(sweep: DataFrame, score: str = "silhouette", largest: bool = True) -> int:
    """F3/F5 pick: the k with the best score of a sweep table (ties: smaller k)."""
    order = [F.desc(score) if largest else F.asc(score), F.asc("k")]
    return int(sweep.where(F.col(score).isNotNull() & ~F.isnan(score)).orderBy(*order).first()["k"])


def _lloyd_stats(centres: np.ndarray, labels: list, vec_col: str):
    def run(batches):
        k, d = centres.shape
        cn = (centres * centres).sum(axis=1)
        sx = np.zeros((k, d)); cnt = np.zeros(k, dtype=np.int64); seen = False
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack([np.asarray(v, dtype=float) for v in pdf[vec_col]])
            lab = np.argmin((x * x).sum(axis=1)[:, None] - 2.0 * x @ centres.T + cn[None, :], axis=1)
            np.add.at(sx, lab, x)
            cnt += np.bincount(lab, minlength=k)
            seen = True
        if seen:
            comp = np.repeat(np.arange(k), d)
            yield pd.DataFrame({"label": np.asarray(labels)[comp].astype("int64"),
                                "dim": np.tile(np.arange(d), k).astype("int32"),
                                "sx": sx.ravel(), "n": np.repeat(cnt, d)})
    return run


def kmeans_step(points: DataFrame, label_col: str = "label", vec_col: str = "embedding",
                id_col: str = "vec_id") -> DataFrame:
    """F2 (one Lloyd iteration from given labels): centres = label means;
    each point goes to its nearest centre; new centres = means of the
    assignment.  One pass: every task emits per-label partial sums (k x d
    numbers), Spark adds them up.  ``(label, dim, centre, n_points)``."""
    means = group_means(points, label_col, vec_col)
    c, labels = centres_matrix(means, label_col)
    stats = (points.select(vec_col)
             .mapInPandas(_lloyd_stats(c, labels, vec_col), "label long, dim int, sx double, n long")
             .groupBy("label", "dim").agg(F.sum("sx").alias("sx"), F.sum("n").alias("n")))
    return (stats.where(F.col("n") > 0)
            .select(F.col("label").cast("int").alias("label"), "dim",
                    (F.col("sx") / F.col("n")).alias("centre"), F.col("n").alias("n_points")))


def silhouette_sq(points: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """F4, exact for squared Euclidean distance in O(N k d) (no point pairs):
    mean squared distance of x to cluster C = (Q_C - 2 x.S_C + n_C |x|^2) / n_C,
    own cluster divided by n_C - 1; singleton clusters score 0.
    Uses Spark ML's evaluator (same closed form).  ``(silhouette)``."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    v = points.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"),
                      F.col(label_col).cast("double").alias("prediction"))
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction",
                             distanceMeasure="squaredEuclidean")
    return points.sparkSession.createDataFrame([(float(ev.evaluate(v)),)], "silhouette double")


def cluster_sizes(labels: DataFrame, corpus: DataFrame | None = None, label_col: str = "label",
                  text_col: str = "corpus", id_col: str = "doc_id",
                  all_labels: DataFrame | None = None) -> DataFrame:
    """F8: documents with non-null text per label; labels without any keep 0."""
    if corpus is not None:
        df = labels.join(corpus.select(id_col, text_col), id_col, "left")
        sizes = df.groupBy(label_col).agg(F.count(text_col).alias("doc_count"))
    else:
        sizes = labels.groupBy(label_col).agg(F.count(F.lit(1)).alias("doc_count"))
    if all_labels is not None:
        sizes = all_labels.select(label_col).distinct().join(sizes, label_col, "left") \
            .withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
    return sizes
