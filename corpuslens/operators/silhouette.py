"""F4 with the Euclidean distance: silhouettes of a seeded sample, each point
of it against all others, by tiles of two strips.

The closed form over cluster sums holds for squared distances only, so here
every distance is worked out, block by block.  A point's row is copied once per
strip, and there are about STRIPS of them whatever the number of points; a tile
yields a row per point and label, and no pair of points leaves a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.kmeans import hash_fraction
from corpuslens.session import stage

#: Points of a block; a task holds BLOCK^2 distances at a time.
BLOCK = 2048
#: Strips that the points are cut into, unless a strip would be of more than
#: STRIP points (each copied once per strip) or its sums of more than CELLS.
STRIPS = 24
STRIP = 32768
CELLS = 1 << 21


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(axis=1)[:, None] - 2.0 * x @ y.T + (y * y).sum(axis=1)
    return np.sqrt(np.maximum(d2, 0.0))


def _one_hot(code: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(code), n))
    out[np.arange(len(code)), code] = 1.0
    return out


def _sums(row: np.ndarray, own: np.ndarray, total: np.ndarray, found: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Per point of ``row`` and label of the other side: sum of distances and points."""
    return pd.DataFrame({
        "row": np.repeat(row, len(found)), "own": np.repeat(own, len(found)), "other": np.tile(found, len(row)),
        "total": total.ravel(), "n": np.tile(n.astype("int64"), len(row))})


def _tile_of(block: int):
    """Task function: the sums of two strips, or of one with itself."""
    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["strip"].to_numpy() == pdf["lo"].to_numpy()
        row, label = pdf["row"].to_numpy(), pdf["label"].to_numpy()
        vec = np.stack(list(pdf["vec"])).astype(float)
        sides = [np.flatnonzero(side)] + ([] if pdf["lo"].iloc[0] == pdf["hi"].iloc[0] else [np.flatnonzero(~side)])
        left, right = sides[0], sides[-1]
        labels = [np.unique(label[at], return_inverse=True) for at in sides]
        (found_l, code_l), (found_r, code_r) = labels[0], labels[-1]
        total_l = np.zeros((len(left), len(found_r)))
        total_r = total_l if len(sides) == 1 else np.zeros((len(right), len(found_l)))
        for i in range(0, len(left), block):
            a = slice(i, i + block)
            hot_l = _one_hot(code_l[a], len(found_l))
            for j in range(i if len(sides) == 1 else 0, len(right), block):
                b = slice(j, j + block)
                d = _distances(vec[left[a]], vec[right[b]])
                if len(sides) == 1 and i == j:
                    np.fill_diagonal(d, 0.0)
                    total_l[a] += d @ hot_l
                    continue
                total_l[a] += d @ _one_hot(code_r[b], len(found_r))
                total_r[b] += d.T @ hot_l
        out = [_sums(row[left], label[left], total_l, found_r, np.bincount(code_r, minlength=len(found_r)))]
        if len(sides) == 2:
            out.append(_sums(row[right], label[right], total_r, found_l, np.bincount(code_l, minlength=len(found_l))))
        return pd.concat(out)
    return tile


def _n_strips(n: int, n_labels: int, block: int) -> int:
    """Strips of a block's points at least, and STRIPS of them until they grow
    beyond STRIP points or CELLS sums."""
    most = max(block, min(STRIP, CELLS // max(1, n_labels)))
    return max(1, min(-(-n // block), max(STRIPS, -(-n // most))))


def silhouette_points(points: DataFrame, fraction: float, seed: int = 0, label_col: str = "label",
                      vec_col: str = "embedding", id_col: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """``(id, label, a, b, silhouette)`` of each sampled point: mean distance
    to the other sampled points of its label, smallest mean distance to those
    of another label, (b - a) / max(a, b).

    ``fraction`` of the ids is drawn by a seeded hash; 1.0 takes every point.
    The work goes with the square of the sample, so the caller states it.  A
    point alone in its label scores 0; with one label only, b and the
    silhouette are null.  Points with a null label or vector take no part.
    Repeated ids are drawn together and stay separate points.  Distances carry
    the rounding of |x|^2 - 2xy + |y|^2."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError("fraction must be in (0, 1]")
    drawn = points if fraction == 1.0 else points.where(hash_fraction(id_col, seed) < fraction)
    rows = stage(drawn.where(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec")))
    n, n_labels = rows.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
    strips = _n_strips(n, n_labels, block)
    tiles = (rows.select("row", "label", "vec", F.pmod(F.xxhash64("row"), F.lit(strips)).cast("int").alias("strip"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
             .select("row", "label", "vec", "strip", F.least("strip", "with").alias("lo"), F.greatest("strip", "with").alias("hi")))
    sums = (tiles.groupBy("lo", "hi").applyInPandas(_tile_of(block), "row long, own long, other long, total double, n long")
            .groupBy("row", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
    same = F.col("own") == F.col("other")
    per = sums.groupBy("row").agg(
        F.max(F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"))
    score = (F.when(F.col("b").isNull(), None).when(F.col("a").isNull() | (F.greatest("a", "b") == 0), 0.0)
             .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))
    return rows.select("row", "id", "label").join(per, "row").select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), "a", "b", score.alias("silhouette"))


def silhouette_euclidean(points: DataFrame, fraction: float, seed: int = 0, label_col: str = "label",
                         vec_col: str = "embedding", id_col: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """``(silhouette, n_points)``, the mean over the sample; null without
    points or with one label."""
    return silhouette_points(points, fraction, seed, label_col, vec_col, id_col, block).agg(
        F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("n_points"))
