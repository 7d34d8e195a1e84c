"""two-dimensional document coordinates.

The single-machine t-SNE solver is re-aimed: the coordinates are the top two
principal axes of the document features, fitted distributed by Spark ML's
PCA, optionally on a seeded hash sample, and applied to every document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.kmeans import hash_fraction


def coordinates_2d(feats: DataFrame, sample_fraction: float | None = None, seed: int = 1,
                   features_col: str = "features", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, x, y)``; with ``sample_fraction`` only sampled documents
    are mapped (seeded, without replacement)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    src = feats if sample_fraction is None else feats.where(hash_fraction(id_col, seed) < sample_fraction)
    model = PCA(k=2, inputCol=features_col, outputCol="_xy").fit(src)
    xy = model.transform(src).select(id_col, vector_to_array("_xy").alias("_a"))
    return xy.select(id_col, F.col("_a")[0].alias("x"), F.col("_a")[1].alias("y"))
