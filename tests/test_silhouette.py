"""Euclidean silhouettes by tiles against the definition."""

import numpy as np
import pytest

from corpuslens.operators import kmeans as KM
from corpuslens.operators import silhouette as SH

POINTS = "vec_id string, label int, embedding array<double>"


def plain(x, labels):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    out = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(x)) != i)
        b = min(d[i, labels == c].mean() for c in set(labels) - {own})
        a = d[i, same].mean() if same.any() else None
        out.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return out


def points(n=150, seed=3):
    r = np.random.default_rng(seed)
    labels = np.where(np.arange(n) % 3 == 0, 0, r.integers(1, 6, n))  # one label holds a third
    labels[5] = 99  # alone
    return r.normal(0, 1, (n, 4)) + labels[:, None] % 7, labels


@pytest.mark.parametrize("block", [1, 16, 64, 2048])
def test_tiles_equal_the_definition(spark, block):
    x, labels = points(40 if block == 1 else 150)
    rows = [(f"p{i}", int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x, strict=True))]
    got = SH.silhouette_points(spark.createDataFrame(rows, POINTS), 1.0, block=block).collect()
    want = dict(zip((r[0] for r in rows), plain(x, labels), strict=True))
    assert len(got) == len(rows) and all(np.isclose(r.silhouette, want[r.vec_id], atol=1e-7) for r in got)
    alone = next(r for r in got if r.vec_id == "p5")
    assert alone.a is None and alone.silhouette == 0.0


def test_sample_is_drawn_by_the_seeded_hash(spark):
    x, labels = points()
    df = spark.createDataFrame([(f"p{i}", int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x, strict=True))], POINTS)
    drawn = {r.vec_id for r in df.where(KM.hash_fraction("vec_id", 4) < 0.4).collect()}
    some = np.array([f"p{i}" in drawn for i in range(len(x))])
    got = SH.silhouette_euclidean(df.repartition(5), 0.4, 4, block=32).first()
    assert got.n_points == some.sum() and 20 < got.n_points < 100
    assert np.isclose(got.silhouette, np.mean(plain(x[some], labels[some])), atol=1e-7)
    for wrong in (0.0, 1.5):
        with pytest.raises(ValueError):
            SH.silhouette_points(df, wrong)


def test_awkward_points(spark):
    rows = [("a", 1, [0.0, 0.0]), ("a", 1, [0.0, 0.0]), (None, 2, [3.0, 4.0]), ("n", None, [1.0, 1.0]), ("v", 1, None)]
    got = SH.silhouette_points(spark.createDataFrame(rows, POINTS).selectExpr("*", "1 AS row", "2 AS own"), 1.0).collect()
    assert sorted((r.vec_id or "", r.a, r.b, r.silhouette) for r in got if r.vec_id) == [("a", 0.0, 5.0, 1.0)] * 2
    assert [(r.a, r.b, r.silhouette) for r in got if r.vec_id is None] == [(None, 5.0, 0.0)]
    one = SH.silhouette_points(spark.createDataFrame(rows[:2], POINTS), 1.0).collect()
    assert len(one) == 2 and all(r.b is None and r.silhouette is None for r in one)
    none = spark.createDataFrame([], POINTS)
    assert SH.silhouette_points(none, 1.0).count() == 0
    assert tuple(SH.silhouette_euclidean(none, 1.0).first()) == (None, 0)
