import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import features as G
from corpuslens.operators import gmm as GM
from corpuslens.operators import kmeans as KM
from corpuslens.operators import svd as SV
from corpuslens.operators import themes as TH


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(0, 5, 0, 2.0), (0, 5, 1, 1.0), (1, 3, 1, 3.0), (2, 4, 2, 1.0), (2, 4, 0, 1.0), (3, 2, 3, 2.0)]
    return spark.createDataFrame(rows, "doc_id long, n_words long, topic_id int, tf double")


def test_tfidf_matches_formula(spark, counts):
    n = 5   # one document has no topic at all
    got = {(r["doc_id"], r["topic_id"]): r["value"] for r in G.tfidf_features(counts, n).collect()}
    df = {0: 2, 1: 2, 2: 1, 3: 1}
    raw = {(r["doc_id"], r["topic_id"]): r["tf"] * (math.log((1 + n) / (1 + df[r["topic_id"]])) + 1)
           for r in counts.collect()}
    for d in {k[0] for k in raw}:
        nrm = math.sqrt(sum(v * v for k, v in raw.items() if k[0] == d))
        for k, v in raw.items():
            if k[0] == d:
                assert math.isclose(got[k], v / nrm, rel_tol=1e-12)


def test_row_norms_are_one(spark, counts):
    for norm, fn in (("l2", lambda v: math.sqrt(sum(x * x for x in v))), ("l1", lambda v: sum(abs(x) for x in v))):
        f = G.tf_features(counts, norm)
        per = {}
        for r in f.collect():
            per.setdefault(r["doc_id"], []).append(r["value"])
        assert all(math.isclose(fn(v), 1.0) for v in per.values())


def test_svd_loadings_orthonormal_and_lsa_rows_unit(spark):
    rng = np.random.default_rng(0)
    rows = [(int(d), int(t), float(rng.random())) for d in range(60) for t in range(12) if rng.random() < 0.5]
    feats = spark.createDataFrame(rows, "doc_id long, topic_id int, value double")
    lsa, model = SV.lsa(feats, 12, 4, feats.select("doc_id").distinct())
    v = model.loadings
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8)
    assert np.all(v[np.argmax(np.abs(v), axis=0), np.arange(4)] > 0)        # sign rule
    norms = [float(np.linalg.norm(r["features"].toArray())) for r in lsa.collect()]
    assert all(math.isclose(x, 1.0, rel_tol=1e-9) or x == 0.0 for x in norms)
    x = np.zeros((60, 12))
    for d, t, val in rows:
        x[d, t] = val
    s = np.linalg.svd(x, compute_uv=False)[:4]
    assert np.allclose(np.sort(model.sigma)[::-1], s, rtol=1e-6)
    proj = np.array([r["features"].toArray() for r in lsa.orderBy("doc_id").collect()])
    ev = SV.explained_variance_of(lsa).first()
    assert math.isclose(ev["total_variance"], float(proj.var(axis=0).sum()), rel_tol=1e-9)
    sc = SV.scree(feats, 12, 4).orderBy("component").collect()
    assert np.allclose([r["sigma"] for r in sc], s, rtol=1e-6)
    assert math.isclose(sum(r["share"] for r in sc), 1.0)


def _blobs(spark, k=3, n=40, d=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 20, size=(k, d))
    rows = []
    for i in range(k * n):
        c = i % k
        rows.append((i, c, [float(x) for x in centres[c] + rng.normal(0, 0.5, size=d)]))
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def test_kmeans_recovers_blobs_and_labels_stable(spark):
    from pyspark.ml.functions import array_to_vector
    e = _blobs(spark)
    v = e.select(F.col("vec_id").alias("doc_id"), array_to_vector("embedding").alias("features"))
    lab, _ = KM.kmeans_fit(v, 3, seed=2)
    lab2, _ = KM.kmeans_fit(v.repartition(3), 3, seed=2)
    truth = {r["vec_id"]: r["label"] for r in e.collect()}
    got = {r["doc_id"]: r["label"] for r in lab.collect()}
    pairs = {(truth[i], got[i]) for i in truth}
    assert len(pairs) == 3                                  # one-to-one
    assert got == {r["doc_id"]: r["label"] for r in lab2.collect()}


def test_kmeans_step_from_true_labels_is_fixed_point(spark):
    e = _blobs(spark)
    out = KM.kmeans_step(e, "label", "embedding", "vec_id")
    assert {r["n_points"] for r in out.collect()} == {40}


def test_silhouette_closed_form_equals_brute_force(spark):
    e = _blobs(spark, k=3, n=8, d=3, seed=5)
    got = KM.silhouette_sq(e, "label", "embedding").first()["silhouette"]
    pts = [(r["label"], np.array(r["embedding"])) for r in e.collect()]
    s = []
    for li, x in pts:
        dist = {}
        for lj, y in pts:
            dist.setdefault(lj, []).append(float(((x - y) ** 2).sum()))
        own = dist[li]
        a = sum(own) / (len(own) - 1)
        b = min(sum(v) / len(v) for l, v in dist.items() if l != li)
        s.append((b - a) / max(a, b))
    assert math.isclose(got, sum(s) / len(s), rel_tol=1e-9)


@pytest.mark.parametrize("kind", ["diag", "spherical", "tied"])
def test_em_loglik_does_not_fall_and_probs_sum_to_one(spark, kind):
    e = _blobs(spark, k=3, n=30, d=3, seed=3).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("features"))
    p = GM.gmm_fit(e, 3, kind, seed=1, max_iter=15, tol=1e-9)
    h = p.history
    assert all(b >= a - 1e-7 for a, b in zip(h, h[1:]))
    probs = GM.gmm_predict(e, p, long_form=True).groupBy("doc_id").agg(F.sum("p").alias("s")).collect()
    assert all(math.isclose(r["s"], 1.0, rel_tol=1e-9) for r in probs)
    ab = GM.aic_bic(e, p).first()
    assert ab["n_params"] == p.n_parameters()
    assert math.isclose(ab["aic"], -2 * ab["loglik"] + 2 * ab["n_params"])


def test_parameter_counts():
    k, d = 4, 3
    m = np.zeros((k, d))
    assert GM.GmmParams("full", np.ones(k) / k, m, None).n_parameters() == k * d * (d + 1) // 2 + k * d + k - 1
    assert GM.GmmParams("diag", np.ones(k) / k, m, None).n_parameters() == 2 * k * d + k - 1
    assert GM.GmmParams("tied", np.ones(k) / k, m, None).n_parameters() == d * (d + 1) // 2 + k * d + k - 1
    assert GM.GmmParams("spherical", np.ones(k) / k, m, None).n_parameters() == k + k * d + k - 1


def test_split_is_deterministic_and_disjoint(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    tr, te = KM.train_test_split(df, 0.25, seed=9)
    a, b = {r[0] for r in tr.collect()}, {r[0] for r in te.collect()}
    assert not a & b and len(a | b) == 2000 and 400 < len(b) < 600
    _, te2 = KM.train_test_split(df.repartition(7), 0.25, seed=9)
    assert b == {r[0] for r in te2.collect()}


def test_themes_from_centres_inverse_transform(spark):
    loadings = np.array([[1.0, 0.0], [0.0, 1.0], [0.7, 0.7]])
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "label int, centre array<double>")
    topics = spark.createDataFrame([(0, "alpha"), (1, "beta"), (2, "gamma")], "topic_id int, phrase string")
    th = {(r["label"], r["rank"]): r["phrase"] for r in TH.themes_from_centres(centres, topics, loadings, 2).collect()}
    assert th == {(0, 0): "alpha", (0, 1): "gamma", (1, 0): "beta", (1, 1): "gamma"}
    wide = TH.themes_wide(TH.themes_from_centres(centres, topics, loadings, 2), 2).orderBy("label").collect()
    assert [r["phrase_0"] for r in wide] == ["alpha", "beta"]
