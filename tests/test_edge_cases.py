"""One case for every wrong answer that was found by reading."""

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import citations as H
from corpuslens.operators import filters as FL
from corpuslens.operators import gmm as GM
from corpuslens.operators import rake as R
from corpuslens.operators import search as S
from corpuslens.operators import svd as SV
from corpuslens.operators import themes as TH
from corpuslens.sources import corpus as SC
from corpuslens.sources import xml as SX


def test_lsa_keeps_documents_without_topics(spark):
    feats = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 2.0), ("b", 1, 1.0), ("c", 2, 1.0)], "uid string, topic_id int, value double")
    every = spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "uid string")
    out, model = SV.lsa(feats, 3, 2, every, id_col="uid")
    got = {r["uid"]: r["features"].toArray() for r in out.collect()}
    assert set(got) == {"a", "b", "c", "none"} and not got["none"].any()
    x = np.array([[1, 0, 2], [0, 1, 0], [0, 0, 1.0]])
    assert np.allclose(model.sigma, np.linalg.svd(x)[1][:2])
    want = x @ model.loadings
    for i, k in enumerate("abc"):
        n = np.linalg.norm(want[i])
        assert np.allclose(got[k], want[i] / n if n > 1e-12 else 0, atol=1e-9)


@pytest.mark.parametrize("block", [3, 32])
def test_singular_values_equal_numpy(spark, block):
    r = np.random.default_rng(5)
    x = np.where(r.random((60, 45)) < 0.2, r.normal(size=(60, 45)), 0.0)
    x[:, 44] = x[:, 43]  # not of full rank
    rows = [(i, j, float(x[i, j])) for i in range(60) for j in range(45) if x[i, j]]
    feats = SV.document_rows(spark.createDataFrame(rows, "doc_id long, topic_id int, value double"))
    want = np.linalg.svd(x)[1]
    for k in (5, 45):
        s, v = SV.top_singular(feats, 45, k, block=block)
        assert np.allclose(s, want[:k], atol=1e-6) and np.allclose(v.T @ v, np.eye(k), atol=1e-8)


@pytest.mark.parametrize("values", [[0, 10, 20, 30], [5], [1, 2, 3], [7, 7, 7, 9], list(range(1000)), [0.5] * 99 + [1.5] * 101, [None, 4.0, 2.0]])
def test_median_is_exact(spark, values):
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g in ("a", None) for v in values], "g string, x double")
    got = {r["g"]: r["median"] for r in TH.exact_median(df, "g", "x").collect()}
    want = float(np.median([v for v in values if v is not None]))
    assert got == {"a": want, None: want}


def test_correlation_of_flat_terms(spark):
    post = [(d, 7, "flat", 3) for d in range(6)] + [(d, 7, "also", 3) for d in range(6)] + [(0, 7, "x", 1), (1, 7, "x", 2)]
    df = spark.createDataFrame(post, "doc_id long, n_words long, term string, tf long")
    assert FL.term_correlation(df, 6, 7.3, 0.7).count() == 0
    assert all(r["corr"] is None for r in FL.term_correlation(df, 6, 7.3).where("t2 = 'flat' OR t1 = 'flat'").collect())
    vocab = spark.createDataFrame([("flat", 0.1), ("also", 0.2), ("x", 0.3)], "stem string, cc_ratio double")
    assert FL.corr_filter(vocab, df, 6, 7.3).where("kept").count() == 3


def test_expected_documents_at_large_n(spark):
    df = spark.createDataFrame([("w", 3.0, 3)], "t string, f double, n long")
    r = df.select(FL.cc_ratio_col(F.col("n"), F.col("f"), 10 ** 11, F.col("t")).alias("r")).first()["r"]
    assert math.isclose(r, 3 / 2.99999999997, rel_tol=1e-13)


def test_impact_of_null_groups(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 4.0), (3, "a", 5.0), (4, "a", None)], "id long, g string, tc double")
    got = {r["id"]: r["impact"] for r in H.normalised_impact(df, "tc", ["g"]).collect()}
    assert got == {1: 2 / 3, 2: 4 / 3, 3: 1.0, 4: None}


def test_phrase_wildcards_and_query_trees(spark):
    pubs = spark.createDataFrame([(1, "solar cells today"), (2, "solar  celluloid"), (3, "wind review"), (4, "wind or water"), (5, "Étude des cellules")], "uid long, title string")
    ids = lambda q, **k: sorted(r["uid"] for r in H.record_search(pubs, ["title"], q, **k).collect())
    assert ids('"solar cell*"') == [1, 2] and ids('"solar cell"') == [] and ids('"sol?r cells"') == [1]
    assert ids(H.all_of("wind", H.any_word("review", "water"))) == [3, 4]
    assert ids(H.any_word('"solar cells"', H.all_of("wind", "review"))) == [1, 3]
    assert ids("étude") == [5]


def test_one_record_per_doi(spark):
    pubs = spark.createDataFrame([("WOS:2", "10.1/x"), ("WOS:1", "10.1/x"), ("WOS:9", None)], "uid string, doi string")
    dois = spark.createDataFrame([("10.1/x",), ("10.1/y",), (None,)], "doi string")
    got = sorted((r["doi"] or "", r["uid"]) for r in H.doi_to_uid(dois, pubs).collect())
    assert got == [("", None), ("10.1/x", "1"), ("10.1/y", None)]


def test_multi_word_stop_entries(spark):
    docs = spark.createDataFrame([(1, "fast proposed method works, the proposed methods fail")], "doc_id long, corpus string")
    got = {r["phrase"] for r in R.rake_phrases(docs, ["the", "proposed method", "proposed"]).collect()}
    assert got == {"fast", "works", "methods fail"}
    assert {r["phrase"] for r in R.rake_phrases(docs, ["the"]).collect()} == {"fast proposed method works", "proposed methods fail"}


def test_regex_search_of_accented_capitals(spark):
    df = spark.createDataFrame([(1, "ÉTUDE longue"), (2, "etude"), (3, None)], "doc_id long, text string")
    for word in ("É", "é", "étude"):
        assert [r["doc_id"] for r in S.search_ids(df, "text", word, regex=True).collect()] == [1]
        assert [r["doc_id"] for r in S.search_ids(df, "text", word).collect()] == [1]


def test_a_uid_twice_on_a_page(spark):
    d = tempfile.mkdtemp(prefix="cl-merge-")
    rec = "<REC><UID>{}</UID><static_data><summary><pub_info pubyear=\"{}\"/></summary></static_data></REC>"
    for i, body in enumerate([rec.format("A", 2001) + rec.format("A", 2001) + rec.format("B", 2001) + rec.format("B", 2002), rec.format("A", 1999)]):
        with open(os.path.join(d, f"p{i}.xml"), "w") as f:
            f.write(f"<records>{body}</records>")
    got = {r["uid"]: r["publication_year"] for r in SX.project_records(SX.merge_pages(SX.read_records(spark, d))).collect()}
    assert got == {"A": 1999, "B": 2002}


def test_strip_namespace(spark):
    x = spark.createDataFrame([('<r xmlns="http://a.b/c" y="1"><k/></r>',)], "x string")
    assert x.select(SX.strip_namespace(F.col("x"))).first()[0] == '<r y="1"><k/></r>'


def test_an_empty_component_is_set_anew(spark):
    pts = [(f"p{i}", [float(i % 2) * 10, 0.1 * (i % 5)]) for i in range(40)] + [("far", [100.0, 100.0])]
    df = spark.createDataFrame(pts, "uid string, features array<double>")
    p = GM.GmmParams("diag", np.array([0.5, 0.5, 1e-300]), np.array([[0.0, 0.2], [10.0, 0.2], [-1e6, -1e6]]), np.ones((3, 2)))
    p = GM._reseed(df, p, np.array([2]), "features", "uid")
    assert p.means[2].tolist() == [100.0, 100.0] and math.isclose(p.weights.sum(), 1.0) and p.weights[2] > 0.1


def test_mixture_of_text_ids_is_ordered_by_size(spark):
    pts = [(f"p{i:03d}", [0.0 + 0.01 * (i % 7), 1.0]) for i in range(60)] + [(f"q{i:03d}", [9.0 + 0.01 * (i % 5), 3.0]) for i in range(30)]
    df = spark.createDataFrame(pts, "uid string, features array<double>")
    p = GM.gmm_fit(df, 2, "diag", seed=3, id_col="uid")
    got = {r["uid"]: r["label"] for r in GM.gmm_predict(df, p, id_col="uid").collect()}
    assert {got[f"p{i:03d}"] for i in range(60)} == {0} and {got[f"q{i:03d}"] for i in range(30)} == {1}


def test_pages_by_the_last_record(spark):
    recs = spark.createDataFrame([(i, None if i % 9 == 0 else float(i % 4)) for i in range(1, 41)], "uid long, tc double")
    for order, field in (("D", "TC"), ("A", "PY")):
        whole = [(r["tc"], r["uid"]) for r in H.retrieve(recs, count=100, sort_field=field, sort_order=order, field_map={field: "tc"}).collect()]
        assert len(whole) == 40
        for at in (0, 7, 30, 36):
            page = H.retrieve(recs, count=5, sort_field=field, sort_order=order, field_map={field: "tc"}, after=whole[at]).collect()
            assert [(r["tc"], r["uid"]) for r in page] == whole[at + 1:at + 6]


def test_created_ids_depend_on_rows_alone(spark):
    d = tempfile.mkdtemp(prefix="cl-ids-")
    spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "t string").repartition(3).write.csv(d, header=True, mode="overwrite")
    one = SC.read_corpus(spark, d, "csv", "t string", create_id=True, check_unique=True)
    two = SC.read_corpus(spark, d, "csv", "t string", create_id=True)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.repartition(5).collect()))
    assert one.select("doc_id").distinct().count() == 4
    with pytest.raises(ValueError):
        SC.read_corpus(spark, d, "csv", "t string", id_col="t", check_unique=True)
