"""Spark query vs DuckDB statement on sf0.001 for a representative set of
registered keys (the full set runs with tools/check_oracle.py)."""

import os

import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, _rows

SF = "/root/testdata/sf0.001"
KEYS = ["clean_text", "rake_phrases", "substring_df", "corr_filter", "feat_tfidf", "kmeans_step",
        "gmm_estep_diag", "silhouette", "cluster_map", "related_records", "xml_records", "page_plan",
        "record_search_tree", "impact_null_groups", "doi_duplicates", "kv_records", "corpus_csv", "vocab_file",
        "cc_ratio_token", "corr_filter_both", "lsa_norms", "svd_trace", "themes_wide", "retrieve_after"]


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.fixture(scope="module")
def queries():
    return E.queries()


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, duck, queries, key):
    sp = queries[key](spark, SF).toPandas()
    dd = duck.execute(E.oracle_sql()[key]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    cols = sorted(sp.columns)
    assert len(sp) == len(dd)
    assert _rows(sp, cols) == _rows(dd, cols)
