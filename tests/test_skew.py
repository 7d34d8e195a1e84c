"""Dictionary stemming and joins where a few keys hold most rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions.porter2 import stem
from corpuslens.operators import skew
from corpuslens.operators import text as TX


@pytest.fixture
def docs(spark):
    r = random.Random(1)
    rows = [(i, ["the"] * r.randint(0, 5) + r.choices(["running", "flies", "boxes", "the", f"rare{i}s"], k=r.randint(0, 8))) for i in range(60)]
    rows += [(100, []), (101, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, tokens array<string>")


@pytest.mark.parametrize("floor", [1, 30, 10_000])
def test_porter2_whatever_is_hot(docs, monkeypatch, floor):
    monkeypatch.setattr(skew, "HOT_FLOOR", floor)
    rows, df = docs
    got = {r["doc_id"]: r["stems"] for r in TX.stem_tokens(df, "porter2").collect()}
    assert got == {i: [stem(t) for t in (tokens or [])] for i, tokens in rows}


def test_hot_tokens_are_not_shuffled_by_token(docs, monkeypatch):
    monkeypatch.setattr(skew, "HOT_FLOOR", 30)
    _, df = docs
    plan = TX.stem_tokens(df, "porter2")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "LeftAnti" in plan and "Union" in plan


def test_given_dictionary(spark, docs):
    rows, df = docs
    given = spark.createDataFrame([("the", "T"), ("boxes", "box")], "token string, stem string")
    got = {r["doc_id"]: r["stems"] for r in TX.stem_tokens(df, "given", dictionary=given).collect()}
    held = {"the": "T", "boxes": "box"}
    assert got == {i: [held.get(t) for t in (tokens or [])] for i, tokens in rows}


def test_join_by_weight(spark):
    big = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 50 + ["b"] * 3 + ["c", None, "z"])], "k string, i long")
    table = spark.createDataFrame([("a", 1, 50), ("b", 2, 3), ("c", 3, 1)], "k string, v int, n long")
    for floor in (1, 10, 1000):
        skew.HOT_FLOOR, before = floor, skew.HOT_FLOOR
        try:
            inner = skew.join_by_weight(big, table, "k", "n")
            left = skew.join_by_weight(big, table, "k", "n", "left")
            assert inner.columns == ["k", "i", "v"]
            assert sorted(map(tuple, inner.collect())) == sorted(map(tuple, big.join(table.drop("n"), "k").collect()))
            assert left.count() == 56 and left.where("v IS NULL").count() == 2
        finally:
            skew.HOT_FLOOR = before
    with pytest.raises(ValueError):
        skew.join_by_weight(big, table, "k", "n", "full")


def test_counted_items(spark):
    df = spark.createDataFrame([(["b", "a", None, "b", "é", "b"],), ([],), (None,), ([None],)], "x array<string>")
    got = [None if r[0] is None else [tuple(v) for v in r[0]] for r in df.select(T.counted_items("x")).collect()]
    assert got == [[("a", 1), ("b", 3), ("é", 1)], [], None, []]


def test_ngram_counts_equal_plain(spark, docs):
    rows, df = docs
    want = {}
    for i, tokens in rows:
        tokens = tokens or []
        for n in (1, 2, 3):
            for k in range(len(tokens) - n + 1):
                want.setdefault(" ".join(tokens[k:k + n]), []).append(i)
    got = {r["gram"]: (r["cnt"], r["n_docs"], r["n"]) for r in TX.ngram_counts(df).collect()}
    assert got == {g: (len(v), len(set(v)), g.count(" ") + 1) for g, v in want.items()}
    plan = TX.ngram_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
