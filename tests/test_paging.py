"""Pages at any offset against a sort of everything."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import citations as H
from corpuslens.operators import paging as PG


def test_ranges_of_page():
    counts = {0: 5, 1: 0, 2: 3, 7: 4}
    assert PG.ranges_of_page(counts, 1, 5) == ([0], 0)
    assert PG.ranges_of_page(counts, 5, 2) == ([0, 2], 0) or PG.ranges_of_page(counts, 5, 2) == ([0, 1, 2], 0)
    assert PG.ranges_of_page(counts, 7, 1) == ([2], 5)
    assert PG.ranges_of_page(counts, 9, 100) == ([7], 8)
    assert PG.ranges_of_page(counts, 13, 5) == ([], 0)


@pytest.fixture(scope="module")
def records(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, "a", "a", "a", "b", "c"]), r.random()) for i in range(500)]
    return rows, spark.createDataFrame(rows, "uid long, title string, times_cited double").repartition(4)


@pytest.mark.parametrize(("offset", "count"), [(1, 10), (120, 40), (241, 200), (499, 50), (900, 10), (300, 0)])
@pytest.mark.parametrize("order", ["A", "D"])
def test_deep_pages_equal_a_full_sort(records, offset, count, order):
    rows, df = records
    got = H.retrieve(df, offset, count or 1, "SO", order, {"SO": "title"}, top_rows=0)
    held = [r for r in rows if r[1] is not None]
    by_title = sorted(held, key=lambda r: r[0])
    by_title = sorted(by_title, key=lambda r: r[1], reverse=order == "D")
    want = by_title + sorted(r for r in rows if r[1] is None)
    assert [tuple(r) for r in got.collect()] == want[offset - 1:offset - 1 + (count or 1)]
    shallow = H.retrieve(df, offset, count or 1, "SO", order, {"SO": "title"})
    assert shallow.collect() == got.collect()


def test_a_deep_page_reads_its_ranges_only(spark, records):
    _, df = records
    wide = spark.range(40_000).select(F.col("id").alias("uid"), (F.col("id") % 7).cast("string").alias("title"), F.rand(3).alias("times_cited"))
    got = H.retrieve(wide, 35_000, 20, "SO", "A", {"SO": "title"}, top_rows=1000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan[plan.index("Filter"):] and got.count() == 20
    with pytest.raises(ValueError):
        PG.page(df, ["uid"], [F.asc("uid")], 0)


def test_related_records_cut_before_the_shuffle(spark):
    cites = spark.createDataFrame([(a, r) for a in range(30) for r in range(a % 5, 12)], "citing_uid long, cited_uid long")
    seeds = spark.createDataFrame([(3,), (4,)], "uid long")
    every = H.related_records(cites, seeds)
    some = H.related_records(cites, seeds, 4, offset=3)
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in every.collect() if 3 <= r["rank"] <= 6)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert {r["n_related"] for r in every.collect()} == {29}
