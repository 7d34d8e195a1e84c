"""Searches over the index against scans of the same rows."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import citations as H
from corpuslens.operators import index as IX
from corpuslens.operators import search as E

TEXTS = [
    None, "", " \t ", "Urgent: not specified", "urgently NOT  SPECIFIED!", "not-specified low", "Low lot LOT lows", "x", "A b\nc",
    "été ÉTÉ naïve", "ſmall Small", "snake_case word", "the the then the", "the. the", "𝄞 clef 𝄞", "c++ and C# 100% x-ray",
    "z" * 3000 + "abc" + "y" * 3000, "a a a a b", "not spec", "tab\tnot\tspecial",
]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    words = ["th", "the", "then", "low", "lot", "urgent", "Urge", "not", "spec", "special", "a", "é"]
    more = [" ".join(r.choice(words) + r.choice(["", "", ",", "-"]) for _ in range(r.randint(0, 12))) for _ in range(120)]
    texts = TEXTS + more
    return spark.createDataFrame([(f"id{i}", t, texts[-i - 1]) for i, t in enumerate(texts)], "doc_id string, text string, title string")


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def spaces(rows):
    return IX.build_index(rows, tempfile.mkdtemp(prefix="cl-ix-"), ["text"], "doc_id", "spaces", buckets=7)


@pytest.fixture(scope="module")
def words(rows):
    return IX.build_index(rows, tempfile.mkdtemp(prefix="cl-ix-"), ["text", "title"], "doc_id", "words", buckets=7)


@pytest.mark.parametrize("search", ["the", "THE low", "e", "é", "hen ot", "++ 100%", "zabcy", "no such", "𝄞", "a b c", "x-r", "ified!", "the the"])
def test_substrings(rows, spaces, search):
    assert ids(IX.search_indexed(spaces, search)) == ids(E.search_ids(rows, "text", search))


TREES = [
    "urgent", "URG*", "*ow", "lo?", "?", "*", "*e*", "x", "snake_case", "sn*_case", "zz*yy", "nowhere", "été", "low urg*",
    '"not spec*"', '"the the"', '"the then the"', '"a a a b"', '"th* lo? not"', '"t?e *ow" urge',
    H.any_word("low", H.all_of("not", "spec*")), H.all_of(H.any_word('"not spec*"', "urg?nt"), "*", H.any_word("the", "a")), H.all_of("the", "the"),
]


@pytest.mark.parametrize("query", TREES, ids=str)
def test_words_phrases_trees(rows, words, query):
    assert ids(IX.record_search_indexed(words, query, id_col="doc_id")) == ids(H.record_search(rows, ["text", "title"], query))


def test_any_of(rows, words):
    got = IX.record_search_indexed(words, "low urgent", any_of=True, id_col="doc_id")
    assert ids(got) == ids(H.record_search(rows, ["text", "title"], "low urgent", any_of=True))


def test_phrases_do_not_cross_columns(spark):
    df = spark.createDataFrame([(1, "end low", "urgent start")], "doc_id long, text string, title string")
    index = IX.build_index(df, tempfile.mkdtemp(prefix="cl-ix-"), ["text", "title"], "doc_id")
    assert ids(IX.record_search_indexed(index, '"low urgent"', id_col="doc_id")) == []
    assert ids(IX.record_search_indexed(index, '"urgent start"', id_col="doc_id")) == [1]


def test_documents_are_added(rows, spark):
    path = tempfile.mkdtemp(prefix="cl-ix-")
    half = F.crc32("doc_id") % 2 == 0
    IX.build_index(rows.where(half), path, ["text"], "doc_id", "spaces", buckets=5)
    index = IX.build_index(rows.where(~half), path, ["text"], "doc_id", "spaces", buckets=5, mode="append")
    assert ids(IX.search_indexed(index, "the lo")) == ids(E.search_ids(rows, "text", "the lo"))


def test_only_the_buckets_of_the_terms_are_read(words):
    def read_by(df):
        files = {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
        return len(files), plan[plan.index("PartitionFilters"):].split("]")[0]

    every, _ = read_by(words.postings)
    some, filters = read_by(IX._postings_of(words, "urgent"))
    assert 0 < some <= every / 4 and "bucket" in filters
    _, filters = read_by(IX._of_tokens(words, words.spark.createDataFrame([("urgent",), ("low",)], "token string")))
    assert "bucket" in filters
    plan = IX._tokens_with(words, ["\x01urg"], F.col("token").startswith("urg"))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan[plan.index("PartitionFilters"):].split("]")[0]
    again = IX.open_index(words.spark, words.path)
    assert again == words


def test_refused(words, spaces, rows):
    for query in ("x-ray", '"a * b"', '""', ""):
        with pytest.raises(ValueError):
            IX.record_search_indexed(words, H.all_of(query))
    with pytest.raises(ValueError):
        IX.search_indexed(words, "low")
    with pytest.raises(ValueError):
        IX.search_indexed(spaces, "  ")
    with pytest.raises(ValueError):
        IX.build_index(rows, "/nowhere", ["text"], kind="lines")
    with pytest.raises(ValueError):
        IX.build_index(rows, words.path, ["text"], kind="spaces", mode="append")


def test_empty_table(rows):
    index = IX.build_index(rows.limit(0), tempfile.mkdtemp(prefix="cl-ix-"), ["text"], "doc_id", "words")
    assert index.postings.count() == 0 and ids(IX.record_search_indexed(index, "low", id_col="doc_id")) == []


def test_positions_are_gathered_where_a_document_is_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "b a  B", "a"), (2, None, "a-b"), (None, "a", "a"), (3, " ", None)], "doc_id long, text string, title string")
    rows = IX._token_rows(df, ["text", "title"], "doc_id", "words")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    step = IX.COLUMN_STEP
    want = {(1, "a", (1, step)), (1, "b", (0, 2)), (2, "a", (step,)), (2, "b", (step + 2,))}
    assert {(r["id"], r["token"], tuple(r["positions"])) for r in rows.collect()} == want
    index = IX.build_index(df, str(tmp_path / "ix"), ["text", "title"])
    assert {(r["id"], r["token"], tuple(r["positions"])) for r in index.postings.collect()} == want


def test_a_task_writes_no_more_as_the_texts_grow(spark, monkeypatch):
    df = spark.createDataFrame([(1, "é" * 100), (2, None)], "doc_id long, text string")
    assert IX._spread(df, ["text"], 4) == (IX.SPREAD, 1)
    monkeypatch.setattr(IX, "TASK_BYTES", 5)
    assert IX._spread(df, ["text"], 4) == (40, 40)
    assert IX._spread(df.limit(0), ["text"], 4) == (IX.SPREAD, 0)


@pytest.mark.parametrize("token", ["a", "ab", "aaaa", "été", "𝄞a", "ab" * 32, "ab" * 32 + "c", "x" * 300])
def test_runs_of_short_and_long_tokens(spark, token):
    marked = IX.MARK + token + IX.MARK
    got = spark.createDataFrame([(token,)], "t string").select(IX._grams(F.col("t"))).first()[0]
    assert sorted(got) == sorted({marked[i:i + 3] for i in range(len(marked) - 2)})
