"""What the flow holds on disk at once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuslens import session
from corpuslens.operators import filters as FL
from corpuslens.operators import postings as PO
from corpuslens.operators import vocab as V
from corpuslens.plans import corpus_flow
from corpuslens.plans.corpus_flow import CorpusFlow
from corpuslens.plans.queries import FLOW
from corpuslens.sources.corpus import default_stop_words


def _docs(spark):
    rows = [(i, "s", "Wolf bear " * (i % 2 * (1 + i % 4)) + f"only{i} grey wolf. Tundra fox, été {i} white owl; snow owl") for i in range(12)]
    return spark.createDataFrame(rows + [(3, "t", "wolf wolf ponies pony"), (None, None, None)], "doc_id long, source string, text string")


@pytest.fixture
def many_passes(monkeypatch):
    monkeypatch.setattr(session, "PASS_ROWS", 4)


def test_passes_grow_with_the_rows_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(session, "PASS_ROWS", 10)
    assert [session.passes_of(n) for n in (0, 10, 11, 35, 10**9)] == [1, 1, 2, 4, session.MOST_PASSES]


def test_a_job_in_passes_gives_the_rows_of_one_pass(spark):
    df = spark.createDataFrame([(None if i % 9 == 0 else f"k{i % 9}", i) for i in range(40)], "k string, x int")
    cuts = []

    def make(part):
        cuts.append(part(df, "k"))
        return cuts[-1].groupBy("k").agg(F.sum("x").alias("s"))

    for passes in (1, 3):
        assert sorted(map(repr, session.stage_in_passes(spark, make, passes).collect())) == sorted(
            map(repr, df.groupBy("k").agg(F.sum("x").alias("s")).collect()))
    assert sum(c.count() for c in cuts[1:]) == 40 and all(c.count() < 40 for c in cuts[1:])


def test_the_flow_in_passes_equals_whole_joins(spark, many_passes):
    flow = CorpusFlow.of_corpus(_docs(spark), ["source", "text"])
    n, _ = flow.stats
    assert session.passes_of(flow.vocab.count()) > 1
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(flow.totals) == rows(FL.term_totals(flow.near))
    known = flow.near.join(flow.vocab.select(F.col("stem").alias("term")), "term", "left_semi").select(*flow.near.columns)
    assert rows(flow.postings) == rows(known)
    whole = FL.freq_filter(flow.vocab, flow.near, n)
    assert rows(flow.freq_kept) == rows(FL.kept_only(whole)) and flow.freq_kept.count() > 0
    assert FLOW["top_by"](flow).collect() == FL.top_by(whole, "frequency", 50).select("stem", "frequency").collect()


def test_kept_terms_are_found_without_a_shuffle_of_the_vocabulary(spark, many_passes, monkeypatch):
    """Below the limits, neither the vocabulary nor all totals meet in whole."""
    flow, met = CorpusFlow.of_corpus(_docs(spark), ["source", "text"]), []
    real = FL.freq_filter
    monkeypatch.setattr(FL, "freq_filter", lambda vocab, post, *a, **k: met.append((vocab.count(), post.count())) or real(vocab, post, *a, **k))
    frequent = flow.totals.where("frequency > 5").count()
    assert flow.freq_kept.count() and met == [(frequent, frequent)]
    assert frequent < flow.vocab.count()


def test_one_word_phrases_change_no_row_of_the_vocabulary(spark):
    docs = corpus_flow.prepare(_docs(spark), ["source", "text"])
    args = (docs, default_stop_words(spark))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(V.create_vocabulary(*args, tokens_of_col=True)) == rows(V.create_vocabulary(*args))
    # a word without an ASCII letter is no token: it stays a phrase
    lone = spark.createDataFrame([(1, "ёж. wolf")], "doc_id long, text string")
    held = V.create_vocabulary(corpus_flow.prepare(lone, ["text"]), default_stop_words(spark), tokens_of_col=True)
    assert {(r["stem"], r["source_rank"]) for r in held.collect()} == {("wolf", 0), ("ёж", 1)}


def test_the_bits_of_a_step_leave_with_it(spark, monkeypatch):
    gone, made = [], []
    kind = type(spark.sparkContext.broadcast(1))
    real, make = kind.destroy, spark.sparkContext.broadcast
    monkeypatch.setattr(kind, "destroy", lambda self, *a: gone.append(self) or real(self, *a))
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: made.append(make(v)) or made[-1])
    docs = corpus_flow.prepare(_docs(spark), ["source", "text"])
    vocab = spark.createDataFrame([("wolf",), ("wolf bear",)], "stem string")
    near = PO.written_near_postings(docs, vocab)
    occ = FL.substring_doc_freq(docs, vocab, written=True)
    assert len(made) == 2 and gone == made
    assert sorted(near.collect()) == sorted(PO.near_postings(docs, vocab).collect()) and near.count() > 0
    assert sorted(occ.collect()) == sorted(FL.substring_doc_freq(docs, vocab).collect())
