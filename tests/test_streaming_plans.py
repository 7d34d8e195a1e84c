"""Streaming equals batch, and what the plans of operators on raw tables hold."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from corpuslens.functions import text as TF
from corpuslens.operators import citations as H
from corpuslens.operators import features as G
from corpuslens.operators import filters as FL
from corpuslens.operators import rake as R
from corpuslens.operators import text as TX
from corpuslens.operators import vocab as V
from corpuslens.plans.corpus_flow import CorpusFlow, Flows, FlowParams, prepared_docs, read
from corpuslens.sources.corpus import default_stop_words
from corpuslens.streaming import text_stream as TS

SF = "/root/testdata/sf0.001"


def test_streaming_term_counts_equal_batch(spark):
    d = tempfile.mkdtemp(prefix="cl-stream-")
    docs = read(spark, SF, "documents").select("doc_id", "source", "text")
    docs.repartition(3).write.mode("overwrite").parquet(d + "/in")
    stream = TS.stream_corpus(spark, d + "/in", docs.schema, ["source", "text"], max_files_per_trigger=1)
    q = TS.start(TS.running_term_counts(stream), d + "/out", "complete")
    q.processAllAvailable()
    q.stop()
    last = max(int(x) for x in re.findall(r"batch=(\d+)", str([r[0] for r in spark.read.format("binaryFile").load(d + "/out/*").select("path").collect()])))
    got = {r["term"]: (r["frequency"], r["docs"]) for r in spark.read.parquet(f"{d}/out/batch={last}").collect()}
    b = TX.stem_tokens(TX.tokenize(TX.build_corpus(docs, ["source", "text"])).select("doc_id", "tokens"), "s")
    ex = b.select("doc_id", F.explode("stems").alias("term"))
    want = {r["term"]: (r["f"], r["d"]) for r in
            ex.groupBy("term").agg(F.count(F.lit(1)).alias("f"), F.countDistinct("doc_id").alias("d")).collect()}
    assert got == want


def test_a_stream_takes_column_stemmers_only(spark):
    with pytest.raises(ValueError):
        TS.stream_corpus(spark, SF, "doc_id long, text string", ["text"], stemmer="porter2")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def raw(spark):
    """Operators on raw tables, nothing written in between."""
    docs = prepared_docs(spark, SF)
    words = read(spark, SF, "part").select(F.explode(F.split("p_name", " ")).alias("stem"))  # a vocabulary of its own
    post = FL.postings(docs, words)
    cites = read(spark, SF, "lineitem").select(F.col("l_orderkey").alias("citing_uid"), F.col("l_partkey").alias("cited_uid"))
    counts = post.select("doc_id", "n_words", F.hash("term").alias("topic_id"), F.col("tf").cast("double").alias("tf"))
    return {
        "tokens": TX.tokenize(TX.build_corpus(read(spark, SF, "documents"), ["source", "text"])).select("doc_id", "tokens"),
        "word_vocab": V.word_vocabulary(docs),
        "postings": post,
        "norm_freq": FL.norm_frequency(post, 100.0),
        "term_corr": FL.term_correlation(post, 200, 100.0, 0.7),
        "rake": R.rake_phrases(docs, R.stop_word_list(default_stop_words(spark))),
        "tfidf": G.tfidf_features(counts, 200),
        "related": H.related_records(cites, read(spark, SF, "orders").select("o_orderkey")),
        "impact": H.normalised_impact(read(spark, SF, "lineitem"), "l_quantity", ["l_returnflag"]),
    }


# Exchanges in the plan before it runs (broadcasts among them), and scans.
EXCHANGES = {"tokens": 0, "word_vocab": 2, "postings": 4, "norm_freq": 5, "rake": 1, "impact": 2, "related": 7}


@pytest.mark.parametrize("key", ["tokens", "word_vocab", "postings", "norm_freq", "term_corr", "rake", "tfidf", "related", "impact"])
def test_plans_are_relational(raw, key):
    plan = _plan(raw[key])
    assert "Scan parquet" in plan or "FileScan parquet" in plan  # a raw table, not a stage
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("key", sorted(EXCHANGES))
def test_exchanges(raw, key):
    n = len(re.findall(r"(?<!Reused)Exchange ", _plan(raw[key])))
    assert n <= EXCHANGES[key], _plan(raw[key])


def test_substring_frequency_shuffles_counts_only(spark):
    docs = TX.tokenize(TX.build_corpus(read(spark, SF, "documents"), ["source", "text"])).select("doc_id", "tokens")
    terms = spark.createDataFrame([("the",), ("tion",), ("of the",)], "stem string")
    plan = _plan(FL.substring_doc_freq(TX.stem_tokens(docs, "s"), terms))
    assert len(re.findall(r"Exchange ", plan)) <= 3
    assert "Exchange" not in plan[plan.index("MapInPandas"):]  # the documents stay where they are read


def test_search_pushes_its_filter_and_columns(spark):
    pubs = read(spark, SF, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("edition"),
                                            F.col("o_orderpriority").alias("title"))
    plan = _plan(H.record_search(pubs, ["title"], "urg*", editions=["F"]).select("uid"))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan)[1]
    assert "EqualTo(o_orderstatus,F)" in pushed or "In(o_orderstatus" in pushed
    assert "o_totalprice" not in re.search(r"ReadSchema: (\S+)", plan)[1]


def test_entry_and_registry(spark):
    out = E.entry(spark)
    assert set(out.columns) == {"label", "rank", "topic_id", "phrase", "weight"}
    assert out.groupBy("label").count().where("count > 10").count() == 0 and out.count() > 20
    assert set(E.oracle_sql()) <= set(E.queries())


def test_flows_follow_the_files(spark):
    d = tempfile.mkdtemp(prefix="cl-flow-")
    docs = read(spark, SF, "documents")
    docs.limit(20).write.parquet(f"{d}/documents.parquet")
    flows = Flows()
    first = flows.of(spark, d)
    assert first is flows.of(spark, d) and first.stats[0] == 20
    docs.limit(30).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    assert flows.of(spark, d).stats[0] == 30


def test_every_document_is_in_the_flow(spark):
    assert CorpusFlow.of_tables(spark, SF).stats[0] == read(spark, SF, "documents").count()


def test_topic_model_end_to_end(spark):
    from corpuslens.plans import topic_model as TM
    flow = CorpusFlow.of_tables(spark, SF, FlowParams(n_topics=40, stemmer="porter2"))
    res = TM.run(flow, TM.ModelParams(lsa_components=8, k_means=4, gmm_components=3, n_words=5, seed=1))
    n_docs = read(spark, SF, "documents").count()
    assert res.km_labels.count() == n_docs and res.gm_labels.count() == n_docs and res.vectors.count() == n_docs
    assert res.km_themes.groupBy("label").count().where("count > 5").count() == 0
    assert set(res.labelled.columns) == {"doc_id", "corpus", "corpus_stemmed", "km_label", "gm_label"}
    assert res.labelled.where("km_label IS NULL OR gm_label IS NULL").count() == 0 and res.labelled.count() == n_docs
    assert res.km_map.count() == 4 and res.gm_map.count() <= 3
    assert "doc_count" in res.gm_map.columns and "phrase_0" in res.gm_map.columns


def test_topic_model_without_lsa_or_mixture(spark):
    from corpuslens.plans import topic_model as TM
    docs = spark.createDataFrame([(f"d{i}", "red green blue red" if i % 2 else "cat dog bird cat") for i in range(40)], "uid string, text string")
    flow = CorpusFlow.of_corpus(docs, ["text"], FlowParams(min_freq=1, max_doc_fraction=0.9, cc_threshold=5.0, corr_threshold=2.0), id_col="uid")
    res = TM.run(flow, TM.ModelParams(lsa_components=None, gmm_covariance=None, k_means=2, n_words=2))
    assert res.gm_labels is None and res.labelled.count() == 40
    got = {(r["doc_id"][1:], r["km_label"]) for r in res.labelled.collect()}
    assert len({lab for i, lab in got if int(i) % 2}) == 1 and len({lab for _, lab in got}) == 2


def test_word_ngram_helper_is_bounded():
    with pytest.raises(ValueError):
        TF.ngrams("x", 3, 2)
