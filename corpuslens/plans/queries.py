"""Registered queries: one per operator group of the blueprint, each over the
whole driver tables, with the DuckDB statement of the same definition.

Floating-point outputs are rounded to 6 decimals on both sides (sums in a
different order differ near 1e-12)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import citations as H
from corpuslens.operators import features as G
from corpuslens.operators import filters as FL
from corpuslens.operators import gmm as GM
from corpuslens.operators import index as IX
from corpuslens.operators import kmeans as KM
from corpuslens.operators import rake as R
from corpuslens.operators import search as E
from corpuslens.operators import silhouette as SH
from corpuslens.operators import sweeps as SW
from corpuslens.operators import text as TX
from corpuslens.operators import themes as TH
from corpuslens.operators import vocab as V
from corpuslens.plans import sql as S
from corpuslens.plans.corpus_flow import CorpusFlow, Flows, prepared_docs, read
from corpuslens.session import new_path, stage
from corpuslens.sources import corpus as C
from corpuslens.sources.corpus import default_stop_words

Query = Callable[[SparkSession, str], DataFrame]


def _iso(c: str) -> F.Column:
    """Dates leave as ISO text so both engines hand over the same type."""
    return F.date_format(F.col(c), "yyyy-MM-dd").alias(c)


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ============================================================ text (B)

def q_clean_text(spark, sf):
    d = TX.build_corpus(read(spark, sf, "documents"), ["source", "text"])
    return d.select("doc_id", "corpus")


def q_tokens(spark, sf):
    d = TX.tokenize(TX.build_corpus(read(spark, sf, "documents"), ["source", "text"]))
    return d.select("doc_id", F.size("tokens").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens_joined"))


def q_doc_lengths(spark, sf):
    d = TX.build_corpus(read(spark, sf, "documents"), ["source", "text"])
    return TX.doc_lengths(d).select("doc_id", "n_words", r6("scale").alias("scale"))


def q_ngrams_count(spark, sf):
    d = prepared_docs(spark, sf)
    return TX.ngram_counts(d, "tokens", 1, 3).select("n", "gram", "cnt", "n_docs")


def q_stem_s(spark, sf):
    d = TX.tokenize(TX.build_corpus(read(spark, sf, "documents"), ["source", "text"]))
    return TX.stem_dictionary(d, "s")


def q_word_vocab(spark, sf):
    return V.word_vocabulary(prepared_docs(spark, sf)).select("phrase", "first_doc", "first_pos")


def q_rake_phrases(spark, sf):
    d = prepared_docs(spark, sf)
    stops = R.stop_word_list(default_stop_words(spark))
    return R.rake_phrases(d, stops).select("doc_id", "phrase", r6("score").alias("score"), "first_pos")


def _vocab_union(spark, sf):
    d = prepared_docs(spark, sf)
    stops = R.stop_word_list(default_stop_words(spark))
    words = V.word_vocabulary(d)
    phrases = R.phrases_in_range(R.rake_phrases(d, stops))
    return V.first_by_stem(TX.stem_terms(V.union_vocabulary(words, phrases), "s", "phrase", "stem"))


def q_vocab_union_first(spark, sf):
    return _vocab_union(spark, sf).select("stem", "phrase", r6("score").alias("score"), "source_rank",
                                          "first_doc", "first_pos")


def q_vocab_stop_anti(f):
    return f.vocab.select("stem", "phrase", r6("score").alias("score"), "source_rank", "first_doc", "first_pos")


# ============================================================ vocabulary filters (D)

def q_postings(f):
    return f.postings.select("doc_id", "term", "tf")


def q_term_freq(f):
    n, _ = f.stats
    return FL.term_stats(f.vocab, f.near, n, totals=f.totals).select("stem", "frequency", "df", r6("fraction").alias("fraction"))


def q_freq_filter(f):
    return f.freq_flagged.select("stem", "frequency", "df", "kept", "reason")


def q_norm_freq(f):
    _, mean = f.stats
    kept = f.seen.join(f.freq_kept.select(F.col("stem").alias("term")), "term", "left_semi")
    return FL.norm_frequency(f.near, mean, kept).select(F.col("term").alias("stem"),
                                                        r6("norm_frequency").alias("norm_frequency"))


def q_substring_df(f):
    return FL.substring_doc_freq(f.docs, f.freq_kept).select("term", "n_occ_doc")


def q_cc_ratio(f):
    return f.cc_flagged.select(
        "stem", r6("norm_frequency").alias("norm_frequency"), "n_occ_doc", r6("cc_ratio").alias("cc_ratio"))


def q_cluster_filter(f):
    return f.cc_flagged.select("stem", "kept", "reason")


def q_term_corr(f):
    return f.correlated.select("t1", "t2", r6("corr").alias("corr"))


def q_corr_filter(f):
    return f.corr_flagged.select("stem", "kept", "reason")


def q_topic_topk(f):
    return f.topics.select("topic_id", "stem", "phrase", r6("cc_ratio").alias("cc_ratio"))


def q_filter_audit(f):
    return FL.filter_audit({"frequency": f.freq_flagged, "cluster": f.cc_flagged,
                            "correlation": f.corr_flagged})


# ============================================================ search (E)

def q_search_rows(spark, sf):
    d = read(spark, sf, "documents")
    return E.search_rows(d, "text", "tion The").select("doc_id", "lang", "source", "n_chars")


def q_search_ids(spark, sf):
    return E.search_ids(read(spark, sf, "conversations"), "text", "ing ON", "conv_id") \
        .groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))


def q_vocab_search(f):
    v = f.vocab
    return E.vocab_search(v, "tion", "phrase", "score").select("stem", "phrase", r6("score").alias("score"))


# ============================================================ features (G)

def q_feat_count(f):
    return f.counts.select("doc_id", "topic_id", "tf")


def q_feat_tf(f):
    return G.tf_features(f.counts, "l2").select("doc_id", "topic_id",
                                                                        r6("value").alias("value"))


def q_feat_tfidf(f):
    n, _ = f.stats
    return G.tfidf_features(f.counts, n, "l2").select("doc_id", "topic_id", r6("value").alias("value"))


def q_l2_normalise(spark, sf):
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(G.l2_normalise_array("embedding")).alias("dim", "value")) \
        .select("vec_id", "dim", r6("value").alias("value"))


def q_explained_var(spark, sf):
    return G.explained_variance(read(spark, sf, "embeddings"), "embedding") \
        .select(r6("total_variance").alias("total_variance"), "n_dims")


def q_distance(spark, sf):
    e = read(spark, sf, "embeddings")
    means = KM.group_means(e, "label", "embedding")
    centre = means.groupBy("label").agg(
        F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("_c")) \
        .select("label", F.col("_c.mean").alias("centre"))
    j = e.join(centre, "label")
    return j.select("vec_id", "label", r6(G.euclidean_distance("embedding", "centre")).alias("dist"))


# ============================================================ clustering (F)

def q_kmeans_step(spark, sf):
    out = KM.kmeans_step(read(spark, sf, "embeddings"), "label", "embedding", "vec_id")
    return out.select("label", "dim", r6("centre").alias("centre"), "n_points")


def q_silhouette(spark, sf):
    return KM.silhouette_sq(read(spark, sf, "embeddings"), "label", "embedding") \
        .select(r6("silhouette").alias("silhouette"))


def q_silhouette_euclidean(spark, sf):
    """F4 with the Euclidean distance, every vector against all others."""
    out = SH.silhouette_points(read(spark, sf, "embeddings"), 1.0)
    return out.select("vec_id", "label", r6("a").alias("a"), r6("b").alias("b"), r6("silhouette").alias("silhouette"))


def q_silhouette_sampled(spark, sf):
    """The mean over half of the vectors, in small blocks."""
    return SH.silhouette_euclidean(read(spark, sf, "embeddings"), 0.5, 7, block=512).select(
        r6("silhouette").alias("silhouette"), "n_points")


def _label_params(e):
    p, labels = GM.params_from_labels(e, "label", "embedding", "diag")
    return p, labels


def q_gmm_estep_diag(spark, sf):
    e = read(spark, sf, "embeddings")
    p, labels = _label_params(e)
    pred = GM.gmm_predict(e, p, "embedding", "vec_id")
    lab = spark.createDataFrame(list(enumerate(labels)), "label int, given int")
    return (pred.join(lab, "label")
            .select("vec_id", F.col("given").alias("label"), r6("p").alias("p"), r6("loglik").alias("loglik")))


def q_aic_bic_given(spark, sf):
    e = read(spark, sf, "embeddings")
    p, _ = _label_params(e)
    return GM.aic_bic(e, p, "embedding").select("n", "n_params", r6("loglik").alias("loglik"),
                                                r6("aic").alias("aic"), r6("bic").alias("bic"))


def q_cluster_sizes(spark, sf):
    d = TX.build_corpus(read(spark, sf, "documents"), ["source", "text"])
    labels = d.select("doc_id", F.col("source").alias("label"))
    return KM.cluster_sizes(labels, d, "label", "corpus")


def q_cluster_themes(f):
    """Documents by their source; the label is the corpus text up to its
    first stop, which is how the flow wrote it."""
    return _themes(f).select("label", "rank", "topic_id", "phrase", r6("weight").alias("weight"))


def _labels(f: CorpusFlow):
    return f.docs.select("doc_id", F.substring_index("corpus", ".", 1).alias("label"))


def _themes(f: CorpusFlow):
    n, _ = f.stats
    return TH.themes_from_labels(G.tfidf_features(f.counts, n, "l2"), _labels(f), f.topics, 10)


def q_themes_wide(f):
    return TH.themes_wide(_themes(f), 3, KM.cluster_sizes(_labels(f), f.docs, "label", "corpus"))


def q_cluster_map(spark, sf):
    """Given coordinates: the norms of either half of an embedding."""
    e = read(spark, sf, "embeddings")
    labels = e.select(F.col("vec_id").alias("doc_id"), "label")
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    half = (F.size("embedding") / 2).cast("int")
    coords = e.select(F.col("vec_id").alias("doc_id"), norm(F.slice("embedding", F.lit(1), half)).alias("x"),
                      norm(F.slice("embedding", half + 1, F.size("embedding"))).alias("y"))
    sizes = KM.cluster_sizes(labels, label_col="label")
    return TH.cluster_map(labels, coords, sizes).select("label", r6("x_median").alias("x_median"),
                                                        r6("y_median").alias("y_median"), "n_mapped", "doc_count")


# ============================================================ citations (H)

def _pubs(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("uid"), F.to_date("o_orderdate").alias("pub_date"),
                    F.year("o_orderdate").alias("pub_year"), F.col("o_orderpriority").alias("title"),
                    F.col("o_orderstatus").alias("edition"), F.col("o_totalprice").alias("times_cited"),
                    F.concat(F.lit("10."), F.col("o_custkey").cast("string"), F.lit("/"),
                             F.col("o_orderkey").cast("string")).alias("doi"))


def _citations(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("citing_uid"),
                                              F.col("l_partkey").alias("cited_uid")).distinct()


def _search(spark, sf):
    return H.record_search(_pubs(spark, sf), ["title"], "urg*", years=[1995, 1996], editions=["F", "O"],
                           time_span=("1995-03-01", "1996-06-30"))


def q_topic_normalised_impact(spark, sf):
    li = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus",
        F.year("l_shipdate").alias("ship_year"))
    out = H.normalised_impact(li, "l_quantity", ["l_returnflag", "ship_year", "l_linestatus"])
    return out.select("l_orderkey", "l_linenumber", r6("impact").alias("impact"))


def q_record_search(spark, sf):
    return _search(spark, sf).select("uid", _iso("pub_date"), "title", "edition")


def q_retrieve_page(spark, sf):
    page = H.retrieve(_search(spark, sf), offset=11, count=50, sort_field="TC", sort_order="D",
                      field_map={"TC": "times_cited"})
    return page.select("uid", "times_cited")


def q_retrieve_count(spark, sf):
    return H.retrieve(_search(spark, sf), count=0)


def q_page_plan(spark, sf):
    return H.page_plan(spark, H.retrieve(_search(spark, sf), count=0), offset=1, limit=100)


def q_retrieve_by_id(spark, sf):
    ids = read(spark, sf, "lineitem").where(F.col("l_quantity") > 45).select("l_orderkey")
    return H.retrieve_by_id(_pubs(spark, sf), ids).select("uid", _iso("pub_date"), "title")


def q_cited_refs(spark, sf):
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("cited_uid"), "p_name", "p_brand")
    refs = H.cited_references(_citations(spark, sf), _search(spark, sf).select("uid"), part)
    return refs.select("citing_uid", "cited_uid", "p_name", "p_brand")


def q_citing(spark, sf):
    seeds = read(spark, sf, "part").where(F.col("p_brand") == "Brand#17").select("p_partkey")
    out = H.citing_articles(_citations(spark, sf), seeds, _pubs(spark, sf), ("1996-01-01", "1997-12-31"))
    return out.select("cited_uid", "citing_uid", _iso("pub_date"))


def q_related_records(spark, sf):
    out = H.related_records(_citations(spark, sf), _search(spark, sf).select("uid"), top_n=10)
    return out.select("seed_uid", "related_uid", "shared", "n_related", "rank")


def q_doi_lookup(spark, sf):
    o = read(spark, sf, "orders").where(F.col("o_orderstatus") == "P")
    p = read(spark, sf, "part").where(F.col("p_size") == 1)
    dois = (o.select(F.concat(F.lit("10."), F.col("o_custkey").cast("string"), F.lit("/"),
                              F.col("o_orderkey").cast("string")).alias("doi"))
            .unionByName(p.select(F.concat(F.lit("10.999/"), F.col("p_partkey").cast("string")).alias("doi"))))
    pubs = _pubs(spark, sf).withColumn("uid", F.concat(F.lit("WOS:"), F.col("uid").cast("string")))
    return H.doi_to_uid(dois, pubs).select("doi", "uid")


# ============================================================ XML records

def _record_structs(spark, sf):
    """Bibliographic records built from the tables: an order is a record, its
    customer the author, its priority the title, the cited parts' names the
    author keywords and the number of its line items the times cited."""
    o = read(spark, sf, "orders")
    c = read(spark, sf, "customer").select("c_custkey", "c_name")
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = read(spark, sf, "part").select("p_partkey", "p_name")
    kw = (li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey")
          .agg(F.sort_array(F.collect_list("p_name")).alias("kw"), F.count(F.lit(1)).alias("tc")))
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
         .join(kw, o.o_orderkey == kw.l_orderkey, "left"))
    uid = F.concat(F.lit("WOS:"), F.col("o_orderkey").cast("string"))
    names = F.struct(F.array(F.struct(F.col("c_name").alias("display_name"),
                                      F.upper("c_name").alias("wos_standard"))).alias("name"))
    titles = F.struct(F.array(F.struct(F.lit("item").alias("_type"), F.col("o_orderpriority").alias("_VALUE")),
                              F.struct(F.lit("source").alias("_type"), F.col("o_orderstatus").alias("_VALUE")))
                      .alias("title"))
    pub = F.struct(F.lit("Journal").alias("_pubtype"), F.year("o_orderdate").alias("_pubyear"),
                   F.date_format("o_orderdate", "yyyy-MM-dd").alias("_sortdate"))
    static = F.struct(
        F.struct(names.alias("names"), titles.alias("titles"), pub.alias("pub_info")).alias("summary"),
        F.struct(F.struct(F.coalesce("kw", F.array().cast("array<string>")).alias("keyword")).alias("keywords"))
        .alias("fullrecord_metadata"))
    dynamic = F.struct(
        F.struct(F.struct(F.array(F.struct(F.coalesce("tc", F.lit(0)).cast("int").alias("_local_count")))
                          .alias("silo_tc")).alias("tc_list")).alias("citation_related"),
        F.struct(F.struct(F.array(F.struct(
            F.lit("doi").alias("_type"),
            F.concat(F.lit("10."), F.col("o_custkey").cast("string"), F.lit("/"),
                     F.col("o_orderkey").cast("string")).alias("_value"))).alias("identifier"))
                 .alias("identifiers")).alias("cluster_related"))
    return j.select(uid.alias("UID"), static.alias("static_data"), dynamic.alias("dynamic_data"))


def q_xml_records(spark, sf):
    """Records of two pages: all of them, and once more those that a second
    page repeats (odd order keys), some of them twice."""
    from corpuslens.sources import xml as SX
    path = new_path(spark, "xml-records")
    rec = _record_structs(spark, sf)
    again = rec.where("cast(substring(UID, 5) AS long) % 2 = 1")
    SX.write_records(rec, f"{path}/page1")
    SX.write_records(again.unionAll(again.where("cast(substring(UID, 5) AS long) % 3 = 0")), f"{path}/page2")
    path = f"{path}/*"
    rec = SX.merge_pages(SX.read_records(spark, path))
    out = SX.project_records(rec, flat=True)
    return out.select("uid", "authors", "title", "source", "publication_year",
                      _iso("publication_date"), "times_cited", "doi", "keywords_author")


def _whole_records(spark, sf):
    """``_record_structs`` with the fields that those leave out, from the same
    tables: addresses, types, subjects, keywords, identifiers and paragraphs."""
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    key = F.col("o_orderkey")
    named = lambda kind, value: F.struct(F.lit(kind).alias("_type"), value.alias("_value"))
    subject = lambda kind, value: F.struct(F.lit(kind).alias("_ascatype"), value.alias("_VALUE"))
    address = lambda x: F.struct(F.struct(x.alias("full_address")).alias("address_spec"))
    more = o.select(
        F.concat(F.lit("WOS:"), key.cast("string")).alias("_uid"),
        F.array(address(F.concat_ws(", ", "c_name", "c_mktsegment")), address(F.concat(F.lit("Nation "), "c_nationkey"))).alias("addresses"),
        F.when(key % 3 == 0, F.array(F.lit("Article"), F.lit("Review"))).otherwise(F.array(F.lit("Letter"))).alias("doctypes"),
        F.array(subject("extended", F.col("c_mktsegment")), subject("traditional", F.col("o_orderstatus")),
                subject("extended", F.col("o_orderpriority"))).alias("subjects"),
        F.when(key % 2 == 0, F.array(F.col("c_mktsegment"), F.lit("plus"))).otherwise(F.array(F.lit("plus"))).alias("plus"),
        F.array(named("issn", F.concat(F.lit("issn-"), "o_custkey")), named("doi", F.concat(F.lit("old/"), key.cast("string"))),
                named("doi", F.concat(F.lit("10."), F.col("o_custkey").cast("string"), F.lit("/"), key.cast("string")))).alias("ids"),
        F.array(F.concat(F.lit("Abstract of order "), key.cast("string")), F.lit("Second paragraph")).alias("abstract"),
        F.when(key % 5 == 0, F.array(F.concat(F.lit("Fund "), "c_mktsegment"))).alias("fund"))
    full = F.col("static_data.fullrecord_metadata")
    static = F.struct(
        F.col("static_data.summary").alias("summary"),
        F.struct(F.struct(F.col("addresses").alias("address_name")).alias("addresses"),
                 F.struct(F.col("doctypes").alias("doctype")).alias("normalized_doctypes"),
                 F.struct(F.struct(F.col("subjects").alias("subject")).alias("subjects")).alias("category_info"),
                 full["keywords"].alias("keywords"),
                 F.struct(F.struct(F.struct(F.col("abstract").alias("p")).alias("abstract_text")).alias("abstract")).alias("abstracts"),
                 F.when(F.col("fund").isNotNull(), F.struct(F.struct(F.col("fund").alias("p")).alias("fund_text"))).alias("fund_ack"))
        .alias("fullrecord_metadata"),
        F.struct(F.struct(F.col("plus").alias("keyword")).alias("keywords_plus")).alias("item"))
    dynamic = F.struct(F.col("dynamic_data.citation_related").alias("citation_related"),
                       F.struct(F.struct(F.col("ids").alias("identifier")).alias("identifiers")).alias("cluster_related"))
    rec = _record_structs(spark, sf)
    return rec.join(more, F.col("UID") == F.col("_uid")).select("UID", static.alias("static_data"), dynamic.alias("dynamic_data"))


def q_xml_columns(spark, sf):
    """A4: all nineteen columns of records landed as XML."""
    from corpuslens.sources import xml as SX
    path = new_path(spark, "xml-columns")
    SX.write_records(_whole_records(spark, sf), path)
    out = SX.project_records(SX.read_records(spark, path), flat=True)
    return out.withColumn("publication_date", _iso("publication_date"))


def q_xml_store(spark, sf):
    """A7 in two merges: all records, then a page that brings every third
    order again under another title."""
    from corpuslens.sources import xml as SX
    from corpuslens.sources.record_store import RecordStore
    path = new_path(spark, "xml-store")
    rec = _record_structs(spark, sf)
    again = rec.where("cast(substring(UID, 5) AS long) % 3 = 0").withColumn("static_data", F.col("static_data").withField(
        "summary.titles", F.struct(F.array(F.struct(F.lit("item").alias("_type"), F.concat(F.lit("Again "), "UID").alias("_VALUE"))).alias("title"))))
    store = RecordStore(spark, f"{path}/store", 16)
    for name, page in (("page1", rec), ("page2", again)):
        SX.write_records(page, f"{path}/{name}")
        store.merge(SX.read_records(spark, f"{path}/{name}"))
    return SX.project_records(store.read(), flat=True).select("uid", "authors", "title", "source", "publication_year", "times_cited", "doi")


def q_xpath_list(spark, sf):
    from corpuslens.sources import xml as SX
    rec = _record_structs(spark, sf)
    xml = rec.select(F.col("UID").alias("uid"),
                     F.to_xml(F.struct("static_data"), {"rowTag": "REC"}).alias("xml"))
    return SX.xpath_list(xml, "xml", "REC/static_data/fullrecord_metadata/keywords/keyword/text()", "uid")


# ============================================================ files

def q_corpus_csv(spark, sf):
    """The documents written as CSV and read again."""
    path = new_path(spark, "corpus-csv")
    C.write_table(read(spark, sf, "documents").select("doc_id", "source", "text"), path, "csv")
    back = C.read_corpus(spark, path, "csv", "doc_id long, source string, text string", check_unique=True)
    return back.select("doc_id", "source", F.md5("text").alias("text_md5"))


def q_corpus_made_ids(spark, sf):
    """A1 without an id column: most rows of source and language are equal."""
    path = new_path(spark, "corpus-made-ids")
    C.write_table(read(spark, sf, "documents").select("source", "lang"), path, "csv")
    return C.read_corpus(spark, path, "csv", "source string, lang string", create_id=True, check_unique=True)


def q_vocab_file(f):
    """A vocabulary written as CSV and read again."""
    path = new_path(f.spark, "vocabulary-csv")
    out = f.freq_flagged.select("phrase", "score", "stem", "frequency", F.lit(1).alias("freq_flag"), "fraction",
                                F.lit(None).cast("double").alias("norm_frequency"),
                                F.lit(None).cast("double").alias("cc_ratio"), F.lit(0).alias("corr_flag"))
    C.write_table(out, path, "csv")
    return C.read_vocabulary(f.spark, path, "csv").select(
        "phrase", r6("score").alias("score"), "stem", "frequency", r6("fraction").alias("fraction"))


def q_stop_words_custom(spark, sf):
    """A custom list in a file (the words of the part names) with
    add-ons."""
    path = new_path(spark, "stop-words")
    words = read(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("value"))
    words.select(F.concat(F.lit(" "), F.upper("value"), F.lit("\r"))).write.text(path)
    return C.read_stop_words(spark, "custom", path, ["Zebra", "of the ", ""])


def q_kv_records(spark, sf):
    """One ``key: value`` file per supplier."""
    path = new_path(spark, "kv-records")
    s = read(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    line = F.concat_ws("\n", F.concat(F.lit("Author(s): "), F.col("s_name"), F.lit("; Co, "), key, F.lit(";")),
                       F.concat(F.lit("Title: T: "), F.col("s_name")), F.lit("Start_Date: 05-11-2008"),
                       F.concat(F.lit("DOI: 10.1/"), key), F.lit("Keywords: a b;c;;"))
    C.write_one_file_each(s.select(line.alias("value"), key.alias("k")), path, "k", "value")
    out = C.read_kv_records(spark, path)
    return out.select(F.array_join("authors", "|").alias("authors"), "title", "misc_pub_info", _iso("start_date"), "doi",
                      F.array_join("keywords", "|").alias("keywords"))


# ============================================================ further forms of operators

def q_stemmed_text(f):
    return TX.stemmed_text(f.docs).select("doc_id", "corpus_stemmed")


def q_stem_given(f):
    """B4 and B6 with a dictionary of the caller's: here, tokens without a
    common ending."""
    words = f.docs.select(F.explode("tokens").alias("token")).distinct()
    given = words.select("token", F.regexp_replace("token", "(tion|ing|ed|ly|s)$", "").alias("stem"))
    return TX.stemmed_text(TX.stem_tokens(f.docs.select("doc_id", "tokens"), "given", dictionary=given)).select("doc_id", "corpus_stemmed")


def q_last_rows(spark, sf):
    return TX.last_rows(read(spark, sf, "documents"), ["n_chars", "doc_id"], 100).select("doc_id", "n_chars")


def q_top_by(f):
    return f.most_frequent(50).select("stem", "frequency")


def q_freq_filter_count(f):
    n, _ = f.stats
    return FL.freq_filter(f.vocab, f.near, n, 2, 500, None, totals=f.totals).select("stem", "kept", "reason")


def q_cc_ratio_token(f):
    return f.cc_flagged_by("token").select("stem", "n_occ_doc", r6("cc_ratio").alias("cc_ratio"), "kept")


def q_corr_filter_both(f):
    return f.corr_flagged_by("both").select("stem", "kept")


def q_rake_score_range(spark, sf):
    d = prepared_docs(spark, sf)
    phrases = R.rake_phrases(d, R.stop_word_list(default_stop_words(spark)))
    return R.rake_vocabulary(phrases, 1.5, 12).select("phrase", r6("score").alias("score"), "first_doc", "first_pos")


def q_feat_tf_l1(f):
    return G.tf_features(f.counts, "l1").select("doc_id", "topic_id", r6("value").alias("value"))


def q_feat_count_docs(f):
    """G1 from the documents instead of the flow's postings."""
    return G.count_features(f.docs, f.topics).select("doc_id", "topic_id", "tf")


def q_search_regex(spark, sf):
    return E.search_rows(read(spark, sf, "documents"), "text", "Éa\\w+ ^l[ea] ", regex=True).select("doc_id", "lang")


def q_train_test(spark, sf):
    train, test = KM.train_test_split(read(spark, sf, "embeddings"), 0.25, 3, "vec_id")
    return train.select("vec_id", F.lit("train").alias("part")).unionAll(test.select("vec_id", F.lit("test").alias("part")))


def q_kmeans_assign(spark, sf):
    """F2's assignment: the nearest label mean of every vector."""
    e = read(spark, sf, "embeddings")
    centres, labels = KM.centres_matrix(KM.group_means(e, "label", "embedding"))
    near = KM.assign_nearest(e, centres)
    lab = spark.createDataFrame(list(enumerate(labels)), "label int, given int")
    return near.join(lab, "label").select("vec_id", F.col("given").alias("label"), r6("dist2").alias("dist2"))


def q_gmm_probabilities(spark, sf):
    """the probability of every component for every vector."""
    e = read(spark, sf, "embeddings")
    p, labels = _label_params(e)
    lab = spark.createDataFrame(list(enumerate(labels)), "label int, given int")
    return GM.gmm_predict(e, p, "embedding", "vec_id", long_form=True).join(lab, "label").select(
        "vec_id", F.col("given").alias("label"), r6("p").alias("p"))


def q_inverse_transform(spark, sf):
    """Label means back from component space, with the label means
    themselves as loadings."""
    e = read(spark, sf, "embeddings")
    means = stage(KM.group_means(e, "label", "embedding"))
    loadings, labels = KM.centres_matrix(means)
    centres = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("c")).select(
        "label", F.col("c.mean").alias("centre"))
    topics = spark.createDataFrame([(i, f"label {x}") for i, x in enumerate(labels)], "topic_id int, phrase string")
    return TH.themes_from_centres(centres, topics, loadings, 5).select("label", "rank", "phrase", r6("weight").alias("weight"))


def q_svd_trace(f):
    """G4 at full rank over all topics: the squared singular values add up to
    the squares of the features."""
    from corpuslens.operators import svd as SV
    n, _ = f.stats
    feats, n_topics = stage(G.tfidf_features(f.counts, n, "l2")), f.topics.count()
    sc = SV.scree(feats, n_topics, n_topics)
    return sc.agg(F.round(F.sum(F.col("sigma") * F.col("sigma")), 4).alias("sum_sq"), F.count(F.lit(1)).alias("n"))


def q_lsa_norms(f):
    """One row per document; unit rows, zero rows where a document
    has no topic."""
    from pyspark.ml.functions import vector_to_array
    from corpuslens.operators import svd as SV
    n, _ = f.stats
    out, _ = SV.lsa(G.tfidf_features(f.counts, n, "l2"), f.topics.count(), 135, f.docs)
    v = vector_to_array("features")
    return out.select("doc_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


def q_lsa_project_given(f):
    """G5's projection on given loadings: unit rows of X V, by component."""
    from corpuslens.operators import svd as SV
    n, _ = f.stats
    n_topics = f.topics.count()
    loadings = np.cos(np.arange(n_topics)[:, None] * 0.37 + np.arange(6) * 1.3)
    rows = stage(SV.document_rows(G.tfidf_features(f.counts, n, "l2"), "doc_id", f.docs))
    return SV.project(rows, loadings).select("doc_id", F.posexplode("features").alias("component", "value")).select(
        "doc_id", "component", (r6("value") + F.lit(0.0)).alias("value"))


def q_map_variance(spark, sf):
    """the coordinates have mean 0 and the first spreads no less than
    the second."""
    from pyspark.ml.functions import array_to_vector
    from corpuslens.operators import map2d as M2
    e = read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    c = M2.coordinates_2d(e).agg(F.count(F.lit(1)).alias("n"), (F.var_pop("x") >= F.var_pop("y")).alias("ordered"),
                                 (F.abs(F.corr("x", "y")) < 1e-6).alias("uncorrelated"))
    return c


def q_impact_null_groups(spark, sf):
    """H1 where group values are missing."""
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                            F.expr("nullif(l_returnflag, 'N')").alias("flag"),
                                            F.expr("nullif(l_linestatus, 'F')").alias("status"))
    return H.normalised_impact(li, "l_quantity", ["flag", "status"]).select("l_orderkey", "l_linenumber", r6("impact").alias("impact"))


def q_record_search_tree(spark, sf):
    """H2: a wildcard within a phrase, OR within AND."""
    tree = H.all_of(H.any_word('"not spec*"', "urg?nt", "lo?"), "*")
    return H.record_search(_pubs(spark, sf), ["title", "edition"], tree).select("uid", "title")


def q_retrieve_after(spark, sf):
    """H3: the page behind a given record."""
    page = H.retrieve(_search(spark, sf), count=50, sort_field="TC", sort_order="D",
                      field_map={"TC": "times_cited"}, after=(200_000.0, 0))
    return page.select("uid", "times_cited")


def q_retrieve_deep(spark, sf):
    """H3: a page deep within all records, nulls in the sort field."""
    pubs = _pubs(spark, sf).withColumn("title", F.expr("nullif(title, '4-NOT SPECIFIED')"))
    page = H.retrieve(pubs, offset=11_990, count=75, sort_field="SO", sort_order="A", field_map={"SO": "title"}, top_rows=1000)
    return page.select("uid", "title", "times_cited")


def q_cited_refs_deep(spark, sf):
    """H5: a page deep within all references."""
    refs = H.cited_references(_citations(spark, sf), _pubs(spark, sf).select("uid"), offset=41_234, count=120, top_rows=1000)
    return refs.select("citing_uid", "cited_uid")


def q_cited_refs_page(spark, sf):
    return H.cited_references(_citations(spark, sf), _search(spark, sf).select("uid"), offset=21, count=40)


def q_citing_editions(spark, sf):
    seeds = read(spark, sf, "part").where(F.col("p_brand") == "Brand#17").select("p_partkey")
    out = H.citing_articles(_citations(spark, sf), seeds, _pubs(spark, sf), editions=["P", "O"])
    return out.select("cited_uid", "citing_uid", "edition")


def q_related_span(spark, sf):
    """H7 within a time span and editions, the second page of five."""
    out = H.related_records(_citations(spark, sf), _search(spark, sf).select("uid"), 5, _pubs(spark, sf),
                            ("1995-01-01", "1996-12-31"), editions=["F"], offset=6)
    return out.select("seed_uid", "related_uid", "shared", "n_related", "rank")


def q_doi_duplicates(spark, sf):
    """H8 where records share a DOI."""
    pubs = _pubs(spark, sf).withColumn("doi", F.concat(F.lit("10."), F.regexp_extract("doi", r"^10\.(\d+)/", 1)))
    return H.doi_to_uid(pubs.select("doi").distinct(), pubs).select("doi", "uid")


# ============================================================ sweeps from given centres

def _sweep_start(spark, sf):
    """The vectors, and for every k of the sweep its first k vectors as centres."""
    e = stage(read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")))
    ks = SW.sweep_range(e.count())
    first = np.array([r[0] for r in e.orderBy("vec_id").limit(ks[-1]).select("embedding").collect()])
    return e, {k: first[:k] for k in ks}


def q_sweep_inertia(spark, sf):
    e, start = _sweep_start(spark, sf)
    return spark.createDataFrame(list(SW.inertias(e, start, "embedding").items()), "k int, inertia double").select("k", r6("inertia").alias("inertia"))


def q_sweep_silhouette(spark, sf):
    e, start = _sweep_start(spark, sf)
    return spark.createDataFrame(list(SW.silhouettes(e, start, "embedding").items()), "k int, silhouette double").select(
        "k", r6("silhouette").alias("silhouette"))


def q_sweep_scores(spark, sf):
    """AIC and BIC of the diagonal mixtures of the labels by nearest centre."""
    e, start = _sweep_start(spark, sf)
    scores = SW.scores(e, SW.mixtures_from_centres(e, start, "diag", "embedding"), "embedding")
    return spark.createDataFrame([(k, *v) for k, v in scores.items()], "k int, aic double, bic double").select(
        "k", F.round("aic", 3).alias("aic"), F.round("bic", 3).alias("bic"))


def q_kmeans_bounded(spark, sf):
    """F2 with bounds: the labels of the third round, k = int(sqrt(N))."""
    e, start = _sweep_start(spark, sf)
    k = math.isqrt(e.count())
    first = np.array([r[0] for r in e.orderBy("vec_id").limit(k).select("embedding").collect()])
    return SW.kmeans_bounded(e, first, 3, 0.0, "embedding", "vec_id")[0]


# ============================================================ search over a persistent index

def q_search_indexed(spark, sf):
    """E1 and E2 without reading texts at search time."""
    d = read(spark, sf, "documents")
    index = IX.build_index(d, new_path(spark, "index"), ["text"], "doc_id", "spaces")
    return d.join(IX.search_indexed(index, "tion The"), "doc_id", "left_semi").select("doc_id", "lang", "source", "n_chars")


def q_record_search_indexed(spark, sf):
    """H2's tree over two text columns."""
    pubs = _pubs(spark, sf)
    index = IX.build_index(pubs, new_path(spark, "index"), ["title", "edition"], "uid", "words")
    tree = H.all_of(H.any_word('"not spec*"', "urg?nt", "lo?"), "*", H.any_word("f", "P"))
    return pubs.join(IX.record_search_indexed(index, tree), "uid", "left_semi").select("uid", "title", "edition")


def q_phrase_search_indexed(spark, sf):
    """H2's words and phrases over the texts."""
    d = read(spark, sf, "documents")
    index = IX.build_index(d, new_path(spark, "index"), ["text"], "doc_id", "words")
    return IX.record_search_indexed(index, H.any_word('"th* the"', H.all_of("*tion", '"de la"')), id_col="doc_id")


# ============================================================ registry

PLAIN: dict[str, Query] = {
    "clean_text": q_clean_text, "tokens": q_tokens, "doc_lengths": q_doc_lengths,
    "ngrams_count": q_ngrams_count, "stem_s": q_stem_s, "word_vocab": q_word_vocab,
    "rake_phrases": q_rake_phrases, "vocab_union_first": q_vocab_union_first, "search_rows": q_search_rows,
    "search_ids": q_search_ids, "l2_normalise": q_l2_normalise, "explained_var": q_explained_var,
    "distance": q_distance, "kmeans_step": q_kmeans_step, "silhouette": q_silhouette,
    "gmm_estep_diag": q_gmm_estep_diag, "aic_bic_given": q_aic_bic_given, "cluster_sizes": q_cluster_sizes,
    "cluster_map": q_cluster_map, "topic_normalised_impact": q_topic_normalised_impact,
    "record_search": q_record_search, "retrieve_page": q_retrieve_page, "retrieve_count": q_retrieve_count,
    "page_plan": q_page_plan, "retrieve_by_id": q_retrieve_by_id, "cited_refs": q_cited_refs,
    "citing": q_citing, "related_records": q_related_records, "doi_lookup": q_doi_lookup,
    "xml_records": q_xml_records, "xpath_list": q_xpath_list, "corpus_csv": q_corpus_csv,
    "stop_words_custom": q_stop_words_custom, "kv_records": q_kv_records, "last_rows": q_last_rows,
    "rake_score_range": q_rake_score_range, "search_regex": q_search_regex, "train_test": q_train_test,
    "kmeans_assign": q_kmeans_assign, "gmm_probabilities": q_gmm_probabilities,
    "inverse_transform": q_inverse_transform, "map_variance": q_map_variance,
    "impact_null_groups": q_impact_null_groups, "record_search_tree": q_record_search_tree,
    "retrieve_after": q_retrieve_after, "cited_refs_page": q_cited_refs_page,
    "citing_editions": q_citing_editions, "related_span": q_related_span, "doi_duplicates": q_doi_duplicates,
    "search_indexed": q_search_indexed, "record_search_indexed": q_record_search_indexed,
    "phrase_search_indexed": q_phrase_search_indexed, "retrieve_deep": q_retrieve_deep,
    "cited_refs_deep": q_cited_refs_deep, "sweep_inertia": q_sweep_inertia,
    "sweep_silhouette": q_sweep_silhouette, "sweep_scores": q_sweep_scores, "kmeans_bounded": q_kmeans_bounded,
    "silhouette_euclidean": q_silhouette_euclidean, "silhouette_sampled": q_silhouette_sampled,
    "xml_columns": q_xml_columns, "xml_store": q_xml_store, "corpus_made_ids": q_corpus_made_ids,
}

# these take the flow over the documents
FLOW: dict[str, Callable[[CorpusFlow], DataFrame]] = {
    "vocab_stop_anti": q_vocab_stop_anti, "postings": q_postings, "term_freq": q_term_freq,
    "freq_filter": q_freq_filter, "norm_freq": q_norm_freq, "substring_df": q_substring_df,
    "cc_ratio": q_cc_ratio, "cluster_filter": q_cluster_filter, "term_corr": q_term_corr,
    "corr_filter": q_corr_filter, "topic_topk": q_topic_topk, "filter_audit": q_filter_audit,
    "vocab_search": q_vocab_search, "feat_count": q_feat_count, "feat_tf": q_feat_tf,
    "feat_tfidf": q_feat_tfidf, "cluster_themes": q_cluster_themes, "vocab_file": q_vocab_file,
    "stemmed_text": q_stemmed_text, "top_by": q_top_by, "freq_filter_count": q_freq_filter_count,
    "cc_ratio_token": q_cc_ratio_token, "corr_filter_both": q_corr_filter_both, "feat_tf_l1": q_feat_tf_l1,
    "feat_count_docs": q_feat_count_docs, "svd_trace": q_svd_trace, "lsa_norms": q_lsa_norms,
    "lsa_project_given": q_lsa_project_given,
    "themes_wide": q_themes_wide, "stem_given": q_stem_given,
}


def registry() -> dict[str, Query]:
    """All queries, as callables of (spark, folder).  Those over the corpus
    flow share its stages: the flows belong to the returned registry and are
    made anew when the files of a folder change."""
    from corpuslens.plans import rows_only as RO
    flows = Flows()

    def of_flow(query):
        return lambda spark, sf: query(flows.of(spark, sf))

    return {**PLAIN, **RO.PLAIN, **{name: of_flow(q) for name, q in {**FLOW, **RO.FLOW}.items()}}


def _oracle() -> dict[str, str]:
    C = S.chain
    base = [S.DOCS]
    vocab = base + [S.WORD_VOCAB, S.rake_ctes(), S.VOCAB]
    post = vocab + [S.POSTINGS]
    freq = post + [S.FREQ]
    cc = freq + [S.CC]
    corr = cc + [S.CORR]
    feats = corr + [S.FEATS]
    all_docs = f"""
adocs AS (SELECT doc_id, {S.clean("concat_ws('. ', source, text)")} AS corpus, source FROM documents)"""
    search = """
pubs AS (SELECT o_orderkey AS uid, o_orderdate::DATE AS pub_date, year(o_orderdate) AS pub_year,
                o_orderpriority AS title, o_orderstatus AS edition, o_totalprice AS times_cited,
                '10.' || o_custkey || '/' || o_orderkey AS doi FROM orders),
found AS (SELECT * FROM pubs WHERE regexp_matches(title, '(?i)\\burg\\w*') AND pub_year IN (1995, 1996)
          AND edition IN ('F', 'O') AND pub_date BETWEEN DATE '1995-03-01' AND DATE '1996-06-30'),
cites AS (SELECT DISTINCT l_orderkey AS citing_uid, l_partkey AS cited_uid FROM lineitem)"""
    o = {}
    o["clean_text"] = C(all_docs) + "SELECT doc_id, corpus FROM adocs"
    o["tokens"] = C(all_docs) + (f"SELECT doc_id, len({S.tokens('corpus')}) AS n_tokens, "
                                 f"array_to_string({S.tokens('corpus')}, ' ') AS tokens_joined FROM adocs")
    o["doc_lengths"] = C(all_docs) + (
        f"SELECT doc_id, nw AS n_words, round(CASE WHEN m > 0 THEN nw / m END, 6) AS scale FROM "
        f"(SELECT doc_id, {S.word_count('corpus')} AS nw, avg({S.word_count('corpus')}) OVER () AS m FROM adocs)")
    o["ngrams_count"] = C(*base) + """
SELECT n, gram, count(*) AS cnt, count(DISTINCT doc_id) AS n_docs FROM (
  SELECT g.doc_id, kk.k AS n, array_to_string(g.tokens[g.i:g.i + kk.k - 1], ' ') AS gram
  FROM (SELECT doc_id, tokens, unnest(generate_series(1, len(tokens))) AS i FROM ds) g,
       (SELECT unnest(generate_series(1, 3)) AS k) kk
  WHERE g.i + kk.k - 1 <= len(g.tokens)) GROUP BY n, gram"""
    o["stem_s"] = C(all_docs) + (f"SELECT token, {S.s_stem('token')} AS stem FROM "
                                 f"(SELECT DISTINCT unnest({S.tokens('corpus')}) AS token FROM adocs)")
    o["stem_given"] = C(*base) + ("SELECT doc_id, array_to_string(list_transform(tokens, lambda t: regexp_replace(t, '(tion|ing|ed|ly|s)$', '')), ' ') "
                                  "AS corpus_stemmed FROM ds")
    o["word_vocab"] = C(*base, S.WORD_VOCAB) + "SELECT phrase, first_doc, first_pos FROM wv"
    o["rake_phrases"] = C(*base, S.rake_ctes()) + "SELECT doc_id, phrase, round(score, 6) AS score, first_pos FROM rp"
    o["vocab_union_first"] = C(*vocab) + (
        "SELECT stem, phrase, round(score, 6) AS score, source_rank, first_doc, first_pos FROM vu")
    o["vocab_stop_anti"] = C(*vocab) + (
        "SELECT stem, phrase, round(score, 6) AS score, source_rank, first_doc, first_pos FROM vf")
    o["postings"] = C(*post) + "SELECT doc_id, term, tf FROM post"
    o["term_freq"] = C(*freq) + "SELECT stem, frequency, df, round(fraction, 6) AS fraction FROM ts"
    o["freq_filter"] = C(*freq) + "SELECT stem, frequency, df, reason IS NULL AS kept, reason FROM ff"
    o["norm_freq"] = C(*cc) + "SELECT term AS stem, round(norm_frequency, 6) AS norm_frequency FROM nf"
    o["substring_df"] = C(*cc) + "SELECT term, n_occ_doc FROM occ"
    o["cc_ratio"] = C(*cc) + ("SELECT stem, round(norm_frequency, 6) AS norm_frequency, n_occ_doc, "
                              "round(cc_ratio, 6) AS cc_ratio FROM cf")
    o["cluster_filter"] = C(*cc) + "SELECT stem, reason IS NULL AS kept, reason FROM cf"
    o["term_corr"] = C(*corr) + "SELECT t1, t2, round(corr, 6) AS corr FROM corr WHERE corr > 0.7"
    o["corr_filter"] = C(*corr) + "SELECT stem, reason2 IS NULL AS kept, reason2 AS reason FROM crf"
    o["topic_topk"] = C(*corr) + "SELECT topic_id, stem, phrase, round(cc_ratio, 6) AS cc_ratio FROM topics"
    o["filter_audit"] = C(*corr) + """
SELECT 'frequency' AS stage, reason IS NULL AS kept, reason, count(*) AS n_terms FROM ff GROUP BY ALL
UNION ALL SELECT 'cluster', reason IS NULL, reason, count(*) FROM cf GROUP BY ALL
UNION ALL SELECT 'correlation', reason2 IS NULL, reason2, count(*) FROM crf GROUP BY ALL"""
    o["search_rows"] = ("SELECT doc_id, lang, source, n_chars FROM documents WHERE text IS NOT NULL "
                        "AND contains(lower(text), 'tion') AND contains(lower(text), 'the')")
    o["search_indexed"] = o["search_rows"]
    o["retrieve_deep"] = """
SELECT o_orderkey AS uid, nullif(o_orderpriority, '4-NOT SPECIFIED') AS title, o_totalprice AS times_cited FROM orders
ORDER BY title NULLS LAST, uid LIMIT 75 OFFSET 11989"""
    o["cited_refs_deep"] = """
SELECT DISTINCT l_orderkey AS citing_uid, l_partkey AS cited_uid FROM lineitem JOIN orders ON o_orderkey = l_orderkey
ORDER BY citing_uid, cited_uid LIMIT 120 OFFSET 41233"""
    o["record_search_indexed"] = """
SELECT o_orderkey AS uid, o_orderpriority AS title, o_orderstatus AS edition FROM orders
WHERE regexp_matches(o_orderpriority, '(?i)\\bnot\\s+spec|\\burg\\wnt\\b|\\blo\\w\\b') AND o_orderstatus IN ('F', 'P')"""
    word = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
    other = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
    o["phrase_search_indexed"] = f"""
SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|{other})th{word}*\\s+the({other}|$)')
   OR regexp_matches(text, '(?i)tion({other}|$)') AND regexp_matches(text, '(?i)(^|{other})de\\s+la({other}|$)')"""
    o["search_ids"] = ("SELECT conv_id, count(*) AS n_turns FROM conversations WHERE text IS NOT NULL "
                       "AND contains(lower(text), 'ing') AND contains(lower(text), 'on') GROUP BY conv_id")
    o["vocab_search"] = C(*vocab) + "SELECT stem, phrase, round(score, 6) AS score FROM vf WHERE contains(phrase, 'tion')"
    o["feat_count"] = C(*feats) + "SELECT doc_id, topic_id, tf FROM tcount"
    o["feat_tf"] = C(*feats) + """
SELECT doc_id, topic_id, round(CASE WHEN nrm > 0 THEN tf / nrm ELSE 0.0 END, 6) AS value
FROM (SELECT *, sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS nrm FROM tcount)"""
    o["feat_tfidf"] = C(*feats) + "SELECT doc_id, topic_id, round(value, 6) AS value FROM tfidf"
    o["l2_normalise"] = """
WITH e AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nrm
           FROM embeddings)
SELECT vec_id, dim, round(value, 6) AS value FROM (
  SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS dim,
         unnest(list_transform(embedding, lambda x: CASE WHEN nrm > 0 THEN x::DOUBLE / nrm ELSE 0.0 END)) AS value
  FROM e)"""
    o["explained_var"] = C(S.EMB) + ("SELECT round(sum(v), 6) AS total_variance, count(*) AS n_dims FROM "
                                     "(SELECT d, var_pop(x) AS v FROM ex GROUP BY d)")
    o["distance"] = C(S.EMB) + """,
m AS (SELECT label, d, avg(x) AS mean FROM ex GROUP BY label, d)
SELECT ex.vec_id, ex.label, round(sqrt(sum((ex.x - m.mean) * (ex.x - m.mean))), 6) AS dist
FROM ex JOIN m ON m.label = ex.label AND m.d = ex.d GROUP BY ex.vec_id, ex.label"""
    o["kmeans_step"] = C(S.EMB) + """,
m AS (SELECT label, d, avg(x) AS mean FROM ex GROUP BY label, d),
dist AS (SELECT ex.vec_id, m.label, sum((ex.x - m.mean) * (ex.x - m.mean)) AS d2
         FROM ex JOIN m ON m.d = ex.d GROUP BY ex.vec_id, m.label),
asg AS (SELECT vec_id, label AS new_label FROM
          (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, label) AS rn FROM dist) WHERE rn = 1),
sz AS (SELECT new_label, count(*) AS n_points FROM asg GROUP BY new_label)
SELECT a.new_label AS label, ex.d AS dim, round(avg(ex.x), 6) AS centre, any_value(sz.n_points) AS n_points
FROM ex JOIN asg a USING (vec_id) JOIN sz ON sz.new_label = a.new_label GROUP BY a.new_label, ex.d"""
    o["silhouette"] = C(S.EMB) + """,
cs AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
cm AS (SELECT label, d, sum(x) AS sx FROM ex GROUP BY label, d),
cq AS (SELECT label, sum(x * x) AS q FROM ex GROUP BY label),
pn AS (SELECT vec_id, any_value(label) AS label, sum(x * x) AS nx FROM ex GROUP BY vec_id),
dt AS (SELECT ex.vec_id, cm.label AS c, sum(ex.x * cm.sx) AS xs FROM ex JOIN cm ON cm.d = ex.d GROUP BY ex.vec_id, cm.label),
md AS (SELECT p.vec_id, p.label AS own, dt.c, (cq.q - 2 * dt.xs + cs.n * p.nx) AS tot, cs.n
       FROM pn p JOIN dt ON dt.vec_id = p.vec_id JOIN cq ON cq.label = dt.c JOIN cs ON cs.label = dt.c),
per AS (SELECT vec_id, max(CASE WHEN c = own AND n > 1 THEN tot / (n - 1) END) AS a,
               min(CASE WHEN c <> own THEN tot / n END) AS b, max(CASE WHEN c = own THEN n END) AS own_n
        FROM md GROUP BY vec_id)
SELECT round(avg(CASE WHEN own_n <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END), 6)
       AS silhouette FROM per"""
    place = "row_number() OVER (ORDER BY vec_id) - 1"
    near = lambda name, centres: f"""
{name} AS (SELECT k, vec_id, arg_min(comp, (d2, comp)) AS comp, min(d2) AS d2 FROM (
  SELECT k, comp, ex.vec_id, sum((x - c) * (x - c)) AS d2 FROM ex JOIN {centres} USING (d) GROUP BY ALL) GROUP BY k, vec_id)"""  # noqa: E731
    start = f"""
ks AS (SELECT unnest(generate_series(5, greatest(5, 2 * floor(sqrt(count(*)))::INTEGER), 5))::INTEGER AS k FROM embeddings),
c0 AS (SELECT k, comp, d, x AS c FROM ks JOIN (SELECT vec_id, {place} AS comp FROM embeddings) ON comp < k JOIN ex USING (vec_id))"""
    sweep = C(S.EMB, start, near("near", "c0")) + ",\nnx AS (SELECT near.k, near.comp, near.vec_id, ex.d, ex.x FROM near JOIN ex USING (vec_id))"
    o["sweep_inertia"] = sweep + "SELECT k, round(sum(d2), 6) AS inertia FROM near GROUP BY k"
    o["sweep_silhouette"] = sweep + """,
cs AS (SELECT k, comp, count(*) AS n FROM near GROUP BY ALL),
cm AS (SELECT k, comp, d, sum(x) AS sx FROM nx GROUP BY ALL),
cq AS (SELECT k, comp, sum(x * x) AS q FROM nx GROUP BY ALL),
pn AS (SELECT k, vec_id, any_value(comp) AS own, sum(x * x) AS sq FROM nx GROUP BY ALL),
dt AS (SELECT cm.k, cm.comp, ex.vec_id, sum(ex.x * cm.sx) AS xs FROM ex JOIN cm USING (d) GROUP BY ALL),
md AS (SELECT k, vec_id, own, comp, cq.q - 2 * xs + cs.n * sq AS tot, cs.n FROM dt JOIN pn USING (k, vec_id) JOIN cq USING (k, comp) JOIN cs USING (k, comp)),
per AS (SELECT k, vec_id, max(CASE WHEN comp = own AND n > 1 THEN greatest(tot, 0) / (n - 1) END) AS a,
               min(CASE WHEN comp <> own THEN tot / n END) AS b FROM md GROUP BY ALL)
SELECT k, round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM per GROUP BY k"""
    o["sweep_scores"] = sweep + """,
par AS (SELECT k, comp, d, avg(x) AS mu, var_pop(x) + 1e-6 AS var FROM nx GROUP BY ALL),
pw AS (SELECT k, comp, count(*) / sum(count(*)) OVER (PARTITION BY k) AS w FROM near GROUP BY k, comp),
lp AS (SELECT par.k, par.comp, ex.vec_id, any_value(ln(w)) - 0.5 * sum(ln(2 * pi() * var) + (x - mu) * (x - mu) / var) AS l
       FROM ex JOIN par USING (d) JOIN pw ON pw.k = par.k AND pw.comp = par.comp GROUP BY ALL),
lse AS (SELECT k, vec_id, m + ln(sum(exp(l - m))) AS l FROM (SELECT *, max(l) OVER (PARTITION BY k, vec_id) AS m FROM lp) GROUP BY k, vec_id, m),
np AS (SELECT k, 2 * count(*) + count(DISTINCT comp) - 1 AS q FROM par GROUP BY k)
SELECT k, round(-2 * sum(l) + 2 * any_value(q), 3) AS aic, round(-2 * sum(l) + any_value(q) * ln(count(*)), 3) AS bic FROM lse JOIN np USING (k) GROUP BY k"""
    mean = lambda name, of: f"\n{name} AS (SELECT {of}.k, {of}.comp, ex.d, avg(ex.x) AS c FROM {of} JOIN ex USING (vec_id) GROUP BY ALL)"
    root = f"""
c0 AS (SELECT 0 AS k, comp, d, x AS c FROM (SELECT vec_id, {place} AS comp, floor(sqrt(count(*) OVER ())) AS k FROM embeddings) JOIN ex USING (vec_id)
       WHERE comp < k)"""
    o["kmeans_bounded"] = C(S.EMB, root, near("n0", "c0"), mean("c1", "n0"), near("n1", "c1"), mean("c2", "n1"), near("n2", "c2")) + (
        "SELECT vec_id, comp::INTEGER AS label FROM n2")
    gm = C(S.EMB) + """,
cs AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
par AS (SELECT label, d, avg(x) AS mu, var_pop(x) + 1e-6 AS var FROM ex GROUP BY label, d),
pw AS (SELECT label, n / sum(n) OVER () AS w FROM cs),
slv AS (SELECT label, sum(ln(var)) AS slv, count(*) AS dd FROM par GROUP BY label),
lp AS (SELECT ex.vec_id, par.label, sum((ex.x - par.mu) * (ex.x - par.mu) / par.var) AS q
       FROM ex JOIN par ON par.d = ex.d GROUP BY ex.vec_id, par.label),
lp2 AS (SELECT lp.vec_id, lp.label, ln(pw.w) - 0.5 * (slv.dd * ln(2 * pi()) + slv.slv + lp.q) AS lp
        FROM lp JOIN pw USING (label) JOIN slv USING (label)),
lse AS (SELECT vec_id, m + ln(sum(exp(lp - m))) AS lse FROM
          (SELECT *, max(lp) OVER (PARTITION BY vec_id) AS m FROM lp2) GROUP BY vec_id, m),
best AS (SELECT vec_id, label, lp FROM
           (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY lp DESC, label) AS rn FROM lp2) WHERE rn = 1)
"""
    o["gmm_estep_diag"] = gm + ("SELECT b.vec_id, b.label, round(exp(b.lp - l.lse), 6) AS p, "
                                "round(l.lse, 6) AS loglik FROM best b JOIN lse l USING (vec_id)")
    o["aic_bic_given"] = gm + """
SELECT count(*) AS n, (SELECT (2 * count(*) + count(DISTINCT label) - 1)::INTEGER FROM par) AS n_params,
       round(sum(lse), 6) AS loglik,
       round(-2 * sum(lse) + 2 * (SELECT 2 * count(*) + count(DISTINCT label) - 1 FROM par), 6) AS aic,
       round(-2 * sum(lse) + (SELECT 2 * count(*) + count(DISTINCT label) - 1 FROM par) * ln(count(*)), 6) AS bic
FROM lse"""
    o["cluster_sizes"] = C(all_docs) + "SELECT source AS label, count(corpus) AS doc_count FROM adocs GROUP BY source"
    o["cluster_themes"] = C(*feats) + """,
lab AS (SELECT doc_id, lower(source) AS label FROM documents),
sz AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
cw2 AS (SELECT l.label, f.topic_id, sum(f.value) / any_value(sz.n) AS weight
        FROM tfidf f JOIN lab l USING (doc_id) JOIN sz ON sz.label = l.label GROUP BY l.label, f.topic_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(weight, 9) DESC, topic_id) - 1 AS rank FROM cw2)
SELECT rk.label, rk.rank, rk.topic_id, t.phrase, round(rk.weight, 6) AS weight
FROM rk JOIN topics t USING (topic_id) WHERE rk.rank < 10"""
    o["cluster_map"] = """
SELECT label, round(median(x), 6) AS x_median, round(median(y), 6) AS y_median, count(x) AS n_mapped, count(*) AS doc_count
FROM (SELECT label, sqrt(list_sum(list_transform(embedding[:32], lambda v: v::DOUBLE * v::DOUBLE))) AS x,
             sqrt(list_sum(list_transform(embedding[33:], lambda v: v::DOUBLE * v::DOUBLE))) AS y FROM embeddings)
GROUP BY label"""
    o["topic_normalised_impact"] = """
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN m <> 0 THEN l_quantity / m END, 6) AS impact
FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_returnflag, year(l_shipdate), l_linestatus) AS m FROM lineitem)"""
    o["record_search"] = C(search) + "SELECT uid, strftime(pub_date, '%Y-%m-%d') AS pub_date, title, edition FROM found"
    o["retrieve_page"] = C(search) + ("SELECT uid, times_cited FROM found ORDER BY times_cited DESC, uid "
                                      "LIMIT 50 OFFSET 10")
    o["retrieve_count"] = C(search) + "SELECT count(*) AS records_found FROM found"
    o["page_plan"] = C(search) + """
SELECT ((s - 1) // 100)::BIGINT AS page, s AS first_record, least(100, c - s + 1) AS size
FROM (SELECT count(*) AS c FROM found) t, range(1, (SELECT count(*) FROM found) + 1, 100) r(s)"""
    o["retrieve_by_id"] = C(search) + ("SELECT uid, strftime(pub_date, '%Y-%m-%d') AS pub_date, title FROM pubs WHERE uid IN "
                                       "(SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
    o["cited_refs"] = C(search) + ("SELECT c.citing_uid, c.cited_uid, p.p_name, p.p_brand FROM cites c "
                                   "JOIN (SELECT DISTINCT uid FROM found) f ON f.uid = c.citing_uid "
                                   "LEFT JOIN part p ON p.p_partkey = c.cited_uid")
    o["citing"] = C(search) + ("SELECT c.cited_uid, c.citing_uid, strftime(p.pub_date, '%Y-%m-%d') AS pub_date FROM cites c "
                               "JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_brand = 'Brand#17') s "
                               "ON s.p_partkey = c.cited_uid JOIN pubs p ON p.uid = c.citing_uid "
                               "WHERE p.pub_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
    o["related_records"] = C(search) + """,
sr AS (SELECT c.citing_uid AS seed_uid, c.cited_uid FROM cites c JOIN (SELECT DISTINCT uid FROM found) f
       ON f.uid = c.citing_uid),
co AS (SELECT sr.seed_uid, c.citing_uid AS related_uid, count(DISTINCT sr.cited_uid) AS shared
       FROM sr JOIN cites c ON c.cited_uid = sr.cited_uid GROUP BY sr.seed_uid, c.citing_uid),
tot AS (SELECT seed_uid, count(*) AS n_related FROM co WHERE seed_uid <> related_uid GROUP BY seed_uid),
rk AS (SELECT *, row_number() OVER (PARTITION BY seed_uid ORDER BY shared DESC, related_uid) AS rank FROM co)
SELECT rk.seed_uid, rk.related_uid, rk.shared, coalesce(tot.n_related, 0) AS n_related, rk.rank
FROM rk LEFT JOIN tot USING (seed_uid) WHERE rk.rank <= 10"""
    o["doi_lookup"] = """
WITH d AS (SELECT '10.' || o_custkey || '/' || o_orderkey AS doi FROM orders WHERE o_orderstatus = 'P'
           UNION ALL SELECT '10.999/' || p_partkey FROM part WHERE p_size = 1),
p AS (SELECT '10.' || o_custkey || '/' || o_orderkey AS doi, regexp_replace('WOS:' || o_orderkey, '^WOS:', '') AS uid
      FROM orders)
SELECT d.doi, p.uid FROM d LEFT JOIN p ON p.doi = d.doi"""
    o["xml_records"] = """
WITH kw AS (SELECT l_orderkey, string_agg(p_name, '; ' ORDER BY p_name) AS kw, count(*) AS tc
            FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT 'WOS:' || o_orderkey AS uid, c.c_name AS authors, o_orderpriority AS title, o_orderstatus AS source,
       year(o_orderdate) AS publication_year, strftime(o_orderdate, '%Y-%m-%d') AS publication_date,
       coalesce(kw.tc, 0)::INTEGER AS times_cited, '10.' || o_custkey || '/' || o_orderkey AS doi,
       coalesce(kw.kw, '') AS keywords_author
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN kw ON kw.l_orderkey = o.o_orderkey"""
    o["xml_columns"] = """
WITH kw AS (SELECT l_orderkey, string_agg(p_name, '; ' ORDER BY p_name) AS kw, count(*) AS tc
            FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT 'WOS:' || o_orderkey AS uid, c_name AS authors, upper(c_name) AS authors_wos,
       c_name || ', ' || c_mktsegment || '; Nation ' || c_nationkey AS addresses, o_orderpriority AS title, o_orderstatus AS source,
       'Journal' AS publication_type, CASE WHEN o_orderkey % 3 = 0 THEN 'Article; Review' ELSE 'Letter' END AS normalized_type,
       year(o_orderdate)::INTEGER AS publication_year, strftime(o_orderdate, '%Y-%m-%d') AS publication_date,
       c_mktsegment || '; ' || o_orderpriority AS category_research, o_orderstatus AS category_wos,
       coalesce(kw.kw, '') AS keywords_author, CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment || '; plus' ELSE 'plus' END AS keywords_plus,
       coalesce(kw.tc, 0)::INTEGER AS times_cited, 'issn-' || o_custkey AS issn, '10.' || o_custkey || '/' || o_orderkey AS doi,
       'Abstract of order ' || o_orderkey AS abstract, CASE WHEN o_orderkey % 5 = 0 THEN 'Fund ' || c_mktsegment END AS funding_text
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN kw ON kw.l_orderkey = o_orderkey"""
    o["xml_store"] = """
WITH tc AS (SELECT l_orderkey, count(*) AS tc FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT 'WOS:' || o_orderkey AS uid, c_name AS authors,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Again WOS:' || o_orderkey ELSE o_orderpriority END AS title,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS source, year(o_orderdate)::INTEGER AS publication_year,
       coalesce(tc.tc, 0)::INTEGER AS times_cited, '10.' || o_custkey || '/' || o_orderkey AS doi
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN tc ON tc.l_orderkey = o_orderkey"""
    o["corpus_made_ids"] = """
SELECT source, lang, sha256('{"source":"' || source || '","lang":"' || lang || '"}') || '-' ||
       (row_number() OVER (PARTITION BY source, lang) - 1) AS doc_id FROM documents"""
    pairs = lambda some: f"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings{some}),
ds AS (SELECT p.vec_id, p.label, q.label AS other, sum(list_distance(p.v, q.v)) AS s, count(*) AS n FROM e p, e q GROUP BY ALL),
per AS (SELECT vec_id, label, max(CASE WHEN label = other AND n > 1 THEN s / (n - 1) END) AS a,
               min(CASE WHEN label <> other THEN s / n END) AS b FROM ds GROUP BY ALL),
sc AS (SELECT *, CASE WHEN b IS NULL THEN NULL WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS score FROM per)"""  # noqa: E731
    o["silhouette_euclidean"] = pairs("") + """
SELECT vec_id, label::BIGINT AS label, round(a, 6) AS a, round(b, 6) AS b, round(score, 6) AS silhouette FROM sc"""
    o["silhouette_sampled"] = pairs(" WHERE ('0x' || substr(md5(vec_id || ':7'), 1, 8))::UBIGINT / 4294967296.0 < 0.5") + """
SELECT round(avg(score), 6) AS silhouette, count(*) AS n_points FROM sc"""
    o["xpath_list"] = """
SELECT 'WOS:' || l_orderkey AS uid, (row_number() OVER (PARTITION BY l_orderkey ORDER BY p_name) - 1)::INTEGER AS pos,
       p_name AS value
FROM lineitem JOIN part ON p_partkey = l_partkey"""
    o["corpus_csv"] = "SELECT doc_id, source, md5(text) AS text_md5 FROM documents"
    o["vocab_file"] = C(*freq) + ("SELECT phrase, round(score, 6) AS score, stem, frequency, "
                                  "round(fraction, 6) AS fraction FROM ts")
    o["stop_words_custom"] = """
SELECT DISTINCT lower(trim(unnest(string_split(p_name, ' ')))) AS word FROM part
UNION SELECT unnest(['zebra', 'of the'])"""
    o["kv_records"] = """
SELECT s_name || '|' || 'Co, ' || s_suppkey AS authors, 'T: ' || s_name AS title, NULL::VARCHAR AS misc_pub_info,
       '2008-05-11' AS start_date, '10.1/' || s_suppkey AS doi, 'a b|c' AS keywords FROM supplier"""
    o["stemmed_text"] = C(*base) + "SELECT doc_id, array_to_string(stems, ' ') AS corpus_stemmed FROM ds"
    o["last_rows"] = "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 100"
    o["top_by"] = C(*freq) + "SELECT stem, frequency FROM ts ORDER BY frequency DESC, stem LIMIT 50"
    o["freq_filter_count"] = C(*freq) + """
SELECT stem, reason IS NULL AS kept, reason FROM (
  SELECT stem, CASE WHEN frequency <= 2 THEN 'frequency<=min' WHEN frequency >= 500 THEN 'above max' END AS reason FROM ts)"""
    token = """
tocc AS (SELECT term, count(*) AS n FROM post2 GROUP BY term),
tcc AS (SELECT cc0.stem, coalesce(t.n, 0) AS n_occ_doc, CASE WHEN expd <> 0 THEN coalesce(t.n, 0) / expd END AS r
        FROM cc0 LEFT JOIN tocc t ON t.term = cc0.stem)"""
    o["cc_ratio_token"] = C(*cc, token) + ("SELECT stem, n_occ_doc, round(r, 6) AS cc_ratio, "
                                           "r IS NOT NULL AND r < 0.9 AS kept FROM tcc")
    o["corr_filter_both"] = C(*corr) + """,
bl AS (SELECT t1 AS stem FROM cpairs WHERE c1 >= c2 UNION SELECT t2 AS stem FROM cpairs WHERE c2 >= c1)
SELECT stem, stem NOT IN (SELECT stem FROM bl) AS kept FROM ck"""
    o["rake_score_range"] = C(*base, S.rake_ctes()) + """
SELECT phrase, round(score, 6) AS score, doc_id AS first_doc, first_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, first_pos) AS rn
  FROM rp WHERE score > 1.5 AND score < 12) WHERE rn = 1"""
    o["feat_tf_l1"] = C(*feats) + """
SELECT doc_id, topic_id, round(tf / sum(tf) OVER (PARTITION BY doc_id), 6) AS value FROM tcount"""
    o["feat_count_docs"] = C(*feats) + "SELECT doc_id, topic_id, tf FROM tcount"
    o["search_regex"] = ("SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)Éa[0-9A-Za-z_]+') "
                         "AND regexp_matches(text, '(?i)^l[ea]')")
    o["train_test"] = """
SELECT vec_id, CASE WHEN ('0x' || substr(md5(vec_id || ':3'), 1, 8))::UBIGINT / 4294967296.0 < 0.25
                    THEN 'test' ELSE 'train' END AS part FROM embeddings"""
    o["kmeans_assign"] = C(S.EMB) + """,
m AS (SELECT label, d, avg(x) AS mean FROM ex GROUP BY label, d),
dist AS (SELECT ex.vec_id, m.label, sum((ex.x - m.mean) * (ex.x - m.mean)) AS d2
         FROM ex JOIN m ON m.d = ex.d GROUP BY ex.vec_id, m.label)
SELECT vec_id, label, round(d2, 6) AS dist2 FROM
  (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, label) AS rn FROM dist) WHERE rn = 1"""
    o["gmm_probabilities"] = gm + "SELECT l.vec_id, l.label, round(exp(l.lp - e.lse), 6) AS p FROM lp2 l JOIN lse e USING (vec_id)"
    o["inverse_transform"] = C(S.EMB) + """,
m AS (SELECT label, d, avg(x) AS mean FROM ex GROUP BY label, d),
w AS (SELECT a.label, b.label AS t, sum(a.mean * b.mean) AS weight FROM m a JOIN m b USING (d) GROUP BY a.label, b.label)
SELECT label, rank, 'label ' || t AS phrase, round(weight, 6) AS weight FROM
  (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY weight DESC, t) - 1)::INTEGER AS rank FROM w) WHERE rank < 5"""
    o["svd_trace"] = C(*feats) + "SELECT round(sum(value * value), 4) AS sum_sq, (SELECT count(*) FROM topics)::BIGINT AS n FROM tfidf"
    o["lsa_norms"] = C(*feats) + """
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM tfidf) THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM ds"""
    o["lsa_project_given"] = C(*feats) + """,
lv AS (SELECT topic_id, unnest(range(6)) AS c FROM topics),
pj AS (SELECT doc_id, c, sum(value * cos(topic_id * 0.37::DOUBLE + c * 1.3::DOUBLE)) AS x FROM tfidf JOIN lv USING (topic_id) GROUP BY doc_id, c),
nr AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS norm FROM pj)
SELECT ds.doc_id, g.c::INTEGER AS component, coalesce(CASE WHEN norm > 0 THEN round(x / norm, 6) ELSE 0.0 END, 0.0) + 0.0 AS value
FROM ds CROSS JOIN (SELECT unnest(range(6)) AS c) g LEFT JOIN nr ON nr.doc_id = ds.doc_id AND nr.c = g.c"""
    o["map_variance"] = "SELECT count(*) AS n, true AS ordered, true AS uncorrelated FROM embeddings"
    o["impact_null_groups"] = """
SELECT l_orderkey, l_linenumber, round(CASE WHEN m <> 0 THEN l_quantity / m END, 6) AS impact
FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY nullif(l_returnflag, 'N'), nullif(l_linestatus, 'F')) AS m FROM lineitem)"""
    o["record_search_tree"] = ("SELECT o_orderkey AS uid, o_orderpriority AS title FROM orders WHERE "
                               "o_orderpriority IN ('4-NOT SPECIFIED', '1-URGENT', '5-LOW')")
    o["retrieve_after"] = C(search) + ("SELECT uid, times_cited FROM found WHERE times_cited < 200000 "
                                       "ORDER BY times_cited DESC, uid LIMIT 50")
    o["cited_refs_page"] = C(search) + ("SELECT c.citing_uid, c.cited_uid FROM cites c JOIN (SELECT DISTINCT uid FROM found) f "
                                        "ON f.uid = c.citing_uid ORDER BY 1, 2 LIMIT 40 OFFSET 20")
    o["citing_editions"] = C(search) + ("SELECT c.cited_uid, c.citing_uid, p.edition FROM cites c "
                                        "JOIN part s ON s.p_partkey = c.cited_uid AND s.p_brand = 'Brand#17' "
                                        "JOIN pubs p ON p.uid = c.citing_uid WHERE p.edition IN ('P', 'O')")
    o["related_span"] = C(search) + """,
ok AS (SELECT uid FROM pubs WHERE edition = 'F' AND pub_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'),
sr AS (SELECT c.citing_uid AS seed_uid, c.cited_uid FROM cites c JOIN (SELECT DISTINCT uid FROM found) f
       ON f.uid = c.citing_uid),
co AS (SELECT sr.seed_uid, c.citing_uid AS related_uid, count(*) AS shared
       FROM sr JOIN cites c ON c.cited_uid = sr.cited_uid WHERE c.citing_uid IN (SELECT uid FROM ok)
       GROUP BY sr.seed_uid, c.citing_uid),
rk AS (SELECT *, (sum((seed_uid <> related_uid)::INTEGER) OVER (PARTITION BY seed_uid))::BIGINT AS n_related,
              row_number() OVER (PARTITION BY seed_uid ORDER BY shared DESC, related_uid) AS rank FROM co)
SELECT seed_uid, related_uid, shared, n_related, rank FROM rk WHERE rank BETWEEN 6 AND 10"""
    o["doi_duplicates"] = """
SELECT '10.' || o_custkey AS doi, min(o_orderkey::VARCHAR) AS uid FROM orders GROUP BY 1"""
    o["themes_wide"] = o["cluster_themes"].replace(
        "SELECT rk.label, rk.rank, rk.topic_id, t.phrase, round(rk.weight, 6) AS weight\nFROM",
        "SELECT rk.label, max(CASE WHEN rk.rank = 0 THEN t.phrase END) AS phrase_0, "
        "max(CASE WHEN rk.rank = 1 THEN t.phrase END) AS phrase_1, max(CASE WHEN rk.rank = 2 THEN t.phrase END) AS phrase_2, "
        "any_value(sz.n) AS doc_count\nFROM").replace(
        "JOIN topics t USING (topic_id) WHERE rk.rank < 10",
        "JOIN topics t USING (topic_id) JOIN sz ON sz.label = rk.label GROUP BY rk.label")
    return o


ORACLE: dict[str, str] = _oracle()
