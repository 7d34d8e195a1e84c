import os
import tempfile

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import citations as H
from corpuslens.sources import corpus as SC
from corpuslens.sources import xml as SX


def test_page_plan_24091_records(spark):
    found = spark.createDataFrame([(24091,)], "records_found long")
    plan = H.page_plan(spark, found, 1, 100).orderBy("page").collect()
    assert len(plan) == 241
    assert (plan[0]["first_record"], plan[0]["size"]) == (1, 100)
    assert (plan[-1]["first_record"], plan[-1]["size"]) == (24001, 91)
    assert sum(r["size"] for r in plan) == 24091


def test_doi_prefix_is_a_prefix_not_a_char_set(spark):
    pubs = spark.createDataFrame([("WOS:000123", "10.1/x"), ("SWO:1", "10.2/y")], "uid string, doi string")
    dois = spark.createDataFrame([("10.1/x",), ("10.2/y",), ("10.9/z",)], "doi string")
    got = {r["doi"]: r["uid"] for r in H.doi_to_uid(dois, pubs).collect()}
    assert got == {"10.1/x": "000123", "10.2/y": "SWO:1", "10.9/z": None}


def test_retrieve_validation_and_paging(spark):
    recs = spark.createDataFrame([(i, float(i % 7)) for i in range(1, 31)], "uid long, tc double")
    with pytest.raises(ValueError):
        H.retrieve(recs, offset=0)
    with pytest.raises(ValueError):
        H.retrieve(recs, count=101, max_count=100)
    with pytest.raises(ValueError):
        H.retrieve(recs, sort_field="TC", sort_order="A", field_map={"TC": "tc"})
    assert H.retrieve(recs, count=0).first()["records_found"] == 30
    page = H.retrieve(recs, offset=3, count=4, sort_field="TC", sort_order="D", field_map={"TC": "tc"}).collect()
    full = sorted(recs.collect(), key=lambda r: (-r["tc"], r["uid"]))
    assert [r["uid"] for r in page] == [r["uid"] for r in full[2:6]]


def test_related_records_equals_brute_force(spark):
    edges = [(1, 10), (1, 11), (2, 10), (3, 11), (3, 10), (4, 12), (5, 12), (5, 10)]
    cit = spark.createDataFrame(edges, "citing_uid long, cited_uid long")
    seeds = spark.createDataFrame([(1,), (4,)], "uid long")
    got = {(r["seed_uid"], r["related_uid"]): (r["shared"], r["n_related"])
           for r in H.related_records(cit, seeds, top_n=None).collect()}
    refs = {}
    for a, b in edges:
        refs.setdefault(a, set()).add(b)
    for s in (1, 4):
        rel = {o: len(refs[s] & refs[o]) for o in refs if refs[s] & refs[o]}
        n_rel = len([o for o in rel if o != s])
        for o, c in rel.items():
            assert got[(s, o)] == (c, n_rel)
    assert len(got) == sum(1 for s in (1, 4) for o in refs if refs[s] & refs[o])


def test_record_search_wildcards_and_spans(spark):
    pubs = spark.createDataFrame(
        [(1, "Photovoltaic cells", "2010-01-05", 2010, "SCI"), (2, "photovoltaics review", "2012-03-01", 2012, "SSCI"),
         (3, "solar thermal", "2010-06-01", 2010, "SCI")],
        "uid long, title string, pub_date string, pub_year int, edition string") \
        .withColumn("pub_date", F.to_date("pub_date")).withColumn("load_date", F.col("pub_date"))
    ids = lambda df: sorted(r["uid"] for r in df.collect())
    assert ids(H.record_search(pubs, ["title"], "photovoltaic*")) == [1, 2]
    assert ids(H.record_search(pubs, ["title"], "photovoltaic")) == [1]
    assert ids(H.record_search(pubs, ["title"], "photovoltaic* solar", any_of=True)) == [1, 2, 3]
    assert ids(H.record_search(pubs, ["title"], None, years=[2010], editions=["SCI"],
                               time_span=("2010-01-01", "2010-03-01"))) == [1]
    assert ids(H.record_search(pubs, ["title"], None, symbolic_time_span="2week", today="2010-01-10")) == [1]
    with pytest.raises(ValueError):
        H.record_search(pubs, ["title"], "x", time_span=("a", "b"), symbolic_time_span="1week")


def test_normalised_impact(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 4.0), (3, "b", 0.0)], "id long, g string, tc double")
    got = {r["id"]: r["impact"] for r in H.normalised_impact(df, "tc", ["g"]).collect()}
    assert got == {1: 2.0 / 3.0, 2: 4.0 / 3.0, 3: None}


REC = """<REC><UID>{uid}</UID><static_data><summary>{names}<titles>{titles}</titles>
<pub_info pubtype="Journal" pubyear="{year}" sortdate="{year}-05-11"/></summary>
<fullrecord_metadata>{abstract}<normalized_doctypes><doctype>Article</doctype></normalized_doctypes>
<keywords><keyword>solar</keyword><keyword>silicon</keyword></keywords>
<category_info><subjects><subject ascatype="traditional">Energy</subject><subject ascatype="extended">Physics</subject></subjects></category_info>
</fullrecord_metadata><item><keywords_plus><keyword>CELLS</keyword></keywords_plus></item></static_data>
<dynamic_data>{tc}<cluster_related><identifiers>{ids}</identifiers></cluster_related></dynamic_data></REC>"""


def _rec(uid, names="", titles="", year=2008, abstract="", tc="", ids=""):
    return REC.format(uid=uid, names=names, titles=titles, year=year, abstract=abstract, tc=tc, ids=ids)


def test_xml_records_edge_cases(spark):
    d = tempfile.mkdtemp(prefix="cl-xml-")
    page1 = "<records>" + _rec(
        "WOS:1",
        names="<names><name><display_name>Doe, J</display_name><wos_standard>Doe, J</wos_standard></name>"
              "<name><display_name>Roe, R</display_name></name></names>",
        titles='<title type="source">J Phys</title><title type="item">First</title><title type="item">Second</title>',
        abstract="<abstracts><abstract><abstract_text><p>Para one</p><p>Para two</p></abstract_text></abstract></abstracts>",
        tc='<citation_related><tc_list><silo_tc local_count="7"/></tc_list></citation_related>',
        ids='<identifier type="doi" value="10.1/a"/><identifier type="doi" value="10.1/b"/>'
            '<identifier type="issn" value="1234-5678"/>') + _rec("WOS:2", titles='<title type="item">No authors</title>') \
        + "</records>"
    page2 = "<records>" + _rec("WOS:2", titles='<title type="item">No authors</title>') + "</records>"
    for i, body in enumerate((page1, page2)):
        with open(os.path.join(d, f"page{i}.xml"), "w") as fh:
            fh.write(body)
    rec = SX.merge_pages(SX.read_records(spark, d))
    out = {r["uid"]: r for r in SX.project_records(rec).collect()}
    assert set(out) == {"WOS:1", "WOS:2"}
    a = out["WOS:1"]
    assert a["authors"] == ["Doe, J", "Roe, R"] and a["authors_wos"] == ["Doe, J"]
    assert a["title"] == "Second" and a["source"] == "J Phys"
    assert a["doi"] == "10.1/b" and a["issn"] == "1234-5678" and a["times_cited"] == 7
    assert a["abstract"] == "Para one" and a["publication_year"] == 2008
    assert a["category_wos"] == ["Energy"] and a["category_research"] == ["Physics"]
    b = out["WOS:2"]
    assert b["authors"] == [] or b["authors"] is None
    assert b["times_cited"] is None and b["abstract"] is None and b["doi"] is None
    flat = SX.project_records(rec, flat=True).where("uid = 'WOS:1'").first()
    assert flat["authors"] == "Doe, J; Roe, R"


def test_xpath_list(spark):
    df = spark.createDataFrame([(1, "<r><k>a</k><k>b</k></r>"), (2, "<r/>")], "id long, x string")
    got = [(r["id"], r["pos"], r["value"]) for r in SX.xpath_list(df, "x", "r/k/text()", "id").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b")]


def test_kv_records_and_stop_words(spark):
    d = tempfile.mkdtemp(prefix="cl-kv-")
    body = ("Author(s): Doe, J.; Roe, R.;\nTitle: Quantum dots\nMisc_Pub_Info: Conf, 2008\n"
            "Start_Date: 05-11-2008\nDOI: 10.1/x\nAbstract: We study dots: small ones.\n"
            "Keywords: Dots;Quantum;\nURL: http://example.org/1")
    with open(os.path.join(d, "r_000.txt"), "w") as fh:
        fh.write(body)
    r = SC.read_kv_records(spark, d).first()
    assert r["authors"] == ["Doe, J.", "Roe, R."] and r["keywords"] == ["Dots", "Quantum"]
    assert str(r["start_date"]) == "2008-05-11" and r["abstract"] == "We study dots: small ones."
    sw = os.path.join(d, "stop.txt")
    with open(sw, "w", newline="") as fh:
        fh.write("the\r\nof\r\nThe\r\n\r\n")
    words = {x["word"] for x in SC.read_stop_words(spark, "custom", sw, ["extra"]).collect()}
    assert words == {"the", "of", "extra"}
    with pytest.raises(ValueError):
        SC.read_stop_words(spark, "inspire")


def test_vocabulary_sink_and_scan_round_trip(spark):
    from corpuslens.operators import filters as FL
    from corpuslens.operators import text as TX
    d = tempfile.mkdtemp(prefix="cl-vocab-")
    vocab = spark.createDataFrame(
        [("solar cells", 4.0, "solar cell", 12, 1, 0.2, 10.5, 0.4, 1), ("silicon", 1.0, "silicon", 30, 1, 0.5, 28.0, 0.8, 0)],
        SC.VOCAB_SCHEMA)
    SC.write_table(vocab, d + "/csv", "csv")
    SC.write_table(vocab, d + "/pq", "parquet", partition_by=["freq_flag"])
    back = SC.read_vocabulary(spark, d + "/csv", "csv")
    assert sorted(back.collect()) == sorted(vocab.collect())
    assert SC.read_vocabulary(spark, d + "/pq").count() == 2
    top = FL.top_by(back, "frequency", 1).first()
    assert top["stem"] == "silicon"
    assert [r["doc_id"] for r in TX.last_rows(spark.range(10).withColumnRenamed("id", "doc_id"), "doc_id", 3)
            .collect()] == [9, 8, 7]


def test_corpus_csv_scan_requires_id(spark):
    d = tempfile.mkdtemp(prefix="cl-csv-")
    with open(os.path.join(d, "c.csv"), "w") as fh:
        fh.write('Title,Abstract\n"A, b","multi\nline"\n')
    with pytest.raises(ValueError):
        SC.read_corpus(spark, d, "csv", "Title string, Abstract string")
    df = SC.read_corpus(spark, d, "csv", "Title string, Abstract string", create_id=True)
    r = df.first()
    assert r["Title"] == "A, b" and r["Abstract"] == "multi\nline" and r["doc_id"] is not None
