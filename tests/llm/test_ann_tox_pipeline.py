import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import ann, bpe, queries, shared, toxicity
from tests.llm.helpers import awkward, frame, prose

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_nearest(rows, step, k=20):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[i] = min(fine.get(i, v), v)
    out = {}
    for i, v in fine.items():
        if i % step == 0:
            near = [(-float(ann.exact_products(np.array([v], float), np.array([w], float))[0]), j) for j, w in fine.items() if j != i and len(w) == len(v)]
            if near:
                out[i] = [(j, -s) for s, j in sorted(near)[:k]]
    return out


@pytest.mark.parametrize("block", [8192, 40])
def test_nearest(spark, block):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=16)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 16) for i in range(100)]  # ties
    rows += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] * 16), (2080, [None] * 16), (2100, [float("inf")] * 16)]
    rows += [(2120, [1.0, 2.0]), (2121, [3.0, 1.0]), (2140, [1.0]), (None, [1.0] * 16), (20, rows[20][1]), (2160, [1e-30] * 16), (2180, [1e30] * 16)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).selectExpr("*", "1 AS qb", "2 AS dim")
    got = {}
    for x in sorted(ann.nearest(df, F.col("vec_id") % 20 == 0, block=block).collect()):
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    want = plain_nearest([(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 20)
    assert got == want
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_bound_holds():
    r = np.random.default_rng(4)
    a, b = r.normal(size=(50, 70)) * 10.0 ** r.integers(-3, 4, (50, 1)), r.normal(size=(60, 70))
    qa, sa, na, la = ann.round_to_int8(a)
    qb, sb, nb, lb = ann.round_to_int8(b)
    about = ann.int8_products(qa, qb) * sa[:, None] * sb
    slack = na[:, None] * lb + la[:, None] * np.linalg.norm(b, axis=1)
    assert (np.abs(about - a @ b.T) <= slack * (1 + 1e-9) + 1e-9).all()


def test_int8_products_of_long_rows_are_exact():
    a = np.full((2, 5000), 127, np.int8)
    assert (ann.int8_products(a, a) == 5000 * 127 * 127).all()


def test_toxicity_on_held_out_documents(spark):
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.1")
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    bad = [r.score for r in rows if r.toxic]
    good = [r.score for r in rows if not r.toxic]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) >= 0.88
    assert np.mean([g >= 0.5 for g in good]) <= 0.02


def test_toxicity_of_awkward_rows(spark):
    docs = frame(spark, awkward()).selectExpr("*", "1 AS x")
    known = [(i, prose(i, 20) + (" vileword nastyword" if i % 2 else ""), i % 2) for i in range(80)] + [(90, None, None), (None, "", 0), (91, None, 1)]
    labelled = spark.createDataFrame(known, "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled, labelled.select("doc_id", "toxic"))
    out = toxicity.score(docs, model)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    two = toxicity.score(frame(spark, [(1, prose(999, 30) + " vileword " + prose(7, 9) + " nastyword"), (2, prose(998, 30))]), model)
    s = {r.doc_id: r.score for r in two.collect()}
    assert s[1] > s[2]
    assert toxicity.score(docs.limit(0), model).count() == 0
    for one in (0, 1):
        only = toxicity.fit(labelled, labelled.where(F.col("toxic") == one))
        assert {round(r.score) for r in toxicity.score(docs, only).collect()} == {one}
    assert toxicity.score(docs, toxicity.fit(labelled, labelled.limit(0))).agg(F.max("score")).first()[0] < 0.5


def test_windows_cover_the_whole_text():
    text = prose(3, 400)
    cut = list(toxicity.windows(text))
    assert cut[0] == text[:48].encode() and cut[-1].endswith(text[-1:].encode())
    assert all(any(text[i:i + 12].encode() in w for w in cut) for i in range(len(text) - 12))
    assert list(toxicity.windows("")) == [b""]


def test_lookup_of_hot_keys(spark):
    big = spark.range(20_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 900) END AS key")
    table = big.where("key is not null").groupBy("key").count().withColumn("value", F.concat("key", F.lit("!")))
    out = shared.lookup(big, table.where("key <> 'k5'"), "key", "count", 20_000)
    assert out.count() == 20_000
    assert out.where("(key is null or key = 'k5') <> (value is null)").count() == 0
    assert out.where("value <> concat(key, '!')").count() == 0


def test_pipeline(spark, sf001):
    """Every stage takes effect on what the one before kept."""
    docs = shared.read(spark, sf001, "documents")
    n = [docs.count()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "exact_dedup", "simhash_dedup", "mix_sources", "encode"]
    at = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        at = shared.stage(step(spark, at, sf001))
        assert at.columns == docs.columns, name
        n.append(at.count())
    assert n[1] >= 0.99 * n[0] and n[2] < n[1] and n[3] <= n[2] and n[4] > 0
    last = corpus_pipeline.encode(spark, at, sf001)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == n[4]
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf001).collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_awkward_rows(spark, name):
    docs = frame(spark, awkward())
    step = dict(corpus_pipeline.STAGES)[name]
    out = step(spark, docs, "")
    assert out.count() >= (0 if name == "mix_sources" else 1)
    assert step(spark, docs.limit(0), "").count() == 0


def test_tokenizer_file_is_a_parameter(spark):
    import public_tokenizers
    one = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    row = one.decode(one.encode(frame(spark, [(1, "Grüße 漢字")]))).first()
    assert bytes(row.decoded).decode() == "Grüße 漢字"


def test_toxicity_of_repeated_ids(spark):
    """One row of an id is learnt from, however often it stands in the table."""
    known = [(i, prose(i, 30) + (" vileword nastyword" if i % 2 else ""), i % 2) for i in range(60)]
    docs = spark.createDataFrame(known, "doc_id long, text string, toxic int")
    twice = docs.unionAll(docs).unionAll(docs.where("doc_id = 3")).unionAll(docs.where("doc_id = 3"))
    assert toxicity.fit(twice, docs.select("doc_id", "toxic")) == toxicity.fit(docs, docs.select("doc_id", "toxic"))


def test_samples_too_few_to_train_on_are_drawn_evenly():
    few = [bytes([65 + i]) * 10 for i in range(5)]
    assert toxicity._train(few, 25) == b" ".join(few[::3])[:25] and toxicity._train(few, 1000) == b" ".join(few)
    assert toxicity._train([], 100) == b" " * 8
