import base64
import math
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpuslens.llm import bpe, langid, mixing
from tests.llm.helpers import awkward, frame, prose, sha, words


@pytest.fixture(scope="module")
def tiktoken_encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["a  b   c \n\n d\t", "it's I'll we've 'tis", "12 345,678.90 ½ ²", "漢字 かな 한글 ไทย हिन्दी", "👩‍👩‍👧 é ​ ﻿", "\x00\x01\x1c\x85\xa0",
       " " * 300 + "x", "<|endoftext|> <unk> </s> ▁a", "Ġ Ċ ġ", "ab" * 3000, "\r\n\r\n  \r"]


def test_bpe_equals_tiktoken(spark, tiktoken_encoding):
    rows = awkward() + [(100 + i, t) for i, t in enumerate(ODD)]
    docs = frame(spark, rows).selectExpr("*", "'q' AS ids", "1 AS decoded")
    got = bpe.round_trip_digests(docs, bpe.default_tokenizer(spark)).collect()
    want = []
    for i, t in [(r[0], r[1] or "") for r in rows]:
        ids = tiktoken_encoding.encode_ordinary(t)
        want.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t)))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.round_trip_digests(docs.limit(0), bpe.default_tokenizer(spark)).count() == 0


def test_bpe_encode_and_decode_alone(spark):
    one = bpe.default_tokenizer(spark)
    docs = one.decode(one.encode(frame(spark, awkward())))
    for r in docs.collect():
        assert bytes(r.decoded).decode() == (r.text or "") and r.n_tokens * 4 == len(r.ids)


def test_every_white_space_and_class_of_the_pattern(spark, tiktoken_encoding):
    text = "".join(f"a{chr(c)} {chr(c)}{chr(c)}1" for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    row = bpe.default_tokenizer(spark).encode(frame(spark, [(1, text)])).first()
    assert list(struct.unpack(f"<{row.n_tokens}I", row.ids)) == tiktoken_encoding.encode_ordinary(text)


def plain_targets(sizes):
    """Reshares the excess until no source is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3.0 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[q] for q in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        capped |= over


def mixed_rows():
    return [*awkward(), *[(1000 + i, prose(i, 5 + i % 90), f"src{i % 5 if i % 3 else 0}") for i in range(900)],
            (5000, "two words", "tiny"), (5001, None, "empty"), (5002, "", "empty"), (5003, prose(1, 40), "Ü"), (5004, prose(1, 40), "a")]


def test_mixing(spark):
    docs = frame(spark, mixed_rows()).selectExpr("*", "1 AS size", "2 AS target")
    got = mixing.copies(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    target = plain_targets(sizes)
    assert len(got) == docs.count()
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in (f"src{i}" for i in range(5)):
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 95
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, mixing.copies(docs.repartition(7)).collect()), key=key)


def test_mix_repeats_rows(spark):
    docs = frame(spark, mixed_rows())
    want = {r["doc_id"]: r["n"] for r in mixing.copies(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r["n"]}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 0, None: 5}, {"a": 0}, {"x": 7},
                                   {f"s{i}": 10 ** (i % 5) for i in range(12)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    for s, t in plain_targets(sizes).items():
        assert math.isclose(got[s], t, rel_tol=1e-9, abs_tol=1e-9)


def test_targets_of_many_sources(spark):
    """Ranges of sources: the same targets wherever they are cut, and no
    window over all sources."""
    sizes = {f"host{i}.example": 1 + (i * 7919) % 5000 for i in range(3000)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = mixing.source_targets(df)
    found, want = {r.source: r.target for r in got.collect()}, plain_targets(sizes)
    assert all(math.isclose(found[s], want[s], rel_tol=1e-9) for s in sizes)
    assert found == {r.source: r.target for r in mixing.source_targets(df.repartition(23)).collect()}
    ranges = mixing._sums_before(df, [F.col("source").asc()], ["source_size"])
    plan = ranges._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan  # written; only the table of ranges is ordered as a whole
    assert ranges.agg(F.max("source_size_before")).first()[0] == sum(sizes.values()) - sizes[max(sizes)]


def test_words_near_the_target_of_small_sources(spark):
    got = mixing.copies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    per = got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest"))
    assert all(abs(r.taken - r.target) <= r.largest for r in per.collect())


def test_domains_of_a_host(spark):
    row = spark.createDataFrame([("a.b.c.d.e.f",), ("x",), ("",), ("a..b",), ("y." * 200 + "z",)], "host string")
    got = [r[0] for r in row.select(langid._domains(F.col("host"))).collect()]
    assert got[0] == ["f", "e.f", "d.e.f", "c.d.e.f", "b.c.d.e.f", "a.b.c.d.e.f"]
    assert got[1:4] == [["x"], [""], ["b", ".b", "a..b"]] and got[4] == ["y." * 200 + "z"]


@pytest.fixture(scope="module")
def profiles(spark, sf001):
    return langid.fit_profiles(spark.read.parquet(f"{sf001}/documents.parquet"))


def test_language_of_held_out_texts(spark, profiles):
    """Profiles fitted on one table, judged on the documents of another, by
    text and host alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 200")
    rows = docs.select("doc_id", F.col("lang").alias("said"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    got = langid.identify(rows, profiles).collect()
    assert len(got) == docs.count()
    assert sum(r.lang == r.said for r in got) >= 0.98 * len(got)
    assert sum(r.accepted for r in got) >= 0.995 * len(got)


def test_language_evidence(spark, profiles):
    en, de = "the of and that this with from", "und der die das nicht auf sich"
    rows = [(1, en, None, None), (2, de, "de", "a.example.de"), (3, "", "de", "b.example.de"), (4, None, None, None), (5, "12 %% 34", None, "b.example.de"),
            (6, "zqxj wvkq qqzz xxkw", None, None), (7, en, "en", None), (7, en, "en", None), (8, "a" * 200_000, None, "x"), (9, "A.", None, "x")]
    rows += [(100 + i, de * 3, "de", f"h{i}.example.de") for i in range(40)] + [(200 + i, en * 3, "en", f"h{i}.example.com") for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string, declared string, host string")
    got = {r.id: r for r in langid.identify(docs.selectExpr("*", "1 AS n", "2 AS soft"), profiles).collect()}
    assert len(got) == len({r[0] for r in rows})
    assert (got[1].lang, got[2].lang, got[1].accepted) == ("en", "de", True)
    assert got[3].lang == "de" and not got[3].accepted  # declaration, suffix and domain speak; there is no text
    assert got[5].lang == "de" and not got[4].accepted and not got[5].accepted
    assert got[6].lang == langid.UNKNOWN and not got[6].accepted
    assert got[9].accepted
    assert langid.identify(docs.limit(0), profiles).count() == 0


def test_keep_accepted(spark, profiles):
    docs = frame(spark, [(1, "the of and that this"), (1, "the of and that this"), (2, "%% 12"), (None, "und der die das"), (3, None)])
    kept = langid.keep_accepted(docs, profiles)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "und der die das"), (1, "the of and that this"), (1, "the of and that this")]
    assert langid.keep_accepted(docs.limit(0), profiles).count() == 0
    clash = docs.selectExpr("*", "1 AS key", "2 AS id", "3 AS said", "4 AS host")
    assert langid.keep_accepted(clash, profiles).columns == clash.columns and langid.keep_accepted(clash, profiles).count() == 3


def test_profiles_of_no_rows(spark):
    flat = langid.fit_profiles(frame(spark, [(1, "x")]).limit(0))
    assert flat.shape == (len(langid.LANGUAGES) + 1, langid.SLOTS) and (flat == flat[0, 0]).all()


def test_url_and_markup(spark):
    row = spark.createDataFrame([("https://u:p@Blog.Example.ORG:80/en?x#y", "<!DOCTYPE html><HTML class=a LANG='de-AT'><script>var t='</p>';</script><p>Hi &amp;</p>")], "u string, h string")
    got = row.select(langid.host_of(F.col("u")), langid.declared_in(F.col("h")), langid.visible_text(F.col("h"))).first()
    assert got[0] == "blog.example.org" and got[1] == "de" and "var" not in got[2] and "Hi" in got[2]
