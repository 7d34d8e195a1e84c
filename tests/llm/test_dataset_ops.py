import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import dataset_queries, decontaminate, divergence, merkle, shared
from tests.llm.helpers import DOCS, UP, awkward, frame, prose, sha

# ------------------------------------------------------- decontamination

TOKEN = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def spans_of(text, windows):
    """Word positions of windows (tuples of words) in a text, by trying all."""
    w = [m.group().translate(UP) for m in TOKEN.finditer(text or "")]
    return w, [(i, n) for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in windows]


def windows_of(text, window=10):
    w = [m.group().translate(UP) for m in TOKEN.finditer(text or "")]
    n = min(len(w), window)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def plain_find(rows, items, window=10):
    held = defaultdict(set)
    for item, text in items:
        for x in windows_of(text, window):
            held[x].add(item)
    out = []
    for doc_id, text, *_ in rows:
        w, spans = spans_of(text, held)
        hit = {i for at, n in spans for i in range(at, at + n)}
        names = sorted({str(i) for at, n in spans for i in held[tuple(w[at:at + n])] if i is not None})
        out.append((doc_id, len(w), len(hit), len(names), names, bool(spans)))
    return out


def plain_cut(text, items, window=10):
    held = set().union(*[windows_of(t, window) for _, t in items])
    _, spans = spans_of(text, held)
    hit = {i for at, n in spans for i in range(at, at + n)}
    out, end = "", 0
    for i, m in enumerate(TOKEN.finditer(text or "")):
        if not (i in hit and i - 1 in hit):
            out += text[end:m.start()]
        out, end = out + ("" if i in hit else m.group()), m.end()
    return None if text is None else out + text[end:]


PASSAGE = prose(7, 30)
ITEMS = [
    (1, PASSAGE), (2, PASSAGE.upper() + "!"), (3, " ".join(PASSAGE.split()[5:20]) + ". " + prose(8, 12)), (4, "Two words"),
    (5, None), (6, ""), (7, "?!"), (None, prose(9, 11)), (8, "Ünïcödé 😀 x"), (9, prose(10, 40)), (9, prose(10, 40)),
]
TEXTS = awkward() + [
    (20, "Before. " + PASSAGE.replace(" ", ",\n") + " - after"), (21, " ".join(PASSAGE.split()[:9])), (22, " ".join(PASSAGE.split()[3:14])),
    (23, "a two  words, TWO-WORDS two words"), (24, prose(9, 11)), (25, "ünïcödé 😀 x"), (26, prose(10, 40) + " " + PASSAGE),
    (26, prose(10, 40) + " " + PASSAGE), (27, (PASSAGE + " ") * 40), (None, PASSAGE), (28, (PASSAGE + " ") * 150),
]


def bench(spark, items):
    return spark.createDataFrame([(*i, "a") for i in items], "item_id long, text string, doc_id string")


@pytest.mark.parametrize(("bit_rows", "piece"), [(1, 128), (1 << 20, 128), (1 << 20, 7)])
def test_find(spark, monkeypatch, bit_rows, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    docs = frame(spark, TEXTS).selectExpr("*", "'a' AS row", "1 AS w", "2 AS window")
    got = decontaminate.find(docs, bench(spark, ITEMS), bit_rows=bit_rows).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = plain_find(TEXTS, ITEMS)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r[-1] for r in want) >= 8 and any(r[3] > 1 for r in want)


def test_window_of_a_third_of_all_documents(spark):
    """A passage that half of the documents hold is looked up, not gathered."""
    rows = [(i, PASSAGE if i % 2 else prose(1000 + i, 20)) for i in range(800)]
    got = decontaminate.find(frame(spark, rows), bench(spark, ITEMS))
    assert got.where("contaminated").count() == 400
    assert {tuple(r.items) for r in got.where("contaminated").collect()} == {("1", "2", "3")}


@pytest.mark.parametrize("remove", ["spans", "documents"])
def test_clean(spark, remove):
    docs = frame(spark, TEXTS).selectExpr("*", "'a' AS row", "1 AS doc", "2 AS spans")
    out = decontaminate.clean(docs, bench(spark, ITEMS), remove)
    assert out.schema.names == docs.columns
    hits = [r[-1] for r in plain_find(TEXTS, ITEMS)]
    want = [(r[0], plain_cut(r[1], ITEMS)) for r in TEXTS] if remove == "spans" else [
        (r[0], r[1]) for r, hit in zip(TEXTS, hits, strict=True) if not hit]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)


def test_decontaminate_empty(spark):
    docs, items = frame(spark, TEXTS), bench(spark, ITEMS)
    assert decontaminate.find(docs.limit(0), items).count() == 0
    clean = decontaminate.find(docs, items.limit(0))
    assert clean.count() == len(TEXTS) and clean.where("contaminated OR n_hit <> 0 OR n_items <> 0").count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(TEXTS)
    with pytest.raises(ValueError):
        decontaminate.clean(docs, items, "words")


# -------------------------------------------------------------- manifest

def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars); result rows as op12's."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def proofs(nodes):
        """The top node, and each node's (before, after) digests on its way."""
        at, ways = [(d, [i]) for i, d in enumerate(nodes)], [[] for _ in nodes]
        while len(at) > 1:
            up = []
            for k in range(0, len(at), 8):
                run = at[k:k + 8]
                for j, (_, below) in enumerate(run):
                    for i in below:
                        ways[i].append(([d for d, _ in run[:j]], [d for d, _ in run[j + 1:]]))
                up.append((sha("".join(d for d, _ in run)), [i for _, below in run for i in below]))
            at = up
        return at[0][0], ways

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    held = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        held[lang] = (own, *proofs([leaf(r, r[1]) for r in own]))
    root, tops = proofs([held[x][1] for x in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        own, subroot, ways = held[lang]
        for r, way in zip(own, ways, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, r[1].translate(UP) if hit and r[1] is not None else r[1])
            for before, after in way + top:
                node = sha("".join([*before, node, *after]))
            proof = sha("".join(d for before, after in way + top for d in [*before, *after]))
            out.append((r[0], leaf(r, r[1]), subroot, root, proof, node, node == root))
    return out


def manifest_rows():
    """Groups of 1, 8, 9, 65 and 600 rows, null and empty groups, null and
    equal ids, equal rows, null texts."""
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(600)]
    rows += [(1000 + i, f"lower {i}" if i % 2 else None, "de", None, None) for i in range(65)]
    rows += [(2000 + i, "A" * i, "", "s", 0) for i in range(9)] + [(3000 + i, "Ünï", None, "s", 0) for i in range(8)]
    rows += [(4000, "One", "é", "s", 1)] + [(None, "No id", "fr", "s", 1)] * 3 + [(7, "Same id", "fr", "s", 1)] + [(7, "Same", "fr", "s", 1)] * 40
    return rows + [(5000 + i, "t", f"x{i}", "s", 0) for i in range(70)]


def registered(docs, monkeypatch):
    monkeypatch.setattr(dataset_queries, "read", lambda spark, sf, name: docs)
    return dataset_queries.op12_merkle_manifest(docs.sparkSession, "")


def test_manifest(spark, monkeypatch):
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "'a' AS tree", "'b' AS key", "1 AS pos")
    got = registered(docs, monkeypatch).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))
    assert len({r.verified for r in got}) == 2


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9])
def test_manifest_of_one_group(spark, monkeypatch, n):
    rows = [(i, f"T{i}", "en", "s", 0) for i in range(n)]
    got = registered(spark.createDataFrame(rows, DOCS), monkeypatch).collect()
    assert Counter(map(tuple, got)) == (Counter(plain_manifest(rows)) if rows else Counter())


def test_manifest_groups(spark):
    docs = spark.createDataFrame(manifest_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    made = merkle.manifest(docs)
    want = {r[2]: p[2] for r, p in zip(sorted_like(manifest_rows()), plain_manifest(manifest_rows()), strict=True)}
    assert {r.group: r.subroot for r in made.groups.collect()} == want
    paths = made.proofs()
    assert paths.where(merkle.fold(F.col("leaf"), F.col("path")) != made.root).count() == 0
    assert merkle.manifest(docs.where("doc_id % 2 = 0")).root != made.root


def sorted_like(rows):
    return sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode()))


# ------------------------------------------------------------- divergence

def plain_audit(rows, least=3, top=200):
    """rows: (text, lang, source)."""
    find = re.compile("[A-Za-z\x80-\U0010ffff]+")
    rows = [((t or "").translate(UP), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, counts = Counter(), defaultdict(Counter)
        for t, x, s in rows:
            if x == lang:
                counts[s].update(find.findall(t))
                docs.update(set(find.findall(t)))
        kept = [t for t in docs if docs[t] >= least]
        whole = sum(counts.values(), Counter())

        def priced(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q, f = {s: priced(c) for s, c in counts.items()}, priced(whole), lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(b, sum(f(p[s][t], p[b][t]) for t in kept)) for b in counts if b != s]
            over = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, held, most in (("pair", pairs, None), ("term", over, top)):
                ranked = sorted(held, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows():
    rows = [(prose(i, 5 + i % 60), ("en", "en", "de")[i % 3], f"s{i % 17}") for i in range(150)]
    rows += [(None, "en", "silent"), ("", None, None), ("words of nowhere", None, "x"), ("x", "lone", "only"), ("rare", "none", "a"), ("odd", "none", "b")]
    return rows + [("Ünï ünï É é TH th thˆ 12 a1b", "en", None)] * 4 + [("th an er", "de", "s3")] * 5


@pytest.mark.parametrize(("cell_terms", "tile_groups", "hot"), [(4096, 32, 1), (7, 3, 1), (7, 32, 256)])
def test_audit(spark, monkeypatch, cell_terms, tile_groups, hot):
    rows = audit_rows()
    monkeypatch.setattr(divergence.pair_divergence, "__defaults__", (cell_terms, tile_groups))
    monkeypatch.setattr(shared, "HOT_FLOOR", hot)
    docs = spark.createDataFrame([(*r, "z") for r in rows], "text string, lang string, source string, term string")
    got = divergence.audit(docs, top=25)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, top=25)


def test_audit_empty(spark):
    assert divergence.audit(frame(spark, awkward()).limit(0)).count() == 0
    got = divergence.audit(frame(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert {(r.source, r["item"], r.value, r["rank"]) for r in got} == {("a", "b", 0, 1), ("b", "a", 0, 1)}


def test_prices_are_exact(spark):
    big = 10 ** 17
    row = spark.range(1).select(divergence.price(F.lit(big), F.lit(3 * big), F.lit(10 ** 9)).alias("p")).first()
    assert row.p == 1 + 10 ** 9 * (big + 1) // (3 * big + 10 ** 9)
