"""Registered queries of the operators that judge or seal a whole dataset:
divergence audit, Merkle manifest and decontamination, with DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, divergence, merkle
from corpuslens.llm.shared import LOWER, UPPER, lower_ascii, read

# --------------------------------------------------- 11 source divergence


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{divergence.TERM}') AS t FROM documents),
e AS (SELECT r, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM e JOIN kept USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, sum(n) AS words, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(l.v), 0) AS v, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = d.lang AND c.source = d.source) AS words
      FROM d LEFT JOIN l USING (lang) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + {divergence.SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.words + g.v) AS p,
             1 + {divergence.SCALE}::HUGEINT * (k.n + 1) // (l.words + l.v) AS q
      FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
rows AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN f USING (lang, source, item)
         UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}"""

# ------------------------------------------------------- 12 Merkle manifest


def tampered_leaf() -> F.Column:
    """The leaf of a row whose text had its capitals lowered, for rows whose
    id's CRC-32 is divisible by three; the row's own leaf otherwise."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return merkle.leaf_digest(*[text if c == "text" else F.col(c) for c in merkle.COLUMNS])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.manifest(read(spark, sf_dir, "documents"), carry={"found": tampered_leaf()})
    out = made.proofs().select(
        F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(made.root).alias("root"),
        merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.fold(F.col("found"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _op12_sql() -> str:
    """Levels as lists of digests, grown until one is left.  A step is the
    text before and after a node, with a bar between them."""
    n = merkle.ARITY
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in merkle.COLUMNS) + ")"
    up = f"list_transform(range((len(nodes) + {n - 1}) // {n}), lambda i: sha256(array_to_string(nodes[i * {n} + 1:i * {n} + {n}], '')))"
    run = f"(pos // power({n}, level + 1)::BIGINT * {n})"
    mine = f"(pos // power({n}, level)::BIGINT)"
    step = f"array_to_string(nodes[{run} + 1:{mine}], '') || '|' || array_to_string(nodes[{mine} + 2:{run} + {n}], '')"
    crc = ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, c: "
           "list_reduce(list_prepend(xor(a, c), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {leaf('text')} AS leaf,
                            CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS found FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang
      UNION ALL SELECT lang, level + 1, {up} FROM t WHERE len(nodes) > 1),
s AS (SELECT lang, nodes[1] AS subroot, level AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM s UNION ALL SELECT level + 1, {up} FROM u WHERE len(nodes) > 1),
r AS (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1),
low AS (SELECT p.lang, pos, list({step} ORDER BY level) AS steps FROM p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang WHERE len(nodes) > 1 GROUP BY p.lang, pos),
high AS (SELECT lang, list({step} ORDER BY level) AS steps FROM (SELECT lang, place AS pos FROM s) CROSS JOIN u WHERE len(nodes) > 1 GROUP BY lang),
w AS (SELECT p.doc_id, p.leaf, p.found, s.subroot, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS path
      FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN low ON low.lang IS NOT DISTINCT FROM p.lang AND low.pos = p.pos
      LEFT JOIN high ON high.lang IS NOT DISTINCT FROM p.lang),
f AS (SELECT *, list_reduce(list_prepend(found, path), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM f CROSS JOIN r"""


# ---------------------------------------------------- 13 decontamination


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _op13_sql() -> str:
    split = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '{decontaminate.TOKEN}')"
    runs = "unnest(range(len(w) - n + 1)) AS i, unnest(list_transform(range(len(w) - n + 1), lambda i: array_to_string(w[i + 1:i + n], ' '))) AS x"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split('text')} AS w FROM documents),
b AS (SELECT item_id, {split('text')} AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, n, x FROM (SELECT item_id, n, {runs} FROM (SELECT *, least(len(w), {decontaminate.WINDOW}) AS n FROM b WHERE len(w) > 0))),
q AS (SELECT r, n, {runs} FROM (SELECT r, w, n FROM d JOIN (SELECT DISTINCT n FROM k) ON len(w) >= n)),
h AS (SELECT r, i, n, item_id FROM q JOIN k USING (n, x)),
c AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS spot FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)"""


QUERIES = {
    "op11_source_divergence": op11_source_divergence,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_decontaminate": op13_decontaminate,
}

ORACLE = {
    "op11_source_divergence": OP11_SQL,
    "op12_merkle_manifest": _op12_sql(),
    "op13_decontaminate": _op13_sql(),
}
