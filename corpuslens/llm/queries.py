"""One registered query per operator, each over its whole table with the
operator's production parameters, and DuckDB statements where SQL can state
the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import ann, bpe, chat, dataset_queries, exact, langid, mixing, pii, secrets, simhash, toxicity
from corpuslens.llm.shared import read

Query = Callable[[SparkSession, str], DataFrame]

# ------------------------------------------------ 1 SimHash near duplicates


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


# ------------------------------------------------------------ 2 toxicity


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(~toxicity.held_out()))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


# ------------------------------------------------------------- 3 secrets


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def _matches(kinds: list[tuple[str, str]], texts: str = "d") -> str:
    """Common table expressions up to ``x``: (doc_id, ord, kind, value, start,
    stop) for all matches of the patterns."""
    each = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS ord, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM {texts}"
        for i, (kind, p) in enumerate((k, p.replace("'", "''")) for k, p in kinds))
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)::BIGINT"
    return f"""
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({each}),
j AS (SELECT *, unnest(range(len(m))) AS i FROM k),
x AS (SELECT doc_id, ord, kind, m[i + 1] AS value, {size('p[1:i + 1]')} + {size('m[1:i]')} AS start,
             {size('p[1:i + 1]')} + {size('m[1:i + 1]')} AS stop FROM j)"""


SPANS = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord){0}, '')"


def _op3_sql() -> str:
    """The scan with patterns that need no look-behind: the matches of whole
    rows of like characters, held to their least length.  Cut strings are
    spelt out character by character, with spaces for what is cut."""
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""(?:{either})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
    value = assign.replace("[A-Za-z0-9+/_.=-]+", "([A-Za-z0-9+/_.=-]+)").replace("'", "''")
    words = f"'{secrets.ALLOW[-1]}'"
    allowed = " OR ".join(f"regexp_full_match(value, '{a.replace('*+', '*')}')" for a in secrets.ALLOW[:-1])
    bits = " ".join(f"WHEN regexp_full_match(value, '{c.pattern}') THEN {c.bits}" for c in secrets.CLASSES)
    w, run, part = secrets.WINDOW, "[A-Za-z0-9+/=_-]+", "[A-Za-z0-9+]+"
    pieces = lambda m, of, more: f"""SELECT {more}, m[i + 1] AS value,
             coalesce(list_sum(list_transform(p[1:i + 1] || m[1:i], lambda y: length(y))), 0)::BIGINT AS behind
      FROM (SELECT *, unnest(range(len(m))) AS i FROM (SELECT *, regexp_extract_all({of}, '{m}') AS m, string_split_regex({of}, '{m}') AS p FROM"""  # noqa: E731
    return f"""
WITH {_matches([("assign", assign), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"), (secrets.ADDED, run)])},
base AS (SELECT * FROM x WHERE kind = 'assign' AND length(regexp_extract(value, '{value}', 1)) >= {secrets.ASSIGN_LEAST}
         OR kind = 'access' AND length(value) >= 20 OR kind = 'hex' AND length(value) >= 24),
r AS (SELECT row_number() OVER () AS rid, doc_id, value AS whole, start, stop FROM x
      WHERE kind = '{secrets.ADDED}' AND length(value) >= {w} AND NOT ({allowed})),
seg AS ({pieces(part, "whole", "rid")} r))),
cut AS (SELECT rid, list(struct_pack(a := a, b := b)) AS cuts FROM (
          SELECT rid, behind AS a, behind + length(value) AS b FROM seg WHERE regexp_full_match(value, {words})
          UNION ALL SELECT r.rid, b.start - r.start, b.stop - r.start FROM r JOIN base b
                    ON b.doc_id IS NOT DISTINCT FROM r.doc_id AND b.start < r.stop AND r.start < b.stop) GROUP BY rid),
blank AS (SELECT doc_id, start, coalesce(whole, '') AS whole, cuts FROM r LEFT JOIN cut USING (rid)),
left_over AS (SELECT doc_id, start, whole AS left_of FROM blank WHERE cuts IS NULL
      UNION ALL SELECT doc_id, start, array_to_string(list_transform(range(length(whole)), lambda i:
                CASE WHEN len(list_filter(cuts, lambda c: c.a <= i AND i < c.b)) > 0 THEN ' ' ELSE substr(whole, (i + 1)::BIGINT, 1) END), '')
           FROM blank WHERE cuts IS NOT NULL),
piece AS ({pieces(run, "left_of", "doc_id, start")} left_over))),
c AS (SELECT row_number() OVER () AS pid, doc_id, start + behind AS start, value, CASE {bits} END AS bits FROM piece
      WHERE length(value) >= {w} AND NOT ({allowed})),
h AS (SELECT pid, doc_id, start, unnest(list_filter(range(length(value) - {w - 1}), lambda i:
             list_aggregate(string_split(substr(value, (i + 1)::BIGINT, {w}), ''), 'entropy') >= bits)) AS hot FROM c),
n AS (SELECT *, coalesce(hot - lag(hot) OVER (PARTITION BY pid ORDER BY hot) > {w}, true)::INTEGER AS begins FROM h),
e AS (SELECT *, sum(begins) OVER (PARTITION BY pid ORDER BY hot) AS stretch FROM n),
s AS (SELECT doc_id, ord, kind, start, stop FROM base
      UNION ALL SELECT any_value(doc_id), {len(secrets.KINDS)}, '{secrets.ADDED}', min(start + hot), max(start + hot) + {w} FROM e GROUP BY pid, stretch),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.KINDS)},
             {SPANS.format(" FILTER (ord < 3)")} AS base, {SPANS.format("")} AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


# ---------------------------------------------------------------- 4 chat


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(rows.unionAll(more)))


def _op4_sql() -> str:
    """The template and the machine, said in SQL."""
    literal = lambda x: "'" + x.replace("'", "''") + "'"

    def escaped(x: str) -> str:
        out = f"replace({x}, {literal(chat.ESCAPE)}, {literal(chat.ESCAPE * 2)})"
        for c in chat.controls():
            out = f"replace({out}, {literal(c)}, {literal(c[0] + chat.ESCAPE + c[1:])})"
        return out

    role = f"replace({escaped('r')}, {literal(chat.OTHER_MID)}, {literal(chat.ESCAPE + chat.OTHER_MID)})"
    marks = " ".join(f"WHEN {literal(n)} THEN {len(m.before) + len(m.after)}" for n, m in chat.TEMPLATE.items())
    others = len(chat.OTHER_BEFORE + chat.OTHER_MID + chat.OTHER_AFTER)
    learnt = ", ".join(literal(n) for n, m in chat.TEMPLATE.items() if m.loss)
    # a role that the machine takes is the state it goes to
    ways = ", ".join(f"({literal(a)}, {literal(b)})" for a, to in chat.TURNS.items() for b in to)
    return f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM c),
m AS (SELECT *, coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY i), 'start') AS before,
             CASE r {marks} ELSE {others} + length({role}) END + length({escaped('t')}) AS chars FROM n),
b AS (SELECT *, (before, r) IN ({ways}) AS fits FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (r IN ({learnt})), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY i) FILTER (r IN ({learnt})), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       min(i) FILTER (NOT fits) IS NULL AND arg_max(r, i) IN ({", ".join(map(literal, chat.ENDS))}) AS valid,
       coalesce(min(i) FILTER (NOT fits) - 1, -1)::INTEGER AS bad_turn
FROM b GROUP BY conv_id"""


# ------------------------------------------------- 5 nearest neighbours


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return ann.nearest(rows, F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


# ------------------------------------------------------------ 6 byte BPE


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"), bpe.default_tokenizer(spark))


# -------------------------------------------------------------- 7 mixing


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(read(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


# --------------------------------------------------------- 8 exact dedup


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(read(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
h AS (SELECT *, ('0x' || substr(md5('42:row:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
             length(bin(size + 1)) * 16 + ('0b' || rpad(substr(bin(size + 1), 2, 4), 4, '0'))::INTEGER AS class FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0, 2.0, 1.0], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
u AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER line, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER line, 0.0)) AS share
      FROM w WINDOW line AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(share) OVER () * w)::DOUBLE AS target FROM u),
r AS (SELECT h.doc_id, h.source, h.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             ('0x' || substr(md5('42:offset:' || coalesce(h.source, '')), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS o,
             row_number() OVER (PARTITION BY h.source ORDER BY class, h % 256, size, h, doc_id NULLS FIRST) AS n
      FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, least(floor(n * rate + o) - floor((n - 1) * rate + o), 3)::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM k
"""

OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

# ----------------------------------------------------- 9 personal data


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def _op9_sql() -> str:
    """Entities, what words beside them may reveal, the corpus counts, and all
    places of the revealing words, in SQL."""
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
             ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)::BIGINT"
    term, near = r"[\p{L}]{3,}", pii.CONTEXT
    luhn = ("list_sum(list_transform(range(length(digits)), lambda i: (substr(digits, length(digits) - i, 1)::INTEGER * (1 + i % 2)) // 10 "
            "+ (substr(digits, length(digits) - i, 1)::INTEGER * (1 + i % 2)) % 10)) % 10 = 0")
    return f"""
WITH {_matches(kinds)},
y AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM x),
base AS (SELECT *, kind || ':' || CASE WHEN ord < 2 THEN lower(value) ELSE digits END AS entity FROM y
         WHERE kind = 'email'
           OR kind = 'ip' AND len(list_filter(string_split(value, '.'), lambda q: length(ltrim(q, '0')) > 3
                OR coalesce(try_cast(ltrim(q, '0') AS INTEGER), 0) > {pii.IP_MOST})) = 0
           OR kind = 'card' AND length(digits) BETWEEN {pii.CARD_DIGITS[0]} AND {pii.CARD_DIGITS[1]} AND {luhn}
           OR kind = 'phone' AND length(digits) BETWEEN {pii.PHONE_DIGITS[0]} AND {pii.PHONE_DIGITS[1]}),
held AS (SELECT *, CASE ord WHEN 0 THEN [entity, kind || ':', kind || ':@' || lower(split_part(value, '@', 2))]
           WHEN 1 THEN [entity, kind || ':', kind || ':' || regexp_extract(value, '^[0-9]+[.][0-9]+[.][0-9]+[.]')] ELSE [entity, kind || ':'] END AS classes FROM base),
around AS (SELECT b.doc_id, classes, greatest(b.start - {near}, 0) AS origin, greatest(b.start - {near}, 0) AS low, NULL::BIGINT AS high,
                  substr(t, greatest(b.start - {near}, 0) + 1, b.start - greatest(b.start - {near}, 0)) AS s
           FROM held b JOIN d USING (doc_id)
           UNION ALL SELECT b.doc_id, classes, b.stop, NULL, CASE WHEN length(t) > b.stop + {near} THEN b.stop + {near} END,
                  substr(t, b.stop + 1, {near}) FROM held b JOIN d USING (doc_id)),
pieces AS (SELECT *, regexp_extract_all(s, '{term}') AS m, string_split_regex(s, '{term}') AS p FROM around),
each AS (SELECT *, unnest(range(len(m))) AS i FROM pieces),
terms AS (SELECT doc_id, classes, lower(m[i + 1]) AS word, origin + {size('p[1:i + 1]')} + {size('m[1:i]')} AS start,
                 origin + {size('p[1:i + 1]')} + {size('m[1:i + 1]')} AS stop, low, high FROM each),
beside AS (SELECT unnest(classes) AS class, word FROM terms e
           WHERE (low IS NULL OR low = 0 OR start > low) AND (high IS NULL OR stop < high)
             AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = e.doc_id AND b.start < e.stop AND e.start < b.stop)),
pairs AS (SELECT class, word, count(*) AS n FROM beside GROUP BY class, word),
words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(t), '{term}')) AS word FROM d) GROUP BY word),
holders AS (SELECT class, count(DISTINCT doc_id) / (SELECT count(*) FROM d) AS whole FROM (SELECT doc_id, unnest(classes) AS class FROM held) GROUP BY class),
shares AS (SELECT word, whole, (pairs.n + {pii.PRIOR} * whole) / (words.n + {pii.PRIOR}) AS share FROM pairs JOIN words USING (word) JOIN holders USING (class)),
strong AS (SELECT word, max(share) AS share FROM shares WHERE share >= {pii.DISCLOSES} AND log2(share / whole) >= {pii.LEAST_BITS} GROUP BY word),
texts AS (SELECT doc_id, regexp_extract_all(t, '{term}') AS m, string_split_regex(t, '{term}') AS p FROM d),
met AS (SELECT doc_id, m, p, i FROM (SELECT *, unnest(range(len(m))) AS i FROM texts) JOIN strong ON word = lower(m[i + 1])),
places AS (SELECT doc_id, {size('p[1:i + 1]')} + {size('m[1:i]')} AS start, {size('p[1:i + 1]')} + {size('m[1:i + 1]')} AS stop FROM met),
added AS (SELECT * FROM places e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = e.doc_id AND b.start < e.stop AND e.start < b.stop)),
s AS (SELECT doc_id, ord, kind, start, stop FROM base
      UNION ALL SELECT doc_id, {len(pii.KINDS)}, '{pii.ADDED}', start, stop FROM added),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS)},
             {SPANS.format(" FILTER (ord < 4)")} AS base, {SPANS.format("")} AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


# -------------------------------------------------------- 10 language ID


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (host: their source) and pages (host, suffix and declared
    language from address and markup) as one corpus."""
    documents, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    none = F.lit(None)
    rows = documents.select(
        "doc_id", none.cast("long").alias("page_id"), "text", none.cast("string").alias("declared"),
        F.col("source").alias("host")).unionAll(pages.select(
            none.cast("long").alias("doc_id"), "page_id", langid.visible_text(F.col("html")).alias("text"),
            langid.declared_in(F.col("html")).alias("declared"), langid.host_of(F.col("url")).alias("host")))
    return langid.identify(rows, langid.fit_profiles(documents))


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_secrets": op3_secrets,
    "op4_chat": op4_chat,
    "op5_neighbours": op5_neighbours,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_personal_data": op9_personal_data,
    "op10_language_id": op10_language_id,
    **dataset_queries.QUERIES,
}

ORACLE: dict[str, str] = {
    "op3_secrets": _op3_sql(),
    "op4_chat": _op4_sql(),
    "op5_neighbours": OP5_SQL,
    "op7_mixing": OP7_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_personal_data": _op9_sql(),
    **dataset_queries.ORACLE,
}
