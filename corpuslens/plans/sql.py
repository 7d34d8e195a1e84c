"""DuckDB SQL fragments for the oracle queries.

Each fragment states the same definition as the Spark operator it checks,
written independently in SQL over the driver's tables."""

from __future__ import annotations

from corpuslens.constants import NLTK_ENGLISH_STOP_WORDS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(expr: str) -> str:
    """B2 in RE2 (no look-ahead): a run of commas is one comma, then a comma
    before a non-digit non-space character goes."""
    x = expr
    for pat, rep in [("[()]", ""), (",{2,}", ","), (r",([^\d\s])", r"\1"), ("[/:]", " "),
                     ("  ", " "), ("[-–−]", " "), (r"\+", "plus"), (r"\*", "")]:
        x = f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"
    return f"lower({x})"


def tokens(expr: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({expr}), '([\\p{{L}}\\p{{N}}]+)', 1), "
            f"lambda t: regexp_matches(t, '[a-z]'))")


def word_count(expr: str) -> str:
    return f"coalesce(len(regexp_extract_all({expr}, '[^ \\t\\n\\f\\r]+')), 0)"


def s_stem(x: str) -> str:
    return (f"(CASE WHEN suffix({x}, 'ies') AND NOT suffix({x}, 'eies') AND NOT suffix({x}, 'aies') "
            f"THEN substr({x}, 1, length({x}) - 3) || 'y' "
            f"WHEN suffix({x}, 'es') AND NOT suffix({x}, 'aes') AND NOT suffix({x}, 'ees') "
            f"AND NOT suffix({x}, 'oes') THEN substr({x}, 1, length({x}) - 1) "
            f"WHEN suffix({x}, 's') AND NOT suffix({x}, 'us') AND NOT suffix({x}, 'ss') AND length({x}) > 1 "
            f"THEN substr({x}, 1, length({x}) - 1) ELSE {x} END)")


def stem_phrase(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: {s_stem('w')}), ' ')"


def stop_values() -> str:
    return "(VALUES " + ", ".join(f"({q(w)})" for w in NLTK_ENGLISH_STOP_WORDS) + ") AS sw(word)"


def stop_list_literal() -> str:
    return "[" + ", ".join(q(w) for w in sorted(set(NLTK_ENGLISH_STOP_WORDS))) + "]"


def r6(x: str) -> str:
    return f"round({x}, 6)"


# ------------------------------------------------------------------ CTE chain

DOCS = f"""
docs AS (SELECT doc_id, {clean("concat_ws('. ', source, text)")} AS corpus FROM documents),
dt AS (SELECT doc_id, corpus, {tokens('corpus')} AS tokens, {word_count('corpus')} AS n_words FROM docs),
ds AS (SELECT doc_id, corpus, tokens, list_transform(tokens, lambda x: {s_stem('x')}) AS stems, n_words FROM dt),
nn AS (SELECT count(*)::DOUBLE AS n, avg(n_words) AS mean FROM ds)"""

WORD_VOCAB = """
tokpos AS (SELECT doc_id, unnest(tokens) AS token, unnest(generate_series(0, len(tokens) - 1)) AS pos FROM ds),
wv AS (SELECT token AS phrase, 1.0::DOUBLE AS score, doc_id AS first_doc, pos::INTEGER AS first_pos
       FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id, pos) AS rn FROM tokpos) WHERE rn = 1)"""


def rake_ctes() -> str:
    stops = stop_list_literal()
    return f"""
rk0 AS (SELECT doc_id, list_filter(list_transform(string_split(array_to_string(list_transform(
            regexp_extract_all(corpus, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\s]+'),
            lambda t: CASE WHEN regexp_matches(t, '^[\\p{{L}}\\p{{N}}]') AND NOT list_contains({stops}, t)
                           THEN t ELSE '|' END), ' '), '|'), lambda p: trim(p)), lambda p: p <> '') AS pieces
        FROM ds),
rk1 AS (SELECT doc_id, unnest(pieces) AS phrase, unnest(generate_series(0, len(pieces) - 1)) AS pidx FROM rk0),
cands AS (SELECT doc_id, pidx, phrase, string_split(phrase, ' ') AS words,
                 list_filter(string_split(phrase, ' '), lambda w: regexp_matches(w, '\\p{{L}}')) AS scored
          FROM rk1),
cands2 AS (SELECT *, len(scored) AS deg FROM cands WHERE len(words) <= 5 AND len(scored) >= 1),
wsc AS (SELECT doc_id, word, sum(deg) / count(*) AS wscore
        FROM (SELECT doc_id, deg, unnest(scored) AS word FROM cands2) GROUP BY doc_id, word),
rph AS (SELECT doc_id, phrase, min(pidx) AS first_pos, any_value(scored) AS scored FROM cands2 GROUP BY doc_id, phrase),
rp AS (SELECT p.doc_id, p.phrase, min(p.first_pos)::INTEGER AS first_pos, sum(w.wscore) AS score
       FROM (SELECT doc_id, phrase, first_pos, unnest(scored) AS word FROM rph) p
       JOIN wsc w ON w.doc_id = p.doc_id AND w.word = p.word GROUP BY p.doc_id, p.phrase),
rv AS (SELECT phrase, score, doc_id AS first_doc, first_pos FROM
         (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, first_pos) AS rn
          FROM rp WHERE score > -10000 AND score < 10000) WHERE rn = 1)"""


VOCAB = f"""
uv AS (SELECT phrase, score, first_doc, first_pos, 0 AS source_rank FROM wv
       UNION ALL SELECT phrase, score, first_doc, first_pos, 1 AS source_rank FROM rv),
uvs AS (SELECT *, {stem_phrase('phrase')} AS stem FROM uv),
vu AS (SELECT stem, phrase, score, source_rank, first_doc, first_pos FROM
         (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY source_rank, first_doc, first_pos, phrase) AS rn
          FROM uvs) WHERE rn = 1),
stops AS (SELECT DISTINCT {stem_phrase('w')} AS stem FROM
            (SELECT DISTINCT lower(trim(word)) AS w FROM {stop_values()}) WHERE w <> ''),
vf AS (SELECT * FROM vu WHERE stem NOT IN (SELECT stem FROM stops))"""

POSTINGS = """
grams AS (SELECT g.doc_id, g.n_words, array_to_string(g.stems[g.i:g.i + kk.k - 1], ' ') AS term
          FROM (SELECT doc_id, n_words, stems, unnest(generate_series(1, len(stems))) AS i FROM ds) g,
               (SELECT unnest(generate_series(1, 5)) AS k) kk
          WHERE g.i + kk.k - 1 <= len(g.stems)),
post AS (SELECT doc_id, n_words, term, count(*) AS tf FROM grams
         WHERE term IN (SELECT stem FROM vf) GROUP BY doc_id, n_words, term)"""

FREQ = """
tstat AS (SELECT term, sum(tf) AS frequency, count(*) AS df FROM post GROUP BY term),
ts AS (SELECT v.*, coalesce(a.frequency, 0)::BIGINT AS frequency, coalesce(a.df, 0)::BIGINT AS df,
              coalesce(a.df, 0) / (SELECT n FROM nn) AS fraction
       FROM vf v LEFT JOIN tstat a ON a.term = v.stem),
ff AS (SELECT *, CASE WHEN frequency <= 5 THEN 'frequency<=min' WHEN fraction >= 0.8 THEN 'above max' END AS reason
       FROM ts),
fk AS (SELECT * FROM ff WHERE reason IS NULL),
post2 AS (SELECT * FROM post WHERE term IN (SELECT stem FROM fk))"""

CC = """
nf AS (SELECT term, sum(tf / n_words) * (SELECT mean FROM nn) AS norm_frequency FROM post2 GROUP BY term),
occ AS (SELECT f.stem AS term, count(d.doc_id) AS n_occ_doc
        FROM fk f LEFT JOIN (SELECT doc_id, array_to_string(stems, ' ') AS cs FROM ds) d
        ON contains(d.cs, f.stem) GROUP BY f.stem),
cc0 AS (SELECT f.stem, coalesce(nf.norm_frequency, 0.0) AS norm_frequency, coalesce(o.n_occ_doc, 0) AS n_occ_doc,
               (SELECT n FROM nn) * (1.0 - pow(1.0 - 1.0 / (SELECT n FROM nn), coalesce(nf.norm_frequency, 0.0))) AS expd
        FROM fk f LEFT JOIN nf ON nf.term = f.stem LEFT JOIN occ o ON o.term = f.stem),
cc AS (SELECT stem, norm_frequency, n_occ_doc,
              CASE WHEN expd <> 0 THEN n_occ_doc / expd END AS cc_ratio FROM cc0),
cf AS (SELECT *, CASE WHEN cc_ratio IS NULL THEN 'cc undefined' WHEN cc_ratio >= 0.9 THEN 'cc>=threshold' END AS reason
       FROM cc),
ck AS (SELECT * FROM cf WHERE reason IS NULL),
post3 AS (SELECT * FROM post WHERE term IN (SELECT stem FROM ck))"""

CORR = """
cw AS (SELECT doc_id, term, tf * (SELECT mean FROM nn) / n_words AS w FROM post3),
csum AS (SELECT term, s, CASE WHEN q - s * s / (SELECT n FROM nn) > 1e-12 * q THEN q - s * s / (SELECT n FROM nn) END AS v
         FROM (SELECT term, sum(w) AS s, sum(w * w) AS q FROM cw GROUP BY term)),
cdot AS (SELECT a.term AS t1, b.term AS t2, sum(a.w * b.w) AS d FROM cw a JOIN cw b
         ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY a.term, b.term),
corr AS (SELECT t1, t2, (d - s1.s * s2.s / (SELECT n FROM nn))
                / sqrt(s1.v * s2.v) AS corr
         FROM cdot JOIN csum s1 ON s1.term = t1 JOIN csum s2 ON s2.term = t2),
cpairs AS (SELECT c.t1, c.t2, round(a.cc_ratio, 9) AS c1, round(b.cc_ratio, 9) AS c2 FROM corr c
           JOIN ck a ON a.stem = c.t1 JOIN ck b ON b.stem = c.t2 WHERE c.corr > 0.7),
losers AS (SELECT t1 AS stem FROM cpairs WHERE c1 > c2 UNION SELECT t2 AS stem FROM cpairs WHERE c2 >= c1),
crf AS (SELECT ck.*, CASE WHEN l.stem IS NOT NULL THEN 'correlated' END AS reason2
        FROM ck LEFT JOIN losers l ON l.stem = ck.stem),
topics AS (SELECT *, (row_number() OVER (ORDER BY round(cc_ratio, 9) ASC NULLS LAST, stem) - 1)::INTEGER AS topic_id
           FROM (SELECT c.stem, v.phrase, c.cc_ratio FROM crf c JOIN vf v ON v.stem = c.stem
                 WHERE reason2 IS NULL ORDER BY round(c.cc_ratio, 9) ASC NULLS LAST, c.stem LIMIT 2000))"""

FEATS = """
tcount AS (SELECT p.doc_id, t.topic_id, p.tf::DOUBLE AS tf FROM post p JOIN topics t ON t.stem = p.term),
tidf AS (SELECT topic_id, ln(((SELECT n FROM nn) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM tcount GROUP BY topic_id),
ttfidf AS (SELECT c.doc_id, c.topic_id, c.tf * i.idf AS v FROM tcount c JOIN tidf i USING (topic_id)),
tfidf AS (SELECT doc_id, topic_id, CASE WHEN nrm > 0 THEN v / nrm ELSE 0.0 END AS value
          FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS nrm FROM ttfidf))"""


def chain(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts) + "\n"


EMB = """
ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, len(embedding) - 1)) AS d
       FROM embeddings)"""
