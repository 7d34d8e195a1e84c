"""Language identification by Bayesian evidence fusion.

Four kinds of evidence speak for a language: the text (hashed byte trigrams
under one profile per language), the language that the markup declares, the
suffix of the address, and the host.  How far a declaration or a suffix speaks
for a language is counted over the whole corpus, weighted by what the texts
alone say; so is the prior of a host, which is smoothed towards its parent
domain, that towards its own parent, and the top towards the whole corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.shared import lookup, stage, text_or_empty

LANGUAGES = ("de", "en", "es", "fr")
#: The class of texts in none of the languages: any trigram is as likely as any other.
UNKNOWN = "und"
#: Trigrams are hashed to so many slots.
SLOTS = 1 << 16
#: Texts per language that profiles are fitted on, those of the smallest hashes.
SAMPLE = 500
#: A text counts as this many independent trigrams at most.
MOST_GRAMS = 200
#: Rows' worth of weight that a parent domain has in the prior of a child.
PARENT_WEIGHT = 10.0
#: Characters of a host name at most (the bound of DNS); longer ones are no
#: names under a domain, and their chain is themselves.
HOST_CHARS = 253
ACCEPT = 0.5
PIECE = 1 << 20

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def gram_slots(text: str) -> Iterator[np.ndarray]:
    """The slots of a text's trigrams of UTF-8 bytes, in pieces: lower case,
    and one space for whatever isn't a letter, before and after each word."""
    words = text.lower().encode().translate(_LETTERS).split()
    raw = b" ".join([b"", *words, b""])
    for at in range(0, len(raw) - 2 if words else 0, PIECE):
        b = np.frombuffer(raw, np.uint8, min(PIECE + 2, len(raw) - at), at).astype(np.uint32)
        mixed = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
        yield mixed >> np.uint32(16)


def fit_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> np.ndarray:
    """Log likelihoods of the trigram slots: a row per language, and one of
    UNKNOWN.  Fitted on up to ``sample`` labelled rows a language (those whose
    id has the smallest hash); a language without any gets the flat profile."""
    ids = None
    for lang in languages:
        some = (docs.where(F.col(lang_col) == lang).select(F.col(id_col).alias("_id"), F.xxhash64(id_col).alias("_h"))
                .orderBy("_h", "_id").limit(sample).select("_id"))
        ids = some if ids is None else ids.unionAll(some)
    # at most sample rows a language, so they may be broadcast
    rows = (docs.where(F.col(lang_col).isin(*languages))
            .select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text"))
            .join(F.broadcast(ids.distinct()), "_id").select("lang", "text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for slots in gram_slots(text):
                    slot, n = np.unique(slots, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "slot": slot.astype(np.int32), "n": n})

    counts = rows.mapInPandas(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = np.full((len(languages) + 1, SLOTS), 0.5)
    for row in counts.collect():  # at most SLOTS rows a language
        table[languages.index(row["lang"]), row["slot"]] += row["n"]
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def host_of(url: Column) -> Column:
    """The host of an address, in lower case; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def declared_in(html: Column) -> Column:
    """The primary language subtag that the markup declares; null without."""
    lang = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})\b""", 1))
    return F.when(lang != "", lang)


def visible_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(
        html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*>", " "), r"<[^>]*+>", " ")


def _domains(host: Column) -> Column:
    """The host's domains, shortest first: its last label, its last two and
    so on up to the host."""
    labels = F.split(host, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    return F.when(F.length(host) <= HOST_CHARS, every).otherwise(F.array(host))


def _sums(classes: int, col: str = "soft") -> list[Column]:
    return [F.sum(F.col(col)[k]).alias(f"c{k}") for k in range(classes)]


def _vector(classes: int) -> Column:
    return F.array(*[F.col(f"c{k}") for k in range(classes)])


def _softmax(logits: Column) -> Column:
    def of(x: Column) -> Column:
        e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
        total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
        return F.transform(F.array(F.struct(e.alias("e"), total.alias("t"))),
                           lambda s: F.transform(s["e"], lambda v: v / s["t"]))[0]
    return F.transform(F.array(logits), of)[0]


def _add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def _reliability(rows: DataFrame, col: str, classes: int, total: list[float]) -> DataFrame:
    """log P(value | language) for every value of ``col``, up to a constant
    per value, with the number of rows that have it."""
    found = rows.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"), *_sums(classes))
    # what each class has of this value, against its share of all rows
    share = [(F.col(f"c{k}") + PARENT_WEIGHT * total[k]) / (total[k] * (F.col("n") + PARENT_WEIGHT)) for k in range(classes)]
    return stage(found.select(col, "n", F.array(*[F.log(x) for x in share]).alias(f"{col}_log")))


def identify(rows: DataFrame, profiles: np.ndarray, languages: tuple[str, ...] = LANGUAGES,
             accept: float = ACCEPT) -> DataFrame:
    """``rows`` has the columns text, declared, host and one or more others;
    the result has those others with lang, posterior, n_grams and accepted.

    The suffix is the last label of a host with a dot.  Missing evidence (null
    declaration or host, a text without letters, null or empty text) says
    nothing; with no evidence at all the prior of the whole corpus decides.
    accepted: the text has trigrams of letters, and one of the languages has a
    posterior of ``accept`` or more.  Ties go to the language listed first.
    No rows give no rows."""
    classes = len(languages) + 1
    others = [c for c in rows.columns if c not in ("text", "declared", "host")]

    @F.pandas_udf("array<double>")
    def likelihoods(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for text in batch:
                total = np.zeros(classes + 1)
                for slots in gram_slots(text):
                    total[:-1] += profiles[:, slots].sum(axis=1, dtype=np.float64)
                    total[-1] += len(slots)
                out.append(total)
            yield pd.Series(out, dtype=object)

    # the other columns travel in one, so that their names clash with nothing
    seen = rows.select(F.struct(*others).alias("_others"), "declared", F.lower("host").alias("host"),
                       F.when(F.instr("host", ".") > 0, F.lower(F.substring_index("host", ".", -1))).alias("suffix"),
                       likelihoods(text_or_empty("text")).alias("_sums"))
    grams = F.col("_sums")[classes]
    # overlapping trigrams tell each letter three times
    weight = F.when(grams > 0, F.least(F.lit(1 / 3), MOST_GRAMS / grams)).otherwise(0.0)
    seen = stage(seen.select("_others", "declared", "host", "suffix", grams.cast("long").alias("n_grams"),
                             F.transform(F.slice("_sums", 1, classes), lambda x: x * weight).alias("loglik")))
    # empty texts speak for no class, so they are left out of the counts
    spoken = seen.withColumn("soft", F.when(F.col("n_grams") > 0, _softmax(F.col("loglik"))).otherwise(
        F.array(*[F.lit(0.0)] * classes)))
    counts = spoken.agg(F.count("*").alias("n"), *_sums(classes)).first()
    held = [counts[f"c{k}"] or 0.0 for k in range(classes)]
    total = [(x + 1) / (sum(held) + classes) for x in held]

    hosts = stage(spoken.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *_sums(classes)))
    chain = hosts.select("host", "n", F.posexplode(_domains(F.col("host"))).alias("level", "domain"),
                         *[f"c{k}" for k in range(classes)])
    domains = stage(chain.groupBy("domain").agg(F.count("*").alias("hosts"), F.sum("n").alias("rows"), *[
        F.sum(f"c{k}").alias(f"c{k}") for k in range(classes)]).select("domain", "hosts", "rows", _vector(classes).alias("soft")))
    links = stage(chain.select("host", "n", "level", "domain"))
    chains = lookup(links, domains, "domain", "hosts", links.count()).groupBy("host").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("level", "soft"))).alias("steps"))
    prior = F.aggregate("steps", F.array(*[F.lit(x) for x in total]), lambda up, step: F.transform(
        F.zip_with(step["soft"], up, lambda c, p: c + PARENT_WEIGHT * p),
        lambda x: x / (F.aggregate(step["soft"], F.lit(0.0), lambda a, v: a + v) + PARENT_WEIGHT)))
    priors = stage(chains.select("host", "n", F.transform(prior, lambda x: F.log(x)).alias("host_log")))

    fused = spoken.drop("soft")
    for col, table in (("host", priors), ("declared", _reliability(spoken, "declared", classes, total)),
                       ("suffix", _reliability(spoken, "suffix", classes, total))):
        fused = lookup(fused, table, col, "n", counts["n"]).drop("n")
    flat = F.array(*[F.lit(0.0)] * classes)
    logits = F.col("loglik")
    for col, default in (("host_log", F.array(*[F.lit(math.log(x)) for x in total])), ("declared_log", flat), ("suffix_log", flat)):
        logits = _add(logits, F.coalesce(F.col(col), default))
    post = fused.withColumn("_post", _softmax(logits))
    best = F.array_max("_post")
    name = F.element_at(F.array(*[F.lit(x) for x in (*languages, UNKNOWN)]), F.array_position("_post", best).cast("int"))
    return post.select("_others.*", name.alias("lang"), best.alias("posterior"), "n_grams",
                       ((F.col("n_grams") > 0) & (name != UNKNOWN) & (best >= accept)).alias("accepted"))


def keep_accepted(docs: DataFrame, profiles: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with their columns.
    Rows that agree in id, text and host are judged alike: a decision is
    joined back by id, host and a hash of all three.  Null ids, texts and hosts
    equal each other; no rows give no rows."""
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.col(host_col))
    rows = docs.select(key.alias("key"), F.col(id_col).alias("id"), F.col(host_col).alias("said"), F.col(text_col).alias("text"),
                       F.lit(None).cast("string").alias("declared"), F.col(host_col).cast("string").alias("host"))
    stay = identify(rows, profiles, **options).where("accepted").select(
        F.col("key").alias("__key"), F.col("id").alias("__id"), F.col("said").alias("__said")).distinct()
    same = ((F.col("__own_key") == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__id"))
            & F.col(host_col).eqNullSafe(F.col("__said")))
    return docs.withColumn("__own_key", key).join(stage(stay), same, "left_semi").select(*[F.col(c) for c in docs.columns])
