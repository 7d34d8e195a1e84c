"""Personal data: patterns of entities, and terms that give an entity away.

Information-theoretic sanitisation: the words around an entity are counted
with it over the whole corpus, and all words of the corpus by themselves.  What
a word may give away is the entity, its neighbourhood (the domain of an email,
the network of an address) or its kind.  The share of the word's occurrences
that stand beside one of these, drawn towards the share of documents that hold
it as if by PRIOR further occurrences, estimates P(entity | term); against that
share of documents it gives the information in bits.  Terms over the thresholds
are generalised, the strongest removed, wherever in the corpus they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.shared import lookup, stage, text_or_empty
from corpuslens.llm.spans import SPAN, count_kind, in_order, let, match_spans, span_string

# Fixed values of the task: the base patterns and the bounds of their matches.
# An email can only start where a row of its characters does (or where the
# last match ended), an address only at a row of digits; that keeps long rows
# linear and finds the same matches.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
IP_MOST, CARD_DIGITS, PHONE_DIGITS = 255, (12, 19), (9, 15)

ADDED = "term"
#: Code points on either side of an entity in which its terms stand.
CONTEXT = 48
TERM = r"\p{L}{3,}+"
#: Occurrences by which a term's share is drawn towards the documents' share.
PRIOR = 1.0
#: A term is generalised from this share and information in bits,
DISCLOSES, LEAST_BITS = 0.5, 2.0
#: and removed from this share.
REMOVES = 0.9
#: Rows of 64 bits of the table of hash bits that words are held against.
SLOTS = 1 << 14


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        twice = F.substring(digits, i, F.lit(1)).cast("int") * (1 + (n - i) % 2)
        return total + F.floor(twice / 10).cast("int") + twice % 10

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    """Digits without leading zeros that are at most IP_MOST, however long."""
    return F.when(F.length(part) <= 3, F.coalesce(part.try_cast("int"), F.lit(0)) <= IP_MOST).otherwise(False)


def base_spans(text: Column) -> Column:
    """Base spans in order; a match that fails takes its place all the same."""
    ip = F.filter(match_spans(text, IP, "ip", 1), lambda s: F.forall(
        F.split(s["value"], r"\."), lambda p: _small(F.regexp_replace(p, "^0+", ""))))
    card = F.filter(match_spans(text, CARD, "card", 2), lambda s: let(
        _digits(s["value"]), lambda d: F.when(F.length(d).between(*CARD_DIGITS), luhn(d)).otherwise(False)))
    phone = F.filter(match_spans(text, PHONE, "phone", 3),
                     lambda s: F.length(_digits(s["value"])).between(*PHONE_DIGITS))
    return in_order(match_spans(text, EMAIL, "email", 0), ip, card, phone)


def entity_classes(span: Column) -> Column:
    """What a word may reveal of an entity: kind and normalised value, the
    kind, and the domain of an email or the first three parts of an address."""
    kind = F.concat(span["kind"], F.lit(":"))
    low = F.lower(span["value"])
    named = lambda value, *more: F.array(F.concat(kind, value), kind, *more)
    return (F.when(span["kind"] == "email", named(low, F.concat(kind, F.lit("@"), F.substring_index(low, "@", -1))))
            .when(span["kind"] == "ip", named(low, F.concat(kind, F.substring_index(low, ".", 3), F.lit("."))))
            .otherwise(named(_digits(span["value"]))))


def context_terms(text: Column, span: Column) -> Column:
    """Spans (kind ``term``) of the words beside a span; a word that the edge
    of the context may cut is left out."""
    start = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = F.filter(match_spans(F.substring(text, start + 1, span["start"] - start), TERM, ADDED, len(KINDS), start),
                      lambda t: (t["start"] > start) | (start == 0))
    edge = span["end"] + CONTEXT
    after = F.filter(match_spans(F.substring(text, span["end"] + 1, F.lit(CONTEXT)), TERM, ADDED, len(KINDS), span["end"]),
                     lambda t: (t["end"] < edge) | (F.length(text) <= edge))
    return F.concat(before, after)


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def _bits(word: Column) -> Column:
    """Two of 64 bits, from twelve bits of the word's hash."""
    h = F.xxhash64(word)
    one = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"),
                                        F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    return one(58).bitwiseOR(one(52))


def hash_bits(words: DataFrame) -> DataFrame:
    """One row: ``bits``, an array of SLOTS longs with two bits set per word."""
    held = words.groupBy(_slot(F.col("word")).alias("slot")).agg(F.bit_or(_bits(F.col("word"))).alias("mask"))
    every = words.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(held, "slot", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("mask", F.lit(0)).alias("mask")))),
                                 lambda r: r["mask"]).alias("bits"))


def _may_hold(bits: Column, word: Column) -> Column:
    """False only for words whose bits are not both set in the table."""
    return let(_bits(word), lambda b: F.get(bits, _slot(word)).bitwiseAND(b) == b)


def occurrences(held: DataFrame, strong: DataFrame) -> DataFrame:
    """(row, term, share): every place outside base spans where a word of
    ``strong`` (word, all: its occurrences, share) stands in ``held``.  Words
    whose bits aren't in a table of fixed size are dropped in their row, so
    what is shuffled grows with the revealing words and not with the corpus."""
    total = strong.agg(F.sum("all")).first()[0] or 0
    marked = held.select("row", "text", "base").crossJoin(F.broadcast(hash_bits(strong)))
    text, bits = F.col("text"), F.col("bits")
    any_word = F.exists(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda w: _may_hold(bits, w))
    found = F.filter(match_spans(text, TERM, ADDED, len(KINDS)), lambda t: _may_hold(bits, F.lower(t["value"])) & ~F.exists(
        "base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    terms = marked.where(any_word).select("row", F.explode(found).alias("term"))
    return lookup(terms.select("row", "term", F.lower("term.value").alias("word")), strong, "word", "all", total).where(
        "share is not null")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR,
         discloses: float = DISCLOSES, least_bits: float = LEAST_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and added (arrays of spans in
    order; added: terms that reveal an entity, its neighbourhood or its kind,
    wherever in the corpus they stand, with the largest such share as
    ``share``) and text_key (a hash of the text).

    With the default ``prior`` a word that stands once in the corpus, beside
    an entity, has a share just above one half.  Copies of a text count as
    often as they stand.  A term that lies within a base span is left out.
    Null and empty texts have no spans; null ids, repeated rows and empty
    tables come out as they went in."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       text.alias("text"), base_spans(text).alias("base"))
    near = F.flatten(F.transform("base", lambda b: F.transform(
        context_terms(F.col("text"), b), lambda t: F.struct(b.alias("entity"), t.alias("term")))))
    free = F.filter(near, lambda n: ~F.exists(
        "base", lambda b: (b["start"] < n["term"]["end"]) & (n["term"]["start"] < b["end"])))
    held = stage(rows.select("doc_id", "row", "text", F.xxhash64("text").alias("text_key"), "base", free.alias("near")))

    beside = held.select(F.explode("near").alias("n")).select(
        F.explode(entity_classes(F.col("n.entity"))).alias("class"), F.lower("n.term.value").alias("word"))
    pairs = beside.groupBy("class", "word").agg(F.count("*").alias("n"))
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("word"))
    # partial counts per task are all that is shuffled of the corpus
    counted = words.groupBy("word").agg(F.count("*").alias("all"))
    most = (F.col("n") + prior) / (F.col("all") + prior)
    known = stage(pairs.join(counted, "word").where(most >= discloses))
    entities = held.select("row", F.explode("base").alias("entity")).select("row", F.explode(entity_classes(F.col("entity"))).alias("class"))
    classes = entities.distinct()
    weights = known.groupBy("class").agg(F.count("*").alias("weight"))
    spread = stage(classes.groupBy("class").agg(F.count("*").alias("rows")).join(weights, "class"))
    whole = F.col("rows") / F.lit(float(max(held.count(), 1)))
    share = (F.col("n") + prior * whole) / (F.col("all") + prior)
    priced = lookup(known, spread, "class", "weight", known.count()).withColumn("share", share)
    strong = stage(priced.where((F.col("share") >= discloses) & (F.log2(F.col("share") / whole) >= least_bits)).groupBy("word").agg(
        F.max("all").alias("all"), F.max("share").alias("share")))
    added = occurrences(held, strong).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("term.start", "term.ord", "term.end", "term.kind", "term.value", "share"))).alias("added"))
    return held.join(added, "row", "left").select(
        "doc_id", "base", F.coalesce("added", F.array().cast(
            "array<struct<start:int,ord:int,end:int,kind:string,value:string,share:double>>")).alias("added"), "text_key")


def sanitise(text: Column, base: Column, added: Column, removes: float = REMOVES) -> Column:
    """The text with entities replaced by their kind, revealing terms by
    [TERM], and terms from the share ``removes`` on removed.  Of spans that
    overlap the first, then longest, is taken.  A null text stays null."""
    cuts = F.sort_array(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.concat(
            F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"))),
        F.transform(added, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.when(
            s["share"] >= removes, "").otherwise("[TERM]").alias("put")))))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(s: Column, c: Column) -> Column:
        kept = F.substring(text, s["at"] + 1, c["start"] - s["at"])
        return F.when(c["start"] < s["at"], s).otherwise(F.struct(
            (-c["back"]).alias("at"), F.concat(s["out"], F.array(kept, c["put"])).alias("out")))

    return F.aggregate(cuts, state, cut, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def digest(found: DataFrame) -> DataFrame:
    base = span_string(F.col("base"))
    plain = F.transform("added", lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"], s["value"])).cast(SPAN)
    return found.select("doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(base, 256).alias("base_sha256"), span_string(in_order(F.col("base"), plain)).alias("spans"))
