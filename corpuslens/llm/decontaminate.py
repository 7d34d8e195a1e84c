"""Benchmark decontamination: windows of benchmark words that stand in
documents are found, verified, and cut out (or their documents dropped).

The windows of the benchmark go to every task as a set of hash bits, sized from
the number of windows but of BIT_ROWS rows at most, so it may be broadcast
whatever the benchmark's size.  Each document's windows are hashed and held
against it where the document is read; the few that pass take their words along
and are verified against the benchmark's own windows by an equality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.shared import lookup, lower_ascii, stage, text_or_empty

# Fixed values of the task: what a word is once A-Z are lower-cased, the same
# over unchanged text, and the words of a window.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10

#: Rows of 64 hash bits in the broadcast table, at most.  With fewer windows
#: than rows about one window in a thousand passes by chance; with ten times
#: as many one in fourteen.  Those are dropped by the verification.
BIT_ROWS = 1 << 20

#: A text is worked on in pieces of so many windows, so that what is held
#: beside a window does not grow with the text.
PIECE = 128


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text_or_empty(text)), F.lit(TOKEN), F.lit(0))


def _window_hashes(held: Column, n: int | Column, most: int | None = None) -> Column:
    """A hash per run of n words, by the position of its first word (the
    first ``most`` of them)."""
    n = F.lit(n) if isinstance(n, int) else n
    last = lambda h: F.size(h) - n + 1 if most is None else F.least(F.size(h) - n + 1, F.lit(most))
    return F.transform(F.array(F.transform(held, lambda w: F.xxhash64(w))), lambda h: F.when(
        F.size(h) >= n, F.transform(F.sequence(F.lit(1), last(h)), lambda i: F.xxhash64(F.slice(h, i, n))))
        .otherwise(F.array().cast("array<bigint>")))[0]


def _pieces(w: Column, longest: int, doc: Column) -> Column:
    """The words of a text as structs: first one with the number of words and
    ``doc``, then pieces of PIECE words and the ``longest`` - 1 after them,
    with the position of their first."""
    none = F.lit(None).cast("int")
    head = lambda held: F.struct(none.alias("first"), F.size(held).cast("long").alias("n_words"), doc.alias("doc"),
                                 F.array().cast("array<string>").alias("w"))
    piece = lambda held: lambda k: F.struct(
        (k * PIECE).cast("int").alias("first"), F.lit(None).cast("long").alias("n_words"),
        F.when(F.lit(False), doc).alias("doc"), F.slice(held, k * PIECE + 1, F.lit(PIECE + longest - 1)).alias("w"))
    return F.transform(F.array(w), lambda held: F.concat(F.array(head(held)), F.when(
        F.size(held) > 0, F.transform(F.sequence(F.lit(0), ((F.size(held) - 1) / PIECE).cast("int")), piece(held)))
        .otherwise(F.slice(F.array(piece(held)(F.lit(0))), 1, 0))))[0]


def _bit(h: Column, shift: int) -> Column:
    """One of 64 bits, from six bits of the hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"),
                           F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))


def _both_bits(h: Column) -> Column:
    return _bit(h, 58).bitwiseOR(_bit(h, 52))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """One row per distinct window: window (its words, space-joined), n (their
    number), h (hash), set_id and items (the sorted ids, as strings, of the
    items that have it).  Items of fewer words are one window, items without
    words none.  A null id is no item to report, but its windows count."""
    held = benchmark.select(F.col(id_col).cast("string").alias("item"), words(text_col).alias("w")).where("size(w) > 0")
    held = held.withColumn("n", F.least(F.size("w"), F.lit(window)))
    starts = held.select("item", "w", "n", F.posexplode(_window_hashes(F.col("w"), F.col("n"))).alias("at", "h"))
    each = starts.select("item", "n", "h", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("window"))
    sets = each.groupBy("window", "n", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return stage(sets.withColumn("set_id", F.sha2(F.array_join("items", ","), 256)))


def candidates(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               bit_rows: int = BIT_ROWS, carry: bool = False) -> DataFrame:
    """Rows (row, doc_id, n_words, at, n, window): one for each row of ``docs``
    with window null, and one for each of its windows whose hash bits are in
    the benchmark's, at a word position.  ``row`` numbers the rows of ``docs``;
    with ``carry`` the first kind holds the whole row in ``doc``.  Written, so
    numbers are the same whenever it is read."""
    size = windows.groupBy("n").count().collect()  # a row per length, WINDOW at most
    lengths = sorted((r["n"] for r in size), reverse=True)
    rows = 1 << max(0, min(bit_rows, sum(r["count"] for r in size)) - 1).bit_length()
    slot = lambda h: h.bitwiseAND(F.lit(rows - 1))
    table = windows.groupBy(slot(F.col("h")).alias("slot")).agg(F.bit_or(_both_bits(F.col("h"))).alias("mask"))
    doc = F.struct(*[F.col(c) for c in docs.columns]) if carry else F.lit(None).cast("int")
    pieces = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                         _pieces(words(text_col), max(lengths, default=1), doc).alias("pieces"))
    pieces = pieces.select("row", "doc_id", F.explode("pieces").alias("piece"))
    # a piece's own mark comes first, then its windows length by length
    marks = F.concat(F.array(F.lit(None).cast("bigint")), *[_window_hashes(F.col("piece.w"), n, PIECE) for n in lengths])
    each = pieces.select("row", "doc_id", "piece", F.posexplode(marks).alias("pos", "h"))
    head = F.col("piece.first").isNull()
    met = (each.withColumn("slot", slot(F.col("h"))).join(F.broadcast(table), "slot", "left")
           .where((head & (F.col("pos") == 0)) | (F.col("mask").bitwiseAND(_both_bits(F.col("h"))) == _both_bits(F.col("h")))))
    at, n, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for length in lengths:
        windows_here = F.least(F.greatest(F.size("piece.w") - length + 1, F.lit(0)), F.lit(PIECE))
        here = (F.col("pos") >= before) & (F.col("pos") < before + windows_here)
        at, n = F.when(here, F.col("pos") - before).otherwise(at), F.when(here, F.lit(length)).otherwise(n)
        before = before + windows_here
    held = [F.col("piece.doc").alias("doc")] if carry else []
    return stage(met.select("row", "doc_id", *held, F.col("piece.n_words").alias("n_words"),
                            (F.col("piece.first") + at).alias("at"), n.alias("n"),
                            F.when(~head, F.array_join(F.slice("piece.w", at + 1, n), " ")).alias("window")))


def _covered(spans: Column) -> Column:
    """Words in the union of (at, n) spans sorted by position."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
    add = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["at"] + s["n"]).alias("end"),
        (acc["sum"] + F.greatest(s["at"] + s["n"] - F.greatest(acc["end"], s["at"]), F.lit(0))).alias("sum"))
    return F.aggregate(spans, start, add, lambda acc: acc["sum"])


def verified(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Per row with a benchmark window: row, spans (array of (at, n), sorted),
    sets (the sorted set_ids of its windows).

    A window that a great many documents hold doesn't meet its row of the
    benchmark in one task: see ``lookup``."""
    near = found.where("window IS NOT NULL").select("row", "at", "n", "window")
    seen = near.groupBy("window").agg(F.count("*").alias("weight"))
    known = stage(seen.join(windows.select("window", "set_id"), "window"))
    hits = lookup(near, known, "window", "weight", near.count()).where("set_id IS NOT NULL")
    return stage(hits.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("at", "n"))).alias("spans"),
        F.sort_array(F.collect_set("set_id")).alias("sets")))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, bit_rows: int = BIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside a
    benchmark window), n_items and items (the sorted ids, as strings, of the
    items whose windows it holds), contaminated.

    Null and empty texts have no words; a document of fewer words than a
    window holds none of that length.  Null ids are rows like others, repeated
    rows give repeated rows, equal items of different ids are all named, and
    rows of the same item id are one item.  No documents give no rows, an
    empty benchmark no hits; other columns are not read."""
    windows = benchmark_windows(benchmark, item_col, item_text, window)
    found = candidates(docs, windows, id_col, text_col, bit_rows)
    hits = verified(found, windows).withColumn("mix", F.sha2(F.array_join("sets", ","), 256))
    # documents with the same sets of items share one list of them
    mixes = hits.groupBy("mix").agg(F.first("sets").alias("sets"), F.count("*").alias("weight"))
    sets = windows.select("set_id", "items").dropDuplicates(["set_id"])
    named = (mixes.select("mix", "weight", F.explode("sets").alias("set_id")).join(sets, "set_id")
             .groupBy("mix", "weight").agg(F.flatten(F.collect_list("items")).alias("all")))
    lists = stage(named.select("mix", "weight", F.array_sort(F.array_distinct("all")).alias("items")))
    hits = lookup(hits.select("row", "spans", "mix"), lists, "mix", "weight", hits.count())
    out = found.where("window IS NULL").select("row", "doc_id", "n_words").join(
        hits.select("row", _covered(F.col("spans")).alias("n_hit"), "items"), "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.size(items).cast("long").alias("n_items"), items.alias("items"),
                      F.col("n_hit").isNotNull().alias("contaminated"))


def _without(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and what stands between them."""
    word, gap = F.regexp_extract_all(text, F.lit(TOKEN_ANY_CASE), F.lit(0)), F.split(text, TOKEN_ANY_CASE, -1)
    hit = F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))
    out = F.map_from_arrays(F.array_distinct(hit), F.array_distinct(hit))

    def rebuilt(held: Column) -> Column:
        gone = lambda i: F.map_contains_key(held["out"], i)
        return F.concat(F.get(held["gap"], F.lit(0)), F.array_join(F.transform(held["word"], lambda w, i: F.concat(
            F.when(gone(i), F.lit("")).otherwise(w),
            F.when(gone(i) & gone(i + 1), F.lit("")).otherwise(F.get(held["gap"], i + 1)))), ""))

    return F.transform(F.array(F.struct(word.alias("word"), gap.alias("gap"), out.alias("out"))), rebuilt)[0]


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, bit_rows: int = BIT_ROWS) -> DataFrame:
    """The rows of ``docs`` with their columns, without benchmark windows:
    ``remove='documents'`` drops the rows that hold one, ``remove='spans'``
    cuts the words inside windows, and what stands between them, out of the
    text.  Rows without a hit come out as they are and are not shuffled by
    their texts' size: only the texts of rows with a candidate are.  Nulls,
    repeated rows and empty tables: as ``find``; a null text stays null."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be 'spans' or 'documents'")
    windows = benchmark_windows(benchmark, item_col, item_text, window)
    found = candidates(docs, windows, id_col, text_col, bit_rows, carry=True)
    hits = verified(found, windows)
    columns = [F.col("doc")[c].alias(c) for c in docs.columns]
    rows = found.where("window IS NULL").select("row", "doc")
    if remove == "documents":
        return rows.join(hits.select("row"), "row", "left_anti").select(*columns)
    both = rows.join(hits.select("row", "spans"), "row", "left")
    cut = F.when(F.col("spans").isNull(), F.col("doc")[text_col]).otherwise(_without(F.col("doc")[text_col], F.col("spans")))
    return both.select(*[cut.alias(c) if c == text_col else col for c, col in zip(docs.columns, columns, strict=True)])
