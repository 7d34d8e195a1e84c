"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the 64-bit hashes of a document's
shingles.  Two documents link when their fingerprints differ in at most
``radius`` bits; components of links are the near-duplicate groups.

Candidates come from 2**(radius+1)-1 tables.  Every bit position has a nonzero
label of radius+1 bits; table v keeps the positions whose label has an odd
number of ones in common with v.  Any ``radius`` positions leave a nonzero v
that is orthogonal to all their labels, so two fingerprints that differ only
there have the same key in table v: no pair within the radius is missed."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.components import connected_components
from corpuslens.llm.shared import WORD, lookup, lower_ascii, stage, text_or_empty

SHINGLE_WORDS = 3
RADIUS = 2
#: Buckets up to this size are compared pair by pair, larger ones by balls.
PAIRWISE = 32


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table keeps, as unsigned 64-bit numbers."""
    labels = [1 + i % ((1 << (radius + 1)) - 1) for i in range(64)]
    return [sum(1 << i for i in range(64) if (labels[i] & v).bit_count() % 2)
            for v in range(1, 1 << (radius + 1))]


def shingle_hashes(text: str | Column, words: int = SHINGLE_WORDS) -> Column:
    """XXH64 (seed 42) of every run of ``words`` words, repeats included; of
    the whole sequence where there are fewer; no words: an empty array."""
    w = F.regexp_extract_all(lower_ascii(text_or_empty(text)), F.lit(WORD), F.lit(0))

    def from_words(held: Column) -> Column:
        shingle = lambda x, i: F.xxhash64(F.concat_ws(
            " ", x, *[F.get(held, i + k) for k in range(1, words)]))
        starts = F.slice(held, 1, F.greatest(F.size(held) - (words - 1), F.lit(0)))
        return (F.when(F.size(held) >= words, F.transform(starts, shingle))
                .when(F.size(held) > 0, F.array(F.xxhash64(F.concat_ws(" ", held))))
                .otherwise(F.array().cast("array<bigint>")))

    # the words are named by a lambda, so that the text is split once
    return F.transform(F.array(w), from_words)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS, row_col: str | None = None) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint as a signed long.  With
    ``row_col``, a column that numbers the rows, (doc_id, fp, row).

    Shingles are summed 64 bits at a time, two counters of 32 bits in a long,
    so a document may have up to 2**31 shingles."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("_row"),
                       shingle_hashes(text_col, words).alias("_hashes"))
    each = rows.select("doc_id", "_row", F.explode_outer("_hashes").alias("_h"))
    lanes = F.lit((1 << 32) + 1)
    sums = each.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.count("_h").alias("_n"),
        *[F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(lanes)).alias(f"_s{j}") for j in range(32)])
    low = F.lit((1 << 32) - 1)
    fp = F.lit(0).cast("long")
    for j in range(32):
        for count, bit in ((F.col(f"_s{j}").bitwiseAND(low), j),
                           (F.shiftrightunsigned(f"_s{j}", 32), j + 32)):
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("_n"), F.lit(_signed(1 << bit))).otherwise(0))
    return sums.select("doc_id", fp.alias("fp"), *([] if row_col is None else [F.col("_row").alias("row")]))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose transitive
    closure is that of all pairs within ``radius`` bits.

    A bucket of up to PAIRWISE fingerprints is compared pair by pair.  In a
    larger one each fingerprint emits the points around it, over the bits that
    the table drops: those within half the radius (rounded down) as centres,
    those within the rest as members.  Two fingerprints are within the radius
    just when one is a centre and the other a member at some point, so linking
    the members of a point to its least centre loses no link and makes rows in
    proportion to the bucket, not to its square; a point has as many members
    as a ball at most."""
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                       for v, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(tables).alias("t")).select("fp", "t.v", "t.key")
    sizes = keyed.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(keyed.join(sizes, ["v", "key"]))
    small = shared.where(F.col("n") <= PAIRWISE).select("v", "key", "fp")
    pairs = (small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), ["v", "key"])
             .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
             .select("a", "b"))
    edges = pairs
    for v, mask in enumerate(masks):
        free = [i for i in range(64) if not mask >> i & 1]
        half = radius // 2
        steps = F.array(*[
            F.struct(F.lit(_signed(sum(1 << i for i in at))).alias("x"), F.lit(k <= half).alias("centre"))
            for k in range(radius - half + 1) for at in combinations(free, k)])
        around = (shared.where((F.col("n") > PAIRWISE) & (F.col("v") == v))
                  .select("fp", F.explode(steps).alias("s"))
                  .select("fp", F.col("fp").bitwiseXOR(F.col("s.x")).alias("point"), "s.centre"))
        least = F.min(F.when(F.col("centre"), F.col("fp"))).over(Window.partitionBy("point"))
        stars = around.withColumn("a", least).where(F.col("a").isNotNull() & (F.col("a") != F.col("fp")))
        edges = edges.unionAll(stars.select("a", F.col("fp").alias("b")))
    return edges.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (smallest doc_id
    of the component).

    Copies share a fingerprint and take part once.  A null text is empty, and
    texts without words have fingerprint zero, linked like any other.  A null
    id never is a component's smallest; a component of null ids only has
    component_id null.  Repeated rows give repeated rows, no rows none; other
    columns of ``docs`` are not read."""
    prints = stage(fingerprints(docs, id_col, text_col, words))
    groups = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = stage(connected_components(links(groups.select("fp"), radius)))
    placed = stage(groups.join(roots, groups.fp == roots.node, "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    top = stage(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    named = stage(lookup(placed, top, "root", "members", placed.count()).select("fp", "n", "component_id"))
    return lookup(prints, named, "fp", "n", prints.count()).select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
             radius: int = RADIUS) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that of the
    smallest id, null last; of rows that share it, that of the smallest
    fingerprint, then any one.

    Rows are numbered once and the decision is by number, so rows that share an
    id are told apart and repeated rows come out once.  Empty tables give none."""
    row = next(f"__row{i}" for i in range(len(docs.columns) + 1) if f"__row{i}" not in docs.columns)
    keyed = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    prints = stage(fingerprints(keyed, id_col, text_col, words, row))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "row"))
    groups = stage(prints.groupBy("fp").agg(best.alias("best"), F.count("*").alias("n")))
    roots = stage(connected_components(links(groups.select("fp"), radius)))
    placed = stage(groups.join(roots, groups.fp == roots.node, "left").select(
        "fp", "best", "n", F.coalesce("root", "fp").alias("root")))
    top = stage(placed.groupBy("root").agg(F.min("best").alias("stays"), F.count("*").alias("members")))
    named = stage(lookup(placed.select("fp", "n", "root"), top, "root", "members", placed.count()).select(
        "fp", "n", F.col("stays.row").alias("stays")))
    gone = lookup(prints, named, "fp", "n", prints.count()).where("row <> stays").select(F.col("row").alias(row))
    return keyed.join(gone, row, "left_anti").select(*[F.col(c) for c in docs.columns])
