"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / source size copies.  The
documents stand in a line, their expected copies are prefix-summed, one random
offset per source is added, and a document is emitted once for every integer
boundary that its stretch of the line crosses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.shared import WORD, stage, text_or_empty

# Fixed values of the task: the weights that sources take in turn, and how
# often a source may be repeated.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 42
#: The line of a size class of a source is cut into so many cells by hash.
SALTS = 256


def word_count(text) -> F.Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sizes`` (source, source_size) with target.  Sources in code-point
    order, null last, take the weights in turn and share the sum of all sizes;
    none gets more than ``max_repeat`` times its size, and what is over goes
    to the others by weight.

    With the sources by rising cap / weight, those that are capped come
    first.  What is left after the first k caps, per unit of the other
    weights, rises with k while caps are below it and falls from there on, so
    the share per unit of weight is the largest of these.

    Both orders are cut into ranges and prefix-summed in two steps, so no task
    holds all sources.  The sums are of whole numbers, so they don't depend on
    where the ranges are cut."""
    one = sizes.withColumn("_one", F.lit(1))
    by_turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_one_before") % len(weights) + 1).cast("int"))
    w = (_sums_before(one, [F.col("source").asc_nulls_last()], ["_one"]).withColumn("_w", by_turn)
         .withColumn("_cap", F.lit(float(max_repeat)) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w")))
    line = stage(_sums_before(w, [F.col("_ratio"), F.col("source").asc_nulls_last()], ["_cap", "_w"]))
    every = line.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    unit = line.agg(F.max((F.lit(every["size"]) - F.col("_cap_before")) / (F.lit(every["w"]) - F.col("_w_before")))).first()[0]
    return line.select("source", "source_size", F.least("_cap", F.lit(unit).cast("double") * F.col("_w")).alias("target"))


def _sums_before(rows: DataFrame, order: list[F.Column], cols: list[str]) -> DataFrame:
    """``rows`` with c_before for every c of ``cols``: its sum over all rows
    that stand before in ``order``, which must have no ties."""
    ranges = stage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # a row per range: as many as the session's shuffle partitions
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("_range").agg(*[F.sum(c).alias(c) for c in cols]).select(
        F.col("_range").alias("_start"), *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}_start") for c in cols])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.select(*rows.columns, "_range", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_{c}_within") for c in cols])
    return placed.join(F.broadcast(starts), F.col("_range") == F.col("_start")).select(
        *rows.columns, *[(F.col(f"_{c}_start") + F.col(f"_{c}_within")).alias(f"{c}_before") for c in cols])


def _hash(seed: int, value: F.Column, kind: str = "row") -> F.Column:
    """60 bits of an MD5, the same in any engine; null as the empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{kind}:"), F.coalesce(value, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def size_class(size: F.Column) -> F.Column:
    """The octave of size + 1 and its next four binary digits."""
    digits = F.bin(size + 1)
    return F.length(digits) * 16 + F.conv(F.rpad(F.substring(digits, 2, 4), 4, "0"), 2, 10).cast("int")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words), source_size,
    target (of its source, in words) and copies (0 to ``max_repeat``).

    The line of a source runs by size class, then by a hash of the id, so that
    copies are spread evenly over long and short texts.  It is cut into cells
    (source, size class, leading bits of the hash); cells are counted with
    partial aggregation and prefix-summed in two steps, and only within a cell
    are rows ranked, so no task holds a whole source.

    Null and empty texts have size 0, and a source of size 0 target 0; null is
    a source of its own.  A source's words miss its target by about the size
    of its largest document (whole copies, one offset), which is a large share
    only of a source of few documents.  Null ids and repeated rows count like others; equal
    rows are interchangeable.  No rows give no rows.  Reruns agree: the offset
    is a hash of seed and source."""
    rows = stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(text_col).alias("size"), _hash(seed, F.col(id_col).cast("string")).alias("_h")))
    rows = rows.withColumn("_class", size_class(F.col("size"))).withColumn("_salt", (F.col("_h") % SALTS).cast("int"))
    cells = stage(rows.groupBy("source", "_class", "_salt").agg(
        F.count("*").alias("_rows"), F.sum("size").alias("_words")))
    targets = source_targets(cells.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, max_repeat)
    # rows before a size class in its source, and before a cell in its class
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    classes = cells.groupBy("source", "_class").agg(F.sum("_rows").alias("_rows")).select(
        "source", "_class", F.coalesce(F.sum("_rows").over(before("source", "_class")), F.lit(0)).alias("_below"))
    classes = classes.alias("k").join(targets.alias("t"), F.expr("k.source <=> t.source")).select(
        F.col("k.source").alias("_src"), F.col("_class").alias("_c"), "_below", "source_size", "target")
    within = F.coalesce(F.sum("_rows").over(before("source", "_class", "_salt")), F.lit(0))
    starts = stage(cells.withColumn("_within", within).join(
        stage(classes), F.col("source").eqNullSafe(F.col("_src")) & (F.col("_class") == F.col("_c"))).select(
        "_src", "_c", F.col("_salt").alias("_s"), (F.col("_below") + F.col("_within")).alias("_start"), "source_size", "target"))
    placed = rows.join(
        starts.hint("merge"),
        F.col("source").eqNullSafe(F.col("_src")) & (F.col("_class") == F.col("_c")) & (F.col("_salt") == F.col("_s")))
    in_cell = Window.partitionBy("source", "_class", "_salt").orderBy("size", "_h", "doc_id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _hash(seed, F.col("source"), "offset") / F.lit(float(1 << 60))
    rank = F.col("_start") + F.row_number().over(in_cell)
    crossed = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        F.least(crossed, F.lit(max_repeat)).cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.  Rows that
    agree in id, source and size share what the mix takes of them evenly, the
    odd copies going to any of them."""
    size, source = word_count(text_col), F.col(source_col).cast("string")
    taken = copies(docs, id_col, text_col, source_col, **options)
    named = ["doc_id", "source", "size"]
    taken = stage(taken.groupBy(*named).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")))
    key = lambda i, s, n: F.xxhash64(i, s, n)
    held = taken.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"),
                        key("doc_id", "source", "size").alias("__key"), F.col("_copies").alias("__copies"),
                        F.col("_rows").alias("__rows"))
    marked = docs.withColumn("__words", size).withColumn("__key2", key(F.col(id_col).cast("long"), source, F.col("__words")))
    met = marked.join(held, (F.col("__key2") == F.col("__key")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
                      & source.eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size")))
    whole, odd = F.floor(F.col("__copies") / F.col("__rows")), F.col("__copies") % F.col("__rows")
    once = met.where("__rows = 1").withColumn("__times", F.col("__copies"))
    nth = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy("__key"))
    again = met.where("__rows > 1").withColumn("__times", whole + F.when(nth <= odd, 1).otherwise(0))
    out = [*[F.col(c) for c in docs.columns]]
    return (once.select(*out, "__times").unionAll(again.select(*out, "__times"))
            .where("__times > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times").cast("long"))))
            .select(*out))
