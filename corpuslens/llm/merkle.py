"""Merkle manifest of a dataset: a root digest over all rows, a subroot per
group, and for every row a proof that it stands under the root.

Rows are leaves, in the order of their ids within their group.  ``ARITY``
consecutive nodes are hashed to one until one is left; the groups' subroots are
hashed on the same way.  A node's step towards an ancestor is the digests that
stand left and right of it in its run of siblings.  Proofs come by pointer
jumping: every node above the leaves holds its steps towards an ancestor, and
joining the nodes with themselves on that ancestor doubles the distance and
puts the steps end to end, until all have reached the root.  The up to eight
leaves of a run share all steps but the first, so they travel as one row, which
meets its steps once, at the end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.shared import lookup, stage

# Fixed values of the task: children of a node, and a leaf's columns in order.
ARITY = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

STEPS = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: its length in bytes, a colon, the value;
    a dash for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on the path, from leaf to root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _place(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with pos (from 0 within ``tree``, by ``order``) and size (rows
    of the tree).  Rows are dealt out by ranges of (tree, order), so a tree may
    hold any share of them; only a count per range and tree is summed up."""
    keys = [tree, *order]
    line = stage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .withColumn("line", F.monotonically_increasing_id()))
    piece = F.concat_ws("/", F.shiftright("line", 33).cast("string"), F.col(tree))
    line = line.withColumn("piece", piece)
    pieces = line.groupBy("piece", tree).agg(F.min("line").alias("first"), F.count("*").alias("weight"))
    earlier = Window.partitionBy(tree).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    pieces = stage(pieces.select(
        "piece", "first", "weight", F.coalesce(F.sum("weight").over(earlier), F.lit(0)).alias("start"),
        F.sum("weight").over(Window.partitionBy(tree)).alias("size")))
    out = lookup(line, pieces, "piece", "weight", line.count())
    return out.select(*rows.columns, (F.col("start") + F.col("line") - F.col("first")).alias("pos"), "size")


def _key(level: int, pos: Column | str) -> Column:
    return F.concat_ws("/", F.lit(str(level)), F.col(pos).cast("string") if isinstance(pos, str) else pos.cast("string"), F.col("tree"))


def _runs(nodes: DataFrame, *held: str) -> DataFrame:
    """Nodes of trees with more than one, by runs of ARITY: tree, size, run,
    kids (structs of pos, digest and ``held``, in order)."""
    return stage(nodes.where("size > 1").groupBy("tree", "size", F.floor(F.col("pos") / ARITY).alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", *held))).alias("kids")))


def _parents(runs: DataFrame, level: int) -> DataFrame:
    return runs.select(
        "tree", F.ceil(F.col("size") / ARITY).alias("size"), F.col("run").alias("pos"), _key(level, "run").alias("key"),
        F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), ""), 256).alias("digest"))


def _step(kids: Column, i: Column) -> Column:
    digests = F.transform(kids, lambda k: k["digest"])
    return F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("before"),
                    F.array_join(F.slice(digests, i + 2, F.lit(ARITY)), "").alias("after"))


def _climb(nodes: DataFrame, most: int, level: int) -> tuple[list[DataFrame], DataFrame, int]:
    """From ``nodes`` (tree, size, pos, key, digest; the largest tree has
    ``most``) to one node a tree: the nodes' steps to their parents (key, up,
    steps), the top nodes, and the levels gone up."""
    steps, tops, gone = [], nodes.where("size = 1"), 0
    while most > 1:
        level, gone, most = level + 1, gone + 1, -(-most // ARITY)
        runs = _runs(nodes, "key")
        each = runs.select(F.posexplode("kids").alias("i", "kid"), _key(level, "run").alias("up"), "kids")
        steps.append(each.select("kid.key", "up", F.array(_step(F.col("kids"), F.col("i"))).alias("steps")))
        nodes = _parents(runs, level)
        tops = tops.unionAll(nodes.where("size = 1"))
    return steps, tops, gone


def _jump(steps: DataFrame, distance: int) -> DataFrame:
    """Pointer jumping over (key, up, steps): afterwards every node holds all
    its steps to the root, ``distance`` of them at most.  Most nodes point at
    few, near the root; those are looked up without a hot task."""
    now, gone = stage(steps), 1
    while gone < distance:
        wanted = now.where("up IS NOT NULL").groupBy(F.col("up").alias("at")).agg(F.count("*").alias("weight"))
        ahead = stage(now.select(F.col("key").alias("at"), F.col("up").alias("next"), F.col("steps").alias("more"))
                      .join(wanted, "at"))
        total = ahead.agg(F.sum("weight")).first()[0] or 0
        joined = lookup(now, ahead.withColumnRenamed("at", "up"), "up", "weight", total)
        # a node that is not ahead of any other is the root: no steps lead on
        now = stage(joined.select("key", F.col("next").alias("up"),
                                  F.concat("steps", F.coalesce("more", F.array().cast(STEPS))).alias("steps")))
        gone *= 2
    return now.select("key", "steps")


@dataclass
class Manifest:
    """``root``: the digest of everything (None without rows).  ``groups``: a
    row per group (group, size, subroot).  ``runs``: what proofs are made of."""
    root: str | None
    groups: DataFrame
    runs: DataFrame
    carried: list[str]

    def proofs(self) -> DataFrame:
        """One row per leaf: id, what was carried, leaf, subroot, path (the
        digests before and after the node in its run, from leaf to root)."""
        each = self.runs.select("*", F.posexplode("kids").alias("i", "kid"))
        own = F.when(F.col("size") > 1, F.array(_step(F.col("kids"), F.col("i")))).otherwise(F.array().cast(STEPS))
        return each.select(
            F.col("kid.id").alias("id"), *[F.col("kid")[c].alias(c) for c in self.carried],
            F.col("kid.digest").alias("leaf"), "subroot",
            F.concat(own, F.coalesce("steps", F.array().cast(STEPS))).alias("path"))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS,
             carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``carry``: small columns (by new names) that
    come out again beside each proof.

    Leaves of a group ascend by id, a null id first; equal ids by leaf digest;
    equal rows are interchangeable, and each is a leaf.  Null in ``group_col``
    is a group of its own and the first one, an empty value the next.  A group
    of one row has its leaf as subroot, one group its subroot as root; no rows
    have no root and no proofs.  Columns that are not named are not read."""
    carried = list(carry or {})
    leaves = stage(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("tree"),
        F.col(id_col).alias("id"), leaf_digest(*[F.col(c) for c in columns]).alias("digest"),
        *[c.alias(name) for name, c in (carry or {}).items()], F.monotonically_increasing_id().alias("row")))
    placed = _place(leaves, "tree", ["id", "digest", "row"]).drop("row").withColumn("key", _key(0, "pos"))
    groups = stage(leaves.groupBy("tree").agg(F.count("*").alias("size")))
    most = groups.agg(F.max("size"), F.count("*")).first()
    runs = _runs(placed, "id", *carried).withColumn("key", _key(1, "run"))
    lone = placed.where("size = 1")
    steps, tops, up = _climb(_parents(runs, 1).unionAll(lone.select("tree", "size", "pos", "key", "digest")),
                             -(-(most[0] or 0) // ARITY), 1)
    tops = stage(tops.select("tree", "key", F.col("digest").alias("subroot")))
    # the groups' own tree: its nodes keep their keys, so steps lead on
    order = _place(tops.select(F.lit("+").alias("all"), F.col("tree").alias("named"), "key", "subroot"), "all", ["named"])
    more, top, over = _climb(order.select(F.col("all").alias("tree"), "size", "pos", "key", F.col("subroot").alias("digest")),
                             most[1], 0)
    root = top.first()
    every = [*steps, *more]
    held = runs.select("tree", "size", "key", "kids").unionAll(lone.select(
        "tree", "size", "key", F.array(F.struct("pos", "digest", "id", *carried)).alias("kids")))
    named = stage(tops.select("tree", "subroot").join(groups.select(
        "tree", "size", F.ceil(F.col("size") / ARITY).alias("weight")), "tree"))
    total = named.agg(F.sum("weight")).first()[0] or 0
    held = lookup(held, named.select("tree", "subroot", "weight"), "tree", "weight", total)
    if every:
        paths = every[0]
        for one in every[1:]:
            paths = paths.unionAll(one)
        held = held.join(_jump(paths, up + over), "key", "left")
    else:
        held = held.withColumn("steps", F.array().cast(STEPS))
    group = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("group")
    return Manifest(root and root["digest"], named.select(group, "size", "subroot"), held, carried)
