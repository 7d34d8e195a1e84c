"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks; each pair of blocks is a tile.
In a tile vectors are rounded to int8 with a scale each, and the products of
the rounded vectors give every inner product up to a bound that follows from
what rounding took away.  Only pairs whose upper bound reaches the k-th
largest lower bound of their query are worked out on the original vectors, and
heaps merge the tiles' lists; so the result is exact."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.shared import stage

K = 20
#: Vectors to a block, queries to a step within a tile, lists merged at a time.
BLOCK = 8192
STEP = 256
MERGED = 64
#: Components whose products of int8 add up exactly in a 32-bit float.
EXACT = 1024
LISTS = "query_id long, part int, ids array<long>, scores array<double>"


def round_to_int8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the norms of the rounded rows and of what
    rounding took away."""
    scale = np.abs(x).max(axis=1) / 127.0
    tiny = scale == 0  # subnormal rows
    scale[tiny] = 1.0
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int8 rows, exact: sums below 2**24 in single
    precision, added up in double."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        out += a[:, at:at + EXACT].astype(np.float32) @ b[:, at:at + EXACT].astype(np.float32).T
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, summed in order."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def tile_lists(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """(query id, ids, scores) of each query's k nearest in one tile; ties go
    to the smaller id, and a vector is no neighbour of itself."""
    c, c_scale, c_norm, c_lost = round_to_int8(vectors)
    full = np.linalg.norm(vectors, axis=1)
    for at in range(0, len(queries), STEP):
        x, x_ids = queries[at:at + STEP], query_ids[at:at + STEP]
        q, scale, norm, lost = round_to_int8(x)
        about = int8_products(q, c) * scale[:, None] * c_scale
        # |xy - x'y'| <= |x'||y - y'| + |x - x'||y|, and room for rounding
        slack = (norm[:, None] * c_lost + lost[:, None] * full) * (1 + 1e-9) + 1e-12 * norm[:, None] * c_norm
        about[x_ids[:, None] == ids] = -np.inf
        low = about - slack
        least = np.partition(low, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(x), -np.inf)
        rows, cols = np.nonzero((about + slack >= least[:, None]) & np.isfinite(about))
        scores = exact_products(x[rows], vectors[cols])
        ends = np.searchsorted(rows, np.arange(len(x) + 1))
        for i, query in enumerate(x_ids):
            part = slice(ends[i], ends[i + 1])
            best = heapq.nsmallest(k, zip((-scores[part]).tolist(), ids[cols[part]].tolist(), strict=True))
            if best:
                yield int(query), [b for _, b in best], [-a for a, _ in best]


def _lists(rows: list[tuple]) -> dict[str, pa.Array]:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()))
    return {name: pa.array(c, kind) for name, c, kind in zip(("query_id", "part", "ids", "scores"), columns, kinds, strict=True)}


def nearest(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
            k: int = K, block: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score): the ``k`` rows of largest
    inner product, in double precision, for every row where ``is_query``.

    Vectors that are null, empty or zero or hold a null or non-finite
    component take no part, nor do null ids; vectors are set against those of
    as many components.  Of repeated ids the smallest vector counts.  Fewer
    than ``k`` candidates are all returned; no rows give no rows."""
    v = F.col("_v")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        v, lambda x: x != 0)
    held = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_v"),
                       is_query.alias("is_query")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)
    held = stage(held.groupBy("vec_id").agg(F.min(F.struct("_v", "is_query")).alias("s")).select(
        "vec_id", "s._v", F.coalesce("s.is_query", F.lit(False)).alias("is_query"), F.size("s._v").alias("dim")))
    sizes = held.agg(F.count("*"), F.count_if("is_query")).first()
    candidate_blocks, query_blocks = (max(1, -(-n // block)) for n in sizes)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = held.where("is_query").select("dim", deal(query_blocks).alias("qb"), every(candidate_blocks).alias("cb"),
                                          F.lit(True).alias("asks"), "vec_id", "_v")
    known = held.select("dim", every(query_blocks).alias("qb"), deal(candidate_blocks).alias("cb"),
                        F.lit(False).alias("asks"), "vec_id", "_v")

    def tile(key: tuple, held: pa.Table) -> pa.Table:
        vectors = held["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, -1)
        ids, asks = held["vec_id"].to_numpy(), held["asks"].to_numpy()
        found = tile_lists(ids[asks], vectors[asks], ids[~asks], vectors[~asks], k) if asks.any() and not asks.all() else ()
        return pa.table(_lists([(query, key[2].as_py(), near, scores) for query, near, scores in found]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                heads = [zip((-x for x in one["scores"]), one["ids"], strict=True) for one in row["lists"]]
                best = [x for x, _ in zip(heapq.merge(*heads), range(k), strict=False)]
                out.append((row["query_id"], row["part"], [b for _, b in best], [-a for a, _ in best]))
            yield pa.RecordBatch.from_pydict(_lists(out))

    # a tile's list goes with those of the next MERGED - 1 blocks, and so on
    lists = asked.unionAll(known).groupBy("dim", "qb", "cb").applyInArrow(tile, LISTS)
    left = candidate_blocks
    while left > 1:
        left = -(-left // MERGED)
        lists = lists.groupBy("query_id", F.floor(F.col("part") / MERGED).cast("int").alias("part")).agg(
            F.collect_list(F.struct("ids", "scores")).alias("lists")).mapInArrow(merge, LISTS)
    return lists.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "one")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("one.ids").alias("vec_id"), F.col("one.scores").alias("score"))
