"""Exact top-k search by inner product: a k-d tree per shard.

Every component x becomes floor(1024 * x); scores are integer inner products. Rows
are dealt evenly to shards of about ``shard_rows``; each shard's task builds a k-d
tree (median splits along the widest dimension, tight bounding boxes). A query
walks it best first, by the greatest product that a box allows, and stops when
that falls below its kth best score. The kth score is propagated: from leaf to
leaf, and from the first shard to all others, which start from what it found.

Queries are handled in blocks of at most about ``block`` rows. A block is gathered
on the driver and sent to the tasks, so what is sent has a fixed size; each block
is searched in all rows. Ties go to the smaller vec_id.

Edge cases: vectors that are null, or hold a null or a component that is not
finite, take no part, nor do rows with a null vec_id. Only vectors of one length
are compared (empty ones score 0). A query's own vec_id is no candidate for it; a
vec_id that repeats among the candidates counts by row, a repeated query row once; different query rows of one
vec_id share one list.
Scores that do not fit a long are cut to its range. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import durable

EXACT = 2.0**53
LEAF = 64


def scaled(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that take part, their lengths, and all their components as floor(1024 * x)."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    flat, of = pc.list_flatten(column), pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.zeros(len(column), dtype=bool)
    bad[of[~np.isfinite(x)]] = True
    bad |= column.is_null().to_numpy(zero_copy_only=False)
    length = np.bincount(of, minlength=len(column))
    with np.errstate(all="ignore"):
        return np.flatnonzero(~bad), length[~bad], np.floor(1024.0 * x[~bad[of]])


class Tree:
    """Points of one length: leaves of at most LEAF rows under median splits."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        self.lo, self.hi, self.child, span = [], [], [], []
        stack = [(0, len(ids), -1)]
        while stack:
            a, b, parent = stack.pop()
            own = points[order[a:b]]
            node = len(self.lo)
            low, high = own.min(axis=0), own.max(axis=0)
            self.lo.append(low)
            self.hi.append(high)
            self.child.append([])
            span.append((a, b))
            if parent >= 0:
                self.child[parent].append(node)
            if b - a > LEAF and own.shape[1] and (high > low).any():
                dim, half = int(np.argmax(high - low)), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, dim], half)]
                stack += [(a, a + half, node), (a + half, b, node)]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.span, self.ids, self.points = span, ids[order], points[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries x nodes: the greatest inner product that a point of the box can have."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T

    def search(self, query_id: int, query: np.ndarray, bound: np.ndarray, k: int, kth: float) -> list[tuple[int, int]]:
        """The k best (score, -vec_id) of this tree that are no worse than ``kth``."""
        best: list[tuple[int, int]] = []
        queue = [(-bound[0], 0)]
        while queue:
            b, node = heapq.heappop(queue)
            if -b < kth:
                break
            if self.child[node]:
                for c in self.child[node]:
                    if bound[c] >= kth:
                        heapq.heappush(queue, (-bound[c], c))
                continue
            at, to = self.span[node]
            scores = self.points[at:to] @ query
            for i in np.flatnonzero(scores >= kth).tolist():
                if (vec_id := int(self.ids[at + i])) != query_id:
                    new = (int(scores[i]), -vec_id)
                    if len(best) < k:
                        heapq.heappush(best, new)
                    elif new > best[0]:
                        heapq.heapreplace(best, new)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return best


def _exact(query_id: int, query: list[int], ids: np.ndarray, points: np.ndarray, k: int) -> list[tuple[int, int]]:
    """As a tree's search, in whole numbers of any size."""
    all_ = ((sum(a * int(b) for a, b in zip(query, p, strict=True)), -int(i)) for i, p in zip(ids, points, strict=True) if i != query_id)
    return heapq.nlargest(k, all_)


def valid_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and v (scaled components as doubles) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, length, x = scaled(b.column(1))
            offsets = np.concatenate(([0], np.cumsum(length)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), pa.array(length.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x))], ["vec_id", "dim", "v"]
            )

    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    return some.mapInArrow(run, "vec_id long, dim int, v array<double>")


def _search_shards(shards: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], kth: dict[int, np.ndarray], k: int) -> DataFrame:
    """The best rows of every shard for every query: query_id, vec_id, score."""
    shared = shards.sparkSession.sparkContext.broadcast((queries, kth))

    def run(table: pa.Table) -> pa.Table:
        own_queries, least = shared.value
        ids, dims = table["vec_id"].to_numpy(), table["dim"].to_numpy()
        out: list[tuple[int, int, int]] = []
        flat, offsets = table["v"].combine_chunks(), None
        values = flat.flatten().to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(dims.astype(np.int64))))
        for dim in np.unique(dims).tolist():
            if dim not in own_queries:
                continue
            rows = np.flatnonzero(dims == dim)
            points = values[(offsets[rows][:, None] + np.arange(dim)[None, :])]
            q_ids, q = own_queries[dim]
            if dim and np.abs(points).max() * np.abs(q).max() * dim >= EXACT:
                for i, x in zip(q_ids.tolist(), q, strict=True):
                    out += [(i, -n, s) for s, n in _exact(i, [int(c) for c in x], ids[rows], points, k)]
                continue
            tree = Tree(ids[rows], points)
            for at in range(0, len(q_ids), 512):
                bound = tree.bounds(q[at : at + 512])
                for j, i in enumerate(q_ids[at : at + 512].tolist()):
                    out += [(i, -n, s) for s, n in tree.search(i, q[at + j], bound[j], k, float(least[dim][at + j]))]
        low, high = -(2**63), 2**63 - 1
        columns = list(zip(*out, strict=True)) or [[], [], []]
        score = [min(max(x, low), high) for x in columns[2]]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(score, pa.int64())})

    return shards.groupBy("shard").applyInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 10, shard_rows: int = 4096, block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of every query."""
    n = vectors.count()
    shards = max(1, -(-n // shard_rows))
    rows = durable(valid_rows(vectors).withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))))
    blocks = max(1, -(-rows.where(is_query).count() // block))
    spark, out = vectors.sparkSession, None
    for b in range(blocks):
        asked = rows.where(is_query & (F.pmod(F.hash("vec_id"), F.lit(blocks)) == b)).select("vec_id", "dim", "v").distinct().collect()
        queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {r["dim"] for r in asked}:
            own = sorted(((r["vec_id"], r["v"]) for r in asked if r["dim"] == dim))
            queries[dim] = (np.array([o[0] for o in own], dtype=np.int64), np.array([o[1] for o in own], dtype=np.float64).reshape(len(own), dim))
        kth = {dim: np.full(len(q[0]), -np.inf) for dim, q in queries.items()}
        if shards > 1 and asked:
            first = _search_shards(rows.where("shard = 0"), queries, kth, k)
            for r in first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).collect():
                for dim, (ids, _) in queries.items():
                    at = np.searchsorted(ids, r["query_id"])
                    if at < len(ids) and ids[at] == r["query_id"] and (ids == r["query_id"]).sum() == 1:
                        kth[dim][at] = r["kth"]
        found = _search_shards(rows, queries, kth, k) if asked else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every hundredth row of ``embeddings`` against all rows."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
