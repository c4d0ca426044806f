"""Centroid clustering in whole numbers: distances by the expansion |x|^2 - 2 x.c + |c|^2 in blocked float64 BLAS.

Components are whole numbers (floor(1024 * x)), laid out once in blocks of at most
``block`` vectors. A block's distances to all centroids are one matrix product. If
dim * (max|x| + max|c|)^2 is below 2^53, every product and sum of the expansion is a
whole number that float64 holds exactly, in whatever order BLAS adds; other blocks
are measured in Python's whole numbers. Sums and counts of a round are combined by
an RDD's ``treeAggregate`` in whole numbers of any size, so nothing but k sums
reaches the driver, whatever the number of vectors, and no key is hot.

The blocks are written to the shared folder once; each round reads them, and a lost
executor costs its blocks of one round.

Edge cases: vectors that are null, of another length, or hold a null or a component
that is not finite (before or after scaling) take no part. Repeated rows count each.
A null vec_id is clustered like others, but seeds only if too few ids are there;
equal ids seed in the order of their components. Fewer vectors than centroids: as
many centroids as vectors. Ties go to the smaller number. A distance or inertia
beyond a long's range is cut to it. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import durable
from .kdsearch import EXACT, scaled

LONG = 2**63 - 1
State = tuple[np.ndarray, np.ndarray, np.ndarray]


def blocks_of(vectors: DataFrame, dim: int, block: int) -> DataFrame:
    """ids (array of long) and x (their float64 components in a row, as bytes) of the vectors that take part, at most ``block`` in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, held = [], [], 0
        for b in batches:
            rows, length, x = scaled(b.column(1))
            fits = length == dim
            own = x[np.repeat(fits, length)].reshape(-1, dim)
            whole = np.isfinite(own).all(axis=1)
            ids.append(b.column(0).take(pa.array(rows[fits][whole])))
            points.append(own[whole])
            held += len(points[-1])
            while held >= block:
                flat, x = pa.concat_arrays(ids), np.concatenate(points)
                yield packed(flat.slice(0, block), x[:block])
                ids, points, held = [flat.slice(block)], [x[block:]], held - block
        if held:
            yield packed(pa.concat_arrays(ids), np.concatenate(points))

    def packed(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x.tobytes()], pa.binary())], ["ids", "x"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "ids array<long>, x binary")


def whole(x: np.ndarray) -> np.ndarray:
    """float64 whole numbers as Python's."""
    return np.array([int(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def nearest(x: np.ndarray, centers: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x`` (float64 whole numbers) the nearest centre, the least of equals, and the squared distance."""
    most = max((abs(v) for c in centers for v in c), default=0) + (int(np.abs(x).max()) if x.size else 0)
    if x.shape[1] * most * most < EXACT:
        c = np.array(centers, dtype=np.float64)
        far = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
        at = far.argmin(axis=1)
        return at, far[np.arange(len(x)), at].astype(np.int64)
    exact = whole(x)
    far = np.stack([((exact - np.array(c, dtype=object)) ** 2).sum(axis=1) for c in centers], axis=1)
    at = np.array([min(range(len(centers)), key=row.__getitem__) for row in far], dtype=np.int64)
    return at, far[np.arange(len(x)), at]


def summed(x: np.ndarray, at: np.ndarray, far: np.ndarray, k: int) -> State:
    """Per centre: the sum of its rows, their number and their distances, as Python's whole numbers."""
    n = np.bincount(at, minlength=k)
    if len(x) * (np.abs(x).max() if x.size else 0) < EXACT:
        member = np.zeros((k, len(x)))
        member[at, np.arange(len(x))] = 1.0
        sums = whole(member @ x)
    else:
        sums = np.zeros((k, x.shape[1]), dtype=object)
        np.add.at(sums, at, whole(x))
    total = np.zeros(k, dtype=object)
    np.add.at(total, at, far.astype(object))
    return sums, n.astype(object), total


def round_of(blocks: DataFrame, centers: list[list[int]], dim: int, depth: int = 2) -> State:
    """Sums, numbers and inertia of all centres after an assignment of all blocks."""
    k, sent = len(centers), blocks.sparkSession.sparkContext.broadcast(centers)

    def one(state: State, row: tuple) -> State:
        x = np.frombuffer(row["x"], dtype=np.float64).reshape(-1, dim)
        at, far = nearest(x, sent.value)
        return both(state, summed(x, at, far, k))

    def both(a: State, b: State) -> State:
        return a[0] + b[0], a[1] + b[1], a[2] + b[2]

    zero = (np.zeros((k, dim), dtype=object), np.zeros(k, dtype=object), np.zeros(k, dtype=object))
    return blocks.select("x").rdd.treeAggregate(zero, one, both, depth)


def first_centers(blocks: DataFrame, k: int, seed: int, dim: int) -> list[list[int]]:
    """The ``k`` vectors of least sha256 of "seed:vec_id"; each block gives its k least, and of these the k least are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, dtype=np.float64).reshape(-1, dim)
                key = ["~" if i is None else sha256(f"{seed}:{i}".encode()).hexdigest() for i in ids]
                least = sorted(range(len(ids)), key=lambda j: (key[j], x[j].tolist()))[:k]
                yield pa.RecordBatch.from_arrays([pa.array([key[j] for j in least], pa.string()), pa.array([x[j].tolist() for j in least], pa.list_(pa.float64()))], ["key", "x"])

    return [[int(v) for v in r["x"]] for r in blocks.mapInArrow(run, "key string, x array<double>").orderBy("key", "x").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, block: int = 4096) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    blocks = durable(blocks_of(vectors, dim, block))
    centers = first_centers(blocks, k, seed, dim)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centers:
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        sums, n, _ = round_of(blocks, centers, dim)
        centers = [[int(s) // int(m) for s in row] if m else c for row, m, c in zip(sums, n, centers, strict=True)]
    inertia = [int(v) for v in round_of(blocks, centers, dim)[2]]
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    cut = [min(v, LONG) for v in inertia]
    total = min(sum(inertia), LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in enumerate(b.column(1)):
                at, far = nearest(np.frombuffer(raw.as_py(), dtype=np.float64).reshape(-1, dim), centers)
                far = pa.array(far if far.dtype != object else [min(v, LONG) for v in far], pa.int64())
                of = at.tolist()
                columns = [b.column(0)[i].values, pa.array(at.astype(np.int32)), far, pa.array([cut[c] for c in of], pa.int64()), pa.array([total] * len(of), pa.int64()), pa.array([digest[c] for c in of])]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(run, schema)


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every vector of ``embeddings`` with 64 finite components, 8 centroids, 10 rounds."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql(k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64) -> str:
    """The same in DuckDB: one pair of tables a round."""
    steps = f"""WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: floor(1024 * CAST(v AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x AS m FROM x ORDER BY sha256('{seed}:' || vec_id), x LIMIT {k}
)"""
    for i in range(rounds + 1):
        steps += f""", a{i} AS MATERIALIZED (
  SELECT r, vec_id, x, min(struct_pack(far := CAST(list_inner_product(x, x) - 2 * list_inner_product(x, m) + list_inner_product(m, m) AS BIGINT), c := c)) AS own FROM x, c{i} GROUP BY ALL
)"""
        if i < rounds:
            steps += f""", s{i} AS MATERIALIZED (
  SELECT c, p, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT own.c AS c, unnest(x) AS v, generate_subscripts(x, 1) AS p FROM a{i}) GROUP BY c, p
), c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(new, m) AS m FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY p) AS new FROM s{i} GROUP BY c) USING (c)
)"""
    return steps + f"""
SELECT vec_id, CAST(own.c AS INTEGER) AS cluster, own.far AS distance,
  CAST(sum(own.far) OVER (PARTITION BY own.c) AS BIGINT) AS cluster_inertia, CAST(sum(own.far) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(m, lambda v: CAST(v AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = own.c"""


ORACLE = sql()
