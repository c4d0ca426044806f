"""Connected components over an edge table, by contraction, all in Spark.

Each round every node points to the least of itself and its neighbours; edges are
renamed by these pointers, loops and repeated edges go. A connected part stays
connected under renaming, and rounds shrink it to one node. The pointers of all
rounds, followed in turn, lead each node to its part's last node. Rounds are cut
by checkpoints in the shared folder, so a lost executor costs one round at most.

Nothing is gathered on the driver but row counts. Minimums are pre-aggregated, so
a node with very many edges costs no large group; the joins have a side that is
unique by key, which adaptive execution can split on the other.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the cluster names. Where none is named, a temporary folder serves a local session; elsewhere that is an error."""
    sc = df.sparkSession.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def hand_over_small(spark: SparkSession, rows: int = 1000) -> None:
    """From now on tasks get at most ``rows`` rows at once: a batch of whole texts is held several times over, by Spark and by the worker."""
    before = int(spark.conf.get(BATCH))
    if not 0 < before <= rows:
        spark.conf.set(BATCH, str(rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is computed inside: for rows that each hold a text or its shingles."""
    before = spark.conf.get(BATCH)
    hand_over_small(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, root) for every node that has an edge.

    ``root`` is equal within a part and different between parts; it is not always
    the least node. Loops and repeated edges are fine; nulls must not occur. No
    edges: no rows.
    """
    spark: SparkSession = edges.sparkSession
    edges = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a")))
        points = durable(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")))
        rounds.append(points)
        left, right = points.select(F.col("node").alias("a"), F.col("root").alias("a2")), points.select(F.col("node").alias("b"), F.col("root").alias("b2"))
        renamed = edges.join(left, "a").join(right, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = durable(renamed.distinct())
    if not rounds:
        return spark.createDataFrame([], "node long, root long")
    out = rounds[0]
    for step in rounds[1:]:
        follow = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(follow, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
