"""Sharding by a k-d tree over document metadata.

The metadata of a document are its size in bytes, its length in characters and the
CRC-32 of its text. A node that stands for k shards is split along its widest
dimension (its box's width as a share of the whole table's) at the weighted
quantile k // 2 : k of its bytes, until every leaf has the target bytes. Law: ``bytes``.

All nodes of a level are measured together in a few distributed passes: boxes,
then histograms of 4,096 bins over the chosen dimension, refined around the cut.
The driver sees sums by node and bin only, at most 40 times 4,096 of them. Equal
texts have equal metadata and stay in one shard, unless so many of them share a cut
that the sizes would differ by more than ``slack`` of a shard: then doc_id decides,
and between rows that repeat text and doc_id the row's number (fixed by a checkpoint).

Slots are counted in parts of bounded size (a shard and a hash of the row's number),
so no task holds a shard.

Edge cases: a null text counts as empty (size 16, CRC 0); rows with a null doc_id
stand first in order; rows that repeat text and doc_id, or lack one, are parted like
any others; an empty table gives no rows; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import durable

DIMENSIONS = ("size", "chars", "crc")
#: What parts rows of equal metadata; the row's number comes last, so that no two rows are inseparable.
TIES = ("ident", "row")
BINS = 4096
OVERHEAD = 16


@dataclass
class Node:
    shards: int
    first: int
    dim: str = ""
    #: Lexicographic cut: columns and values; a row is left if it is at most this.
    cut: list[tuple[str, int]] = field(default_factory=list)
    left: Node | None = None
    right: Node | None = None
    number: int = 0


def metadata(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.length(text).cast("long").alias("chars"), F.crc32(text).alias("crc"),
    )


def _ident() -> F.Column:
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 62)))


def _at_most(cut: list[tuple[str, int]]) -> F.Column:
    """Whether a row is at most the cut, column by column."""
    name, value = cut[-1]
    out = F.col(name) <= value
    for name, value in reversed(cut[:-1]):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def _place(node: Node, leaf) -> F.Column:
    if node.left is None:
        return F.lit(leaf(node))
    return F.when(_at_most(node.cut), _place(node.left, leaf)).otherwise(_place(node.right, leaf))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else _leaves(node.left) + _leaves(node.right)


def build(meta: DataFrame, shards: int, slack: float = 0.01, tolerance: float = 0.0005) -> tuple[Node, int]:
    """The tree over ``meta`` (doc_id, size, chars, crc, ident, row) and the number of rows."""
    root = Node(shards, 0)
    spread, rows, target = {}, 0, 0.0
    while True:
        open_ = [n for n in _leaves(root) if n.shards > 1]
        if not open_:
            return root, rows
        for k, n in enumerate(_leaves(root)):
            n.number = -1 if n.shards == 1 else k
        placed = meta.withColumn("node", _place(root, lambda n: n.number)).where("node >= 0")
        boxes = {
            r["node"]: r for r in placed.groupBy("node").agg(
                F.count("*").alias("n"), F.sum("size").alias("bytes"),
                *[f(d).alias(f"{name}_{d}") for d in (*DIMENSIONS, *TIES) for name, f in (("lo", F.min), ("hi", F.max))],
            ).collect()
        }
        if not spread:
            if not boxes:
                return Node(1, 0), 0
            b = boxes[open_[0].number]
            spread = {d: max(1, b[f"hi_{d}"] - b[f"lo_{d}"]) for d in DIMENSIONS}
            rows, target = b["n"], b["bytes"] / shards
        todo: dict[int, dict] = {}
        for n in open_:
            b = boxes.get(n.number)
            if b is None:  # nothing left to split
                n.cut = [("size", 0)]
                continue
            widest = max(DIMENSIONS, key=lambda d: (b[f"hi_{d}"] - b[f"lo_{d}"]) / spread[d])
            n.dim = widest
            order = [widest, *(d for d in DIMENSIONS if d != widest), *TIES]
            todo[n.number] = {"node": n, "order": order, "at": 0, "fixed": [], "lo": b[f"lo_{widest}"], "hi": b[f"hi_{widest}"], "below": 0, "want": b["bytes"] * (n.shards // 2) / n.shards, "box": b}
        while todo:
            _refine(placed, todo, target * slack, target * tolerance)
        for n in open_:
            half = n.shards // 2
            n.left, n.right = Node(half, n.first), Node(n.shards - half, n.first + half)


def _refine(placed: DataFrame, todo: dict[int, dict], slack: float, tolerance: float) -> None:
    """One pass over all open cuts; removes those that are settled."""
    inside, bin_ = F.lit(False), F.lit(None).cast("long")
    for number, t in todo.items():
        here = F.col("node") == number
        for name, value in t["fixed"]:
            here = here & (F.col(name) == value)
        x = F.col(t["order"][t["at"]])
        here = here & x.between(t["lo"], t["hi"])
        width = max(1, -(-(t["hi"] - t["lo"] + 1) // BINS))
        t["width"] = width
        inside = inside | here
        bin_ = F.when(here, F.floor((x - t["lo"]) / F.lit(width)) if width > 1 else x - t["lo"]).otherwise(bin_)
    sums: dict[int, list[tuple[int, int]]] = {}
    for r in placed.where(inside).withColumn("bin", bin_.cast("long")).groupBy("node", "bin").agg(F.sum("size").alias("bytes")).collect():
        sums.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
    for number, t in list(todo.items()):
        bins = sorted(sums.get(number, []))
        column = t["order"][t["at"]]
        ends = np.cumsum([b[1] for b in bins]) + t["below"]
        k = min(int(np.searchsorted(ends, t["want"])), len(bins) - 1)
        bin_number, weight = bins[k]
        before = int(ends[k]) - weight
        lo = t["lo"] + bin_number * t["width"]
        hi = min(t["hi"], lo + t["width"] - 1)
        last = column == TIES[-1]
        # settled if the bin is light, or if it is one value of all metadata and may stay whole
        whole = t["width"] == 1 and (last or (t["at"] == len(DIMENSIONS) - 1 and weight <= slack))
        if weight <= tolerance or whole:
            keep = hi if abs(ends[k] - t["want"]) <= abs(before - t["want"]) else lo - 1
            t["node"].cut = [*t["fixed"], (column, int(keep))]
            del todo[number]
        elif t["width"] == 1:
            t["fixed"].append((column, int(lo)))
            t["at"] += 1
            nxt = t["order"][t["at"]]
            t["lo"], t["hi"], t["below"] = t["box"][f"lo_{nxt}"], t["box"][f"hi_{nxt}"], before
        else:
            t["lo"], t["hi"], t["below"] = lo, hi, before


def shard_documents(docs: DataFrame, shards: int = 40, part_rows: int = 200_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    meta = durable(metadata(docs).withColumn("ident", _ident()).withColumn("row", F.monotonically_increasing_id()))
    root, rows = build(meta, shards)
    parts = max(1, -(-rows // (shards * part_rows)))
    placed = meta.withColumn("shard", _place(root, lambda n: n.first).cast("int")).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    counts = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("ident", "crc", "size", "row")
    numbered = placed.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["shard", "part"])
    return numbered.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every row of ``documents`` into 40 shards."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
