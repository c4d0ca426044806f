"""Bounded samples of rows, the same in every run, for the classifiers that learn; and models sent to tasks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a class that are cut, so that it is learned at all, if even its shortest text is longer than its share.
FEW = 8
_PLACES = 1 << 30


@dataclass
class Chosen:
    doc_id: int
    label: Any
    text_hash: int
    size: int
    #: Characters to learn from; None: all.
    part: int | None = None


def counts_of(rows: DataFrame, label: str) -> dict[Any, int]:
    """About how many ids each class has."""
    return {r[0]: r[1] for r in rows.groupBy(label).agg(F.approx_count_distinct("doc_id")).collect() if r[0] is not None}


def share_of(rows: DataFrame, label: str, counts: dict[Any, int], most: int) -> DataFrame:
    """The rows of a share of the ids, by a hash of theirs: about four times ``most`` ids of a class, however many it has."""
    place, part = F.pmod(F.xxhash64("doc_id"), F.lit(_PLACES)), F.lit(False)
    for value, n in counts.items():
        part = part | ((F.col(label) == F.lit(value)) & (place < int(min(1.0, 4.0 * most / max(1, n)) * _PLACES)))
    return rows.where(part)


def least_of_each(rows: DataFrame, label: str, most: int) -> list[Chosen]:
    """At most ``most`` of each class, by the order of a hash, of the few ``rows`` (``share_of`` of doc_id, text and ``label``).

    Of rows that repeat an id and class one counts. The driver sees ids and sizes, no text.
    """
    own = F.min(F.struct(F.octet_length("text").alias("size"), F.xxhash64("text").alias("text_hash"))).alias("own")
    few = rows.where("text is not null").groupBy("doc_id", label).agg(own).select("doc_id", label, "own.*", F.pmod(F.xxhash64("doc_id"), F.lit(_PLACES)).alias("place"))
    by_class: dict[Any, list[tuple]] = {}
    for r in few.collect():
        by_class.setdefault(r[1], []).append((r["place"], r["doc_id"], r["text_hash"], r["size"]))
    return [Chosen(d, value, h, size) for value, own in sorted(by_class.items()) for _, d, h, size in sorted(own)[:most]]


def within_bytes(chosen: list[Chosen], most: int) -> list[Chosen]:
    """Those of ``chosen`` whose texts sum to at most ``most`` bytes.

    All of them if they fit. Otherwise each class has an equal share and gives its
    shortest texts, so that a text longer than that costs no place but its own. A
    class whose shortest text is longer than its share gives the beginnings of its
    FEW shortest, cut to equal parts of the share.
    """
    if sum(c.size for c in chosen) <= most:
        return chosen
    classes: dict[Any, list[Chosen]] = {}
    for c in chosen:
        classes.setdefault(c.label, []).append(c)
    out, share = [], most // len(classes)
    for own in classes.values():
        own = sorted(own, key=lambda c: (c.size, c.doc_id))
        if own[0].size > share:
            few = own[:FEW]
            out += [Chosen(c.doc_id, c.label, c.text_hash, c.size, max(1, share // len(few) // 4)) for c in few]  # a character has at most four bytes
            continue
        left = share
        for c in own:
            left -= c.size
            if left < 0:
                break
            out.append(c)
    return out


def texts_of(docs: DataFrame, chosen: list[Chosen]) -> DataFrame:
    """doc_id, label and text (whole, or the part to learn from) of the ``chosen``, in one partition; their number and bytes are bounded."""
    spark = docs.sparkSession
    kind = "string" if any(isinstance(c.label, str) for c in chosen) else "int"
    wanted = spark.createDataFrame([(c.doc_id, c.label, c.text_hash, c.part) for c in chosen], f"__id long, label {kind}, __hash long, __part int")
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
    cut = found.select("doc_id", "label", F.when(F.col("__part").isNull(), F.col("text")).otherwise(F.substring("text", F.lit(1), F.col("__part"))).alias("text"))
    return cut.dropDuplicates(["doc_id", "label"]).repartition(1)


def train_in_task(rows: DataFrame, train: Callable[[list[dict]], Any]) -> Any:
    """What ``train`` makes of all ``rows`` (a bounded sample of one partition), in one task of an executor; the driver gets its result only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in b.to_pylist()]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(got))], pa.binary())], ["model"])

    made = rows.mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0][0]) if made else train([])


def shared(docs: DataFrame, value: Any) -> Broadcast:
    """``value`` for tasks, with the code of its classes, so that executors need no copy of this package."""
    return docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(sent: Broadcast) -> Any:
    """What ``shared`` sent; a worker makes it once and keeps it beside the bytes for its later tasks."""
    if not hasattr(sent, "opened"):
        sent.opened = pickle.loads(sent.value)
    return sent.opened
