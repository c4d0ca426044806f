"""SimHash near-duplicates, filtered by the pigeonring principle.

A fingerprint has 64 bits, read as a ring of m = 4 segments of 16. If two of them
differ in at most t = 3 bits, some segment starts a chain whose first l segments
differ in at most l * t / m bits for every l: 0, 1, 2 and 3. The first two steps
make the join key: a segment, equal, and one half of the next segment, which must
be equal too as that segment has at most one differing bit. Each fingerprint so
has 8 keys of 24 bits. Inside a key's bucket the chain's third and fourth steps
prune the pairs before the full Hamming check.

Work is on distinct fingerprints (copies meet in one row before anything is
shuffled by key). A bucket yields a spanning forest of its links, never all pairs.
A bucket of more than ``hot`` fingerprints is not held by one task: its members
are spread by their neighbours instead (a and b differ in at most 3 bits exactly
if some value is within 1 bit of a and 2 bits of b), which is linear in members.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like
any other; fewer than three words make one shingle; repeated rows stay repeated;
rows with a null doc_id keep their fingerprint, and a class of only such rows has
a null component_id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from . import textops as tx
from .components import connected, durable

SHINGLE, SEED, DISTANCE, HOT = 3, 42, 3, 8192


def shingle_hashes(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of every shingle of the lower-cased words, repeats included."""
    words = raw.lower().split()  # of bytes: A-Z only, and exactly the blanks of [\x20\x09-\x0D]
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(line, seed)] if words else []
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[: -shingle])]
    return [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]


def hashed(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By group of texts: the rows that have a shingle, where each begins, and the hashes of all their shingles."""
    raw, offsets = tx.buffers(column)
    for i, j in tx.groups(offsets):
        whole = raw[offsets[i] : offsets[j]].tobytes()
        hashes, count = [], np.zeros(j - i, dtype=np.int64)
        for d in range(i, j):
            h = shingle_hashes(whole[offsets[d] - offsets[i] : offsets[d + 1] - offsets[i]], shingle, seed)
            count[d - i] = len(h)
            hashes += h
        if hashes:
            has = np.flatnonzero(count)
            yield i + has, np.cumsum(count[has]) - count[has], np.array(hashes, dtype=np.uint64)


def majority(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The bits that over half the hashes of each text have; a text's hashes begin at ``first``."""
    count = np.diff(np.append(first, len(hashes)))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # sums of up to 255 rows fit a byte, so eight counters are added at once
    pieces = -(-count // 255)
    at = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    small = np.add.reduceat(bits.view(np.uint64), at, axis=0).view(np.uint8).reshape(-1, 64)
    total = np.add.reduceat(small.astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
    return np.packbits((2 * total > count[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts."""
    out = np.zeros(len(column), dtype=np.uint64)
    for rows, first, hashes in hashed(column, shingle, seed):
        out[rows] = majority(first, hashes)
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(tx.text_column(b, "text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bucket_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): a segment, equal, with one half of the next; 8 rows for each fingerprint."""

    def part(low: int, bits: int) -> F.Column:
        return F.shiftrightunsigned("fp", low).bitwiseAND((1 << bits) - 1)

    keys = []
    for i in range(4):
        nxt = 16 * ((i + 1) % 4)
        for half in (0, 1):
            keys.append(F.lit((2 * i + half) << 24).cast("long") + part(16 * i, 16) * 256 + part(nxt + 8 * half, 8))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _linked(a: np.ndarray, b: np.ndarray, segment: np.ndarray | int) -> np.ndarray:
    """Whether the chain from ``segment`` stays within its budgets, and then the full distance."""
    x = a ^ b
    second = np.bitwise_count((x >> np.uint64(16) * ((segment + np.uint64(1)) % np.uint64(4))) & np.uint64(0xFFFF))
    third = second + np.bitwise_count((x >> np.uint64(16) * ((segment + np.uint64(2)) % np.uint64(4))) & np.uint64(0xFFFF))
    return (second <= 1) & (third <= 2) & (np.bitwise_count(x) <= DISTANCE)


def _forest(fp: np.ndarray, segment: np.uint64) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of one bucket's links; each member is compared with those not yet reached."""
    out, rest = [], fp
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            hit = _linked(rest, u, segment)
            if hit.any():
                got = rest[hit]
                out.append((np.full(len(got), u), got))
                queue += list(got)
                rest = rest[~hit]
    return out


def _bucket_links(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside whole buckets, sorted by key."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    length = np.diff(np.concatenate((start, [len(key)])))
    segment = (key >> 25).astype(np.uint64)
    small = np.repeat((length > 1) & (length <= 8), length)
    for d in range(1, 8):
        i = np.flatnonzero(small[:-d] & (key[:-d] == key[d:])) if len(key) > d else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[_linked(fp[i], fp[i + d], segment[i])]
        if len(i):
            yield fp[i], fp[i + d]
    for r in np.flatnonzero(length > 8):
        at = start[r]
        yield from _forest(fp[at : at + length[r]], segment[at])


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """``fps`` (fp: long, distinct) -> edges (a, b) that join all fingerprints within 3 bits."""
    kinds = "a long, b long, key long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(key)], ["a", "b", "key"])

        held_key, held_fp, hot_key = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for b in batches:
            key = np.concatenate((held_key, b.column(0).to_numpy()))
            fp = np.concatenate((held_fp, b.column(1).to_numpy().view(np.uint64)))
            if hot_key is not None:
                more = key == hot_key
                yield rows(fp[more], fp[more], key[more])
                key, fp = key[~more], fp[~more]
                if not len(key):
                    held_key, held_fp = key, fp
                    continue
                hot_key = None
            if not len(key):
                continue
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            length = np.diff(np.concatenate((start, [len(key)])))
            big = np.repeat(length > hot, length)
            if big[-1]:
                hot_key = key[-1]
            if big.any():
                yield rows(fp[big], fp[big], key[big])
            last = np.arange(len(key)) >= start[-1]
            done = ~big & ~last
            for x, y in _bucket_links(key[done], fp[done]) if done.any() else ():
                yield rows(x, y, np.full(len(x), -1))
            keep = last & ~big
            held_key, held_fp = key[keep], fp[keep]
        if len(held_key):
            for x, y in _bucket_links(held_key, held_fp):
                yield rows(x, y, np.full(len(x), -1))

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = bucket_keys(fps).repartition(n, "key").sortWithinPartitions("key", "fp")
    found = durable(dealt.mapInArrow(run, kinds))
    return found.where("key < 0").select("a", "b").union(_spread(found.where("key >= 0").select("key", F.col("a").alias("fp"))))


def _spread(members: DataFrame) -> DataFrame:
    """Links inside hot buckets: members meet at values within 1 bit of one and 2 bits of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, f in zip(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), strict=True):
                segment, half = int(k) >> 25, (int(k) >> 24) & 1
                nxt = 16 * ((segment + 1) % 4) + 8 * half
                free = np.array([p for p in range(64) if not (16 * segment <= p < 16 * segment + 16 or nxt <= p < nxt + 8)], dtype=np.uint64)
                one = np.uint64(1) << free
                i, j = np.triu_indices(len(one), 1)
                near = np.concatenate(([np.uint64(0)], one, one[i] | one[j])) ^ f
                close = np.arange(len(near)) <= len(one)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), k)), pa.array(near.view(np.int64)), pa.array(np.full(len(near), f).view(np.int64)), pa.array(close)], ["key", "at", "fp", "close"])

    met = members.mapInArrow(run, "key long, at long, fp long, close boolean")
    centre = met.where("close").groupBy("key", "at").agg(F.min("fp").alias("a"))
    return met.join(centre, ["key", "at"]).where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def classes(marked: DataFrame, hot: int = HOT) -> DataFrame:
    """``marked`` (doc_id, fp) -> (fp, component_id): the least doc_id that links lead to."""
    least = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return named(least, connected(links(least.select("fp"), hot)).withColumnRenamed("node", "fp"))


def named(least: DataFrame, root: DataFrame) -> DataFrame:
    """``least`` (fp, least) and ``root`` (fp, root) of linked ones -> (fp, component_id)."""
    joined = least.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNull().alias("alone"))
    first = joined.where("not alone").groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(first, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    marked = durable(with_fingerprints(docs))
    out = marked.join(classes(marked, hot), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row of ``docs``, unchanged, of each class: that of the least doc_id.

    Of rows that repeat this doc_id one stays (the least text); rows with a null
    doc_id stay only in a class without another doc_id, one row for each fingerprint.
    """
    marked = durable(with_fingerprints(docs))
    return one_of_each(docs, marked, durable(classes(marked, hot)), with_fingerprints_of)


def one_of_each(docs: DataFrame, marked: DataFrame, of: DataFrame, again_marked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``keep_first`` for rows ``marked`` (doc_id, fp) in classes ``of`` (fp, component_id); ``again_marked`` adds __sg_fp to rows."""
    heads = F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("heads")
    firsts = marked.join(of, "fp").groupBy("doc_id").agg(F.count("*").alias("count"), heads).where("heads")
    # A repeated id may head one class and lie in another, so an id is clear only if it has one row in all.
    clear = firsts.where("count = 1 and doc_id is not null").select(F.col("doc_id").alias("__sg_id"))
    kept = docs.join(clear, docs["doc_id"] == F.col("__sg_id"), "left_semi")
    rest = firsts.where("count > 1 or doc_id is null").select(F.col("doc_id").alias("__sg_id"))
    if rest.isEmpty():
        return kept
    # Only rows whose id repeats, or is null, are looked at by text again.
    again = docs.join(rest, docs["doc_id"].eqNullSafe(F.col("__sg_id")), "left_semi").withColumn("__sg_row", F.monotonically_increasing_id())
    home = of.select(F.col("fp").alias("__sg_fp"), F.col("component_id").alias("__sg_home"))
    ranked = again_marked(again).join(home, "__sg_fp").where(F.col("doc_id").eqNullSafe(F.col("__sg_home")))
    # A class of null ids only has no name of its own, so its members are kept apart by fingerprint.
    first = Window.partitionBy("__sg_home", F.when(F.col("__sg_home").isNull(), F.col("__sg_fp"))).orderBy("text", "__sg_row")
    one = ranked.withColumn("__sg_n", F.row_number().over(first)).where("__sg_n = 1")
    return kept.unionByName(one.select(*docs.columns))


def with_fingerprints_of(rows: DataFrame, mark: Callable[[pa.Array], np.ndarray] = fingerprints) -> DataFrame:
    """All columns of ``rows`` and __sg_fp."""
    schema = StructType([*rows.schema.fields, StructField("__sg_fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = mark(tx.text_column(b, "text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], [*b.schema.names, "__sg_fp"])

    return rows.mapInArrow(run, schema)


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every row of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
