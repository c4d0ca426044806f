"""SimHash near-copies of five-word shingles, widened to the Jaccard similarity of 0.8.

Two texts are linked if at least four fifths of the five-word shingles of both
are shared. Candidates come from two sides, and each is held against the shingles
themselves, so nothing below 0.8 is linked:

* operator 5: fingerprints within 3 bits, found by pigeonring chains. Alone this
  is not enough: a pair of similarity 0.8 differs in 10 bits on average, and no
  chain of segments of 64 bits is selective at a radius that would hold it.
* agreement in one of 24 bands of 5 minima; a pair of similarity 0.8 is missed
  with a chance of (1 - 0.8 ** 5) ** 24 = 7e-5, a closer one less often.

A class is a connected part of the links. Equal texts (in lower case, blanks run
together) are one node before anything is shuffled by band. In a bucket every
member first meets one head, by a join. Members that this leaves outside the
bucket's largest part are then held against the whole bucket, in blocks of about
BLOCK by BLOCK texts inside tasks: only links leave a block, so the rows follow
the members and not the pairs.

Edge cases: null, empty and blank texts are copies of each other and of nothing
else; fewer than five words make one shingle; rows with a null doc_id are treated
as in ``simhash.keep_first``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from . import textops as tx
from .components import connected, durable, small_batches

SHINGLE, SEED, BANDS, ROWS, BLOCK = 5, 42, 24, 5, 256
#: Least similarity, as shared over all shingles.
SHARED, ALL = 4, 5


def copy_key(raw: bytes) -> int:
    """XXH64 of a text in lower case with its blanks run together."""
    return xxhash.xxh64_intdigest(b" ".join(raw.lower().split()), SEED)


def copy_keys(column: pa.Array) -> np.ndarray:
    """The key of each text, equal for equal texts."""
    raw, offsets = tx.buffers(column)
    out = np.zeros(len(column), dtype=np.uint64)
    for i, j in tx.groups(offsets):
        whole = raw[offsets[i] : offsets[j]].tobytes()
        out[i:j] = [copy_key(whole[offsets[d] - offsets[i] : offsets[d + 1] - offsets[i]]) for d in range(i, j)]
    return out


def sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have a shingle; the fingerprint and BANDS keys of each."""
    draw = np.random.default_rng(SEED)
    mult = draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    rows, prints, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros((0, BANDS), np.uint64)]
    for has, first, h in simhash.hashed(column, SHINGLE, SEED):
        key = np.zeros((len(has), BANDS), dtype=np.uint64)
        for p in range(BANDS * ROWS):
            band = p // ROWS
            key[:, band] = tx.mixed((key[:, band] + np.uint64(p + 1)) * mult[0] ^ np.minimum.reduceat((h ^ flip[p]) * mult[p], first))
        rows.append(has)
        prints.append(simhash.majority(first, h))
        keys.append(key)
    return np.concatenate(rows), np.concatenate(prints), np.concatenate(keys)


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, print, bands) of every row; fp is its copy key, print its fingerprint (null without a shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = tx.text_column(b, "text")
            has, prints, keys = sketches(column)
            count, whole = np.zeros(len(column), dtype=np.int32), np.zeros(len(column), dtype=np.uint64)
            count[has], whole[has] = BANDS, prints
            ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            columns = [b.column(0), pa.array(copy_keys(column).view(np.int64)), pa.array(whole.view(np.int64), mask=count == 0), bands]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "print", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, print long, bands array<long>")


def with_copy_keys(rows: DataFrame) -> DataFrame:
    """All columns of ``rows`` and __sg_fp."""
    return simhash.with_fingerprints_of(rows, copy_keys)


def shingle_sets(docs: DataFrame, wanted: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(fp, shingles) of the texts with the ``wanted`` keys (fp, distinct): sorted hashes, eight bytes each.

    Copies are one row before they are shuffled. At most ``most`` keys (of 8 bytes) go to
    all tasks, so that other texts need not move; more meet the texts by a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (np.unique(np.array(simhash.shingle_hashes(t.encode(), SHINGLE, SEED), dtype="<u8")).tobytes() for t in tx.text_column(b, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(sets), pa.binary())], ["fp", "shingles"])

    keyed = with_copy_keys(docs.select("text")).select(F.col("__sg_fp").alias("fp"), "text")
    text = F.min("text").alias("text")
    if wanted.limit(most + 1).count() <= most:
        one = keyed.join(F.broadcast(wanted), "fp", "left_semi").groupBy("fp").agg(text)
    else:
        one = keyed.groupBy("fp").agg(text).join(wanted, "fp", "left_semi")
    return one.mapInArrow(run, "fp long, shingles binary")


def _hashes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype="<u8")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: copy keys, distinct) whose texts share enough shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            for r, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = _hashes(x), _hashes(y)
                if ALL * min(len(x), len(y)) < SHARED * max(len(x), len(y)):
                    continue
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                keep[r] = ALL * shared >= SHARED * (len(both) - shared)
            yield tx.keep_rows(b.select(["a", "b"]), keep)

    left, right = (sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"of_{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _pair(a: str, b: str) -> list[F.Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def close_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of copy keys that operator 5's links join; texts of one fingerprint each meet the least of them."""
    heads = durable(nodes.where("print is not null").groupBy("print").agg(F.min("fp").alias("head")))
    same = nodes.join(heads, "print").where("fp <> head").select(*_pair("fp", "head"))
    left, right = (heads.select(F.col("print").alias(c), F.col("head").alias(f"of_{c}")) for c in ("a", "b"))
    near = simhash.links(heads.select(F.col("print").alias("fp"))).join(left, "a").join(right, "b").select(*_pair("of_a", "of_b"))
    return same.union(near)


def _held_against(group: pa.Table) -> pa.Table:
    """Links from the asking texts of a block to the others, one for each part that they reach."""
    fp, part, asks = (group.column(c).to_numpy() for c in ("fp", "r", "asks"))
    sets = [_hashes(x) for x in group.column("shingles")]
    known, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
    out: list[tuple[int, int]] = []
    if len(known) and len(asking):
        size = np.array([len(sets[k]) for k in known])
        every = np.concatenate([sets[k] for k in known])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(known)), size)[order]
        for q in asking:
            lo, hi = np.searchsorted(every, sets[q], "left"), np.searchsorted(every, sets[q], "right")
            n = hi - lo
            met = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            shared = np.bincount(met, minlength=len(known))
            hit = np.flatnonzero((ALL * shared >= SHARED * (size + len(sets[q]) - shared)) & (part[known] != part[q]))
            _, one = np.unique(part[known[hit]], return_index=True)
            out += [(min(int(fp[q]), x), max(int(fp[q]), x)) for x in fp[known[hit[one]]].tolist()]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def rest_of_buckets(known: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``known`` (key, fp, r: the part so far) -> links of the members outside their bucket's largest part."""
    parts = known.groupBy("key", "r").count().groupBy("key").agg(
        F.max_by("r", F.struct("count", "r")).alias("h"), F.max("count").alias("most"), F.sum("count").alias("n"), F.count("*").alias("kinds")
    )
    # Of two members one is the other's head, so they have met.
    mixed = parts.where("kinds > 1 and n > 2").select("key", "h", F.ceil(F.col("n") / block).alias("ps"), F.ceil((F.col("n") - F.col("most")) / block).alias("qs"))
    some = known.join(mixed, "key")
    place = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    met = some.select("key", "fp", "r", place("ps", 1).alias("p"), every("qs").alias("q"), F.lit(False).alias("asks"))
    asks = some.where("r <> h").select("key", "fp", "r", every("ps").alias("p"), place("qs", 2).alias("q"), F.lit(True).alias("asks"))
    dealt = met.select("key", "p", "q", "fp", "r", "asks").union(asks.select("key", "p", "q", "fp", "r", "asks"))
    return dealt.join(sets, "fp").groupBy("key", "p", "q").applyInArrow(_held_against, "a long, b long").distinct()


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``nodes`` (fp, print, bands; fp distinct) -> edges (a, b) that join all candidates found similar."""
    dealt = nodes.select(F.explode("bands").alias("key"), "fp").distinct()
    heads = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", "key")).alias("head")).where("n > 1").select("key", "head")
    members = durable(dealt.join(heads, "key"))
    star = members.where("fp <> head").select(*_pair("fp", "head"))
    pairs = durable(star.union(close_prints(nodes)).distinct())
    sets = durable(shingle_sets(docs, durable(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())))
    found = durable(similar(pairs, sets))
    root = connected(found).select(F.col("node").alias("fp"), F.col("root").alias("to"))
    known = durable(members.join(root, "fp", "left").select("key", "fp", F.coalesce("to", "fp").alias("r")))
    return found.union(rest_of_buckets(known, sets))


def classes(marked: DataFrame, docs: DataFrame) -> DataFrame:
    """``marked`` (doc_id, fp, print, bands) -> (fp, component_id): the least doc_id that links lead to."""
    least = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("print").alias("print"), F.first("bands").alias("bands")))
    root = connected(links(least.select("fp", "print", "bands"), docs)).withColumnRenamed("node", "fp")
    return simhash.named(least.select("fp", "least"), root)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, unchanged, of each class, chosen as by ``simhash.keep_first``."""
    with small_batches(docs.sparkSession):
        marked = durable(marks(docs))
        of = durable(classes(marked, docs))
    return simhash.one_of_each(docs, marked.select("doc_id", "fp"), of, with_copy_keys)
