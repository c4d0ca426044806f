"""Spelling variant grouping: each word's distance-one Levenshtein automaton is intersected with compact trie shards.

Words are the letter runs of all texts, counted by task and then in Spark; those of
``min_length`` code points and ``min_count`` occurrences form the vocabulary. It is
dealt by ranges of the word into shards, and a task lays each shard out as a compact
trie: chains of single children are one node, the children of a node stand side by
side, so a child is found by a search in a slice of one string. Shards go to the
tasks by broadcast, as many at a time as fit ``group_bytes``, however large the
vocabulary: a larger one takes more passes over the words.

A task walks every shard depth-first for each of its words. While no error is spent
the automaton follows the word down one path and at every branch tries a replaced,
an added and a skipped letter; after the error the rest must match. Inside a chain
only the first mismatch needs to be tried. What a word meets is reduced at once to
the number of its near words and the best of them; no pair leaves a task.

A form has at least ``ratio`` times the occurrences of its word, so chains of forms
end, after at most 63 / log2(ratio) steps; roots follow them by pointer doubling.

Edge cases: null and empty texts hold no words; a null doc_id counts as empty in
the hash; repeated rows are counted each; very long texts are read in parts that no
run crosses; an empty table gives no rows. A shard holds at most ``shard_words``
words and ``shard_bytes`` of them, or one longer word.
"""

from __future__ import annotations

import pickle
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .components import durable
from .sampling import opened, shared

#: A-Z to lower case; bytes of no run to a blank. U+00C0 to U+00FF are the byte 0xC3 and one more.
RUN_LUT = np.full(256, tx.SPACE, dtype=np.uint8)
for _b in range(ord("a"), ord("z") + 1):
    RUN_LUT[_b] = RUN_LUT[_b - 32] = _b
LEAD = 0xC3
RUN_LUT[LEAD] = LEAD
#: Bytes before which a text can be cut: what begins a character of no run.
CUT = RUN_LUT == tx.SPACE
CUT[0x80:0xC0] = False


@dataclass
class Settings:
    min_length: int = 6
    min_count: int = 5
    ratio: int = 5
    one_in: int = 199  # of so many runs of a document one loses a letter, by a hash
    shard_words: int = 65_536
    shard_bytes: int = 4 << 20
    group_bytes: int = 64 << 20
    part_bytes: int = 2 << 20
    held: int = 300_000


def parts(raw: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """``raw`` in parts of about ``most`` bytes that no run crosses."""
    at = 0
    while len(raw) - at > most:
        to, step = at + most, 4096
        while to < len(raw) and not (hit := np.flatnonzero(CUT[raw[to : to + step]])).size:
            to += step
            step *= 2
        if to >= len(raw):
            break
        yield raw[at : to + int(hit[0])]
        at = to + int(hit[0])
    yield raw[at:]


def runs(raw: np.ndarray) -> np.ndarray:
    """The bytes of a text, its runs lower-cased and all else blank."""
    out = RUN_LUT[raw]
    second = np.flatnonzero(raw[:-1] == LEAD) + 1
    out[second] = raw[second]
    return out


def without(run: bytes, h: int) -> bytes:
    """The run without its code point h % length."""
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, s: Settings) -> DataFrame:
    """word and n of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        crc32, one_in, least = zlib.crc32, s.one_in, s.min_length
        for b in batches:
            raw, offsets = tx.buffers(tx.text_column(b, "text"))
            for i, j in tx.groups(offsets):
                laid = [runs(p) for p in parts(raw[offsets[i] : offsets[j]], s.part_bytes)] if j == i + 1 else [runs(raw[offsets[i] : offsets[j]])]
                for d in range(i, j):
                    doc_id = b.column(0)[d].as_py()
                    prefix = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for part in laid if j == i + 1 else [laid[0][offsets[d] - offsets[i] : offsets[d + 1] - offsets[i]]]:
                        for w, n in Counter([w for w in part.tobytes().split() if len(w) >= least]).items():
                            h = crc32(w, prefix)
                            total[w if h % one_in else without(w, h)] += n
                    if len(total) >= s.held:
                        yield flushed(total)
        if total:
            yield flushed(total)

    def flushed(total: Counter[bytes]) -> pa.RecordBatch:
        words, n = pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())
        total.clear()
        return pa.RecordBatch.from_arrays([words, n], ["word", "n"]).filter(pc.greater_equal(pc.utf8_length(words), s.min_length))

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return some.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= s.min_count)


class Trie:
    """A compact trie of sorted words; node 0 is the root, the children of a node are a range of nodes."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, array("q", n)
        self.end, self.sample, self.term, self.first = array("i"), array("i"), array("i"), array("i")
        letters, spans = ["\0"], [(0, len(words), 0)]
        for a, b, end in spans:  # grows while it is read
            low, high = words[a], words[b - 1]
            top = min(len(low), len(high))
            while end < top and low[end] == high[end]:
                end += 1
            self.end.append(end)
            self.sample.append(a)
            self.first.append(len(spans))
            self.term.append(a if len(low) == end else -1)
            at = a + (len(low) == end)
            while at < b:
                letter, to = words[at][end], at + 1
                while to < b and words[to][end] == letter:
                    to += 1
                letters.append(letter)
                spans.append((at, to, end + 1))
                at = to
        self.first.append(len(spans))
        self.label = "".join(letters)

    def packed(self) -> bytes:
        return pickle.dumps(("\n".join(self.words), self.label, *(x.tobytes() for x in (self.n, self.end, self.sample, self.term, self.first))))

    @classmethod
    def unpacked(cls, blob: bytes) -> Trie:
        out = cls.__new__(cls)
        words, out.label, n, *rest = pickle.loads(blob)
        out.words, out.n = words.split("\n"), array("q", n)
        out.end, out.sample, out.term, out.first = (array("i", x) for x in rest)
        return out

    def exact(self, word: str, v: int, d: int, i: int) -> int:
        """The word that the rest word[i:] leads to from depth ``d`` of node ``v``'s chain, or -1."""
        label, end, first = self.label, self.end, self.first
        while True:
            e = end[v]
            if e > d:
                if not word.startswith(self.words[self.sample[v]][d:e], i):
                    return -1
                i += e - d
            if i == len(word):
                return self.term[v]
            v = label.find(word[i], first[v], first[v + 1])
            if v < 0:
                return -1
            d, i = e + 1, i + 1

    def near(self, word: str) -> set[int]:
        """The words at distance one."""
        label, end, first, exact, length = self.label, self.end, self.first, self.exact, len(word)
        found: set[int] = set()
        v = d = i = 0
        while True:
            e = end[v]
            if e > d:
                chain = self.words[self.sample[v]]
                if not word.startswith(chain[d:e], i):
                    while i < length and chain[d] == word[i]:
                        d, i = d + 1, i + 1
                    found.add(exact(word, v, d + 1, i))
                    if i < length:
                        found.add(exact(word, v, d + 1, i + 1))
                        found.add(exact(word, v, d, i + 1))
                    break
                i += e - d
            a, b = first[v], first[v + 1]
            if i == length:
                for c in range(a, b):
                    found.add(exact(word, c, e + 1, i))
                break
            found.add(exact(word, v, e, i + 1))
            own = -1
            for c in range(a, b):
                found.add(exact(word, c, e + 1, i))
                if label[c] == word[i]:
                    own = c
                else:
                    found.add(exact(word, c, e + 1, i + 1))
            if own < 0:
                break
            v, d, i = own, e + 1, i + 1
        found.discard(-1)
        return found


def shards_of(words: DataFrame, s: Settings, number: int) -> DataFrame:
    """size and blob (a packed ``Trie``) of every shard of ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, size = [], [], 0
        for b in batches:
            for w, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own and (len(own) >= s.shard_words or size + len(w) > s.shard_bytes):
                    yield packed(own, n)
                    own, n, size = [], [], 0
                own.append(w)
                n.append(m)
                size += len(w)
        if own:
            yield packed(own, n)

    def packed(own: list[str], n: list[int]) -> pa.RecordBatch:
        blob = Trie(own, n).packed()
        return pa.RecordBatch.from_arrays([pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())], ["size", "blob"])

    dealt = words.repartitionByRange(number, "word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "size long, blob binary")


def groups_of(shards: DataFrame, most: int) -> list[list[int]]:
    """Shard numbers in groups of at most ``most`` bytes (a larger shard is alone)."""
    out, total = [], 0
    for r in shards.select("shard", "size").orderBy("shard").collect():
        if not out or total + r["size"] > most:
            out.append([])
            total = 0
        out[-1].append(r["shard"])
        total += r["size"]
    return out


def met(words: DataFrame, tries: list[bytes]) -> DataFrame:
    """word, n_near and best (its most frequent near word, as (-n, form)) of every word, among the words of ``tries``."""
    sent = shared(words, Shards(tries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(sent).open()
        for b in batches:
            number, least, form = [], [], []
            for w in b.column(0).to_pylist():
                count, best = 0, None
                for t in own:
                    found = t.near(w)
                    count += len(found)
                    for k in found:
                        key = (-t.n[k], t.words[k])
                        if best is None or key < best:
                            best = key
                number.append(count)
                least.append(best and best[0])
                form.append(best and best[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number, pa.int64()), pa.array(least, pa.int64()), pa.array(form, pa.string())], ["word", "n_near", "least", "form"])

    return words.select("word").mapInArrow(run, "word string, n_near long, least long, form string")


class Shards:
    """Packed tries; a worker opens them once."""

    def __init__(self, tries: list[bytes]):
        self.tries = tries

    def open(self) -> list[Trie]:
        if not hasattr(self, "made"):
            self.made = [Trie.unpacked(t) for t in self.tries]
        return self.made


def near_words(words: DataFrame, s: Settings) -> DataFrame:
    """word, n_near, form and form_n (both null without a near word) of every word; ``words`` must be durable."""
    many = words.count()
    shards = durable(shards_of(words, s, -(-many // s.shard_words) or 1).withColumn("shard", F.monotonically_increasing_id()))
    dealt = words.repartition(max(words.sparkSession.sparkContext.defaultParallelism, -(-many // 16_384)), "word")
    out = None
    for group in groups_of(shards, s.group_bytes):
        own = met(dealt, [bytes(r["blob"]) for r in shards.where(F.col("shard").isin(group)).orderBy("shard").collect()])
        out = own if out is None else out.unionByName(own)
    if out is None:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct("least", "form"))).alias("best")
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.least")).alias("form_n"))


def roots_of(links: DataFrame) -> DataFrame:
    """``links`` (word, form) -> word, root: the end of each word's chain of forms."""
    out = durable(links.select("word", F.col("form").alias("root")))
    while True:
        step = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if out.join(step, "root", "left_semi").isEmpty():
            return out
        out = durable(out.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of the vocabulary of ``docs`` (doc_id, text)."""
    s = s or Settings()
    words = durable(word_counts(docs, s))
    found = words.join(near_words(words, s), "word")
    frequent = F.col("form_n") >= s.ratio * F.col("n")
    table = durable(found.select("word", F.when(frequent, F.col("form")).alias("form"), "n", "n_near", F.when(frequent, F.col("form_n")).alias("form_n")))
    roots = roots_of(table.where("form is not null"))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every text of ``documents``."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
