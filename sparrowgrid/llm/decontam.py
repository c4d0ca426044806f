"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every training passage.

Impacts are BM25 weights divided by the item's own total, so a passage that holds
all words of an item scores 1 on it whatever its length; ``threshold`` is a share
of that. Passages are windows of twice an item length class (64 words, 128, ...),
one class apart, so an item copied anywhere lies whole inside one of them. No
passage and no item is left out, and no number of results is capped.

Retrieval is block-max WAND with a fixed threshold. First, for all passages of a
group of documents at once, the block maxima of the passage's terms are summed per
block of items; blocks whose sum stays below the threshold are skipped (terms of
little weight are not looked up there, their greatest possible sum is added
instead). Passages with blocks left are then traversed item by item with pivots,
term maxima and block maxima. Items above the threshold are verified in order of
words: the question (all but the last sentence) and the answer (the last sentence;
of a single sentence, its last third) must both overlap with the passage, each
measured by the longest common subsequence.

The index is built on the driver in shards of about ``shard_bytes`` of item text (a
longer item is a shard of its own) and sent to the tasks; documents are scanned once
for every ``scan_bytes`` of shards, so a benchmark below that takes one scan, and a
larger one never more memory. Statistics cover the whole benchmark.

Words end at blanks and punctuation; letters of scripts without blanks are words.

Edge cases: null or wordless texts match nothing; null or wordless items are never
matched; items with a null id are searched like others and reported under it;
repeated items with one id and text count once; repeated documents are reported
each; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .sampling import opened, shared


@dataclass
class Settings:
    threshold: float = 0.6
    overlap: float = 0.7
    k1: float = 1.2
    b: float = 0.75
    block: int = 2
    slight: float = 0.25  # share of an item that terms of little weight may have together
    shard_bytes: int = 2 << 20
    scan_bytes: int = 16 << 20


@dataclass
class Item:
    item_id: int | None
    question: list[int]
    answer: list[int]


@dataclass
class Index:
    """Postings of one length class: by term (sorted hashes) the items and impacts, and block maxima."""

    size: int  # words of the class
    terms: np.ndarray
    start: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    most: np.ndarray  # greatest impact of each term
    heavy: np.ndarray  # whether the term is looked up in the first step
    block_start: np.ndarray
    block: np.ndarray
    block_most: np.ndarray
    rest: float  # greatest sum of the other terms
    items: list[Item]
    settings: Settings = field(default_factory=Settings)
    sieve: np.ndarray | None = None

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term, -1 for words that no item has."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        may = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.searchsorted(self.terms, hashes[may])
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == hashes[may]
        out[may[hit]] = at[hit]
        return out


def hashed_words(text: str) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    padded, _ = tx.padded(raw, np.array([0, len(raw)]), 0, 1)
    return tx.word_hashes(padded, *tx.token_spans(padded))


_SENTENCE = re.compile(r"[.?!\n]+\s+")


def question_and_answer(text: str) -> tuple[list[int], list[int]]:
    words = hashed_words(text).tolist()
    cut = 0
    for m in _SENTENCE.finditer(text.rstrip()):
        cut = m.end()
    n = len(hashed_words(text[:cut]))
    if n == 0 or n >= len(words):
        n = len(words) - max(1, len(words) // 3)
    return words[:n], words[n:]


def build(rows: list[tuple[int, str]], df: dict[int, int], n_items: int, average: float, settings: Settings) -> list[Index]:
    """One index for each length class of the items; ``df``, ``n_items`` and ``average`` are of the whole benchmark."""
    classes: dict[int, list[tuple[int, str, np.ndarray]]] = {}
    for item_id, text in rows:
        words = hashed_words(text)
        if len(words):
            size = 64
            while size < len(words):
                size *= 2
            classes.setdefault(size, []).append((item_id, text, words))
    return [_build(size, own, df, n_items, average, settings) for size, own in sorted(classes.items())]


def _build(size: int, own: list, df: dict[int, int], n_items: int, average: float, s: Settings) -> Index:
    term, item, share = [], [], []
    for k, (_, _, words) in enumerate(own):
        t, tf = np.unique(words, return_counts=True)
        d = np.array([df[x] for x in t.tolist()], dtype=float)
        w = np.log(1 + (n_items - d + 0.5) / (d + 0.5)) * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * len(words) / average))
        term.append(t)
        item.append(np.full(len(t), k))
        share.append(w / w.sum())
    term, item, share = np.concatenate(term), np.concatenate(item), np.concatenate(share)
    order = np.lexsort((item, term))
    term, item, share = term[order], item[order], share[order]
    terms, start = np.unique(term, return_index=True)
    start = np.append(start, len(term))
    number = np.repeat(np.arange(len(terms)), np.diff(start))
    most = np.maximum.reduceat(share, start[:-1])
    # terms in the order of document frequency are left out of the first step while no item loses more than ``slight``
    heavy, lost, rest = np.ones(len(terms), dtype=bool), np.zeros(len(own)), 0.0
    for t in sorted(range(len(terms)), key=lambda t: -df[int(terms[t])]):
        at = slice(start[t], start[t + 1])
        if df[int(terms[t])] < 2 or (lost[item[at]] + share[at]).max() > s.slight:
            continue
        lost[item[at]] += share[at]
        heavy[t] = False
    rest = float(lost.max())
    key = number * (len(own) // s.block + 1) + item // s.block
    unique, first = np.unique(key, return_index=True)
    block_most = np.maximum.reduceat(share, first)
    block_start = np.searchsorted(number[first], np.arange(len(terms) + 1))
    items = [Item(item_id, *question_and_answer(text)) for item_id, text, _ in own]
    sieve = np.zeros(1 << 20, dtype=bool)
    sieve[(terms & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return Index(size, terms, start, item, share, most, heavy, block_start, item[first] // s.block, block_most, rest, items, s, sieve)


def wand(query: np.ndarray, ix: Index, blocks: set[int]) -> list[tuple[int, float]]:
    """All (item, score) of at least the threshold for a passage's distinct terms, inside ``blocks``."""
    s, out = ix.settings, []
    cursors = [[int(ix.start[t]), int(ix.start[t + 1]), float(ix.most[t]), int(t)] for t in query.tolist()]
    least, B = s.threshold - 1e-9, s.block
    while cursors:
        cursors.sort(key=lambda c: ix.item[c[0]])
        total, pivot = 0.0, -1
        for n, c in enumerate(cursors):
            total += c[2]
            if total >= least:
                pivot = n
                break
        if pivot < 0:
            break
        doc = int(ix.item[cursors[pivot][0]])
        while pivot + 1 < len(cursors) and ix.item[cursors[pivot + 1][0]] == doc:
            pivot += 1
        bound = 0.0
        if doc // B in blocks:
            for c in cursors[: pivot + 1]:
                a, b = ix.block_start[c[3]], ix.block_start[c[3] + 1]
                k = a + np.searchsorted(ix.block[a:b], doc // B)
                bound += float(ix.block_most[k]) if k < b and ix.block[k] == doc // B else 0.0
        if bound < least:  # no item of this block can do, as far as the next list's item
            target = (doc // B + 1) * B
            if pivot + 1 < len(cursors):
                target = min(target, int(ix.item[cursors[pivot + 1][0]]))
            target = max(target, doc + 1)
        elif ix.item[cursors[0][0]] == doc:
            score = sum(float(ix.impact[c[0]]) for c in cursors[: pivot + 1])
            if score >= least:
                out.append((doc, score))
            target = doc + 1
        else:
            target = doc
        for c in cursors[: pivot + 1]:
            if ix.item[c[0]] < target:
                c[0] += int(np.searchsorted(ix.item[c[0] : c[1]], target))
        cursors = [c for c in cursors if c[0] < c[1]]
    return out


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel addition."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = masks.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def leaks_of(column: pa.Array, indexes: list[Index]) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(row, item_id, score, question overlap, answer overlap, first word of the passage), best passage of each row and item."""
    raw, offsets = tx.buffers(column)
    for i, j in tx.groups(offsets):
        text, starts = tx.padded(raw, offsets, i, j)
        begins, ends = tx.token_spans(text)
        if not len(begins):
            continue
        hashes = tx.word_hashes(text, begins, ends)
        first = tx.per_document(begins, starts)
        best: dict[tuple[int, int], tuple] = {}
        for ix in indexes:
            for doc, at, to, found in _passages(hashes, first, ix):
                words = hashes[at:to].tolist()
                for k, score in found:
                    item = ix.items[k]
                    q, a = common(item.question, words) / max(1, len(item.question)), common(item.answer, words) / max(1, len(item.answer))
                    if a >= ix.settings.overlap and (q >= ix.settings.overlap or not item.question):
                        new = (score, q, a, int(at - first[doc]))
                        if best.get((doc, item.item_id), (-1.0,))[:3] < new[:3]:
                            best[doc, item.item_id] = new
        for (doc, item_id), x in sorted(best.items(), key=lambda e: (e[0][0], e[0][1] is None, e[0][1] or 0)):
            yield (i + doc, item_id, *x)


def _passages(hashes: np.ndarray, first: np.ndarray, ix: Index) -> Iterator[tuple[int, int, int, list[tuple[int, float]]]]:
    """(document, begin, end, items) of the passages that reach the threshold."""
    size, s = ix.size, ix.settings
    words = np.diff(first)
    n = np.maximum(1, -(-words // size) - 1)  # windows [k * size, (k + 2) * size)
    n[words == 0] = 0
    base = np.cumsum(n) - n
    term = ix.lookup(hashes)
    at = np.flatnonzero(term >= 0)
    at = at[ix.heavy[term[at]]]
    if not len(at):
        return
    doc = np.searchsorted(first, at, side="right") - 1
    k = (at - first[doc]) // size
    lists = ix.block_start[term[at] + 1] - ix.block_start[term[at]]
    entry = np.repeat(ix.block_start[term[at]] - np.cumsum(lists) + lists, lists) + np.arange(lists.sum())
    nb = len(ix.items) // s.block + 1
    window, block, weight = [], np.tile(ix.block[entry], 2), np.tile(ix.block_most[entry], 2)
    for back in (0, 1):
        ok = (k - back >= 0) & (k - back < n[doc])
        window.append(np.repeat(np.where(ok, base[doc] + k - back, -1), lists))
    window = np.concatenate(window)
    ok = window >= 0
    key = window[ok] * nb + block[ok]
    if int(n.sum()) * nb <= 1 << 22:
        sums = np.bincount(key, weights=weight[ok])
        left = np.flatnonzero(sums + ix.rest >= s.threshold - 1e-9)
    else:
        unique, back = np.unique(key, return_inverse=True)
        left = unique[np.bincount(back, weights=weight[ok]) + ix.rest >= s.threshold - 1e-9]
    if not len(left):
        return
    of = np.repeat(np.arange(len(words)), n)
    passages, cut = np.unique(left // nb, return_index=True)
    for p, a, b in zip(passages.tolist(), cut, [*cut[1:], len(left)], strict=True):
        d = int(of[p])
        lo = int(first[d] + (p - base[d]) * size)
        hi = int(min(lo + 2 * size, first[d + 1]))
        own = np.unique(term[lo:hi])
        found = wand(own[own >= 0], ix, set((left[a:b] % nb).tolist()))
        if found:
            yield d, lo, hi, found


def shards(benchmark: DataFrame, settings: Settings | None = None) -> Iterator[list[Index]]:
    """The benchmark's index, in parts of bounded size."""
    s = settings or Settings()
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // s.shard_bytes))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                h = hashed_words(t)
                u = np.unique(h).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(u, 0)), pa.array(np.append(np.zeros(len(u), np.int64), len(h)))], ["term", "words"])

    found = items.select("text").mapInArrow(words, "term long, words long")
    # the row of each item that counts its words has term 0
    stats = found.where("words > 0").agg(F.count("*"), F.avg("words")).first()
    if not stats[0]:
        return
    counted = found.where("words = 0").groupBy("term").count()
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if not rows:
            continue
        own = part.select("text").mapInArrow(words, "term long, words long").where("words = 0").select("term").distinct() if n > 1 else None
        df = {r["term"] & (2**64 - 1): r["count"] for r in (counted if own is None else counted.join(own, "term", "left_semi")).collect()}
        yield build(rows, df, stats[0], stats[1], s)


def scans(benchmark: DataFrame, settings: Settings | None = None) -> Iterator[list[Index]]:
    """The shards' indexes, as many at once as one scan of the documents serves."""
    s = settings or Settings()
    held: list[Index] = []
    for n, indexes in enumerate(shards(benchmark, s), 1):
        held += indexes
        if n % max(1, s.scan_bytes // s.shard_bytes) == 0:
            yield held
            held = []
    if held:
        yield held


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """A row for each document row and item that it holds."""
    out = None
    for indexes in scans(benchmark, settings):
        sent = shared(docs, indexes)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = opened(sent)
            for b in batches:
                rows = list(leaks_of(tx.text_column(b, "text"), own))
                of = pa.array([r[0] for r in rows], pa.int64())
                numbers = [pa.array([round(r[c], 6) for r in rows], pa.float64()) for c in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array([r[1] for r in rows], pa.int64()), *numbers, pa.array([r[5] for r in rows], pa.int64())], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no item of the benchmark."""
    for indexes in scans(benchmark, settings):
        sent = shared(docs, indexes)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = opened(sent)
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[r[0] for r in leaks_of(tx.text_column(b, "text"), own)]] = False
                yield tx.keep_rows(b, keep)

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every passage of ``documents`` against all of ``benchmark``."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
