"""Toxicity: averaged subword embeddings under a linear softmax.

A word is the bag of its character n-grams (3 to 5 code points, its edges marked) and
of itself; every member has a row in one hashed embedding table. The vectors of a
word's members are averaged to the word, those of a window's words to the window,
and a linear softmax over two classes reads the window. Embeddings and softmax
are trained together in numpy. A misspelt or inflected word that was never seen
shares n-grams, and so vectors, with those that were.

A text is scored by the highest of its windows (``window`` words, every half
window), so that a long text does not dilute a short insult. The whole text
counts, at any length.

Edge cases: a null or empty text, or one without words, can hold no insult: its
score is the toxic share of the rows learned from, but at most ``WORDLESS``, whatever
the softmax's bias. Repeated rows are scored alike. With no labelled rows at all, or
with one class only, the model is the class share.
The training rows are a sample bounded by ``per_class`` rows, in the order of a
hash of doc_id, and ``max_bytes`` of text (see ``sampling.within_bytes``: a long
text costs its own place only, and both classes keep some).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .sampling import counts_of, least_of_each, opened, share_of, shared, texts_of, train_in_task, within_bytes

NGRAMS = (3, 4, 5)
#: The most that a text without words can score.
WORDLESS = 0.25
_C = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


@dataclass
class Settings:
    buckets: int = 1 << 18
    dim: int = 8
    window: int = 2
    per_class: int = 2500
    max_bytes: int = 14 << 20
    epochs: int = 8
    batch_bytes: int = 1 << 20
    rate: float = 0.5
    rare: float = 10.0
    toxic_weight: float = 1.0
    seed: int = 7
    folds: int = 5
    held_out_fold: int = 0


@dataclass
class Model:
    """Per bucket the embedding's projection on the softmax's class difference, its bias, and the toxic share of what was learned from."""

    scalars: np.ndarray
    bias: float
    settings: Settings = field(default_factory=Settings)
    share: float = 0.0

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -40, 40)))


def _members(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bucket) of all members of all words, one n-gram size at a time."""
    wide = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)  # characters
    solid = wide != tx.SPACE
    word_of = np.cumsum(np.diff(solid.astype(np.int8), prepend=0) == 1, dtype=np.int32) - 1
    for n in NGRAMS:
        m = len(wide) - n + 1
        if m <= 0:
            continue
        ok = solid[1 : 1 + m].copy()
        for k in range(2, n - 1):
            ok &= solid[k : k + m]
        at = np.flatnonzero(ok)
        h = wide[at] * _C[0]
        for k in range(1, n):
            h += wide[at + k] * _C[k]
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D) + np.uint32(2 * n)
        h ^= h >> np.uint32(13)
        yield word_of[at + 1], (h & np.uint32(buckets - 1)).astype(np.int32)
    whole = tx.word_hashes(text, begins, ends)
    yield np.arange(len(begins), dtype=np.int32), (whole & np.uint64(buckets - 1)).astype(np.int32)


def _word_values(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, model: Model) -> np.ndarray:
    total, count = np.zeros(len(begins)), np.zeros(len(begins))
    for word, bucket in _members(text, begins, ends, model.settings.buckets):
        total += np.bincount(word, weights=model.scalars[bucket], minlength=len(begins))
        count += np.bincount(word, minlength=len(begins))
    return total / np.maximum(count, 1)


def _windows(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end) of each window; documents without words have none."""
    half = max(1, window // 2)
    words = np.diff(first)
    n = np.where(words > 0, 1 + np.maximum(0, -(-(words - window) // half)), 0)
    doc = np.repeat(np.arange(len(words)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    lo = first[doc] + k * half
    return doc, lo, np.minimum(lo + window, first[doc + 1])


def scores(column: pa.Array, model: Model) -> np.ndarray:
    raw, offsets = tx.buffers(column)
    out = np.full(len(column), min(model.share, WORDLESS))
    for i, j in tx.groups(offsets):
        text, starts = tx.padded(raw, offsets, i, j)
        begins, ends = tx.word_spans(text)
        if not len(begins):
            continue
        sums = np.concatenate(([0.0], np.cumsum(_word_values(text, begins, ends, model))))
        doc, lo, hi = _windows(tx.per_document(begins, starts), model.settings.window)
        logits = (sums[hi] - sums[lo]) / (hi - lo) + model.bias
        best = np.full(j - i, -np.inf)
        np.maximum.at(best, doc, logits)
        has = np.isfinite(best)
        out[i:j][has] = model.probability(best[has])
    return out


def train(texts: list[str], labels: np.ndarray, settings: Settings | None = None) -> Model:
    """Fits embeddings and softmax together: a toxic text counts through its highest window, a clean one through all."""
    s = settings or Settings()
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(s.buckets), float(np.log(share / (1 - share))), s, share)
    order = np.random.default_rng(s.seed).permutation(len(texts))
    y = y[order]
    raw, offsets = tx.buffers(pa.array([texts[k] for k in order], pa.large_string()))
    batches = [_Batch(raw, offsets, i, j, s) for i, j in tx.groups(offsets, s.batch_bytes)]
    share = 0.5 / np.array([max(1.0, (1 - y).sum()), max(1.0, y.sum())]) * np.array([1.0, s.toxic_weight])
    rng = np.random.default_rng(s.seed)
    table = rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (s.dim, 2))
    bias = np.zeros(2)
    # Adagrad whose sums begin at what ``rare`` texts would give: a member of few texts moves little.
    rare = s.rare * share.min() / (s.window * 12)
    square, sq_soft, sq_bias = np.full(table.shape, rare * rare, np.float32), np.full(soft.shape, 1e-10), np.full(2, 1e-10)
    for epoch in range(s.epochs):
        for b in batches:
            direction = soft[:, 1] - soft[:, 0]
            z, at, end, who = b.forward((table @ direction.astype(np.float32)).astype(np.float64), y, float(bias[1] - bias[0]), epoch == 0)
            if not len(z):
                continue
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            g = (p - y[b.begin + who]) * share[y[b.begin + who].astype(int)]
            hit, per_bucket = b.backward(g, at, end, s.buckets)
            d_soft = table[hit].T @ per_bucket
            d_soft, d_bias = np.stack((-d_soft, d_soft), axis=1), np.array([-g.sum(), g.sum()])
            d_table = np.outer(per_bucket, direction).astype(np.float32)
            square[hit] += d_table * d_table
            table[hit] -= s.rate * d_table / np.sqrt(square[hit])
            sq_soft += d_soft * d_soft
            soft -= s.rate * d_soft / np.sqrt(sq_soft)
            sq_bias += d_bias * d_bias
            bias -= s.rate * d_bias / np.sqrt(sq_bias)
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), s, float(y.mean()))


class _Batch:
    """Features of a few training texts: their word types, the types' members, and the windows."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, i: int, j: int, s: Settings):
        text, starts = tx.padded(raw, offsets, i, j)
        begins, ends = tx.word_spans(text)
        _, where, self.token = np.unique(tx.word_hashes(text, begins, ends), return_index=True, return_inverse=True)
        fresh = np.full(len(begins), -1, dtype=np.int32)
        fresh[where] = np.arange(len(where))
        kind, bucket = [], []
        for word, at in _members(text, begins, ends, s.buckets) if len(begins) else ():
            new = fresh[word] >= 0
            kind.append(fresh[word][new])
            bucket.append(at[new])
        self.begin, self.types, self.window = i, len(where), s.window
        self.token = self.token.astype(np.int32)
        self.first = tx.per_document(begins, starts)
        self.kind, self.bucket = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (kind, bucket))
        self.size = np.maximum(np.bincount(self.kind, minlength=self.types), 1)

    def forward(self, projected: np.ndarray, y: np.ndarray, bias: float, whole: bool) -> tuple:
        """Logit, first word, end and text of the windows that count."""
        value = np.bincount(self.kind, weights=projected[self.bucket], minlength=self.types) / self.size
        sums = np.concatenate(([0.0], np.cumsum(value[self.token])))
        if whole:  # whole texts first, so that the windows chosen later mean something
            who = np.flatnonzero(np.diff(self.first) > 0)
            lo, hi = self.first[who], self.first[who + 1]
            return (sums[hi] - sums[lo]) / (hi - lo) + bias, lo, hi, who
        doc, lo, hi = _windows(self.first, self.window)
        z = (sums[hi] - sums[lo]) / (hi - lo) + bias
        toxic = y[self.begin + doc] > 0
        some = np.flatnonzero(toxic)
        some = some[np.lexsort((-z[some], doc[some]))]
        lead = np.concatenate(([True], doc[some][1:] != doc[some][:-1])) if len(some) else np.zeros(0, bool)
        pick = np.concatenate((some[lead], np.flatnonzero(~toxic)))  # every window of a clean text is clean
        return z[pick], lo[pick], hi[pick], doc[pick]

    def backward(self, g: np.ndarray, at: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that the logits' gradients reach, and what reaches each."""
        n = len(self.token) + 1
        spread = np.bincount(at, weights=g / (end - at), minlength=n) - np.bincount(end, weights=g / (end - at), minlength=n)
        per_type = np.bincount(self.token, weights=np.cumsum(spread)[:-1], minlength=self.types) / self.size
        total = np.bincount(self.bucket, weights=per_type[self.kind], minlength=buckets)
        hit = np.flatnonzero(total)
        return hit, total[hit]


def fold(column: str, folds: int) -> F.Column:
    """crc32 of the decimal id, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Trains on a bounded sample of the labelled rows outside the held-out fold.

    An id with several labels is toxic if one of them says so; null labels and
    labels without a text are left out.
    """
    s = settings or Settings()
    marked = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id", s.folds) != s.held_out_fold))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    some = share_of(marked, "toxic", counts_of(marked, "toxic"), s.per_class)  # a bounded number of ids, so it may be sent to all tasks
    chosen = within_bytes(least_of_each(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "toxic", s.per_class), s.max_bytes)

    def learn(sample: list[dict]) -> tuple[np.ndarray, float, float]:
        sample.sort(key=lambda r: (r["doc_id"], r["text"]))
        model = train([r["text"] for r in sample], np.array([r["label"] for r in sample]), s)
        return model.scalars, model.bias, model.share

    scalars, bias, share = train_in_task(texts_of(docs, chosen), learn)
    return Model(scalars, bias, s, share)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    s = model.settings
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(sent)
        for b in batches:
            p = scores(tx.text_column(b, "text"), own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", s.folds) == s.held_out_fold).alias("held_out"), "text")
    return some.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is below ``threshold``."""
    sent = shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(sent)
        for b in batches:
            yield tx.keep_rows(b, scores(tx.text_column(b, "text"), own) < threshold)

    return docs.mapInArrow(run, docs.schema)


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: trained on ``labels``, applied to all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
