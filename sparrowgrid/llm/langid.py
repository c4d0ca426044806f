"""Language identification with error-correcting output codes.

Each language has a binary codeword; one linear classifier per code bit, trained
in numpy on hashed byte n-grams (1 to 4 bytes of the lower-cased text, words
between blanks), predicts that bit. Decoding sums a logistic loss over the bits,
each weighted by that classifier's accuracy on its training rows, and chooses the
codeword of least loss. The score is the softmax of the negative losses, and a
text is ambiguous if the two best codewords are closer than ``margin``.

Up to seven languages get the exhaustive code (all ways to split them in two);
more get random splits with pairwise distances checked.

Edge cases: a null text or one without a letter is ``und`` with score 0; with no
labelled rows every text is ``und``; with one language only, that is predicted.
Null languages are not learned. Texts are read whole. The training rows are a
sample of at most ``max_docs`` rows (equal shares per language, by the order of a
hash of doc_id) and ``max_bytes`` of text (see ``sampling.within_bytes``: a long
text costs its own place only, and every language keeps some).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .sampling import counts_of, least_of_each, opened, share_of, shared, texts_of, train_in_task, within_bytes

UND = "und"
#: Loss of a codeword whose every bit is a toss-up.
TOSS_UP = float(np.log(2))
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
_K = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


@dataclass
class Settings:
    buckets: int = 1 << 13
    sizes: tuple[int, ...] = (1, 2, 3, 4)
    max_docs: int = 800
    max_bytes: int = 16 << 20
    chunk: int = 240
    epochs: int = 60
    rate: float = 0.3
    decay: float = 1e-4
    margin: float = 0.1
    seed: int = 11
    folds: int = 3
    held_out_fold: int = 1


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss
    settings: Settings = field(default_factory=Settings)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n codewords of -1 and 1; exhaustive up to seven languages."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([[1 if (k == 0 or not (b >> (k - 1)) & 1) else -1 for b in range(1, 2 ** (n - 1))] for k in range(n)], dtype=float)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(200):
        code = np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2
        np.fill_diagonal(apart, bits)
        if apart.min() > most:
            best, most = code, apart.min()
    return best


def _buckets(text: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, int]]:
    """Bucket of the n-gram that begins at each byte, one size after the other."""
    wide = text.astype(np.uint32)
    for n in s.sizes:
        m = len(text) - n + 1
        if m <= 0:
            continue
        h = wide[:m] * _K[0]
        for k in range(1, n):
            h += wide[k : k + m] * _K[k]
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D) + np.uint32(2 * n)
        h ^= h >> np.uint32(14)
        yield (h & np.uint32(s.buckets - 1)).astype(np.int32), n


def has_letter(raw: np.ndarray, offsets: np.ndarray, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), dtype=bool)
    for i, j in tx.groups(offsets, tx.GROUP_BYTES // 4):
        hits = np.concatenate(([0], np.cumsum(_ASCII_LETTER[raw[offsets[i] : offsets[j]]], dtype=np.int32)))
        out[i:j] = hits[offsets[i + 1 : j + 1] - offsets[i]] > hits[offsets[i:j] - offsets[i]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = _LETTER.search(column[int(i)].as_py()) is not None
    return out


def margins(column: pa.Array, model: Model) -> np.ndarray:
    """What each bit's classifier says of each text."""
    raw, offsets = tx.buffers(column)
    out = np.tile(model.bias, (len(column), 1))
    bits = model.weights.shape[1]
    # n-grams of different sizes at the same byte are added before the sum over the text
    for i, j in tx.groups(offsets, tx.GROUP_BYTES // 4):
        text, starts = tx.padded(raw, offsets, i, j)
        acc = np.zeros((starts[-1], bits), dtype=np.float32)  # the last blank begins no text
        for bucket, n in _buckets(text, model.settings):
            part = model.weights[bucket[: len(acc)]]
            across = (starts[1:, None] - np.arange(1, n - 1)).ravel()  # n-grams that would reach into the next text
            part[across[(across >= 0) & (across < len(part))]] = 0
            acc[: len(bucket)] += part
        sums = np.add.reduceat(acc, starts[:-1], axis=0, dtype=np.float64)
        out[i:j] += sums / (len(model.settings.sizes) * np.diff(starts))[:, None]
    return out


def losses(margin: np.ndarray, model: Model) -> np.ndarray:
    """Loss of each text (row) under each codeword."""
    loss = np.logaddexp(0.0, -margin[:, None, :] * model.code[None, :, :])
    return (loss * model.trust).sum(axis=2) / model.trust.sum()


def decode(margin: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its score, and the lead over the second."""
    loss = losses(margin, model)
    rating = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    rating /= rating.sum(axis=1, keepdims=True)
    order = np.sort(rating, axis=1)
    lead = order[:, -1] - order[:, -2] if rating.shape[1] > 1 else order[:, -1]
    return loss.argmin(axis=1), rating.max(axis=1), lead


def predict(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    raw, offsets = tx.buffers(column)
    ok = has_letter(raw, offsets, column)
    if not model.languages:
        return [UND] * len(column), np.zeros(len(column)), np.ones(len(column), dtype=bool)
    best, score, lead = decode(margins(column, model), model)
    names = [model.languages[b] if o else UND for b, o in zip(best, ok, strict=True)]
    return names, np.where(ok, score, 0.0), ~ok | (lead < model.settings.margin)


def train(texts: list[str], langs: list[str], settings: Settings | None = None) -> Model:
    s = settings or Settings()
    languages = sorted(set(langs))
    code = codewords(len(languages), s.seed)
    if len(languages) < 2:
        return Model(languages, code, np.zeros((s.buckets, 1), np.float32), np.ones(1), np.ones(1), s)
    # every text counts whole and through chunks of itself, so that short texts are met as well
    rows, y = [], []
    rng = np.random.default_rng(s.seed)
    for t, lang in zip(texts, langs, strict=True):
        rows.append(t)
        y.append(languages.index(lang))
        for n in (s.chunk, s.chunk // 8):
            at = int(rng.integers(0, max(1, len(t) - n)))
            rows.append(t[at : at + n])
            y.append(y[-1])
    raw, offsets = tx.buffers(pa.array(rows, pa.large_string()))
    x = np.zeros((len(rows), s.buckets), dtype=np.float32)
    for r in range(len(rows)):
        text, starts = tx.padded(raw, offsets, r, r + 1)
        for bucket, _ in _buckets(text, s):
            x[r] += np.bincount(bucket[: len(text) - 1], minlength=s.buckets)  # the blank at the end belongs to the next text
        x[r] /= len(s.sizes) * (len(text) - 1)
    target = code[np.array(y)]
    count = np.bincount(y, minlength=len(languages))
    weight = (1.0 / count[np.array(y)] / len(languages))[:, None].astype(np.float32)
    w, b = np.zeros((s.buckets, code.shape[1]), np.float32), np.zeros(code.shape[1])
    sq_w, sq_b = np.full(w.shape, 1e-12), np.full(b.shape, 1e-6)
    for _ in range(s.epochs):
        m = x @ w + b
        g = -target / (1 + np.exp(np.clip(m * target, -40, 40))) * weight
        dw, db = x.T @ g.astype(np.float32) + s.decay * w * 1e-3, g.sum(axis=0)
        sq_w += dw * dw
        sq_b += db * db
        w -= (s.rate * 20 * dw / np.sqrt(sq_w)).astype(np.float32)
        b -= s.rate * db / np.sqrt(sq_b)
    right = ((np.sign(x @ w + b) == target) * weight).sum(axis=0)
    return Model(languages, code, w, b, np.maximum(right - 0.5, 0.05), s)


def fold(column: str, folds: int) -> F.Column:
    """crc32 of the decimal id, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def fit(docs: DataFrame, settings: Settings | None = None) -> Model:
    """Trains on a bounded sample of the rows outside the held-out fold that name a language."""
    s = settings or Settings()
    able = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", s.folds) != s.held_out_fold)).select("doc_id", "text", "lang")
    counts = counts_of(able, "lang")
    most = max(8, s.max_docs // max(1, len(counts)))
    chosen = within_bytes(least_of_each(share_of(able, "lang", counts, most), "lang", most), s.max_bytes)

    def learn(sample: list[dict]) -> tuple:
        sample.sort(key=lambda r: (r["doc_id"], r["text"], r["label"]))
        m = train([r["text"] for r in sample], [r["label"] for r in sample], s)
        return m.languages, m.code, m.weights, m.bias, m.trust

    return Model(*train_in_task(texts_of(docs, chosen), learn), s)


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()),
])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row."""
    s = model.settings
    sent = shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(sent)
        for b in batches:
            lang, score, unsure = predict(tx.text_column(b, "text"), own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], SCHEMA.names)

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", s.folds) == s.held_out_fold).alias("held_out"), "text")
    return some.mapInArrow(run, SCHEMA)


def identified(column: pa.Array, model: Model) -> np.ndarray:
    """Whether each text has a letter and a codeword that is nearer than a toss-up of all bits."""
    raw, offsets = tx.buffers(column)
    ok = has_letter(raw, offsets, column)
    if len(model.languages) > 1:
        ok &= losses(margins(column, model), model).min(axis=1) <= TOSS_UP
    return ok


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text is of a language: it has a letter, and the decoder does not reject it.

    The decoder rejects a text whose nearest codeword has a greater loss than a
    toss-up of every bit would have: its bits contradict all codewords. Without a
    model of two languages at least, the letter alone decides.
    """
    sent = shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(sent)
        for b in batches:
            yield tx.keep_rows(b, identified(tx.text_column(b, "text"), own))

    return docs.mapInArrow(run, docs.schema)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: trained on two thirds of ``documents``, applied to all of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
