"""BPE encoding and decoding with an index of pair occurrences.

Words (whitespace-free stretches) of a group of texts are laid out once each in
one array of symbols with links to both neighbours. An index maps every mergeable
pair to all its positions in the group. The active ranks are taken in ascending
order; all positions of a rank are merged at once, and the pairs that this makes
or breaks are moved between the lists. A merge cannot cross words, so words that
repeat share one encoding; a bounded cache keeps encodings between groups.

The vocabulary file is read with ``json`` only; nothing of the tokenizers library
takes part. Supported are files of the kind of ``word_bpe_49k.json``: NFC, white
space to one blank, lower case by character; a pattern that keeps letters, single
digits, punctuation and English contractions; bytes as printable characters; an
end-of-word suffix; special tokens found in the raw text; no decoder, so decoding
joins token strings with one blank.

Edge cases: a null or empty text has no tokens; both digests are then those of the
empty string. Repeated rows are encoded alike. Texts are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as tx
from .sampling import opened, shared

#: White space of the file's patterns (Unicode's White_Space), which has no U+001C to U+001F.
BLANKS = r"\t-\r \x85\xa0  -     　"
#: Letters and digits that came after Unicode 16, the version of the tokenizers library.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F 11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
)
_LATER = "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in LATER.split())
#: Capitals that came after the Unicode version of Python's own tables, and their small letters.
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_CAPITALS |= {0x10D50 + k: 0x10D70 + k for k in range(22)} | {0x16EA0 + k: 0x16EBB + k for k in range(25)}
_NEW_CAPITAL = regex.compile("[" + "".join(map(chr, NEW_CAPITALS)) + "]")
_SPLIT = regex.compile(f"[{BLANKS}]+")
_ODD = regex.compile("[\x1c-\x1f]")
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_LATER}]]+|[\p{{N}}--[{_LATER}]]|(?:[^{BLANKS}\p{{L}}\p{{N}}]|[{_LATER}])+", regex.V1)


def byte_characters() -> list[str]:
    """Of each byte the printable character that stands for it: itself if printable, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in own else chr(0x100 + more)
        more += b not in own
    return out


@dataclass
class Vocabulary:
    """Ids of bytes, of bytes that end a word, the merges by rank, and the tokens."""

    byte_ids: np.ndarray
    last_ids: np.ndarray
    keys: np.ndarray  # left * 2**20 + right, sorted
    ranks: np.ndarray  # of keys
    merged: np.ndarray  # by rank
    tokens: list[str]
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        return cls.parse(spec)

    @classmethod
    def parse(cls, spec: dict) -> Vocabulary:
        model = spec["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m if not isinstance(m, str) else m.split(" ") for m in model["merges"]]
        keys = np.array([(ids[a] << 20) + ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        tokens = [""] * (max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for t, i in ids.items():
            tokens[i] = t
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in special.items():
            tokens[i] = t
        chars = byte_characters()
        return cls(
            np.array([ids[c] for c in chars], dtype=np.int64), np.array([ids[c + suffix] for c in chars], dtype=np.int64),
            keys[order], order.astype(np.int64), np.array([ids[a + b] for a, b in pairs], dtype=np.int64), tokens, special,
        )

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair the rank of its merge, or -1."""
        key = (left << 20) + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_pieces(pieces: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces one after the other, and where each piece begins (and the end)."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.concatenate(([0], np.cumsum(lengths)))
    n = int(begin[-1])
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sym = v.byte_ids[data]
    last = begin[1:] - 1
    sym[last] = v.last_ids[data[last]]
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[last] = -1
    prv[begin[:-1]] = -1
    alive = np.ones(n, dtype=bool)
    rank_at = np.full(n, -1, dtype=np.int64)
    at = np.flatnonzero(nxt >= 0)
    rank_at[at] = v.rank(sym[at], sym[at + 1])

    occurrences: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(positions: np.ndarray) -> None:
        ranks = rank_at[positions]
        positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        heads = [0, *cuts.tolist()]
        for r, a, b in zip(ranks[heads].tolist(), heads, [*heads[1:], len(ranks)], strict=True):
            if r in occurrences:
                occurrences[r].append(positions[a:b])
            else:
                occurrences[r] = [positions[a:b]]
                heapq.heappush(heap, r)

    enter(at)
    while heap:
        r = heapq.heappop(heap)
        lists = occurrences.pop(r)
        p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        p = p[alive[p] & (rank_at[p] == r)]
        if not len(p):
            continue
        j = nxt[p]
        if sym[p[0]] == sym[j[0]]:  # runs of one symbol: from the left, no overlap
            taken: set[int] = set()
            for x, y in sorted(zip(p.tolist(), j.tolist(), strict=True)):
                if x not in taken:
                    taken.add(y)
            p = np.array(sorted(set(p.tolist()) - taken), dtype=np.int64)
            j = nxt[p]
        k = nxt[j]
        sym[p] = v.merged[r]
        alive[j] = False
        rank_at[j] = -1
        nxt[p] = k
        more = k >= 0
        prv[k[more]] = p[more]
        rank_at[p] = -1
        left = prv[p]
        left = left[left >= 0]
        touched = np.concatenate((p[more], left)) if len(left) else p[more]
        if len(touched):
            rank_at[touched] = v.rank(sym[touched], sym[nxt[touched]])
            enter(np.unique(touched) if len(left) else touched)
    kept = np.flatnonzero(alive)
    return sym[kept], np.searchsorted(kept, begin)


class Encoder:
    """Encodes texts; holds at most about ``cache`` words between groups."""

    def __init__(self, vocabulary: Vocabulary, cache: int = 200_000):
        self.v, self.most = vocabulary, cache
        self.known: dict[str, tuple[str, int, str]] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None

    def words(self, text: str) -> list[str]:
        """Normalised stretches without white space, and special tokens (as they are, marked by a leading blank)."""
        if self.special and "<" in text and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(" " + m[0])
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [w for w in _SPLIT.split(text) if w] if _ODD.search(text) else text.split()

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words that the cache lacks, all in one index."""
        fresh, pieces, count = [], [], []
        for w in words:
            if w[0] == " ":
                self.known[w] = (str(self.v.special[w[1:]]), 1, w[1:])
                continue
            if w.isascii() and w.isalpha():
                found = [w]
            else:
                found = _PIECE.findall(w.translate(NEW_CAPITALS) if _NEW_CAPITAL.search(w) else w)
            fresh.append(w)
            count.append(len(found))
            pieces += found
        if not fresh:
            return
        unique = list(dict.fromkeys(pieces))
        ids, begin = merge_pieces([p.encode() for p in unique], self.v)
        ids, begin, tokens = ids.tolist(), begin.tolist(), self.v.tokens
        done = {}
        for p, a, b in zip(unique, begin, begin[1:], strict=False):
            own = ids[a:b]
            done[p] = (" ".join(map(str, own)), b - a, " ".join([tokens[x] for x in own]))
        at = 0
        for w, n in zip(fresh, count, strict=True):
            if n == 1:
                self.known[w] = done[pieces[at]]
            else:
                got = [done[p] for p in pieces[at : at + n]]
                self.known[w] = (" ".join([g[0] for g in got]), sum(g[1] for g in got), " ".join([g[2] for g in got]))
            at += n

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, ids joined by blanks, decoded text) of each text."""
        split = [self.words(t) for t in texts]
        known = self.known
        missing = set().union(*split).difference(known)
        if len(known) + len(missing) > self.most:
            known.clear()
            missing = set().union(*split)
        self.learn(missing)
        for words in split:
            got = [known[w] for w in words]
            yield sum([g[1] for g in got]), " ".join([g[0] for g in got if g[1]]), " ".join([g[2] for g in got if g[1]])


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text of token ids, special tokens included; ids outside the vocabulary have none."""
    return " ".join([v.tokens[i] for i in ids if 0 <= i < len(v.tokens) and v.tokens[i]])


def _as_string(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tx.buffers(tx.text_column(b, "text"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; ``path``: the vocabulary file, read on the driver."""
    sent = shared(docs, Vocabulary.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(opened(sent))
        for b in batches:
            raw, offsets = _as_string(b)
            n, ids, decoded = [], [], []
            for i, j in tx.groups(offsets, 2 << 20):
                whole = raw[offsets[i] : offsets[j]].tobytes()
                texts = [whole[offsets[d] - offsets[i] : offsets[d + 1] - offsets[i]].decode() for d in range(i, j)]
                for count, x, y in encoder.encode(texts):
                    n.append(count)
                    ids.append(sha256(x.encode()).hexdigest())
                    decoded.append(sha256(y.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return some.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every row: the operator's real output."""
    sent = shared(docs, Vocabulary.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(opened(sent))
        for b in batches:
            got = list(encoder.encode(tx.text_column(b, "text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[int(x) for x in g[1].split()] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())], ["doc_id", "ids", "decoded"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return some.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """op3: every row of ``documents``."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or vocabulary_path())
