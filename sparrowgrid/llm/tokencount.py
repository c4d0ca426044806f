"""Token counts: batch encoding by the tokenizers library in Arrow functions that return lengths only.

Texts are cut at safe boundaries into short pieces, the pieces of a group of texts
that the task has not met yet are encoded in batches of about equal bytes, and a
text's count is the sum of its pieces' counts. Pieces repeat, so most are counted
from a bounded cache. A text longer than ``part_bytes`` is handled in parts, which
are cut at safe boundaries too, so memory follows the part and not the text.

A boundary is safe if the library never makes a token across it and reads both
sides as it would read them together. For byte-level files with the usual pattern
that is where a blank or line feed follows what is no white space: each match
begins before white space or after it, and none looks back; the same holds between
a letter and one of ``.,;:!?``. Added tokens are found in the raw text first; they
may hold neither white space nor these marks, nor strip what stands beside them. For a file that does not meet these conditions (``splits`` says so) texts are
encoded whole.

Special strings inside texts are special tokens, the library's default; nothing is
added, padded or truncated.

Edge cases: a null text has no bytes and no tokens, as an empty one; a text without
blanks is one piece and is encoded whole; repeated rows are counted alike; null ids
are kept; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import opened, shared
from .textops import text_column

#: A word before a blank or mark; else white space, what is none, and again if the white space between begins with neither blank nor line feed.
PIECE = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+(?=[ \n.,;:!?])|\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")


def splits(spec: dict) -> bool:
    """Whether texts may be cut at ``BOUNDARY`` for a tokenizers file."""
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
    whole = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"[\s.,;:!?]", t["content"]) for t in added)
    return bool(plain and whole and not spec["model"].get("dropout"))


class Counter:
    """Counts tokens; keeps the counts of at most ``most`` short pieces."""

    def __init__(self, source: str, part_bytes: int = 1 << 20, batch_bytes: int = 1 << 18, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.splits = splits(json.loads(source))
        self.part, self.batch, self.most = part_bytes, batch_bytes, most
        self.known: dict[str, int] = {}

    def parts(self, text: str) -> Iterator[str]:
        """``text`` in parts of about ``part`` characters, cut at safe boundaries."""
        at = 0
        while len(text) - at > self.part and self.splits:
            found = BOUNDARY.search(text, at + self.part)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def lengths(self, pieces: Iterable[str]) -> Iterator[tuple[str, int]]:
        """The number of tokens of each piece, encoded in batches of about ``batch`` bytes."""
        batch, size = [], 0
        for p in pieces:
            batch.append(p)
            size += len(p) + 16
            if size >= self.batch:
                yield from zip(batch, map(len, self.library.encode_batch_fast(batch, add_special_tokens=False)), strict=True)
                batch, size = [], 0
        if batch:
            yield from zip(batch, map(len, self.library.encode_batch_fast(batch, add_special_tokens=False)), strict=True)

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        out, group, size = [0] * len(texts), [], 0
        for k, text in enumerate(texts):
            for part in self.parts(text):
                group.append((k, part))
                size += len(part)
                if size >= self.part:
                    self._add(group, out)
                    group, size = [], 0
        self._add(group, out)
        return out

    def _add(self, group: list[tuple[int, str]], out: list[int]) -> None:
        if not self.splits:
            order = sorted(range(len(group)), key=lambda i: len(group[i][1]))  # equal lengths together
            for i, (_, n) in zip(order, self.lengths(group[i][1] for i in order), strict=True):
                out[group[i][0]] += n
            return
        pieces = [PIECE.findall(part) for _, part in group]
        fresh = set().union(*pieces).difference(self.known)
        if len(self.known) + len(fresh) > self.most:
            self.known.clear()
            fresh = set().union(*pieces)
        self.known.update(self.lengths(sorted(fresh, key=len)))
        get = self.known.__getitem__
        for (k, _), own in zip(group, pieces, strict=True):
            out[k] += sum(map(get, own))
        for p in [p for p in fresh if len(p) > 256]:
            del self.known[p]


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row; ``path``: the tokenizers file, read on the driver."""
    with open(path, encoding="utf-8") as f:
        sent = shared(docs, Source(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = opened(sent).counter()
        for b in batches:
            texts, n = text_column(b, "text"), []
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(texts):  # strings of a few megabytes at once
                to, total = at + 1, int(size[at])
                while to < len(texts) and total + size[to] <= 4 << 20:
                    total += int(size[to])
                    to += 1
                n += counter.counts(texts.slice(at, to - at).to_pylist())
                at = to
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return some.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class Source:
    """A tokenizers file; a worker opens it once for all its tasks."""

    def __init__(self, text: str):
        self.text = text

    def counter(self) -> Counter:
        if not hasattr(self, "made"):
            self.made = Counter(self.text)
        return self.made


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """op12: every row of ``documents``."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or vocabulary_path())
