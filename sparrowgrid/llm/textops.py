"""Byte-level helpers shared by the text operators.

Texts stay in the UTF-8 buffers that Arrow hands over; numpy works on whole
groups of documents at once. A group holds at most ``limit`` bytes, except that
one longer document forms a group of its own, so memory is bounded by the
longest document rather than by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
SPACE = 0x20

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")] = True
_IS_WORD[0x80:] = True

#: A-Z to lower case, every other ASCII byte that is no letter, digit or "_" to a blank.
WORD_LUT = np.arange(256, dtype=np.uint8)
WORD_LUT[ord("A") : ord("Z") + 1] += 32
WORD_LUT[~_IS_WORD] = SPACE

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named column (the last of that name) as strings, nulls as empty texts."""
    at = batch.schema.get_all_field_indices(name)[-1]
    column = batch.column(at)
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose bytes sum to at most ``limit`` (one document at least)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n, i + 8192)
        yield i, j
        i = j


def lowered(raw: np.ndarray, lut: np.ndarray = WORD_LUT) -> np.ndarray:
    """A mapped copy; capitals of the Latin-1 supplement become small ones too."""
    out = lut[raw]
    if len(raw) > 1:
        lead = raw[:-1] == 0xC3
        tail = raw[1:]
        hit = np.flatnonzero(lead & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)) + 1
        out[hit] += 0x20
    return out


def padded(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents i..j-1, lower-cased, each between blanks; and where each begins (and the end)."""
    part = lowered(raw[offsets[i] : offsets[j]])
    starts = offsets[i : j + 1] - offsets[i]
    out = np.full(len(part) + (j - i) + 1, SPACE, dtype=np.uint8)
    lengths = np.diff(starts)
    out[np.arange(len(part)) + np.repeat(np.arange(1, j - i + 1), lengths)] = part
    return out, starts + np.arange(j - i + 1)


def word_spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of bytes other than blanks; the text begins and ends with a blank."""
    solid = text != SPACE
    edge = np.diff(solid.astype(np.int8))
    return np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1


def token_spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_spans``, and general punctuation and no-break blanks part words too; letters of scripts without blanks (U+3000 to U+9FFF) are a word each."""
    solid = text != SPACE
    for lead, second, length in ((0xE2, (0x80,), 3), (0xC2, (0xA0, 0xAB, 0xBB), 2)):
        at = np.flatnonzero((text[:-1] == lead) & np.isin(text[1:], second))
        for k in range(length):
            solid[at + k] = False
    lone = np.flatnonzero((text >= 0xE3) & (text <= 0xE9))
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    if len(lone):
        start[lone] = True
        after = lone + 3
        start[after[after < len(text)]] |= solid[after[after < len(text)]]
    edge = start.copy()
    edge[1:] |= solid[:-1] & ~solid[1:]  # a word ends where none stands, or where the next begins
    edge[0] = False
    begins = np.flatnonzero(start)
    ends = np.flatnonzero(edge[1:] & solid[:-1]) + 1
    return begins, ends


def powers(n: int, base: np.uint64 = _MULT) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalising mix, so that all bits of a product hash can be used."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal bytes wherever they stand."""
    n = len(text)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(n)[:n], out=total[1:])
    # Dividing each sum by the power of its place makes it independent of the place.
    return mixed((total[ends] - total[begins]) * powers(n, _INVERSE)[begins])


def per_document(word_begins: np.ndarray, doc_begins: np.ndarray) -> np.ndarray:
    """Index of the first word of each document, and the number of words at the end."""
    return np.searchsorted(word_begins, doc_begins)


def keep_rows(batch: pa.RecordBatch, mask: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(mask, pa.bool_()))
