"""Word detection in gray frames: blobs of blurred ink, cut at wide gaps.

A frame is one row (at most 480 x 640 pixels), so detection is a map over rows: no
shuffle, and memory bounded by the frame. Arithmetic is in whole numbers where the
rules are; the kernels' exponential comes from its formula rather than a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import label_batch
from .decode import PAD_CLIPPED, PUNCTUATION, SPLIT

ONE = 32768


@dataclass
class Config:
    """Percentages of the median character height unless named otherwise."""

    pad_x: int = 12
    pad_y: int = 15
    merge_x: int = 30
    merge_y: int = 12
    word_threshold: int = 35  # of the text line's peak
    split_gap: int = 45
    split_ratio_x10: int = 18  # of the blob's median gap
    otsu_cap_x10: int = 20  # of the absolute gap
    punctuation_height: int = 55
    punctuation_parts: int = 2
    border: int = 1
    decimate: int = 4
    radius: int = 31
    least_area: int = 15
    most_radius: int = 96
    skew: bool = True
    gap_split: bool = True
    drop_rules: bool = True
    drop_truncated: bool = False


def kernel(sigma_q12: int, radius: int) -> np.ndarray:
    """A Gaussian in units of 1 / 32768 that sums to one, the middle corrected."""
    x = np.arange(-radius, radius + 1, dtype=np.int64)
    t = np.minimum((x * x * 8589934592 + sigma_q12 * sigma_q12 // 2) // (sigma_q12 * sigma_q12), 4608)
    raw = np.floor(np.exp(-t / 1024) * ONE + 0.5).astype(np.int64)
    out = (raw * ONE + raw.sum() // 2) // raw.sum()
    out[radius] += ONE - out.sum()
    return out


def weighed(image: np.ndarray, taps: np.ndarray, axis: int, shear: np.ndarray | None = None) -> np.ndarray:
    """Sums of neighbours along an axis, borders replicated; ``shear`` moves each tap by rows."""
    h, w = image.shape
    radius = len(taps) // 2
    out = np.zeros((h, w), dtype=np.int64)
    for i, weight in enumerate(taps.tolist()):
        ys, xs = np.arange(h), np.arange(w)
        if axis:
            xs = np.clip(xs + i - radius, 0, w - 1)
            if shear is not None:
                ys = np.clip(ys + shear[i], 0, h - 1)
        else:
            ys = np.clip(ys + i - radius, 0, h - 1)
        out += image[ys][:, xs] * weight
    return out


def blocks(image: np.ndarray, size: int, how: str) -> np.ndarray:
    """Blocks of size x size pixels, cut at the borders: whole mean or maximum."""
    h, w = image.shape
    rows, columns = np.arange(0, h, size), np.arange(0, w, size)
    if how == "max":
        return np.maximum.reduceat(np.maximum.reduceat(image, rows, axis=0), columns, axis=1)
    sums = np.add.reduceat(np.add.reduceat(image.astype(np.int64), rows, axis=0), columns, axis=1)
    return sums // (np.diff(np.append(rows, h))[:, None] * np.diff(np.append(columns, w))[None, :])


def contrast_of(gray: np.ndarray) -> tuple[int, int]:
    """Contrast between paper and ink, and the threshold below the background."""
    hist = np.bincount(gray.ravel(), minlength=256)
    paper = 64 + int(hist[64:].argmax()) if hist[64:].any() else 255
    ink = int(np.searchsorted(np.cumsum(hist), max(1, gray.size // 100)))
    contrast = max(0, paper - ink)
    return contrast, min(18, max(6, contrast // 12))


def ink_mask(gray: np.ndarray, radius: int, threshold: int, c: Config) -> np.ndarray:
    """Pixels darker than the local background, which is blurred on a coarse grid and spread bilinearly."""
    h, w = gray.shape
    small = blocks(gray, c.decimate, "mean")
    r = min(max(-(-radius // c.decimate), 2), c.most_radius)
    taps = kernel(max(4096, r * 4096 // 2), r)
    small = np.minimum((weighed((weighed(small, taps, 1) + 64) >> 7, taps, 0) + (1 << 14)) >> 15 >> 8, 255)

    def spread(n: int, grid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((2 * np.arange(n, dtype=np.int64) - (c.decimate - 1)) * ONE // c.decimate, 0, (grid - 1) << 16)
        return at >> 16, np.minimum((at >> 16) + 1, grid - 1), at & 0xFFFF

    y0, y1, wy = spread(h, small.shape[0])
    x0, x1, wx = spread(w, small.shape[1])
    across = small[:, x0] * (65536 - wx) + small[:, x1] * wx
    background = (across[y0] * (65536 - wy)[:, None] + across[y1] * wy[:, None]) >> 16
    level = threshold << 16
    return (background > level) & ((gray.astype(np.int64) << 16) < background - level)


def parts(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(label, area, x1, y1, x2, y2) of each 4-connected part of at least ``least`` pixels, by first pixel; and the label image."""
    label = label_batch(mask[None], False)[0]
    y, x = np.nonzero(label >= 0)
    names, back = np.unique(label[y, x], return_inverse=True)
    table = np.zeros((len(names), 6), dtype=np.int64)
    table[:, 0], table[:, 1] = names, np.bincount(back, minlength=len(names))
    table[:, 2:4] = 1 << 30
    np.minimum.at(table[:, 2], back, x)
    np.minimum.at(table[:, 3], back, y)
    np.maximum.at(table[:, 4], back, x)
    np.maximum.at(table[:, 5], back, y)
    return table[table[:, 1] >= least], label


def median_x2(heights: np.ndarray) -> int:
    s = np.sort(heights)
    return int(s[(len(s) - 1) // 2] + s[len(s) // 2]) if len(s) else 0


def skew_q12(chars: np.ndarray, height: int) -> int:
    """Median slope between characters and their right neighbours, in 4096ths; 0 for fewer than 8 pairs."""
    if len(chars) < 8:
        return 0
    cx, cy = (chars[:, 2] + chars[:, 4]) >> 1, (chars[:, 3] + chars[:, 5]) >> 1
    order = np.lexsort((chars[:, 3], cx))
    cx, cy = cx[order], cy[order]
    tall, bins = max(2, 6 * height // 10), []
    for i in range(0, len(cx), 1 + len(cx) // 1200 if len(cx) > 1200 else 1):
        j = slice(np.searchsorted(cx, cx[i], "right"), np.searchsorted(cx, cx[i] + 3 * height, "right"))
        near = np.flatnonzero(np.abs(cy[j] - cy[i]) <= tall)
        if len(near):
            k = j.start + int(near[0])
            slope = int((int(cy[k]) - int(cy[i])) * 4096 / (int(cx[k]) - int(cx[i])))
            at = int((slope + (4 if slope >= 0 else -4)) / 8)
            if abs(at) <= 96:
                bins.append(at)
    if len(bins) < 8:
        return 0
    slope = min(737, max(-737, sorted(bins)[len(bins) // 2] * 8))
    return slope if abs(slope) >= 84 else 0


def word_mask(ink: np.ndarray, height_x2: int, slope: int, c: Config) -> np.ndarray:
    """Ink blurred along the text line, cut at a share of the line's own peak."""
    sx = max(4096, (height_x2 * max(1, c.merge_x) * 2048 + 50) // 100)
    sy = max(2458, (height_x2 * max(1, c.merge_y) * 2048 + 50) // 100)
    rx, ry = max(3, (3 * sx + 4095) // 4096), max(2, (3 * sy + 4095) // 4096)
    rx, ry = min(rx, c.most_radius), min(ry, c.most_radius)
    moved = slope * np.arange(-rx, rx + 1)
    shear = np.trunc((moved + np.where(moved >= 0, 2048, -2048)) / 4096).astype(int)
    across = np.minimum(weighed(ink.astype(np.int64), kernel(sx, rx), 1, shear), ONE)
    value = np.minimum((weighed(across, kernel(sy, ry), 0) + (1 << 14)) >> 15, ONE) >> 7
    peak = value.max(axis=1)
    if not peak.max():
        return np.zeros(ink.shape, dtype=bool)
    reach = ry + max(1, height_x2 // 4)
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(peak, reach), 2 * reach + 1).max(axis=1)
    return value * 100 > (np.maximum(wide, peak.max() // 4) * max(1, c.word_threshold))[:, None]


def otsu(values: list[int]) -> int:
    """Otsu's threshold over whole numbers of 0..255, differences scaled by 1024, first maximum."""
    hist = np.bincount(np.clip(np.array(values, dtype=int), 0, 255), minlength=256) if values else np.zeros(256, int)
    total, whole = int(hist.sum()), int((np.arange(256) * hist).sum())
    best, out, wb, sb = 0, 0, 0, 0
    for t in range(256):
        wb += int(hist[t])
        sb += t * int(hist[t])
        if wb and total > wb:
            scaled = abs(sb * (total - wb) - (whole - sb) * wb) >> 10
            variance = scaled * scaled // (wb * (total - wb))
            if variance > best:
                best, out = variance, t
    return out


BOX = "ink_x1 ink_y1 ink_x2 ink_y2 x1 y1 x2 y2 baseline area chars flags".split()


def detect_words(gray: np.ndarray, c: Config | None = None) -> tuple[list[dict], dict]:
    """Boxes of a frame in reading order, and what was measured on the way."""
    c = c or Config()
    h, w = gray.shape
    contrast, threshold = contrast_of(gray)
    radius = c.radius
    ink = ink_mask(gray, radius, threshold, c)
    chars, label = parts(ink, c.least_area)
    height_x2 = median_x2(chars[:, 5] - chars[:, 3] + 1)
    if height_x2:  # a window that suits the text, if the first did not
        wanted = min(max(22 * max(1, height_x2 // 2) // 10, 16), c.decimate * c.most_radius)
        if abs(wanted - radius) > 8:
            radius = wanted
            ink = ink_mask(gray, radius, threshold, c)
            chars, label = parts(ink, c.least_area)
            height_x2 = median_x2(chars[:, 5] - chars[:, 3] + 1)
    seen = {"contrast": contrast, "threshold": threshold, "radius": radius, "height_x2": height_x2, "rules": 0, "slope": 0}
    if not height_x2:
        return [], seen
    height = max(1, height_x2 // 2)
    if c.drop_rules:
        rule = (chars[:, 5] - chars[:, 3] + 1 > 4 * height) | (chars[:, 4] - chars[:, 2] + 1 > max(8 * height, 8 * w // 10))
        seen["rules"] = int(rule.sum())
        chars = chars[~rule]
    ink = np.isin(label, chars[:, 0])  # specks and rules erased
    if not len(chars):
        return [], seen
    seen["slope"] = slope = skew_q12(chars, height) if c.skew else 0
    small = min(max(height // 8, 1), 4)
    mask = word_mask(blocks(ink, small, "max") if small > 1 else ink, max(2, height_x2 // small), slope, c)
    blobs, _ = parts(mask, max(3, max(12, 3 * height_x2 * height_x2 // 40) // (small * small)))
    cx, cy = (chars[:, 2] + chars[:, 4]) >> 1, (chars[:, 3] + chars[:, 5]) >> 1
    owner = np.full(len(chars), -1)
    for k in range(len(blobs) - 1, -1, -1):  # the first blob wins
        _, _, x1, y1, x2, y2 = blobs[k]
        owner[(cx >= x1 * small) & (cx <= x2 * small + small - 1) & (cy >= y1 * small) & (cy <= y2 * small + small - 1)] = k
    runs = [chars[owner == k][np.argsort(chars[owner == k][:, 2], kind="stable")] for k in range(len(blobs))]
    gaps = [(r[1:, 2] - r[:-1, 4] - 1).tolist() for r in runs]
    absolute = max(2, c.split_gap * height // 100)
    cut_at = max(absolute, min(otsu([g for own in gaps for g in own]) if c.gap_split else 255, absolute * c.otsu_cap_x10 // 10))
    boxes = []
    for run, own in zip(runs, gaps, strict=True):
        if not len(run):
            continue
        middle = sorted(min(255, max(0, g)) for g in own)[-(-len(own) // 2) - 1] if len(run) > 2 else 0
        relative = max(1, middle * c.split_ratio_x10 // 10)
        cuts = [i + 1 for i, g in enumerate(own) if c.gap_split and g >= cut_at and g >= relative]
        for a, b in zip([0, *cuts], [*cuts, len(run)], strict=True):
            boxes.append(_box(run[a:b], bool(cuts), h, w, height, c))
    boxes = [b for b in boxes if not (c.drop_truncated and b["flags"] & 15)]
    return _read(boxes, height), seen


def _box(own: np.ndarray, split: bool, h: int, w: int, height: int, c: Config) -> dict:
    x1, y1, x2, y2 = int(own[:, 2].min()), int(own[:, 3].min()), int(own[:, 4].max()), int(own[:, 5].max())
    px, py = max(2, (c.pad_x * height + 50) // 100), max(2, (c.pad_y * height + 50) // 100)
    bottoms = np.sort(own[:64, 5])
    flags = (x1 <= c.border) | (x2 >= w - 1 - c.border) << 1 | (y1 <= c.border) << 2 | (y2 >= h - 1 - c.border) << 3
    if not flags and (x1 - px < 0 or y1 - py < 0 or x2 + px > w - 1 or y2 + py > h - 1):
        flags |= PAD_CLIPPED
    flags |= SPLIT * split
    if len(own) <= c.punctuation_parts and y2 - y1 + 1 < c.punctuation_height * height // 100:
        flags |= PUNCTUATION
    values = (x1, y1, x2, y2, max(0, x1 - px), max(0, y1 - py), min(w - 1, x2 + px), min(h - 1, y2 + py), min(y2, max(y1, int(bottoms[len(bottoms) // 2]))), int(own[:, 1].sum()), len(own), int(flags))
    return dict(zip(BOX, values, strict=True))


def _read(boxes: list[dict], height: int) -> list[dict]:
    """Lines by their first box's centre, then by the left edge."""
    middle = lambda b: (b["ink_y1"] + b["ink_y2"]) >> 1
    line, first = 0, None
    for b in sorted(boxes, key=lambda b: (middle(b), b["ink_x1"])):
        if first is not None and middle(b) - first > max(2, 7 * height // 10):
            line, first = line + 1, None
        first = middle(b) if first is None else first
        b["line"] = line
    return sorted(boxes, key=lambda b: (b["line"], b["ink_x1"]))


SCHEMA = "frame long, page int, box int, line int, " + ", ".join(f"{n} int" for n in BOX)


def detect(frames: DataFrame, config: Config | None = None, most_w: int = 480, most_h: int = 640) -> DataFrame:
    """``frames`` (frame, page, w, h, pixels binary) -> boxes; frames whose size is out of range or does not fit their pixels have none. Without a page column it is page 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["frame", "page", "box", "line", *BOX]
        for b in batches:
            rows = []
            for frame, page, w, h, px in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if px is None or not w or not h or not (0 < w <= most_w and 0 < h <= most_h) or len(px) != w * h:
                    continue
                found, _ = detect_words(np.frombuffer(px, dtype=np.uint8).reshape(h, w), config)
                rows += [(frame, page, k, x["line"], *(x[n] for n in BOX)) for k, x in enumerate(found)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if n == "frame" else pa.int32()) for n, v in zip(names, columns, strict=True)], names)

    page = F.col("page") if "page" in frames.columns else F.lit(0)
    return frames.select(F.col("frame").cast("long").alias("frame"), page.cast("int").alias("page"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), "pixels").mapInArrow(run, SCHEMA)


LINES, LETTERS = 24, 40


def drawn(texts: DataFrame, width: int = 480) -> DataFrame:
    """(frame, page, w, h, pixels, words): whole texts (frame, text) as pages of dark blocks, one for each letter; for tests.

    A text takes as many pages as it needs (one if it is empty); a word of more than
    LETTERS letters is drawn as several, which ``words`` counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["frame", "page", "w", "h", "pixels", "words"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
        for b in batches:
            for k, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows: list[tuple] = []
                for n, page in enumerate(pages_of(t or "", width)):
                    rows.append((k, n, width, *page))
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return texts.mapInArrow(run, "frame long, page int, w int, h int, pixels binary, words int")


def pages_of(text: str, width: int) -> Iterator[tuple[int, bytes, int]]:
    """Height, pixels and number of words of each page: 9 x 6 blocks two pixels apart, words ten apart, lines 26 apart."""
    lines: list[list[tuple[int, int]]] = [[]]
    at, most = 12, min(LETTERS, (width - 24) // 8)
    for word in (w[k : k + most] for w in text.split() for k in range(0, len(w), most)):
        if at + 8 * len(word) > width - 12:
            at = 12
            lines.append([])
        if len(lines) > LINES:
            yield _painted(lines[:LINES], width)
            lines = [[]]
        lines[-1].append((at, len(word)))
        at += 8 * len(word) + 10
    yield _painted(lines, width)


def _painted(lines: list[list[tuple[int, int]]], width: int) -> tuple[int, bytes, int]:
    height = 26 * (len(lines) - 1) + 40
    page = np.full((height, width), 215, dtype=np.uint8)
    for n, words in enumerate(lines):
        for at, letters in words:
            for k in range(letters):
                page[14 + 26 * n : 23 + 26 * n, at + 8 * k : at + 8 * k + 6] = 40
    return height, page.tobytes(), sum(map(len, lines))


def draw(text: str, width: int) -> tuple[int, bytes, int]:
    """The first page of a text."""
    return next(pages_of(text, width))
