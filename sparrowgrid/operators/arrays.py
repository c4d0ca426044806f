"""Analytics over dense arrays: a frame's pixels, a line's gaps, a step's classes.

Two forms: columns over an array (a whole frame in one row, no shuffle), and plans over
exploded pixels (frame, y, x, v) where sums run over neighbours or frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(sorted_values: Column, k: Column | int) -> Column:
    """The k-th smallest, from 1; of a k below 1 the value 0 (a count of none is reached at once)."""
    k = k if isinstance(k, Column) else F.lit(k)
    return F.when(k < 1, F.lit(0)).otherwise(F.try_element_at(sorted_values, F.least(k, F.size(sorted_values)).cast("int")))


def levels(values: Column) -> dict[str, Column]:
    """The low and high levels of the four percentile rules, each with its own comparison.

    frame: count reaches n / 50 and n - n / 50. crop: count exceeds 2 %, reaches 98 %.
    line: count exceeds the ranks (n - 1) * 2 / 100 and * 98 / 100. ink: count
    reaches 1 %, at least 1.
    """
    s, n = F.sort_array(values), F.size(values)
    part = lambda x, d: F.floor(x / d)
    return {
        "frame_lo": ranked(s, part(n, 50)), "frame_hi": ranked(s, n - part(n, 50)),
        "crop_lo": ranked(s, part(n * 2, 100) + 1), "crop_hi": ranked(s, part(n * 98, 100)),
        "line_lo": ranked(s, part((n - 1) * 2, 100) + 1), "line_hi": ranked(s, part((n - 1) * 98, 100) + 1),
        "ink": ranked(s, F.greatest(F.lit(1), part(n, 100))),
    }


def medians(values: Column) -> dict[str, Column]:
    """The six conventions: sum of both middles, their mean, upper by count, lower by count, upper by index, upper of at most 64."""
    s, n = F.sort_array(values), F.size(values)
    at = lambda k: F.try_element_at(s, (k + 1).cast("int"))  # noqa: E731  from 0
    lower, upper = at(F.floor((n - 1) / 2)), at(F.floor(n / 2))
    first = F.sort_array(F.slice(values, 1, 64))
    return {
        "x2": lower + upper, "mean": (lower + upper) / 2, "upper_count": upper, "lower_count": lower, "upper_index": upper,
        "upper_64": F.try_element_at(first, F.floor(F.size(first) / 2).cast("int") + 1),
    }


def histogram(values: DataFrame, by: list[str]) -> DataFrame:
    return values.groupBy(*by, "v").agg(F.count("*").alias("n"))


def paper_mode(hist: DataFrame, by: list[str], low: int = 64) -> DataFrame:
    """The most frequent value of at least ``low``; the least of equals; 255 if there is none."""
    return hist.groupBy(*by).agg(F.coalesce(F.max_by("v", F.when(F.col("v") >= low, F.struct("n", -F.col("v")))), F.lit(255)).alias("paper"))


def contrast_threshold(paper: Column, ink: Column) -> Column:
    return F.least(F.greatest(F.floor(F.greatest(paper - ink, F.lit(0)) / 12), F.lit(6)), F.lit(18)).cast("int")


def otsu_bins(hist: DataFrame, by: list[str]) -> DataFrame:
    """Otsu's threshold in whole numbers, differences scaled by 1,024; the first maximum, 0 if no split has any variance."""
    order, whole = Window.partitionBy(*by).orderBy("v"), Window.partitionBy(*by)
    x = hist.select(
        *by, "v", F.sum("n").over(order).alias("wb"), F.sum(F.col("v") * F.col("n")).over(order).alias("sb"), F.sum("n").over(whole).alias("total"), F.sum(F.col("v") * F.col("n")).over(whole).alias("s"),
    )
    scaled = F.shiftright(F.abs(F.col("sb") * (F.col("total") - F.col("wb")) - (F.col("s") - F.col("sb")) * F.col("wb")), 10)
    rated = x.where("wb < total").withColumn("variance", F.expr("0L") + F.floor(scaled * scaled / (F.col("wb") * (F.col("total") - F.col("wb")))))
    best = rated.groupBy(*by).agg(F.max_by(F.struct("v", "variance"), F.struct("variance", -F.col("v"))).alias("b"))
    out = hist.select(*by).distinct().join(best, by, "left")
    return out.select(*by, F.when(F.coalesce(F.col("b.variance"), F.lit(0)) > 0, F.col("b.v")).otherwise(0).cast("int").alias("threshold"))


def otsu_sorted(values: Column) -> Column:
    """Otsu's threshold between two neighbours of the sorted values (their middle); the first maximum; of one value itself."""
    # What a step needs of the whole travels in its state: a lambda reads an outer expression anew for each value.
    s = F.sort_array(values)
    first = F.element_at(s, 1).cast("double")
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.lit(0).alias("i"), F.size(values).alias("n"), total.alias("total"), F.lit(0.0).alias("left"), first.alias("before"), F.lit(-1.0).alias("best"), first.alias("t"))

    def step(a: Column, x: Column) -> Column:
        i, n = a["i"], a["n"]
        left = F.when(i > 0, a["left"] + a["before"]).otherwise(a["left"])
        gap = left / i - (a["total"] - left) / (n - i)
        v = i.cast("double") * (n - i) * gap * gap
        better = (i > 0) & (v > a["best"])
        best, t = F.when(better, v).otherwise(a["best"]), F.when(better, (a["before"] + x) * 0.5).otherwise(a["t"])
        return F.struct((i + 1).alias("i"), n.alias("n"), a["total"].alias("total"), left.alias("left"), x.cast("double").alias("before"), best.alias("best"), t.alias("t"))

    return F.aggregate(s, start, step, lambda a: a["t"])


def weighted_median(pairs: Column) -> Column:
    """``pairs``: array of (x, w); the first x, in order, whose weights so far reach half of all."""
    s = F.sort_array(pairs)
    total = F.aggregate(s, F.lit(0.0), lambda a, p: a + p["w"])
    start = F.struct(F.lit(0.0).alias("acc"), F.lit(None).cast("double").alias("x"))
    return F.aggregate(s, start, lambda a, p: F.struct((a["acc"] + p["w"]).alias("acc"), F.when(a["x"].isNull() & (a["acc"] + p["w"] >= total / 2), p["x"]).otherwise(a["x"]).alias("x")), lambda a: a["x"])


def line_fit(points: DataFrame, by: list[str]) -> DataFrame:
    """Least squares of v on u, degree 1; a single u gives a level line through the mean."""
    return points.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.when(F.var_pop("u") > 0, F.regr_slope("v", "u")).otherwise(0.0), 6).alias("slope"),
        F.round(F.when(F.var_pop("u") > 0, F.regr_intercept("v", "u")).otherwise(F.avg("v")), 6).alias("intercept"),
    )


def quadratic_fit(points: DataFrame, by: list[str]) -> DataFrame:
    """Least squares of degree 2 by centred normal equations: v = a + b (u - m) + c (u - m)^2, with m the mean of u."""
    centred = points.withColumn("d", F.col("u") - F.avg("u").over(Window.partitionBy(*by)))
    sums = centred.groupBy(*by).agg(F.avg("u").alias("m"), F.count("*").cast("double").alias("s0"), *[F.sum(F.pow("d", F.lit(k))).alias(f"s{k}") for k in (2, 3, 4)], *[F.sum(F.col("v") * F.pow("d", F.lit(k))).alias(f"t{k}") for k in range(3)])
    det = F.col("s0") * (F.col("s2") * F.col("s4") - F.col("s3") * F.col("s3")) - F.col("s2") * F.col("s2") * F.col("s2")
    a = (F.col("t0") * (F.col("s2") * F.col("s4") - F.col("s3") * F.col("s3")) - F.col("s2") * (F.col("t2") * F.col("s2") - F.col("t1") * F.col("s3"))) / det
    b = (F.col("s0") * (F.col("t1") * F.col("s4") - F.col("s3") * F.col("t2")) + F.col("s2") * (F.col("t0") * F.col("s3") - F.col("t1") * F.col("s2"))) / det
    c = (F.col("s0") * (F.col("s2") * F.col("t2") - F.col("s3") * F.col("t1")) - F.col("s2") * F.col("s2") * F.col("t0")) / det
    return sums.where(det != 0).select(*by, F.round("m", 6).alias("m"), F.round(a, 5).alias("a"), F.round(b, 5).alias("b"), F.round(c, 5).alias("c"))


def over_frames(frames: DataFrame, shape: tuple[int, int], schema: str, f: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], most: int = 1 << 20) -> DataFrame:
    """``f`` of frame numbers and of (n, height, width) pixels gives the columns of ``schema``; no shuffle, about ``most`` pixels at once. Frames of another size have no rows."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    h, w = shape
    step = max(1, most // (h * w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                pixels = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, h, w)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in f(part.column(0).to_numpy(), pixels)], names)

    some = frames.where(F.size("px") == h * w).select(F.col("frame").cast("long").alias("frame"), F.transform("px", lambda v: v.cast("int")).alias("px"))
    return some.mapInArrow(run, schema)


def _by_pixel(frame: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """frame, y, x and values of every pixel."""
    n, h, w = values[0].shape
    y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
    return [np.repeat(frame, h * w), np.tile(y, n), np.tile(x, n), *(v.reshape(-1) for v in values)]


def _bordered(pixels: np.ndarray, radius: int) -> np.ndarray:
    return np.pad(pixels, ((0, 0), (radius, radius), (radius, radius)), mode="edge")


def box_sums(frames: DataFrame, shape: tuple[int, int], radius: int) -> DataFrame:
    """frame, y, x, total: the sum over the square around each pixel, borders replicated; by running sums, whatever the radius."""

    def f(frame: np.ndarray, pixels: np.ndarray) -> list[np.ndarray]:
        c = np.pad(_bordered(pixels.astype(np.int64), radius).cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
        k = 2 * radius + 1
        return _by_pixel(frame, c[:, k:, k:] - c[:, :-k, k:] - c[:, k:, :-k] + c[:, :-k, :-k])

    return over_frames(frames, shape, "frame long, y int, x int, total long", f)


def extremes(frames: DataFrame, shape: tuple[int, int], radius: int) -> DataFrame:
    """frame, y, x, least, most over the square around each pixel, borders replicated; rows first, then columns."""

    def f(frame: np.ndarray, pixels: np.ndarray) -> list[np.ndarray]:
        out = []
        for how in (np.minimum, np.maximum):
            v = _bordered(pixels.astype(np.int32), radius)
            for axis in (1, 2):
                n = v.shape[axis] - 2 * radius
                v = reduce(how, [np.take(v, range(d, d + n), axis) for d in range(2 * radius + 1)])
            out.append(v)
        return _by_pixel(frame, *out)

    return over_frames(frames, shape, "frame long, y int, x int, least int, most int", f)


def _shares(n: int, parts: int) -> np.ndarray:
    """parts x n: how much of each of n pixels lies in each of ``parts`` equal stretches, in units of 1 / parts."""
    begin, end = np.arange(n) * parts, np.arange(1, n + 1) * parts
    low, high = np.arange(parts) * n, np.arange(1, parts + 1) * n
    return np.clip(np.minimum(end, high[:, None]) - np.maximum(begin, low[:, None]), 0, None)


def area_scaled(frames: DataFrame, shape: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """frame, y, x, area: frames at any ``size`` (rows, columns), each pixel the mean of the area it covers, borders by their share; whole part.

    The shares are separable, so a frame is two small products of whole numbers.
    """
    (h, w), (rows, columns) = shape, size
    down, across = _shares(h, rows), _shares(w, columns)

    def f(frame: np.ndarray, pixels: np.ndarray) -> list[np.ndarray]:
        return _by_pixel(frame, ((down @ pixels.astype(np.int64) @ across.T) // (h * w)).astype(np.int32))

    return over_frames(frames, shape, "frame long, y int, x int, area int", f)


def binned(pixels: DataFrame, factor: int) -> DataFrame:
    """Blocks of factor x factor pixels: their average (whole part) and their greatest."""
    block = pixels.groupBy("frame", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x"))
    return block.agg(F.floor(F.sum("v") / F.count("*")).cast("int").alias("area"), F.max("v").alias("most"))


def rotated_crop(pixels: DataFrame, side: int, crop: int) -> DataFrame:
    """A quarter turn clockwise, then the middle ``crop`` x ``crop`` pixels."""
    margin = (side - crop) // 2
    turned = pixels.select("frame", F.col("x").alias("y"), (F.lit(side - 1) - F.col("y")).alias("x"), "v")
    inside = turned.where((F.col("y") >= margin) & (F.col("y") < margin + crop) & (F.col("x") >= margin) & (F.col("x") < margin + crop))
    return inside.select("frame", (F.col("y") - margin).cast("int").alias("y"), (F.col("x") - margin).cast("int").alias("x"), "v")


def sharpness(frames: DataFrame, shape: tuple[int, int], least: int, angles: list[float]) -> DataFrame:
    """frame, angle, sharpness: the sum of squared counts of the pixels of at least ``least``, projected onto the normal; frames without one have no rows."""

    def f(frame: np.ndarray, pixels: np.ndarray) -> list[np.ndarray]:
        at, y, x = np.nonzero(pixels >= least)
        rows: list[np.ndarray] = []
        has, first = np.unique(at, return_index=True)
        for angle in angles if len(has) else ():
            t = np.radians(angle)
            p = -x * np.sin(t) + y * np.cos(t)
            bins = np.floor(np.round(p - np.minimum.reduceat(p, first)[np.searchsorted(has, at)], 6)).astype(np.int64)
            key, n = np.unique(at * (bins.max() + 1) + bins, return_counts=True)
            rows.append(np.bincount(key // (bins.max() + 1), weights=n * n, minlength=len(frame))[has].astype(np.int64))
        angle = np.repeat(np.array(angles, dtype=float), len(has)) if rows else np.zeros(0)
        return [np.tile(frame[has], len(rows)), angle, np.concatenate(rows) if rows else np.zeros(0, np.int64)]

    return over_frames(frames, shape, "frame long, angle double, sharpness long", f)


def best_angle(rated: DataFrame, larger: bool) -> DataFrame:
    """The sharpest angle; of equals the larger (coarse search) or the smaller, which a rising search meets first (fine search)."""
    tie = F.col("angle") if larger else -F.col("angle")
    return rated.groupBy("frame").agg(F.max_by("angle", F.struct("sharpness", tie)).alias("angle"), F.max("sharpness").alias("sharpness"))


def label_batch(mask: np.ndarray, eight: bool) -> np.ndarray:
    """Component labels of many masks (n, h, w) at once: the least pixel index of each component, -1 outside."""
    n, h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(1, h, w), h * w)
    shifts = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if eight else [])
    while True:
        pad = np.full((n, h + 2, w + 2), h * w)
        pad[:, 1:-1, 1:-1] = label
        new = label
        for dy, dx in shifts:
            new = np.minimum(new, pad[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w])
        new = np.where(mask, new, h * w)
        flat = np.concatenate((new.reshape(n, -1), np.full((n, 1), h * w)), axis=1)
        new = np.take_along_axis(flat, new.reshape(n, -1), axis=1).reshape(n, h, w)  # follow labels of labels
        if (new == label).all():
            return np.where(mask, label, -1)
        label = new


def components(frames: DataFrame, side: int, threshold: int, eight: bool = False, least: int = 1) -> DataFrame:
    """``frames`` (frame, px) -> frame, label, area and box of each component of pixels of at least ``threshold``."""
    schema = "frame long, label int, area int, x1 int, y1 int, x2 int, y2 int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, side, side)
            label = label_batch(flat >= threshold, eight)
            f, y, x = np.nonzero(label >= 0)
            key, back = np.unique(f.astype(np.int64) * side * side + label[f, y, x], return_inverse=True)
            area = np.bincount(back, minlength=len(key))
            box = [np.full(len(key), side), np.full(len(key), side), np.full(len(key), -1), np.full(len(key), -1)]
            np.minimum.at(box[0], back, x)
            np.minimum.at(box[1], back, y)
            np.maximum.at(box[2], back, x)
            np.maximum.at(box[3], back, y)
            keep = area >= least
            columns = [b.column(0).take(pa.array(key[keep] // (side * side)))] + [pa.array(c[keep].astype(np.int32)) for c in (key % (side * side), area, *box)]
            yield pa.RecordBatch.from_arrays(columns, ["frame", "label", "area", "x1", "y1", "x2", "y2"])

    return frames.select(F.col("frame").cast("long").alias("frame"), F.transform("px", lambda v: v.cast("int")).alias("px")).mapInArrow(run, schema)


def gaussian_q15(sigma: float, radius: int) -> list[int]:
    """A kernel in units of 1 / 32768 that sums to exactly 32768, the middle corrected."""
    raw = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    out = np.floor(raw / raw.sum() * 32768 + 0.5).astype(int)
    out[radius] += 32768 - out.sum()
    return out.tolist()


def stretch(v: Column, low: Column, high: Column) -> Column:
    """low..high mapped to 0..255; a span under 24 is taken as 0..255."""
    narrow = high - low < 24
    lo, hi = F.when(narrow, 0).otherwise(low), F.when(narrow, 255).otherwise(high)
    return F.least(F.greatest(F.floor((v - lo) * 255 / (hi - lo)), F.lit(0)), F.lit(255)).cast("int")


def stretch_lut(low: Column, high: Column) -> Column:
    """The 256 entries of ``stretch``."""
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: stretch(v, low, high))


def bilinear(frames: DataFrame, shape: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """frame, y, x, v: frames sampled at ``size`` pixel centres in 1 / 65536, halves up."""

    def places(n: int, of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = np.clip((2 * np.arange(n, dtype=np.int64) + 1) * of * 32768 // n - 32768, 0, (of - 1) << 16)
        return q >> 16, np.minimum((q >> 16) + 1, of - 1), q & 0xFFFF

    (ya, yb, yw), (xa, xb, xw) = places(size[0], shape[0]), places(size[1], shape[1])

    def f(frame: np.ndarray, pixels: np.ndarray) -> list[np.ndarray]:
        px = pixels.astype(np.int64)
        across = px[:, :, xa] * (65536 - xw) + px[:, :, xb] * xw
        value = across[:, ya] * (65536 - yw)[:, None] + across[:, yb] * yw[:, None]
        return _by_pixel(frame, (value + (1 << 31) >> 32).astype(np.int32))

    return over_frames(frames, shape, "frame long, y int, x int, v int", f)
