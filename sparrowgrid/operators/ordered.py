"""Ordered state per device: histories, day bands, taps, drags, contacts.

Rows carry a device (``key``) and an order within it. Sequential rules are folds over
one device's rows, so the work is spread over devices; nothing is ordered globally.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def history(pushes: DataFrame, most: int | None = 48) -> DataFrame:
    """``pushes`` (key, seq, en, bn, ocr, src, day) -> kept entries with their place ``pos`` from 1, oldest first.

    Entries without word and gloss are ignored. A push that repeats the last pair
    only renews its OCR text; source and day stay those of the first. The newest
    ``most`` entries remain.
    """
    order = Window.partitionBy("key").orderBy("seq")
    rows = pushes.where("en <> '' or bn <> ''")
    new = ~(F.lag("en").over(order).eqNullSafe(F.col("en")) & F.lag("bn").over(order).eqNullSafe(F.col("bn")))
    marked = rows.withColumn("island", F.sum(new.cast("int")).over(order))
    entries = marked.groupBy("key", "island").agg(
        F.min("seq").alias("seq"), F.first("en").alias("en"), F.first("bn").alias("bn"), F.max_by("ocr", "seq").alias("ocr"), F.min_by("src", "seq").alias("src"), F.min_by("day", "seq").alias("day")
    )
    if most is not None:
        entries = entries.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("island")))).where(F.col("__n") <= most)
    return entries.select("key", "seq", "en", "bn", "ocr", "src", "day", F.row_number().over(Window.partitionBy("key").orderBy("island")).alias("pos"))


def remove(entries: DataFrame, removed: DataFrame) -> DataFrame:
    """Entries without those at (key, pos) of ``removed``; later ones move up."""
    left = entries.join(removed.select("key", "pos"), ["key", "pos"], "left_anti")
    return left.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("seq")))


def day_bands(entries: DataFrame) -> DataFrame:
    """(key, item, band, pos, day): entries in order with a heading wherever the day changes."""
    order = Window.partitionBy("key").orderBy("pos")
    change = F.when(F.lag("day").over(order).eqNullSafe(F.col("day")) & F.lag("pos").over(order).isNotNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))
    rows = entries.withColumn("__bands", change).select("key", "pos", "day", F.explode("__bands").alias("band"))
    return rows.select("key", F.row_number().over(Window.partitionBy("key").orderBy("pos", F.desc("band"))).alias("item"), "band", F.when(~F.col("band"), F.col("pos")).alias("pos"), "day")


def page(items: DataFrame, budget: int, band_height: int, row_height: int, top: int = 1) -> DataFrame:
    """Items from ``top`` that fit the height; a heading left last is dropped."""
    height = F.when(F.col("band"), band_height).otherwise(row_height)
    order = Window.partitionBy("key").orderBy("item")
    fit = items.where(F.col("item") >= top).withColumn("used", F.sum(height).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)
    last = F.lead("item").over(order).isNull()
    return fit.withColumn("__stray", last & F.col("band")).where("not __stray").drop("__stray")


def fold_rows(rows: DataFrame, order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple], schema: str) -> DataFrame:
    """Folds each device's rows in order: ``start`` gives its state, ``step`` takes state and row to a result row.

    ``rows`` has the device as its first column. Rows stream through sorted, so a task
    holds one batch and one device's state, however many rows the device has.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    types = [f.dataType for f in StructType.fromDDL(schema).fields]
    key = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, begun = None, None, False
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or r[0] != current:
                    state, current, begun = start(), r[0], True
                out.append(step(state, r))
            values = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, to_arrow_type(t)) for v, t in zip(values, types, strict=True)], names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class Contact:
    """Touch debouncer: +2 for a valid sample, -1 for an empty one, within 0..8; down from 4, up at 2 or less.

    Samples closer than 8 ms to the last one used are passed over. The press point is
    the median of the first three valid samples, the mean of two, else the last one;
    samples count from the last one that left the contact up. A contact held for over
    5 s is let go.
    """

    POLL_MS, STUCK_MS = 8, 5000

    def __init__(self):
        self.last_poll = self.down_since = None
        self.conf, self.down = 0, False
        self.x = self.y = self.press_x = self.press_y = 0
        self.first: list[tuple[int, int]] = []

    def sample(self, ms: int, valid: bool, x: int, y: int) -> str | None:
        """What the sample did: press, release, move, none; or null if it was passed over."""
        if self.last_poll is not None and ms - self.last_poll < self.POLL_MS:
            return None
        self.last_poll = ms
        if valid:
            self.x, self.y = x, y
            if len(self.first) < 3:
                self.first.append((x, y))
        self.conf = min(8, self.conf + 2) if valid else max(0, self.conf - 1)
        was, now = self.down, self.conf > 2 if self.down else self.conf >= 4
        if now and was and ms - self.down_since > self.STUCK_MS:
            self.conf, now = 0, False
        out = "none"
        if now and not was:
            self.press_x, self.press_y = (self._point(k) for k in (0, 1))
            self.down_since, out = ms, "press"
        elif was and not now:
            self.down_since, out = None, "release"
        elif now:
            out = "move"
        if not now:
            self.first = []
        self.down = now
        return out

    def _point(self, k: int) -> int:
        own = [p[k] for p in self.first]
        if len(own) == 3:
            return sorted(own)[1]
        return int((own[0] + own[1]) / 2) if len(own) == 2 else (self.x, self.y)[k]


def debounce(samples: DataFrame) -> DataFrame:
    """``samples`` (key, seq, ms, valid, x, y) -> key, seq, state, down, conf, press_x, press_y; passed-over samples have a null state."""

    def step(c: Contact, r: tuple) -> tuple:
        key, seq, ms, valid, x, y = r
        state = c.sample(ms, valid, x, y)
        return key, seq, state, c.down, c.conf, c.press_x, c.press_y

    rows = samples.select("key", "seq", "ms", "valid", "x", "y")
    return fold_rows(rows, ["ms", "seq"], Contact, step, "key long, seq long, state string, down boolean, conf int, press_x int, press_y int")


def taps(rows: DataFrame, window_ms: int = 400, reach: int = 50) -> DataFrame:
    """``rows`` (key, seq, ms, x, y) -> each tap's role: ``double`` if it completes a pair, ``first`` of a pair, or ``single``.

    A pair is at most 400 ms and less than 50 pixels apart on either axis; a tap that
    completed a pair begins no other. Taps that cannot pair replace the parked one.
    """
    order = Window.partitionBy("key").orderBy("ms", "seq")
    near = (F.col("ms") - F.lag("ms").over(order) <= window_ms) & (F.abs(F.col("x") - F.lag("x").over(order)) < reach) & (F.abs(F.col("y") - F.lag("y").over(order)) < reach)
    chained = rows.withColumn("near", F.coalesce(near, F.lit(False)))
    run = chained.withColumn("run", F.sum((~F.col("near")).cast("int")).over(order))
    place = F.row_number().over(Window.partitionBy("key", "run").orderBy("ms", "seq"))
    size = F.count("*").over(Window.partitionBy("key", "run"))
    return run.withColumn("__p", place).withColumn("__s", size).select(
        "key", "seq", "ms", "x", "y", F.when(F.col("__p") % 2 == 0, "double").when(F.col("__p") < F.col("__s"), "first").otherwise("single").alias("role")
    )


def releases(strokes: DataFrame, rects: DataFrame, reach_x: int = 28, reach_y: int = 22) -> DataFrame:
    """``strokes`` (key, seq, press_x, press_y, x, y: where the finger came up) -> key, seq, what, target, tap_x, tap_y.

    A press on a target of ``rects`` (rect, x, y, w, h; few) is its ``button`` if it is
    released on the same one, else ``none``. Elsewhere a release near its press (under
    28 and 22 pixels) is a ``tap``, at the place of the press; any other is a ``slide``.
    """
    held, under = (
        rects.select(F.col("rect").alias(name), F.col("x").alias(f"{name}_x"), F.col("y").alias(f"{name}_y"), F.col("w").alias(f"{name}_w"), F.col("h").alias(f"{name}_h")) for name in ("held", "under")
    )

    def over(name: str, x: str, y: str) -> Column:
        return F.col(x).between(F.col(f"{name}_x"), F.col(f"{name}_x") + F.col(f"{name}_w") - 1) & F.col(y).between(F.col(f"{name}_y"), F.col(f"{name}_y") + F.col(f"{name}_h") - 1)

    s = strokes.join(F.broadcast(held), over("held", "press_x", "press_y"), "left").join(F.broadcast(under), over("under", "x", "y"), "left")  # a screen's few targets
    near = (F.abs(F.col("x") - F.col("press_x")) < reach_x) & (F.abs(F.col("y") - F.col("press_y")) < reach_y)
    what = F.when(F.col("held") == F.col("under"), "button").when(F.col("held").isNotNull(), "none").when(near, "tap").otherwise("slide")
    tap = what == "tap"
    return s.select("key", "seq", what.alias("what"), F.when(what == "button", F.col("held")).alias("target"), F.when(tap, F.col("press_x")).alias("tap_x"), F.when(tap, F.col("press_y")).alias("tap_y"))


def drag_steps(rows: DataFrame, start: int = 6, step: int = 24) -> DataFrame:
    """``rows`` (key, stroke, seq, y) -> steps scrolled at each sample of a stroke.

    Movement is summed from the press; once it has been more than ``start`` away, each
    whole ``step`` (toward zero) scrolls and is taken off, the rest carried on.
    """
    def fold(state: dict, r: tuple) -> tuple:
        key, stroke, seq, y = r
        if state.get("stroke", ()) != stroke:
            state |= {"stroke": stroke, "from": y, "on": False, "done": 0}
        away = y - state["from"]
        state["on"] = state["on"] or abs(away) > start
        rest = away - state["done"] * step
        whole = (1 if rest > 0 else -1) * (abs(rest) // step) if state["on"] else 0
        state["done"] += whole
        return key, stroke, seq, whole

    return fold_rows(rows.select("key", "stroke", "seq", "y"), ["stroke", "seq"], dict, fold, "key long, stroke long, seq long, steps int")


def median_of(values: Column, discard: int = 1) -> Column:
    """Upper median of samples after the first ``discard``."""
    own = F.sort_array(F.slice(values, discard + 1, F.greatest(F.size(values) - discard, F.lit(0))))
    return F.try_element_at(own, F.floor(F.size(own) / 2).cast("int") + 1)


def type_query(keys: DataFrame, most: int = 24) -> DataFrame:
    """``keys`` (key, seq, char) -> the text after each key: letters are added up to ``most`` characters, "<" takes one off, "!" clears."""
    def step(state: dict, r: tuple) -> tuple:
        key, seq, char = r
        q = state.get("q", "")
        state["q"] = q[:-1] if char == "<" else "" if char == "!" else q + char if len(q) < most else q
        return key, seq, state["q"]

    return fold_rows(keys.select("key", "seq", "char"), ["seq"], dict, step, "key long, seq long, q string")


def throttle(rows: DataFrame, period_ms: int = 1000) -> DataFrame:
    """``rows`` (key, seq, ms, q): searches that a live search runs: changed text, at least a second after the last run."""

    def step(state: dict, r: tuple) -> tuple:
        key, seq, ms, q = r
        go = q != state["q"] and (state["ms"] is None or ms - state["ms"] >= period_ms)
        if go:
            state |= {"q": q, "ms": ms}
        return key, seq, go

    return fold_rows(rows.select("key", "seq", "ms", "q"), ["ms", "seq"], lambda: {"q": None, "ms": None}, step, "key long, seq long, ran boolean")
