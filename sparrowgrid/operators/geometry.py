"""Joins and ordered folds over rectangles, points, characters and spans of a frame.

Range conditions are met by cells: both sides are cut into cells of a fixed size, so
each join is an equi-join on (frame, cell) with the exact condition left over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = 64
#: Boxes widened by their reach lie in fewer of these.
WIDE_CELL = 128
REACH = 22


def cells(low: Column, high: Column, size: int = CELL) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def in_quad(quad: Column, px: Column, py: Column) -> Column:
    """Whether a point lies on one side of all four edges (x0, y0, x1, y1, ...)."""
    at = lambda k: F.element_at(quad, k % 8 + 1)
    cross = [(at(2 * k + 2) - at(2 * k)) * (py - at(2 * k + 1)) - (at(2 * k + 3) - at(2 * k + 1)) * (px - at(2 * k)) for k in range(4)]
    return ~((F.greatest(*cross) > 0) & (F.least(*cross) < 0))


def box_at(points: DataFrame, boxes: DataFrame, reach: int = REACH) -> DataFrame:
    """``points`` (frame, pid, px, py), ``boxes`` (frame, box, x1..y2, geom, quad) -> frame, pid, box, how.

    The smallest box around the point (tilted ones by their quad), of equals the
    first; else the nearest centre closer than ``reach``; else null.
    """
    quad = F.when(F.col("geom"), F.col("quad")).alias("quad")
    wide = boxes.select("frame", "box", "x1", "y1", "x2", "y2", "geom", quad, F.explode(cells(F.col("x1") - reach, F.col("x2") + reach, WIDE_CELL)).alias("cx"))
    b = wide.select("*", F.explode(cells(F.col("y1") - reach, F.col("y2") + reach, WIDE_CELL)).alias("cy"))
    p = points.select("frame", "pid", "px", "py", F.floor(F.col("px") / WIDE_CELL).alias("cx"), F.floor(F.col("py") / WIDE_CELL).alias("cy"))
    near = p.join(b, ["frame", "cx", "cy"], "left")  # a point lies in one cell: what it meets there is all, and is grouped where it lies
    inside = F.col("px").between(F.col("x1"), F.col("x2")) & F.col("py").between(F.col("y1"), F.col("y2")) & (~F.col("geom") | in_quad(F.col("quad"), F.col("px"), F.col("py")))
    area = (F.col("x2") - F.col("x1") + 1).cast("long") * (F.col("y2") - F.col("y1") + 1)
    dx, dy = F.floor((F.col("x1") + F.col("x2")) / 2) - F.col("px"), F.floor((F.col("y1") + F.col("y2")) / 2) - F.col("py")
    away = dx * dx + dy * dy
    rated = near.select("frame", "cx", "cy", "pid", "px", "py", "box", F.when(inside, area).alias("area"), F.when(away < reach * reach, away).alias("away"))
    best = rated.groupBy("frame", "cx", "cy", "pid", "px", "py").agg(F.min(F.when(F.col("area").isNotNull(), F.struct("area", "box"))).alias("a"), F.min(F.when(F.col("away").isNotNull(), F.struct("away", "box"))).alias("d"))
    return best.select("frame", "pid", F.coalesce("a.box", "d.box").alias("box"), F.when(F.col("a").isNotNull(), "inside").when(F.col("d").isNotNull(), "near").otherwise("none").alias("how"))


def first_box(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The first box in order around each point (``pid``, px, py), or null."""
    b = boxes.select("*", F.explode(cells(F.col("x1"), F.col("x2"))).alias("cx"))
    p = points.withColumn("cx", F.floor(F.col("px") / CELL))
    hit = p.join(b, ["frame", "cx"]).where(F.col("px").between(F.col("x1"), F.col("x2")) & F.col("py").between(F.col("y1"), F.col("y2")))
    return points.select("frame", "pid").join(hit.groupBy("frame", "pid").agg(F.min("box").alias("box")), ["frame", "pid"], "left")


def nearest_span(marks: DataFrame, spans: DataFrame, xh: float) -> DataFrame:
    """``marks`` (frame, mark, uc), ``spans`` (frame, word, u1, u2) -> the nearest word's number, null beyond 0.9 of the x-height.

    Inside a span widened by 0.2 of the x-height the distance is zero; of equals the first word.
    """
    reach = 0.9 * xh
    s = spans.select("*", F.explode(cells(F.col("u1") - reach, F.col("u2") + reach)).alias("c"))
    m = marks.withColumn("c", F.floor(F.col("uc") / CELL))
    inside = F.col("uc").between(F.col("u1") - 0.2 * xh, F.col("u2") + 0.2 * xh)
    d = F.when(inside, 0.0).otherwise(F.least(F.abs(F.col("uc") - F.col("u1")), F.abs(F.col("uc") - F.col("u2"))))
    near = m.join(s, ["frame", "c"]).withColumn("d", d).where(F.col("d") <= reach)
    best = near.groupBy("frame", "mark").agg(F.min(F.struct("d", "word")).alias("b"))
    return marks.select("frame", "mark").join(best, ["frame", "mark"], "left").select("frame", "mark", F.col("b.word").alias("word"), F.col("b.d").alias("distance"))


def right_neighbour(chars: DataFrame, height: int) -> DataFrame:
    """``chars`` (frame, cid, cx, cy) -> each one's nearest character to the right, within 3 heights and 0.6 of one up or down."""
    wide, tall = 3 * height, max(2, 6 * height // 10)
    a = chars.select("frame", "cid", "cx", "cy", F.explode(F.sequence(F.floor(F.col("cx") / wide), F.floor(F.col("cx") / wide) + 1)).alias("c"))
    b = chars.select("frame", F.col("cid").alias("right"), F.col("cx").alias("bx"), F.col("cy").alias("by"), F.floor(F.col("cx") / wide).alias("c"))
    dx, dy = F.col("bx") - F.col("cx"), F.col("by") - F.col("cy")
    near = a.join(b, ["frame", "c"]).where((dx > 0) & (dx <= wide) & (F.abs(dy) <= tall))
    best = near.groupBy("frame", "cid").agg(F.min(F.struct(dx.alias("dx"), F.col("by"), F.col("right"), dy.alias("dy"))).alias("b"))
    return best.select("frame", "cid", "b.right", "b.dx", "b.dy")


def skew(pairs: DataFrame, least: int = 8) -> DataFrame:
    """``pairs`` (frame, dx, dy) -> the median bin of slopes (4,096ths, bins of 8, within 737); 0 for fewer than ``least`` pairs."""
    slope = F.expr("cast(dy as long) * 4096 div dx")
    bin_ = F.expr("(slope + if(slope >= 0, 4, -4)) div 8")
    hist = pairs.withColumn("slope", slope).withColumn("bin", bin_).where(F.col("bin").between(-96, 96)).groupBy("frame", "bin").agg(F.count("*").alias("n"))
    so_far = hist.select("frame", "bin", F.sum("n").over(Window.partitionBy("frame").orderBy("bin")).alias("seen"), F.sum("n").over(Window.partitionBy("frame")).alias("total"))
    found = so_far.groupBy("frame").agg(F.min(F.when(F.col("seen") > F.floor(F.col("total") / 2), F.col("bin"))).alias("bin"), F.max("total").alias("total"))
    return found.select("frame", F.when(F.col("total") < least, 0).otherwise(F.least(F.greatest(F.col("bin") * 8, F.lit(-737)), F.lit(737))).cast("int").alias("slope"))


def reading_order(boxes: DataFrame, height: int) -> DataFrame:
    """``boxes`` (frame, box, x1, y1, y2) -> line and place of each box.

    A new line begins where the centre is more than 0.7 of a height below the centre
    of the line's first box (not of the box before).
    """
    tolerance = max(2, 7 * height // 10)
    each = boxes.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct(F.shiftright(F.col("y1") + F.col("y2"), 1).alias("c"), "x1", "box"))).alias("b"))  # one frame
    start = F.struct(F.lit(0).alias("line"), F.lit(None).cast("int").alias("ref"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        new = s["ref"].isNotNull() & (b["c"] - s["ref"] > tolerance)
        line = F.when(new, s["line"] + 1).otherwise(s["line"])
        return F.struct(line.alias("line"), F.when(s["ref"].isNull() | new, b["c"]).otherwise(s["ref"]).cast("int").alias("ref"), F.array_append(s["out"], line).alias("out"))

    lines = each.select("frame", F.explode(F.arrays_zip("b", F.aggregate("b", start, step, lambda s: s["out"]).alias("line"))).alias("z"))
    flat = lines.select("frame", "z.b.box", "z.b.x1", "z.b.c", "z.line")
    return flat.select("frame", "box", "line", F.row_number().over(Window.partitionBy("frame").orderBy("line", "x1", "c", "box")).alias("place"))


def gap_words(chars: DataFrame, split_gap: int, ratio10: int = 18) -> DataFrame:
    """``chars`` (frame, blob, cid, x1, x2) -> the word of each character inside its blob, and the gap before it.

    Cut where the gap is at least ``split_gap`` and 1.8 times the blob's lower median
    gap (which counts from three characters on).
    """
    order = Window.partitionBy("frame", "blob").orderBy("x1", "cid")
    whole = Window.partitionBy("frame", "blob")
    g = chars.withColumn("gap", F.col("x1") - F.lag("x2").over(order) - 1).withColumn("n", F.count("*").over(whole))
    clamped = F.when(F.col("gap").isNotNull(), F.least(F.greatest(F.col("gap"), F.lit(0)), F.lit(255)))
    ranks = g.withColumn("__r", F.row_number().over(Window.partitionBy("frame", "blob").orderBy(clamped.asc_nulls_last())))
    median = F.max(F.when(F.col("__r") == F.floor(F.col("n") / 2), clamped)).over(whole)  # rank ceil((n - 1) / 2)
    relative = F.greatest(F.lit(1), F.floor(F.when(F.col("n") > 2, median).otherwise(0) * ratio10 / 10))
    cut = ranks.withColumn("__cut", F.coalesce((F.col("gap") >= split_gap) & (F.col("gap") >= relative), F.lit(False)).cast("int"))
    return cut.select("frame", "blob", "cid", "gap", F.sum("__cut").over(order).cast("int").alias("word"))


def clusters(letters: DataFrame, xh: float) -> DataFrame:
    """``letters`` (frame, lid, u1, u2) -> cluster of each: a new one begins beyond the furthest end so far (plus 0.02 x-heights)."""
    order = Window.partitionBy("frame").orderBy("u1", "lid")
    furthest = F.max("u2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("u1") > furthest + 0.02 * xh, F.lit(False)).cast("int")
    return letters.withColumn("__new", new).select("frame", "lid", "u1", "u2", F.sum("__new").over(order).cast("int").alias("cluster"))


def cluster_words(clustered: DataFrame, xh: float, default: float = 0.40, low: float = 0.28, high: float = 0.75) -> DataFrame:
    """Words of clusters: frame, cluster, gap after it, word, and tau, the frame's adaptive threshold.

    tau is Otsu's threshold of the gaps (in x-heights) if there are four at least, it lies
    within bounds, both sides are there, the wide gaps' mean is 1.8 times the
    narrow ones' (0.05 at least) and none of the wide is under 0.3; else the default.
    Sums are taken in ascending order, so that no order of rows decides.
    """
    from .arrays import otsu_sorted

    order = Window.partitionBy("frame").orderBy("cluster")
    c = clustered.groupBy("frame", "cluster").agg(F.min("u1").alias("u1"), F.max("u2").alias("u2"))
    g = c.withColumn("gap", (F.lead("u1").over(order) - F.col("u2") - 1) / xh)
    each = g.groupBy("frame").agg(F.sort_array(F.collect_list("gap")).alias("gaps")).where("size(gaps) >= 4").withColumn("t", otsu_sorted(F.col("gaps")))
    lo, hi = F.filter("gaps", lambda x: x <= F.col("t")), F.filter("gaps", lambda x: x > F.col("t"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    good = (F.size(lo) > 0) & (F.size(hi) > 0) & F.col("t").between(low, high) & (mean(hi) >= 1.8 * F.greatest(mean(lo), F.lit(0.05))) & (F.array_min(hi) >= 0.3)
    tau = each.select("frame", F.when(good, F.col("t")).alias("tau"))
    w = g.join(tau, "frame", "left").withColumn("tau", F.coalesce("tau", F.lit(default)))
    cut = F.coalesce(F.lag("gap").over(order) >= F.col("tau"), F.lit(False)).cast("int")
    return w.withColumn("__cut", cut).select("frame", "cluster", F.round("gap", 6).alias("gap"), F.round("tau", 6).alias("tau"), F.sum("__cut").over(order).cast("int").alias("word"))


def paint_out(pixels: DataFrame, owners: DataFrame, word: int, paper: Column | int = 255) -> DataFrame:
    """``pixels`` (frame, y, x, v, label), ``owners`` (frame, label, owner): parts of other words become paper; shared and unowned ones stay."""
    joined = pixels.join(owners.select("frame", "label", "owner"), ["frame", "label"], "left")
    paper = paper if isinstance(paper, Column) else F.lit(paper)
    return joined.select("frame", "y", "x", F.when(F.col("owner") != word, paper).otherwise(F.col("v")).alias("v"))
