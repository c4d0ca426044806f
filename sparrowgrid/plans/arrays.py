"""Queries over dense arrays; frames are embeddings read as 8 x 8 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tf
from ..operators import arrays
from . import tables as t

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_PX = f"WITH px AS ({t.PIXELS_SQL})"
_HIST = f"{_PX}, hs AS (SELECT frame, v, count(*) AS n FROM px GROUP BY frame, v), cm AS (SELECT *, sum(n) OVER (PARTITION BY frame ORDER BY v) AS acc, sum(n) OVER (PARTITION BY frame) AS total FROM hs)"


@query("histogram256", f"{_PX} SELECT v, count(*) AS n FROM px GROUP BY v")
def histogram256(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.histogram(t.pixels(spark, sf), [])


@query("percentile_levels", f"""{_HIST} SELECT frame, min(v) FILTER (acc >= total // 50) AS frame_lo, min(v) FILTER (acc >= total - total // 50) AS frame_hi,
 min(v) FILTER (acc > total * 2 // 100) AS crop_lo, min(v) FILTER (acc >= total * 98 // 100) AS crop_hi, min(v) FILTER (acc > (total - 1) * 2 // 100) AS line_lo,
 min(v) FILTER (acc > (total - 1) * 98 // 100) AS line_hi, min(v) FILTER (acc >= greatest(1, total // 100)) AS ink FROM cm GROUP BY frame""")
def percentile_levels(spark: SparkSession, sf: str) -> DataFrame:
    return t.frames(spark, sf).select("frame", *[c.alias(n) for n, c in arrays.levels(F.col("px")).items()])


@query("mode_paper", f"{_HIST} SELECT frame, coalesce((array_agg(v ORDER BY n DESC, v) FILTER (v >= 64))[1], 255) AS paper FROM hs GROUP BY frame")
def mode_paper(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.paper_mode(arrays.histogram(t.pixels(spark, sf), ["frame"]), ["frame"])


@query("contrast_threshold", f"""{_HIST}, p AS (SELECT frame, coalesce((array_agg(v ORDER BY n DESC, v) FILTER (v >= 64))[1], 255) AS paper, min(v) FILTER (acc >= greatest(1, total // 100)) AS ink FROM cm GROUP BY frame)
 SELECT frame, greatest(paper - ink, 0) AS contrast, CAST(least(18, greatest(6, greatest(paper - ink, 0) // 12)) AS INTEGER) AS threshold FROM p""")
def contrast_threshold(spark: SparkSession, sf: str) -> DataFrame:
    ink = t.frames(spark, sf).select("frame", arrays.levels(F.col("px"))["ink"].alias("ink"))
    both = mode_paper(spark, sf).join(ink, "frame")
    return both.select("frame", F.greatest(F.col("paper") - F.col("ink"), F.lit(0)).alias("contrast"), arrays.contrast_threshold(F.col("paper"), F.col("ink")).alias("threshold"))


@query("otsu_bins", f"""{_HIST}, x AS (SELECT *, sum(v * n) OVER (PARTITION BY frame ORDER BY v) AS sb, sum(v * n) OVER (PARTITION BY frame) AS s FROM cm),
 y AS (SELECT frame, v, CAST(abs(sb * (total - acc) - (s - sb) * acc) AS BIGINT) >> 10 AS sc, CAST(acc * (total - acc) AS BIGINT) AS w FROM x WHERE acc < total),
 z AS (SELECT frame, arg_max(v, (sc * sc // w) * 1000 - v) AS v, max(sc * sc // w) AS best FROM y GROUP BY frame)
 SELECT f.frame, CASE WHEN best > 0 THEN z.v ELSE 0 END AS threshold FROM (SELECT DISTINCT frame FROM px) f LEFT JOIN z USING (frame)""")
def otsu_bins(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.otsu_bins(arrays.histogram(t.pixels(spark, sf), ["frame"]), ["frame"])


@query("otsu_float", """WITH e AS (SELECT vec_id AS frame, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE len(embedding) > 0),
 s AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY x) AS i, lag(x) OVER (PARTITION BY frame ORDER BY x) AS before, sum(x) OVER (PARTITION BY frame) AS total, count(*) OVER (PARTITION BY frame) AS n,
   sum(x) OVER (PARTITION BY frame ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lft FROM e),
 v AS (SELECT *, (i - 1) * (n - i + 1) * pow(lft / (i - 1) - (total - lft) / (n - i + 1), 2) AS var FROM s WHERE i > 1)
 SELECT frame, round(arg_max((before + x) * 0.5, var), 6) AS threshold FROM v GROUP BY frame""")
def otsu_float(spark: SparkSession, sf: str) -> DataFrame:
    e = t.table(spark, sf, "embeddings").where("size(embedding) > 0").select(F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("xs"))
    return e.select("frame", F.round(arrays.otsu_sorted(F.col("xs")), 6).alias("threshold"))


@query("median_variants", f"""{_PX}, s AS (SELECT frame, list_sort(list(v)) AS s FROM px GROUP BY frame) SELECT frame, s[32] + s[33] AS x2, (s[32] + s[33]) / 2 AS mean, s[33] AS upper_count, s[32] AS lower_count, s[33] AS upper_index, s[33] AS upper_64 FROM s""")
def median_variants(spark: SparkSession, sf: str) -> DataFrame:
    return t.frames(spark, sf).select("frame", *[c.alias(n) for n, c in arrays.medians(F.col("px")).items()])


@query("weighted_median", """WITH p AS (SELECT l_orderkey AS k, l_extendedprice AS x, l_quantity AS w FROM lineitem), c AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY x, w ROWS UNBOUNDED PRECEDING) AS acc, sum(w) OVER (PARTITION BY k) AS total FROM p)
 SELECT k AS orderkey, min(x) FILTER (acc >= total / 2) AS median FROM c GROUP BY k""")
def weighted_median(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w"))).alias("p"))
    return li.select("orderkey", arrays.weighted_median(F.col("p")).alias("median"))


@query("line_fit", f"""{_PX} SELECT frame, x, count(*) AS n, round(regr_slope(v, y), 6) AS slope, round(regr_intercept(v, y), 6) AS intercept FROM px GROUP BY frame, x""")
def line_fit(spark: SparkSession, sf: str) -> DataFrame:
    p = t.pixels(spark, sf).select("frame", "x", F.col("y").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    return arrays.line_fit(p, ["frame", "x"])


@query("quadratic_fit", f"""{_PX}, c AS (SELECT frame, x, v, y - 3.5 AS d FROM px), s AS (SELECT frame, x, CAST(count(*) AS DOUBLE) AS s0, sum(d * d) AS s2, sum(d * d * d * d) AS s4, CAST(sum(v) AS DOUBLE) AS t0, sum(v * d) AS t1, sum(v * d * d) AS t2 FROM c GROUP BY frame, x)
 SELECT frame, x, 3.5 :: DOUBLE AS m, round((t0 * s4 - s2 * t2) / (s0 * s4 - s2 * s2), 5) AS a, round(CAST(t1 / s2 AS DOUBLE), 5) AS b, round((s0 * t2 - s2 * t0) / (s0 * s4 - s2 * s2), 5) AS c FROM s""")
def quadratic_fit(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.quadratic_fit(t.pixels(spark, sf).select("frame", "x", F.col("y").cast("double").alias("u"), F.col("v").cast("double").alias("v")), ["frame", "x"])


def _around(agg: str, name: str, radius: int) -> str:
    return f"""{_PX}, o AS (SELECT unnest(range(-{radius}, {radius + 1})) AS d) SELECT c.frame, c.y, c.x, {agg} AS {name} FROM px c, o dy, o dx JOIN px n ON n.frame = c.frame AND n.y = greatest(0, least(7, c.y + dy.d)) AND n.x = greatest(0, least(7, c.x + dx.d)) GROUP BY c.frame, c.y, c.x"""


@query("box_sum", _around("CAST(sum(n.v) AS BIGINT)", "total", 1))
def box_sum(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.box_sums(t.frames(spark, sf), (t.SIDE, t.SIDE), 1)


@query("minmax_filter", _around("min(n.v) AS least, max(n.v)", "most", 1))
def minmax_filter(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.extremes(t.frames(spark, sf), (t.SIDE, t.SIDE), 1)


@query("downscale_area", f"{_PX} SELECT frame, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CAST(sum(v) // count(*) AS INTEGER) AS area FROM px GROUP BY frame, y // 2, x // 2")
def downscale_area(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.binned(t.pixels(spark, sf), 2).select("frame", "y", "x", "area")


@query("downscale_any_area", f"""{_PX}, r AS (SELECT unnest(range(7)) AS ry), c AS (SELECT unnest(range(5)) AS rx),
 o AS (SELECT *, greatest(0, least((y + 1) * 7, (ry + 1) * 8) - greatest(y * 7, ry * 8)) * greatest(0, least((x + 1) * 5, (rx + 1) * 8) - greatest(x * 5, rx * 8)) AS part FROM px, r, c)
 SELECT frame, CAST(ry AS INTEGER) AS y, CAST(rx AS INTEGER) AS x, CAST(sum(v * part) // 64 AS INTEGER) AS area FROM o WHERE part > 0 GROUP BY frame, ry, rx""")
def downscale_any_area(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of 8 x 8 as 7 x 5: borders that fall inside a pixel count by their share."""
    return arrays.area_scaled(t.frames(spark, sf), (t.SIDE, t.SIDE), (7, 5))


@query("maxpool", f"{_PX} SELECT frame, CAST(y // 4 AS INTEGER) AS y, CAST(x // 4 AS INTEGER) AS x, max(v) AS most FROM px GROUP BY frame, y // 4, x // 4")
def maxpool(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.binned(t.pixels(spark, sf), 4).select("frame", "y", "x", "most")


@query("rotate90_crop", f"{_PX} SELECT frame, CAST(x - 1 AS INTEGER) AS y, CAST(6 - y AS INTEGER) AS x, v FROM px WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6")
def rotate90_crop(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.rotated_crop(t.pixels(spark, sf), t.SIDE, 6)


@query("luma", f"{_PX} SELECT frame, y, x, CAST((77 * v + 150 * (255 - v) + 29 * (v // 2)) >> 8 AS INTEGER) AS luma, CAST(((v >> 3) << 11) | (((255 - v) >> 2) << 5) | ((v // 2) >> 3) AS INTEGER) AS rgb565 FROM px")
def luma(spark: SparkSession, sf: str) -> DataFrame:
    r, g, b = F.col("v"), F.lit(255) - F.col("v"), F.shiftright("v", 1)
    return t.pixels(spark, sf).select("frame", "y", "x", tf.luma(r, g, b).alias("luma"), tf.rgb565(r, g, b).alias("rgb565"))


_ANGLES = list(range(-40, 41, 2))
_SHARP = f"""{_PX}, g AS (SELECT unnest({_ANGLES}) :: DOUBLE AS angle), p AS (SELECT frame, angle, -x * sin(radians(angle)) + y * cos(radians(angle)) AS p FROM px, g WHERE v >= 140),
 q AS (SELECT frame, angle, floor(round(p - min(p) OVER (PARTITION BY frame, angle), 6)) AS bin FROM p), n AS (SELECT frame, angle, bin, count(*) AS n FROM q GROUP BY ALL),
 s AS (SELECT frame, angle, CAST(sum(n * n) AS BIGINT) AS sharpness FROM n GROUP BY frame, angle)"""


def _sharp(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.sharpness(t.frames(spark, sf), (t.SIDE, t.SIDE), 140, _ANGLES)


@query("projection_sharpness", f"{_SHARP} SELECT * FROM s")
def projection_sharpness(spark: SparkSession, sf: str) -> DataFrame:
    return _sharp(spark, sf)


@query("skew_angle", f"{_SHARP} SELECT frame, arg_max(angle, sharpness * 1000 + angle) AS angle, max(sharpness) AS sharpness FROM s GROUP BY frame")
def skew_angle(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.best_angle(_sharp(spark, sf), True)


def _components(eight: bool) -> str:
    near = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1" if eight else "abs(a.y - b.y) + abs(a.x - b.x) = 1"
    return f"""{_PX.replace('WITH', 'WITH RECURSIVE', 1)}, m AS (SELECT frame, y, x, y * 8 + x AS i FROM px WHERE v >= 150), e AS (SELECT a.frame, a.i AS a, b.i AS b FROM m a JOIN m b ON a.frame = b.frame AND a.i <> b.i AND {near}),
 r AS (SELECT frame, i AS root, i FROM m UNION SELECT r.frame, r.root, e.b FROM r JOIN e ON e.frame = r.frame AND e.a = r.i AND r.root < e.b),
 l AS (SELECT frame, i, min(root) AS label FROM r GROUP BY frame, i)
 SELECT frame, CAST(label AS INTEGER) AS label, CAST(count(*) AS INTEGER) AS area, CAST(min(i % 8) AS INTEGER) AS x1, CAST(min(i // 8) AS INTEGER) AS y1, CAST(max(i % 8) AS INTEGER) AS x2, CAST(max(i // 8) AS INTEGER) AS y2 FROM l GROUP BY frame, label"""


@query("connected_components", _components(False))
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.components(t.frames(spark, sf), t.SIDE, 150)


@query("connected_components8", _components(True))
def connected_components8(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.components(t.frames(spark, sf), t.SIDE, 150, eight=True)


@query("crop_lut", f"""{_HIST}, l AS (SELECT frame, min(v) FILTER (acc > total * 2 // 100) AS lo, min(v) FILTER (acc >= total * 98 // 100) AS hi FROM cm GROUP BY frame),
 n AS (SELECT frame, CASE WHEN hi - lo < 24 THEN 0 ELSE lo END AS lo, CASE WHEN hi - lo < 24 THEN 255 ELSE hi END AS hi FROM l)
 SELECT frame, y, x, CAST(least(255, greatest(0, floor((v - lo) * 255 / (hi - lo)))) AS INTEGER) AS v FROM px JOIN n USING (frame)""")
def crop_lut(spark: SparkSession, sf: str) -> DataFrame:
    lv = arrays.levels(F.col("px"))
    f = t.frames(spark, sf).select("frame", "px", lv["crop_lo"].alias("lo"), lv["crop_hi"].alias("hi"))
    px = f.select("frame", "lo", "hi", F.posexplode("px").alias("i", "v"))
    return px.select("frame", F.floor(F.col("i") / t.SIDE).cast("int").alias("y"), (F.col("i") % t.SIDE).cast("int").alias("x"), arrays.stretch(F.col("v"), F.col("lo"), F.col("hi")).alias("v"))
