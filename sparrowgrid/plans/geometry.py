"""Queries over boxes, points, characters and class scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tf
from ..operators import decode, geometry
from . import tables as t

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as boxes; the customer is the frame."""
    k = F.col("o_orderkey")
    place = F.row_number().over(geometry.Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    raw = t.table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("frame"), place.alias("box"), ((k * 37) % 400).cast("int").alias("x1"), ((k * 53) % 300).cast("int").alias("y1"), k.alias("k"))
    b = raw.select("frame", "box", "x1", "y1", (F.col("x1") + 8 + F.col("k") % 60).cast("int").alias("x2"), (F.col("y1") + 6 + F.col("k") % 20).cast("int").alias("y2"), (F.col("k") % 3 == 0).alias("geom"), (F.col("k") % 32 + F.when(F.col("k") % 5 == 0, 128).otherwise(0)).cast("int").alias("flags"))
    quad = F.array(F.col("x1") + 2, F.col("y1"), F.col("x2"), F.col("y1") + 2, F.col("x2") - 2, F.col("y2"), F.col("x1"), F.col("y2") - 2)
    return b.withColumn("quad", quad)


_BOX = """bx AS (SELECT o_custkey AS frame, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS box, CAST((o_orderkey * 37) % 400 AS INTEGER) AS x1, CAST((o_orderkey * 53) % 300 AS INTEGER) AS y1,
 CAST((o_orderkey * 37) % 400 + 8 + o_orderkey % 60 AS INTEGER) AS x2, CAST((o_orderkey * 53) % 300 + 6 + o_orderkey % 20 AS INTEGER) AS y2, o_orderkey % 3 = 0 AS geom, CAST(o_orderkey % 32 + CASE WHEN o_orderkey % 5 = 0 THEN 128 ELSE 0 END AS INTEGER) AS flags FROM orders)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return t.table(spark, sf, "events").select(F.col("user_id").alias("frame"), i.alias("pid"), ((i * 29) % 480).cast("int").alias("px"), ((i * 31) % 330).cast("int").alias("py"))


_POINT = "pt AS (SELECT user_id AS frame, event_id AS pid, CAST((event_id * 29) % 480 AS INTEGER) AS px, CAST((event_id * 31) % 330 AS INTEGER) AS py FROM events)"


@query("point_in_box_smallest", f"""WITH {_BOX}, {_POINT}, j AS (SELECT frame, pid, box, px, py, x1, y1, x2, y2, geom,
  [(x2 - x1 - 2) * (py - y1) - 2 * (px - x1 - 2), (-2) * (py - y1 - 2) - (y2 - y1 - 2) * (px - x2), (x1 - x2 + 2) * (py - y2) + 2 * (px - x2 + 2), 2 * (py - y2 + 2) - (y1 - y2 + 2) * (px - x1)] AS c,
  (x2 - x1 + 1) * (y2 - y1 + 1) AS area, pow((x1 + x2) // 2 - px, 2) + pow((y1 + y2) // 2 - py, 2) AS away FROM pt JOIN bx USING (frame)),
 i AS (SELECT frame, pid, arg_min(box, area * 100000 + box) AS box FROM j WHERE px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 AND (NOT geom OR NOT (list_max(c) > 0 AND list_min(c) < 0)) GROUP BY ALL),
 n AS (SELECT frame, pid, arg_min(box, away * 100000 + box) AS box FROM j WHERE away < 484 GROUP BY ALL)
 SELECT p.frame, p.pid, coalesce(i.box, n.box) AS box, CASE WHEN i.box IS NOT NULL THEN 'inside' WHEN n.box IS NOT NULL THEN 'near' ELSE 'none' END AS how FROM pt p LEFT JOIN i ON i.frame = p.frame AND i.pid = p.pid LEFT JOIN n ON n.frame = p.frame AND n.pid = p.pid""")
def point_in_box_smallest(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.box_at(points(spark, sf), boxes(spark, sf))


@query("char_to_blob", f"""WITH {_BOX}, {_POINT} SELECT frame, pid, (SELECT min(box) FROM bx WHERE bx.frame = pt.frame AND px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2) AS box FROM pt""")
def char_to_blob(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.first_box(points(spark, sf), boxes(spark, sf))


@query("nearest_span", f"""WITH {_BOX}, {_POINT}, j AS (SELECT frame, pid, box, CASE WHEN px BETWEEN x1 - 4 AND x2 + 4 THEN 0 ELSE least(abs(px - x1), abs(px - x2)) END AS d FROM pt JOIN bx USING (frame)),
 b AS (SELECT frame, pid, arg_min(box, d * 100000 + box) AS word, CAST(min(d) AS DOUBLE) AS distance FROM j WHERE d <= 18 GROUP BY ALL) SELECT pt.frame, pt.pid AS mark, word, distance FROM pt LEFT JOIN b USING (frame, pid)""")
def nearest_span(spark: SparkSession, sf: str) -> DataFrame:
    spans = boxes(spark, sf).select("frame", F.col("box").alias("word"), F.col("x1").cast("double").alias("u1"), F.col("x2").cast("double").alias("u2"))
    return geometry.nearest_span(points(spark, sf).select("frame", F.col("pid").alias("mark"), F.col("px").cast("double").alias("uc")), spans, 20.0)


def chars(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as characters; the order is the frame."""
    li = t.table(spark, sf, "lineitem")
    place = F.row_number().over(geometry.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return li.select(F.col("l_orderkey").alias("frame"), place.alias("cid"), ((F.col("l_partkey") * 7) % 120).cast("int").alias("cx"), ((F.col("l_suppkey") * 11) % 40).cast("int").alias("cy"))


_CHAR = """ch AS (SELECT l_orderkey AS frame, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS cid, CAST((l_partkey * 7) % 120 AS INTEGER) AS cx, CAST((l_suppkey * 11) % 40 AS INTEGER) AS cy FROM lineitem)"""
_RIGHT = f"""{_CHAR}, j AS (SELECT a.frame, a.cid, b.cid AS r, b.cx - a.cx AS dx, b.cy - a.cy AS dy, b.cy AS bcy FROM ch a JOIN ch b ON a.frame = b.frame AND b.cx > a.cx AND b.cx - a.cx <= 36 AND abs(b.cy - a.cy) <= 7),
 rn AS (SELECT frame, cid, r AS "right", dx, dy FROM (SELECT *, row_number() OVER (PARTITION BY frame, cid ORDER BY dx, bcy, r) AS n FROM j) WHERE n = 1)"""


@query("right_neighbor", f"WITH {_RIGHT} SELECT * FROM rn")
def right_neighbor(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.right_neighbour(chars(spark, sf), 12)


@query("skew_slope", f"""WITH {_RIGHT}, s AS (SELECT frame % 100 AS frame, CAST(trunc(dy * 4096.0 / dx) AS BIGINT) AS slope FROM rn), b AS (SELECT frame, CAST(trunc((slope + CASE WHEN slope >= 0 THEN 4 ELSE -4 END) / 8.0) AS BIGINT) AS bin FROM s),
 h AS (SELECT frame, bin, count(*) AS n FROM b WHERE bin BETWEEN -96 AND 96 GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY frame ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY frame) AS total FROM h)
 SELECT frame, CAST(CASE WHEN max(total) < 8 THEN 0 ELSE greatest(-737, least(737, min(bin) FILTER (seen > total // 2) * 8)) END AS INTEGER) AS slope FROM c GROUP BY frame""")
def skew_slope(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.skew(right_neighbor(spark, sf).withColumn("frame", F.col("frame") % 100))


@query("reading_order_lines", f"""WITH RECURSIVE {_BOX}, o AS (SELECT frame, box, x1, (y1 + y2) >> 1 AS c, row_number() OVER (PARTITION BY frame ORDER BY (y1 + y2) >> 1, x1, box) AS n FROM bx),
 f AS (SELECT frame, box, x1, c, n, 0 AS line, c AS ref FROM o WHERE n = 1 UNION ALL SELECT o.frame, o.box, o.x1, o.c, o.n, CASE WHEN o.c - f.ref > 14 THEN f.line + 1 ELSE f.line END, CASE WHEN o.c - f.ref > 14 THEN o.c ELSE f.ref END FROM f JOIN o ON o.frame = f.frame AND o.n = f.n + 1)
 SELECT frame, box, line, CAST(row_number() OVER (PARTITION BY frame ORDER BY line, x1, c, box) AS INTEGER) AS place FROM f""")
def reading_order_lines(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.reading_order(boxes(spark, sf), 20)


@query("gap_split_words", f"""WITH {_BOX}, s AS (SELECT frame, y1 // 100 AS blob, box AS cid, x1, x2 FROM bx), g AS (SELECT *, x1 - lag(x2) OVER w - 1 AS gap, count(*) OVER (PARTITION BY frame, blob) AS n FROM s WINDOW w AS (PARTITION BY frame, blob ORDER BY x1, cid)),
 m AS (SELECT frame, blob, list_sort(list(greatest(0, least(255, gap))) FILTER (gap IS NOT NULL)) AS gaps FROM g GROUP BY ALL),
 c AS (SELECT g.*, CASE WHEN gap >= 10 AND gap >= greatest(1, CASE WHEN n > 2 THEN gaps[CAST(ceil((n - 1) / 2) AS BIGINT)] ELSE 0 END * 18 // 10) THEN 1 ELSE 0 END AS cut FROM g JOIN m USING (frame, blob))
 SELECT frame, CAST(blob AS BIGINT) AS blob, cid, gap, CAST(sum(cut) OVER (PARTITION BY frame, blob ORDER BY x1, cid) AS INTEGER) AS word FROM c""")
def gap_split_words(spark: SparkSession, sf: str) -> DataFrame:
    c = boxes(spark, sf).select("frame", F.floor(F.col("y1") / 100).alias("blob"), F.col("box").alias("cid"), "x1", "x2")
    return geometry.gap_words(c, 10)


_CLUSTER = f"""{_BOX}, l AS (SELECT frame, box AS lid, CAST(x1 AS DOUBLE) AS u1, CAST(x1 + 5 + box % 12 AS DOUBLE) AS u2 FROM bx),
 cl AS (SELECT frame, lid, u1, u2, CAST(sum(new) OVER (PARTITION BY frame ORDER BY u1, lid) AS INTEGER) AS cluster FROM (SELECT *, CASE WHEN u1 > max(u2) OVER (PARTITION BY frame ORDER BY u1, lid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.4 THEN 1 ELSE 0 END AS new FROM l))"""


def _letters(spark: SparkSession, sf: str) -> DataFrame:
    return boxes(spark, sf).select("frame", F.col("box").alias("lid"), F.col("x1").cast("double").alias("u1"), (F.col("x1") + 5 + F.col("box") % 12).cast("double").alias("u2"))


@query("interval_clusters", f"WITH {_CLUSTER} SELECT * FROM cl")
def interval_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.clusters(_letters(spark, sf), 20.0)


#: A list's sum in its order, so that both sides round alike.
_SUM = "list_reduce(list_prepend(CAST(0 AS DOUBLE), {x}), lambda a, x: a + x)"


@query("cluster_words", f"""WITH {_CLUSTER}, c AS (SELECT frame, cluster, min(u1) AS u1, max(u2) AS u2 FROM cl GROUP BY ALL), g AS (SELECT *, (lead(u1) OVER (PARTITION BY frame ORDER BY cluster) - u2 - 1) / 20.0 AS gap FROM c),
 s AS (SELECT frame, list_sort(list(gap)) AS gs FROM g WHERE gap IS NOT NULL GROUP BY frame HAVING count(*) >= 4), k AS (SELECT frame, gs, unnest(range(1, len(gs))) AS i FROM s),
 d AS (SELECT frame, gs, i, {_SUM.format(x='gs[1:i]')} / i - ({_SUM.format(x='gs')} - {_SUM.format(x='gs[1:i]')}) / (len(gs) - i) AS d FROM k),
 o AS (SELECT frame, gs, (gs[i] + gs[i + 1]) * 0.5 AS t, row_number() OVER (PARTITION BY frame ORDER BY CAST(i AS DOUBLE) * (len(gs) - i) * d * d DESC, i) AS n FROM d),
 q AS (SELECT frame, t, list_filter(gs, lambda x: x <= t) AS lo, list_filter(gs, lambda x: x > t) AS hi FROM o WHERE n = 1),
 ta AS (SELECT frame, t FROM q WHERE len(lo) > 0 AND len(hi) > 0 AND t BETWEEN 0.28 AND 0.75 AND {_SUM.format(x='hi')} / len(hi) >= 1.8 * greatest({_SUM.format(x='lo')} / len(lo), 0.05) AND hi[1] >= 0.3),
 w AS (SELECT g.*, coalesce(t, 0.4) AS tau, lag(gap) OVER (PARTITION BY frame ORDER BY cluster) AS pg FROM g LEFT JOIN ta USING (frame))
 SELECT frame, cluster, round(gap, 6) AS gap, round(tau, 6) AS tau, CAST(sum(CASE WHEN pg >= tau THEN 1 ELSE 0 END) OVER (PARTITION BY frame ORDER BY cluster) AS INTEGER) AS word FROM w""")
def cluster_words(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.cluster_words(interval_clusters(spark, sf), 20.0)


ALPHABET = list("abcdefg")


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Frames as 8 steps of 8 class scores, coarse enough for ties and repeats."""
    return t.frames(spark, sf).select("frame", decode.steps(F.transform("px", lambda v: F.floor((v - 128) / 16).cast("int")), 8).alias("rows"))


_LOGIT = f"WITH px AS ({t.PIXELS_SQL}), lg AS (SELECT frame, y, x, CAST(floor((v - 128) / 16) AS INTEGER) AS s FROM px), best AS (SELECT frame, y, CAST(min(x) FILTER (s = m) AS INTEGER) AS c, max(m) AS m FROM (SELECT *, max(s) OVER (PARTITION BY frame, y) AS m FROM lg) GROUP BY frame, y)"


@query("ctc_greedy", f"""{_LOGIT}, p AS (SELECT *, lag(c) OVER (PARTITION BY frame ORDER BY y) AS before FROM best)
 SELECT frame, coalesce(string_agg(CASE WHEN c <> 0 AND c IS DISTINCT FROM before THEN 'abcdefg'[c] END, '' ORDER BY y), '') AS text FROM p GROUP BY frame""")
def ctc_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return logits(spark, sf).select("frame", decode.greedy_ctc(F.col("rows"), ALPHABET).alias("text"))


@query("argmax_margin", f"""{_LOGIT}, r AS (SELECT frame, y, s, row_number() OVER (PARTITION BY frame, y ORDER BY s DESC) AS n FROM lg), g AS (SELECT frame, y, max(s) FILTER (n = 1) - max(s) FILTER (n = 2) AS margin FROM r GROUP BY frame, y)
 SELECT frame, CAST(count(*) FILTER (c = 0) AS INTEGER) AS blank_wins, CAST(least(127, floor(sum(margin) / count(*))) AS INTEGER) AS mean_margin, any_value(low) AS low, any_value(high) AS high FROM best JOIN g USING (frame, y) JOIN (SELECT frame, min(s) AS low, max(s) AS high FROM lg GROUP BY frame) USING (frame) GROUP BY frame""")
def argmax_margin(spark: SparkSession, sf: str) -> DataFrame:
    return logits(spark, sf).select("frame", *[c.alias(n) for n, c in decode.step_stats(F.col("rows")).items()])


@query("fnv1a", f"""WITH RECURSIVE px AS ({t.PIXELS_SQL}), f AS (SELECT frame, CAST(0 AS BIGINT) AS n, CAST(2166136261 AS BIGINT) AS h FROM (SELECT DISTINCT frame FROM px) UNION ALL
 SELECT f.frame, f.n + 1, (xor(f.h, CAST(p.v AS BIGINT)) * 16777619) & 4294967295 FROM f JOIN px p ON p.frame = f.frame AND p.y * 8 + p.x = f.n) SELECT frame, h AS hash FROM f WHERE n = 64""")
def fnv1a(spark: SparkSession, sf: str) -> DataFrame:
    return t.frames(spark, sf).select("frame", tf.fnv1a(F.col("px")).alias("hash"))


def wanted(spark: SparkSession, sf: str) -> DataFrame:
    f = boxes(spark, sf).select("frame").distinct()
    return f.select("frame", F.when(F.col("frame") % 3 == 0, "").when(F.col("frame") % 3 == 1, "3,1,1,x,99").otherwise("2,5,7").alias("list"))


@query("box_select", f"""WITH {_BOX} SELECT frame, box, flags FROM bx WHERE (flags & 143) = 0 AND (frame % 3 = 0 OR (frame % 3 = 1 AND box IN (0, 1, 3, 99)) OR (frame % 3 = 2 AND box IN (2, 5, 7)))""")
def box_select(spark: SparkSession, sf: str) -> DataFrame:
    return decode.select_boxes(boxes(spark, sf).select("frame", "box", "flags"), wanted(spark, sf))


@query("box_counts", f"WITH {_BOX} SELECT frame, count(*) AS boxes, count(*) FILTER ((flags & 15) <> 0) AS truncated, count(*) FILTER ((flags & 128) <> 0) AS punctuation, count(*) FILTER ((flags & 143) = 0) AS recognizable FROM bx GROUP BY frame")
def box_counts(spark: SparkSession, sf: str) -> DataFrame:
    return decode.box_counts(boxes(spark, sf))


@query("box_flags", f"""WITH {_BOX} SELECT frame, box, CAST((CASE WHEN x1 < 3 THEN 1 ELSE 0 END) | (CASE WHEN y1 < 3 THEN 2 ELSE 0 END) | (CASE WHEN x2 >= 407 THEN 4 ELSE 0 END) | (CASE WHEN y2 >= 307 THEN 8 ELSE 0 END) | (CASE WHEN flags % 4 BETWEEN 1 AND 2 AND (y2 - y1 + 1) * 100 < 55 * 20 THEN 128 ELSE 0 END) AS INTEGER) AS edge FROM bx""")
def box_flags(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    edge = decode.edge_flags(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 410, 310, 3)
    return b.select("frame", "box", edge.bitwiseOR(decode.punctuation_flag(F.col("flags") % 4, F.col("y2") - F.col("y1") + 1, 20)).alias("edge"))


_ONE = """'{"box":' || box || ',"x1":' || x1 || ',"y1":' || y1 || ',"x2":' || x2 || ',"y2":' || y2 || ',"flags":' || flags || '}'"""


@query("detect_json", f"""WITH {_BOX} SELECT frame, '{{"count":' || count(*) || ',"boxes":[' || string_agg({_ONE}, ',' ORDER BY box) || ']}}' AS json FROM bx GROUP BY frame""")
def detect_json(spark: SparkSession, sf: str) -> DataFrame:
    return decode.detect_json(boxes(spark, sf))


@query("recognize_ndjson", f"""WITH {_BOX}, n AS (SELECT frame, count(*) AS n FROM bx GROUP BY frame) SELECT frame, CAST(-1 AS BIGINT) AS at, '{{"event":"begin","total":' || n || '}}' AS line FROM n
 UNION ALL SELECT frame, CAST(box AS BIGINT), '{{"box":' || box || ',"status":"' || CASE WHEN flags = 7 THEN 'ocr_error' ELSE 'ok' END || '"}}' FROM bx UNION ALL SELECT frame, 4611686018427387904, '{{"event":"done","recognized":' || n || '}}' FROM n""")
def recognize_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    return decode.ndjson(boxes(spark, sf), "frame", "box", F.struct("box", F.when(F.col("flags") == 7, "ocr_error").otherwise("ok").alias("status")))


@query("stats_row", f"""WITH d AS ({t.DICTIONARY_SQL}), l AS ({t.FEW_LEARNED_SQL}) SELECT (SELECT count(*) FROM d) AS dictionary_rows, (SELECT count(*) FROM l) AS learned, CAST(2000 AS INTEGER) AS learned_capacity,
 (SELECT CAST(sum(strlen(en) + strlen(bn) + 2) AS BIGINT) FROM l) AS arena_bytes, (SELECT count(*) FROM events) AS pushes, (SELECT count(DISTINCT user_id) FROM events) AS devices""")
def stats_row(spark: SparkSession, sf: str) -> DataFrame:
    learned = t.few_learned(spark, sf).agg(F.count("*").alias("learned"), F.sum(F.octet_length("en") + F.octet_length("bn") + 2).alias("arena_bytes"))
    events = t.table(spark, sf, "events").agg(F.count("*").alias("pushes"), F.countDistinct("user_id").alias("devices"))
    rows = t.dictionary(spark, sf).agg(F.count("*").alias("dictionary_rows"))
    return rows.crossJoin(learned).crossJoin(events).select("dictionary_rows", "learned", F.lit(2000).alias("learned_capacity"), "arena_bytes", "pushes", "devices")  # three single rows


#: Words that exercise conjuncts, signs, marks and plain letters.
AKSHARA_TEXTS = ["বিজ্ঞান", "ক্ষ", "স্ত্রী", "আমি বাংলায়", "কর্ম", "দুঃখ", "চাঁদ", "রং", "abc 12", "বই"]
_AKSHARA_ROWS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(AKSHARA_TEXTS)) + ") AS t(id, text)"


# Character by character: a sign, a mark or a virama joins what is before it, and so does a consonant after a virama.
@query("akshara_segments", f"""WITH t AS ({_AKSHARA_ROWS}), c AS (SELECT id, i, text[i] AS ch, CASE WHEN i > 1 THEN text[i - 1] END AS before FROM (SELECT id, text, unnest(range(1, CAST(len(list_transform(string_split(text, ''), lambda x: x)) AS BIGINT) + 1)) AS i FROM
 (SELECT id, text FROM t))), j AS (SELECT id, i, ch, CASE WHEN ch IN ('়', '্') OR unicode(ch) BETWEEN 2494 AND 2508 OR unicode(ch) IN (2519, 2530, 2531) OR unicode(ch) BETWEEN 2433 AND 2435 OR (before = '্' AND unicode(ch) BETWEEN 2453 AND 2545) THEN 0 ELSE 1 END AS new FROM c),
 g AS (SELECT id, i, ch, sum(new) OVER (PARTITION BY id ORDER BY i) AS g FROM j) SELECT id, CAST(g - 1 AS INTEGER) AS pos, string_agg(ch, '' ORDER BY i) AS akshara FROM g GROUP BY id, g""")
def akshara_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Orthographic syllables of Bengali test strings."""
    rows = spark.createDataFrame(list(enumerate(AKSHARA_TEXTS)), "id int, text string")
    return rows.select("id", F.posexplode(tf.aksharas(F.col("text"))).alias("pos", "akshara"))


@query("akshara_lines", f"""WITH t AS (SELECT ord AS id, line AS text FROM ({t.IMPORT_SQL})), c AS (SELECT id, i, text[i] AS ch, CASE WHEN i > 1 THEN text[i - 1] END AS before FROM (SELECT id, text, unnest(range(1, CAST(len(list_transform(string_split(text, ''), lambda x: x)) AS BIGINT) + 1)) AS i FROM
 (SELECT id, text FROM t))), j AS (SELECT id, i, ch, CASE WHEN ch IN ('়', '্') OR unicode(ch) BETWEEN 2494 AND 2508 OR unicode(ch) IN (2519, 2530, 2531) OR unicode(ch) BETWEEN 2433 AND 2435 OR (before = '্' AND unicode(ch) BETWEEN 2453 AND 2545) THEN 0 ELSE 1 END AS new FROM c),
 g AS (SELECT id, i, ch, sum(new) OVER (PARTITION BY id ORDER BY i) AS g FROM j) SELECT id, CAST(g - 1 AS INTEGER) AS pos, string_agg(ch, '' ORDER BY i) AS akshara FROM g GROUP BY id, g""")
def akshara_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orthographic syllables of every line of the word lists made of ``part``."""
    return t.import_lines(spark, sf).select(F.col("ord").alias("id"), F.posexplode(tf.aksharas(F.col("line"))).alias("pos", "akshara"))
