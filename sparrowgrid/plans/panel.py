"""Queries over the panel's rules and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tf
from ..operators import arrays, decode, geometry, lookup, panel, ring
from . import geometry as g
from . import ordered as o
from . import tables as t
from . import words as wd

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("fit_frame", f"""WITH {g._BOX}, p AS (SELECT frame, box, x1 AS bx, y1 AS y0, x2 - x1 + 1 AS bw, y2 - y1 + 1 AS bh, 480 AS sw, 300 + flags AS sh FROM bx),
 s AS (SELECT *, greatest(1, CASE WHEN bw * sh < bh * sw THEN bw ELSE bh * sw // sh END) AS w, greatest(1, CASE WHEN bw * sh < bh * sw THEN bw * sh // sw ELSE bh END) AS h FROM p)
 SELECT frame, box, CAST(bx + trunc((bw - w) / 2) AS BIGINT) AS x, CAST(y0 + trunc((bh - h) / 2) AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM s""")
def fit_frame(spark: SparkSession, sf: str) -> DataFrame:
    b = g.boxes(spark, sf)
    fit = panel.fit_frame(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1, F.lit(480), F.col("flags") + 300)
    return b.select("frame", "box", fit.alias("f")).select("frame", "box", "f.x", "f.y", "f.w", "f.h")


RECTS = [(k, 10 + 60 * (k % 6), 20 + 40 * (k // 6), 66, 36) for k in range(24)]


@query("button_hit", f"""WITH {g._POINT}, r AS (SELECT * FROM (VALUES {', '.join(map(str, RECTS))}) AS t(rect, x, y, w, h))
 SELECT pid AS tap, CAST(min(rect) AS INTEGER) AS rect FROM pt LEFT JOIN r ON px >= x AND px < x + w AND py >= y AND py < y + h GROUP BY pid""")
def button_hit(spark: SparkSession, sf: str) -> DataFrame:
    rects = spark.createDataFrame(RECTS, "rect int, x int, y int, w int, h int")
    return panel.hit(g.points(spark, sf).select(F.col("pid").alias("tap"), "px", "py"), rects)


@query("touch_map", """SELECT event_id, CAST(least(479, greatest(0, trunc((event_id % 4096 - 300) * 480 / 3500))) AS BIGINT) AS x, CAST(least(319, greatest(0, trunc((event_id * 7 % 4096 - 3800) * 320 / -3400))) AS BIGINT) AS y,
 CASE WHEN event_id % 1000 >= 100 AND event_id % 3001 > event_id % 1000 THEN CAST(greatest(0, floor(((event_id % 3001) / (event_id % 1000) - 1.0) * (event_id % 4096) * 300 / 4095)) AS BIGINT) END AS r FROM events""")
def touch_map(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return t.table(spark, sf, "events").select(
        "event_id", panel.calibrated(i % 4096, F.lit(300), F.lit(3800), 480).alias("x"), panel.calibrated(i * 7 % 4096, F.lit(3800), F.lit(400), 320).alias("y"),
        panel.pressure(i % 4096, F.when(i % 1000 > 0, i % 1000), i % 3001, 300, 4095, 100).alias("r"),
    )


@query("page_top", f"""WITH {o._PUSH}, {o._LAST}, {o._ITEMS}, u AS (SELECT key, item, sum(CASE WHEN band THEN 18 ELSE 26 END) OVER (PARTITION BY key ORDER BY item DESC) AS used FROM items)
 SELECT key, CAST(coalesce(min(item) FILTER (used <= 240), max(item)) AS INTEGER) AS top FROM u GROUP BY key""")
def page_top(spark: SparkSession, sf: str) -> DataFrame:
    items = o.day_bands(spark, sf).select("key", "item", F.when(F.col("band"), 18).otherwise(26).alias("height"))
    return panel.last_page(items, 240)


@query("row_peaks", f"""WITH px AS ({t.PIXELS_SQL}), r AS (SELECT frame, y, max(v) AS peak FROM px GROUP BY frame, y)
 SELECT frame, y, CAST(greatest(max(peak) OVER (PARTITION BY frame ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), max(peak) OVER (PARTITION BY frame) // 4) AS INTEGER) AS reference FROM r""")
def row_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return panel.row_peaks(t.pixels(spark, sf).groupBy("frame", "y").agg(F.max("v").alias("peak")), 1)


@query("rolling_medians", f"""WITH {g._CHAR} SELECT frame AS line, cid AS n, median(cy) OVER (PARTITION BY frame ORDER BY cid ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v, median(cx) OVER (PARTITION BY frame ORDER BY cid ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS h FROM ch""")
def rolling_medians(spark: SparkSession, sf: str) -> DataFrame:
    return panel.rolling(g.chars(spark, sf).select(F.col("frame").alias("line"), F.col("cid").alias("n"), F.col("cy").alias("v"), F.col("cx").alias("h")))


@query("read_all", f"""WITH {g._BOX}, b AS (SELECT frame, box, (flags & 143) = 0 AS ok, CAST(CASE WHEN box % 4 = 3 THEN 2 ELSE 0 END AS INTEGER) AS state FROM bx), n AS (SELECT *, sum(CASE WHEN ok AND state = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY frame ORDER BY box) AS n FROM b)
 SELECT frame, box, CAST(CASE WHEN ok AND state = 0 AND (frame % 2 = 1 OR n <= frame % 3) THEN 2 ELSE state END AS INTEGER) AS state FROM n""")
def read_all(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.decode import recognizable

    b = g.boxes(spark, sf).select("frame", "box", recognizable(F.col("flags")).alias("recognizable"), F.when(F.col("box") % 4 == 3, 2).otherwise(0).alias("state"))
    stops = b.select("frame").distinct().where("frame % 2 = 0").select("frame", (F.col("frame") % 3).alias("after"))
    return panel.read_all(b, stops)


@query("session_guard", f"""WITH {o._TOUCH}, e AS (SELECT key, seq, CASE WHEN kind = 'view' THEN 'frame' ELSE 'request' END AS kind, id % 9 AS session FROM tt),
 c AS (SELECT *, CAST(count(*) FILTER (kind = 'frame') OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS current FROM e) SELECT key, seq, kind, current, CASE WHEN kind <> 'frame' THEN session = current END AS fresh FROM c""")
def session_guard(spark: SparkSession, sf: str) -> DataFrame:
    e = o.touches(spark, sf).select("key", "seq", F.when(F.col("kind") == "view", "frame").otherwise("request").alias("kind"), (F.col("id") % 9).alias("session"))
    return panel.sessions(e)


@query("panel_commands", f"""WITH RECURSIVE {o._TOUCH}, a AS (SELECT key, seq, CASE id % 9 WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 2 THEN 'down' WHEN 3 THEN 'hist' WHEN 4 THEN 'back' WHEN 5 THEN 'search' WHEN 6 THEN 'h' WHEN 7 THEN 'clearhist' ELSE 'x' END AS act FROM tt),
 f AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS seq, 'home' AS page, 0 AS top FROM a UNION ALL SELECT a.key, a.seq,
  CASE WHEN act = 'hist' THEN 'hist' WHEN act = 'back' THEN 'home' WHEN act = 'search' THEN 'search' WHEN act = 'h' AND page = 'hist' THEN 'home' WHEN act = 'h' THEN 'hist' ELSE page END,
  CASE WHEN act = 'up' THEN greatest(top - 4, 0) WHEN act = 'down' THEN top + 4 WHEN act IN ('search', 'clearhist') THEN 0 ELSE top END FROM f JOIN a ON a.key = f.key AND a.seq = f.seq + 1)
 SELECT key, seq, page, top FROM f WHERE seq > 0""")
def panel_commands(spark: SparkSession, sf: str) -> DataFrame:
    act = F.element_at(F.array(*map(F.lit, ["up", "down", "down", "hist", "back", "search", "h", "clearhist", "x"])), (F.col("id") % 9 + 1).cast("int"))
    return panel.commands(o.touches(spark, sf).select("key", "seq", act.alias("action")))


_ACTS = ["up", "down", "capture", "hist", "back", "search", "h", "clearhist", "x", "srhome", "kb", "clear", "new", "snap", "img", "readall", "capture", "cl", "capture"]


def _set(column: str, otherwise: str, **values: str) -> str:
    return "CASE " + " ".join(f"WHEN act IN ({acts}) THEN {value}" for value, acts in values.items()) + f" ELSE {otherwise} END AS {column}"


# The state after each action, each column by the actions that set it.
@query("panel_state", f"""WITH RECURSIVE {o._TOUCH}, a AS (SELECT key, seq, CASE id % {len(_ACTS)} {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_ACTS))} END AS act, 'w' || id % 5 AS word FROM tt),
 f AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS act, false AS img, false AS hist, false AS search, false AS kb, false AS shot, 0 AS n, -1 AS fresh, 0 AS top, CAST(NULL AS VARCHAR) AS last FROM a
 UNION ALL SELECT key, seq, act, img, hist, search, kb, shot, n, fresh, CASE WHEN act = 'x' THEN top ELSE CAST(least(greatest(CASE WHEN act IN ('capture', 'clear', 'cl', 'hist', 'back', 'h', 'new') THEN n + 1 WHEN act = 'clearhist' THEN 0 WHEN act = 'up' THEN top - 4 WHEN act = 'down' THEN top + 4 ELSE top END, 0), greatest(0, n + CASE WHEN n > 0 THEN 1 ELSE 0 END - 8)) AS INTEGER) END, last
 FROM (SELECT key, seq, act, img, hist, search, kb, shot, top, last, n, CASE WHEN act = 'capture' THEN n - 1 WHEN act IN ('clear', 'cl', 'clearhist') THEN -1 ELSE fresh END AS fresh FROM (SELECT a.key, a.seq, a.act, top, fresh,
  {_set("img", "img", false="'search', 'hist', 'back', 'h'", true="'img', 'readall'")}, CASE WHEN act = 'h' THEN NOT hist WHEN act = 'hist' THEN true WHEN act IN ('search', 'back', 'snap', 'img', 'readall') THEN false ELSE hist END AS hist,
  {_set("search", "search", true="'search'", false="'srhome'")}, {_set("kb", "kb", true="'search', 'srhome', 'kb'")}, {_set("shot", "shot", true="'capture'", false="'clear', 'cl', 'clearhist'")},
  CASE WHEN act = 'clearhist' THEN 0 WHEN act = 'capture' AND NOT (n > 0 AND last = word) THEN CAST(least(n + 1, 48) AS INTEGER) ELSE n END AS n, CASE WHEN act = 'clearhist' THEN NULL WHEN act = 'capture' THEN word ELSE last END AS last
  FROM (SELECT f.* EXCLUDE (act, seq), a.act, a.seq, a.word FROM f JOIN a ON a.key = f.key AND a.seq = f.seq + 1) a)))
 SELECT key, seq, act <> 'x' AS known, img, hist, search, kb, shot, CAST(n AS INTEGER) AS n, CAST(fresh AS INTEGER) AS fresh, CAST(top AS INTEGER) AS top FROM f WHERE seq > 0""")
def panel_state(spark: SparkSession, sf: str) -> DataFrame:
    """The whole reducer: pages, keyboard, picture, history and place of the list after every action of each user's panel."""
    act = F.element_at(F.array(*map(F.lit, _ACTS)), (F.col("id") % len(_ACTS) + 1).cast("int"))
    word = F.concat(F.lit("w"), (F.col("id") % 5).cast("string"))
    return panel.reduced(o.touches(spark, sf).select("key", "seq", act.alias("action"), word.alias("word")))


@query("online_translations", """WITH r AS (SELECT p_size AS qid, p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE ' শব্দ' || p_partkey % 13 || ' ' END AS text FROM part),
 f AS (SELECT qid, trim(text) AS text, min(pos) AS pos FROM r WHERE regexp_matches(text, '[ঀ-৿]') GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS rk FROM f)
 SELECT qid, CAST(rk AS INTEGER) AS rk, text FROM n WHERE rk <= 8""")
def online_translations(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit(" শব্দ"), (F.col("p_partkey") % 13).cast("string"), F.lit(" ")))
    return panel.translations(t.table(spark, sf, "part").select(F.col("p_size").alias("qid"), F.col("p_partkey").alias("pos"), text.alias("text")))


_ROW = """'{"en":"' || word || '","bn":"' || meaning || '","src":"' || CASE WHEN from_fts5 THEN 'db/fts5' ELSE 'db/fuzzy' END || '","via":"' || CASE WHEN from_fts5 THEN 'FTS5+BM25' ELSE 'FUZZY-SCAN' END || '","fuzzy":' || printf('%.4f', fuzzy)
 || CASE WHEN bm25 <> 0 THEN ',"bm25":' || printf('%.4f', bm25) ELSE '' END || ',"score":' || printf('%.4f', combined) || '}'"""


@query("search_json", f"{wd._SEARCH} SELECT qid, '[' || string_agg({_ROW}, ',' ORDER BY rk) || ']' AS json FROM rh WHERE rk <= 10 GROUP BY qid")
def search_json(spark: SparkSession, sf: str) -> DataFrame:
    r = lookup.ranked_hybrid(t.queries(spark, sf), t.dictionary(spark, sf)).where("rk <= 10")
    via = F.when(F.col("from_fts5"), "FTS5+BM25").otherwise("FUZZY-SCAN")
    src = F.when(F.col("from_fts5"), "db/fts5").otherwise("db/fuzzy")
    row = panel.search_row(F.col("word"), F.col("meaning"), src, via, F.col("fuzzy"), F.col("bm25"), F.col("combined"))
    return r.select("qid", "rk", row.alias("row")).groupBy("qid").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rk", "row"))), lambda x: x["row"]), ","), F.lit("]")).alias("json"))


@query("import_json", f"""{wd._ROUTE} SELECT '{{"received":' || count(*) || ',"added":' || count(*) FILTER (outcome = 'added') || ',"in_dictionary":' || count(*) FILTER (outcome = 'in_dictionary') || ',"already_learned":' || count(*) FILTER (outcome = 'already_learned')
 || ',"rejected":' || count(*) FILTER (outcome = 'rejected') || ',"no_room":' || count(*) FILTER (outcome = 'no_room') || '}}' AS json FROM routed""")
def import_json(spark: SparkSession, sf: str) -> DataFrame:
    return wd.import_outcome_counts(spark, sf).select(F.to_json(F.struct("received", "added", "in_dictionary", "already_learned", "rejected", "no_room")).alias("json"))


_MIX = "(((t >> {k}) & {m}) * (n * 17) + ((u >> {k}) & {m}) * (255 - n * 17)) // 255"


@query("blend_pixels", f"""WITH px AS ({t.PIXELS_SQL}), c AS (SELECT frame, y, x, v * 251 % 65536 AS u, (255 - v) * 197 % 65536 AS t, v % 16 AS n FROM px)
 SELECT frame, y, x, CAST((({_MIX.format(k=11, m=31)}) << 11) | (({_MIX.format(k=5, m=63)}) << 5) | ({_MIX.format(k=0, m=31)}) AS INTEGER) AS colour FROM c""")
def blend_pixels(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return t.pixels(spark, sf).select("frame", "y", "x", tf.blend565(v * 251 % 65536, (F.lit(255) - v) * 197 % 65536, v % 16).alias("colour"))


@query("box_report", f"WITH {g._BOX} SELECT frame, box, 'BOX ' || box || ' x1=' || x1 || ' y1=' || y1 || ' x2=' || x2 || ' y2=' || y2 || ' flags=' || flags AS line FROM bx")
def box_report(spark: SparkSession, sf: str) -> DataFrame:
    return g.boxes(spark, sf).select("frame", "box", decode.box_line().alias("line"))


@query("read_ndjson", f"WITH {g._BOX}, n AS (SELECT frame, count(*) AS n FROM bx GROUP BY frame) SELECT frame, 'begin' AS event, n AS total, CAST(NULL AS INTEGER) AS box, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS recognized FROM n UNION ALL SELECT frame, NULL, NULL, box, CASE WHEN flags = 7 THEN 'ocr_error' ELSE 'ok' END, NULL FROM bx UNION ALL SELECT frame, 'done', NULL, NULL, NULL, n FROM n")
def read_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    lines = g.recognize_ndjson(spark, sf).select("frame", F.explode(F.array(F.col("line"), F.lit(" "), F.lit("{broken"))).alias("value"))
    return decode.read_ndjson(lines)


@query("paint_out", f"""WITH px AS ({t.PIXELS_SQL}) SELECT frame, y, x, CASE WHEN (y * 8 + x) % 5 <> 0 AND (y * 8 + x) % 5 % 3 <> 1 THEN 255 ELSE v END AS v FROM px""")
def paint_out(spark: SparkSession, sf: str) -> DataFrame:
    """Labels 0..4 by place; label 0 is shared, the others belong to word label % 3; all but word 1 is painted out."""
    px = t.pixels(spark, sf).withColumn("label", ((F.col("y") * 8 + F.col("x")) % 5).cast("int"))
    owners = px.select("frame", "label").distinct().where("label <> 0").withColumn("owner", F.col("label") % 3)
    return geometry.paint_out(px, owners, 1)


@query("stalled_uploads", """WITH c AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id * 70 AS ms FROM events), w AS (SELECT *, ms - lag(ms) OVER (PARTITION BY id ORDER BY seq) AS waited FROM c)
 SELECT id, min(seq) AS seq, arg_min(waited, seq) AS waited FROM w WHERE waited > 5000 GROUP BY id""")
def stalled_uploads(spark: SparkSession, sf: str) -> DataFrame:
    e = t.table(spark, sf, "events")
    seq = F.row_number().over(o.ordered.Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return ring.stalled(e.select(F.col("user_id").alias("id"), seq.alias("seq"), (F.col("event_id") * 70).alias("ms"), F.lit("WRITE").alias("status")))


@query("bilinear_sample", f"""WITH px AS MATERIALIZED ({t.PIXELS_SQL}), d AS (SELECT unnest(range(0, 12)) AS d), k AS (SELECT d, greatest(0, least(7 << 16, (2 * d + 1) * 8 * 32768 // 12 - 32768)) AS q FROM d),
 c AS (SELECT d, q >> 16 AS a, least((q >> 16) + 1, 7) AS b, q & 65535 AS w FROM k)
 SELECT p.frame, CAST(cy.d AS INTEGER) AS y, CAST(cx.d AS INTEGER) AS x, CAST(((p.v * (65536 - cx.w) + q.v * cx.w) * (65536 - cy.w) + (r.v * (65536 - cx.w) + s.v * cx.w) * cy.w + 2147483648) >> 32 AS INTEGER) AS v
 FROM c cy, c cx JOIN px p ON p.y = cy.a AND p.x = cx.a JOIN px q ON q.frame = p.frame AND q.y = cy.a AND q.x = cx.b JOIN px r ON r.frame = p.frame AND r.y = cy.b AND r.x = cx.a JOIN px s ON s.frame = p.frame AND s.y = cy.b AND s.x = cx.b""")
def bilinear_sample(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.bilinear(t.frames(spark, sf), (t.SIDE, t.SIDE), (12, 12))

