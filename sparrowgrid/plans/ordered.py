"""Queries over ordered state: histories, taps, drags, contacts, ring stores, uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered, ring
from . import tables as t

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def pushes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as history pushes; "signup" ones carry no word."""
    e = t.table(spark, sf, "events")
    seq = F.row_number().over(ordered.Window.partitionBy("user_id").orderBy("ts", "event_id"))
    en = F.when(F.col("event_type") == "signup", "").otherwise(F.col("event_type"))
    return e.select(
        F.col("user_id").alias("key"), seq.alias("seq"), en.alias("en"), F.when(en == "", "").otherwise("g").alias("bn"), F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("ocr"),
        F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("src"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


_PUSH = """p AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_type = 'signup' THEN '' ELSE event_type END AS en,
 CASE WHEN event_type = 'signup' THEN '' ELSE 'g' END AS bn, 'o' || event_id AS ocr, 's' || event_id % 4 AS src, strftime(ts, '%Y-%m-%d') AS day FROM events),
 i AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY seq) AS island FROM (
  SELECT *, CASE WHEN lag(en) OVER w IS NOT DISTINCT FROM en AND lag(bn) OVER w IS NOT DISTINCT FROM bn THEN 0 ELSE 1 END AS new FROM p WHERE en <> '' OR bn <> '' WINDOW w AS (PARTITION BY key ORDER BY seq))),
 h AS (SELECT key, min(seq) AS seq, arg_min(en, seq) AS en, arg_min(bn, seq) AS bn, arg_max(ocr, seq) AS ocr, arg_min(src, seq) AS src, arg_min(day, seq) AS day, island FROM i GROUP BY key, island)"""
_LAST = """k AS (SELECT key, seq, en, bn, ocr, src, day, CAST(row_number() OVER (PARTITION BY key ORDER BY island) AS INTEGER) AS pos FROM (
 SELECT *, row_number() OVER (PARTITION BY key ORDER BY island DESC) AS n FROM h) WHERE n <= 48)"""
_ITEMS = """items AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY pos, band DESC) AS INTEGER) AS item, band, CASE WHEN NOT band THEN pos END AS pos, day FROM (
 SELECT key, pos, day, false AS band FROM k UNION ALL
 SELECT key, pos, day, true FROM (SELECT *, lag(day) OVER (PARTITION BY key ORDER BY pos) AS before FROM k) WHERE before IS DISTINCT FROM day))"""


@query("history_dedup", f"WITH {_PUSH} SELECT key, CAST(seq AS INTEGER) AS seq, en, bn, ocr, src, day, CAST(row_number() OVER (PARTITION BY key ORDER BY island) AS INTEGER) AS pos FROM h")
def history_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.history(pushes(spark, sf), None)


@query("history_last48", f"WITH {_PUSH}, {_LAST} SELECT key, CAST(seq AS INTEGER) AS seq, en, bn, ocr, src, day, pos FROM k")
def history_last48(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.history(pushes(spark, sf))


@query("day_bands", f"WITH {_PUSH}, {_LAST}, {_ITEMS} SELECT * FROM items")
def day_bands(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.day_bands(history_last48(spark, sf))


@query("history_page", f"""WITH {_PUSH}, {_LAST}, {_ITEMS}, f AS (SELECT *, sum(CASE WHEN band THEN 18 ELSE 26 END) OVER (PARTITION BY key ORDER BY item) AS used FROM items),
 g AS (SELECT *, lead(item) OVER (PARTITION BY key ORDER BY item) IS NULL AS final FROM f WHERE used <= 240) SELECT key, item, band, pos, day, CAST(used AS BIGINT) AS used FROM g WHERE NOT (final AND band)""")
def history_page(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.page(day_bands(spark, sf), 240, 18, 26)


@query("history_remove", f"WITH {_PUSH}, {_LAST} SELECT key, CAST(seq AS INTEGER) AS seq, en, bn, ocr, src, day, CAST(row_number() OVER (PARTITION BY key ORDER BY seq) AS INTEGER) AS pos FROM k WHERE pos % 5 <> 0")
def history_remove(spark: SparkSession, sf: str) -> DataFrame:
    h = history_last48(spark, sf)
    return ordered.remove(h, h.where("pos % 5 = 0"))


def touches(spark: SparkSession, sf: str) -> DataFrame:
    """Events as taps and samples: time in ms made dense, places from the ids."""
    e = t.table(spark, sf, "events")
    seq = F.row_number().over(ordered.Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return e.select(F.col("user_id").alias("key"), seq.alias("seq"), F.col("event_id").alias("id"), F.col("event_type").alias("kind")).select(
        "key", "seq", (F.col("seq") * 137 + F.col("id") % 400).alias("ms"), (F.col("id") % 97).cast("int").alias("x"), (F.col("id") % 61).cast("int").alias("y"), "kind", "id",
    )


_TOUCH = """tt AS (SELECT key, seq, seq * 137 + id % 400 AS ms, CAST(id % 97 AS INTEGER) AS x, CAST(id % 61 AS INTEGER) AS y, kind, id FROM (
 SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id AS id, event_type AS kind FROM events))"""


@query("double_tap_batch", f"""WITH RECURSIVE {_TOUCH}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n FROM tt),
 f AS (SELECT key, n, seq, ms, x, y, true AS parked, false AS pair FROM o WHERE n = 1 UNION ALL
  SELECT o.key, o.n, o.seq, o.ms, o.x, o.y, NOT (f.parked AND o.ms - f.ms <= 400 AND abs(o.x - f.x) < 50 AND abs(o.y - f.y) < 50),
   f.parked AND o.ms - f.ms <= 400 AND abs(o.x - f.x) < 50 AND abs(o.y - f.y) < 50 FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1)
 SELECT key, seq, ms, x, y, CASE WHEN pair THEN 'double' WHEN lead(pair) OVER (PARTITION BY key ORDER BY n) THEN 'first' ELSE 'single' END AS role FROM f""")
def double_tap_batch(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.taps(touches(spark, sf).select("key", "seq", "ms", "x", "y"))


@query("drag_steps", f"""WITH RECURSIVE {_TOUCH}, o AS (SELECT key, (seq - 1) // 12 AS stroke, seq, (id * 7) % 240 AS y, (seq - 1) % 12 AS n FROM tt),
 f AS (SELECT key, stroke, seq, y AS y0, y AS last, CAST(0 AS BIGINT) AS acc, false AS dragging, CAST(0 AS BIGINT) AS steps, n FROM o WHERE n = 0 UNION ALL
  SELECT key, stroke, seq, y0, y, acc2 - CASE WHEN drag2 THEN CAST(sign(acc2) * (abs(acc2) // 24) AS BIGINT) * 24 ELSE 0 END, drag2, CASE WHEN drag2 THEN CAST(sign(acc2) * (abs(acc2) // 24) AS BIGINT) ELSE 0 END, n FROM (
   SELECT o.key, o.stroke, o.seq, f.y0, o.y, f.acc + o.y - f.last AS acc2, f.dragging OR abs(o.y - f.y0) > 6 AS drag2, o.n FROM f JOIN o ON o.key = f.key AND o.stroke = f.stroke AND o.n = f.n + 1))
 SELECT key, stroke, seq, CAST(steps AS INTEGER) AS steps FROM f""")
def drag_steps(spark: SparkSession, sf: str) -> DataFrame:
    s = touches(spark, sf).select("key", F.floor((F.col("seq") - 1) / 12).alias("stroke"), "seq", ((F.col("id") * 7) % 240).cast("int").alias("y"))
    return ordered.drag_steps(s)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return touches(spark, sf).select("key", "seq", (F.col("seq") * 9 + F.col("id") % 3).alias("ms"), (F.col("kind") != "error").alias("valid"), "x", "y")


@query("debounce_batch", f"""WITH RECURSIVE {_TOUCH}, s AS (SELECT key, seq, seq * 9 + id % 3 AS ms, kind <> 'error' AS valid, x, y FROM tt),
 o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n FROM s),
 f AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, CAST(-1000 AS BIGINT) AS poll, 0 AS conf, false AS down, false AS was, false AS used, CAST(NULL AS BIGINT) AS since, 0 AS gx, 0 AS gy, CAST([] AS INTEGER[]) AS rx, CAST([] AS INTEGER[]) AS ry, 0 AS px, 0 AS py FROM (SELECT DISTINCT key FROM o)
  UNION ALL SELECT key, n, seq, poll, CASE WHEN stuck THEN 0 ELSE conf END, down AND NOT stuck, was, used, CASE WHEN NOT used THEN since WHEN down AND NOT stuck AND NOT was THEN ms WHEN was AND (NOT down OR stuck) THEN NULL ELSE since END, gx, gy,
   CASE WHEN used AND (NOT down OR stuck) THEN [] ELSE rx END, CASE WHEN used AND (NOT down OR stuck) THEN [] ELSE ry END,
   CASE WHEN used AND down AND NOT was THEN CASE len(rx) WHEN 3 THEN list_sort(rx)[2] WHEN 2 THEN (rx[1] + rx[2]) // 2 ELSE gx END ELSE px END,
   CASE WHEN used AND down AND NOT was THEN CASE len(ry) WHEN 3 THEN list_sort(ry)[2] WHEN 2 THEN (ry[1] + ry[2]) // 2 ELSE gy END ELSE py END
  FROM (SELECT *, used AND down AND was AND ms - since > 5000 AS stuck FROM (
   SELECT *, CASE WHEN NOT used THEN was WHEN was THEN conf > 2 ELSE conf >= 4 END AS down FROM (
    SELECT o.key, o.n, o.seq, o.ms, o.ms - f.poll >= 8 AS used, CASE WHEN o.ms - f.poll >= 8 THEN o.ms ELSE f.poll END AS poll, f.down AS was, f.since,
     CASE WHEN o.ms - f.poll < 8 THEN f.conf WHEN o.valid THEN least(8, f.conf + 2) ELSE greatest(0, f.conf - 1) END AS conf,
     CASE WHEN o.ms - f.poll >= 8 AND o.valid THEN o.x ELSE f.gx END AS gx, CASE WHEN o.ms - f.poll >= 8 AND o.valid THEN o.y ELSE f.gy END AS gy,
     CASE WHEN o.ms - f.poll >= 8 AND o.valid AND len(f.rx) < 3 THEN list_append(f.rx, o.x) ELSE f.rx END AS rx, CASE WHEN o.ms - f.poll >= 8 AND o.valid AND len(f.ry) < 3 THEN list_append(f.ry, o.y) ELSE f.ry END AS ry, f.px, f.py
    FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1))))
 SELECT key, seq, CASE WHEN NOT used THEN NULL WHEN down AND NOT was THEN 'press' WHEN was AND NOT down THEN 'release' WHEN down THEN 'move' ELSE 'none' END AS state, down, CAST(conf AS INTEGER) AS conf, CAST(px AS INTEGER) AS press_x, CAST(py AS INTEGER) AS press_y FROM f WHERE n > 0""")
def debounce_batch(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.debounce(samples(spark, sf))


@query("press_median", f"""WITH {_TOUCH}, g AS (SELECT key, (seq - 1) // 10 AS reading, list(x ORDER BY seq) AS xs FROM tt GROUP BY ALL), s AS (SELECT key, reading, list_sort(xs[2:]) AS own FROM g)
 SELECT key, reading, own[len(own) // 2 + 1] AS value FROM s""")
def press_median(spark: SparkSession, sf: str) -> DataFrame:
    g = touches(spark, sf).groupBy("key", F.floor((F.col("seq") - 1) / 10).alias("reading")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x"))), lambda r: r["x"]).alias("xs"))
    return g.select("key", "reading", ordered.median_of(F.col("xs")).alias("value"))


@query("type_query", f"""WITH RECURSIVE {_TOUCH}, k AS (SELECT key, seq, CASE WHEN id % 11 = 0 THEN '!' WHEN id % 5 = 0 THEN '<' ELSE kind[1] END AS char FROM tt),
 f AS (SELECT key, seq, CASE WHEN char IN ('<', '!') THEN '' ELSE char END AS q FROM k WHERE seq = 1 UNION ALL
  SELECT k.key, k.seq, CASE char WHEN '<' THEN left(q, greatest(length(q) - 1, 0)) WHEN '!' THEN '' ELSE CASE WHEN length(q) < 24 THEN q || char ELSE q END END FROM f JOIN k ON k.key = f.key AND k.seq = f.seq + 1)
 SELECT key, seq, q FROM f""")
def type_query(spark: SparkSession, sf: str) -> DataFrame:
    char = F.when(F.col("id") % 11 == 0, "!").when(F.col("id") % 5 == 0, "<").otherwise(F.substring("kind", 1, 1))
    return ordered.type_query(touches(spark, sf).select("key", "seq", char.alias("char")))


@query("live_search_throttle", f"""WITH RECURSIVE {_TOUCH}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n FROM tt),
 f AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS last, CAST(NULL AS BIGINT) AS ran_at, false AS ran FROM (SELECT DISTINCT key FROM o) UNION ALL
  SELECT key, n, seq, CASE WHEN go THEN kind ELSE last END, CASE WHEN go THEN ms ELSE ran_at END, go FROM (
   SELECT o.key, o.n, o.seq, o.kind, o.ms, f.last, f.ran_at, o.kind IS DISTINCT FROM f.last AND (f.ran_at IS NULL OR o.ms - f.ran_at >= 1000) AS go FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1))
 SELECT key, seq, ran FROM f WHERE n > 0""")
def live_search_throttle(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.throttle(touches(spark, sf).select("key", "seq", "ms", F.col("kind").alias("q")))


def writes(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("generation"), F.floor("o_totalprice").alias("bytes"))


_RING = """r AS (SELECT CAST(o_orderkey % 4 AS INTEGER) AS slot, max(o_orderkey) AS generation, arg_max(CAST(floor(o_totalprice) AS BIGINT), o_orderkey) AS bytes FROM orders GROUP BY 1),
 held AS (SELECT slot, generation, '/photo' || slot || '.jpg' AS path, bytes FROM r WHERE bytes > 0)"""


@query("photo_ring_latest", f"WITH {_RING} SELECT * FROM held")
def photo_ring_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ring.latest(writes(spark, sf))


@query("photos_newest_first", f"WITH {_RING} SELECT *, CAST(row_number() OVER (ORDER BY generation DESC) AS INTEGER) AS pos FROM held")
def photos_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    return ring.newest_first(ring.latest(writes(spark, sf)))


@query("photo_recovery", f"WITH {_RING} SELECT CAST(coalesce(max(slot) + 1, 0) AS INTEGER) AS total FROM held")
def photo_recovery(spark: SparkSession, sf: str) -> DataFrame:
    return ring.recovered(ring.latest(writes(spark, sf)))


@query("storage_totals", f"WITH {_RING} SELECT count(*) AS photos, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, CAST(coalesce((sum(bytes) + 1023) // 1024, 0) AS BIGINT) AS kb FROM held")
def storage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ring.totals(ring.latest(writes(spark, sf)))


_TABLE = "list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_PAGE_BYTES = "list_transform(range(0, strlen(html)), lambda i: CAST('0x' || substr(hex(encode(html)), CAST(i * 2 + 1 AS BIGINT), 2) AS BIGINT))"


@query("crc32_check", f"""WITH tb AS MATERIALIZED (SELECT {_TABLE} AS tab) SELECT page_id, CAST(strlen(html) AS BIGINT) AS size,
 xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_PAGE_BYTES}), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) AS crc FROM pages, tb""")
def crc32_check(spark: SparkSession, sf: str) -> DataFrame:
    """CRC-32 of whole blobs; SQL computes it from its own table."""
    return t.table(spark, sf, "pages").select("page_id", F.octet_length("html").cast("long").alias("size"), F.crc32("html").alias("crc"))


def transfers(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as one transfer in pieces, whatever its id: transfer, id, expected, seq, status, data. Some declare a wrong size, some are aborted with their last piece."""
    n, k = F.octet_length("text"), F.col("doc_id")
    size = n + F.when(k % 7 == 0, 5).when(k % 11 == 0, -5).otherwise(0)
    last = F.greatest(F.ceil(n / 1024), F.lit(1)) - 1
    end = F.when(k % 13 == 0, "ABORTED").when(k % 13 != 0, "END")
    own = F.struct(F.monotonically_increasing_id().alias("transfer"), k.alias("id"), size.alias("expected"), last.alias("last"), end.alias("end"))
    chunks = ring.pieces(t.table(spark, sf, "documents").select(own.alias("id"), "text")).select("id.*", "seq", "data")
    status = F.when(F.col("seq") == F.col("last"), F.col("end")).otherwise("WRITE")
    return chunks.select("transfer", "id", "expected", "seq", status.alias("status"), "data")


@query("chunk_assembly", """WITH b AS (SELECT doc_id AS id, strlen(text) AS real FROM documents), e AS (SELECT id, real, real + CASE WHEN id % 7 = 0 THEN 5 WHEN id % 11 = 0 THEN -5 ELSE 0 END AS size, greatest(1, CAST(ceil(real / 1024) AS BIGINT)) AS chunks FROM b)
 SELECT id, CAST(real AS BIGINT) AS received, chunks, CASE WHEN 1024 * (chunks - 1) > size THEN 'overflow' WHEN id % 13 = 0 THEN 'aborted' WHEN real > size THEN 'overflow' WHEN real < size THEN 'short' END AS error, NOT (id % 13 = 0) AND real = size AS complete FROM e""")
def chunk_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return ring.assemble(transfers(spark, sf))
