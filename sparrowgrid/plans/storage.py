"""Sources, sinks and small rules at rest: what the device keeps in files, as tables written and read back."""

from __future__ import annotations

import sqlite3
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tf
from ..operators import arrays, ordered, panel, ring
from ..sources import frames, words
from ..streaming.stateful import place
from . import ordered as od
from . import tables as t

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# word lists


@query("learned_file", f"""SELECT CAST(row_number() OVER (ORDER BY seq) - 1 AS BIGINT) AS seq, en, bn FROM ({t.FEW_LEARNED_SQL})""")
def learned_file(spark: SparkSession, sf: str) -> DataFrame:
    """A store exported as one TSV file, and loaded again in its order."""
    path = place(spark)
    words.export_learned(t.few_learned(spark, sf), path)
    return words.load_learned(spark, path)


@query("learned_append", f"""WITH s AS ({t.FEW_LEARNED_SQL}) SELECT en, bn, count(*) AS n FROM (SELECT en, bn FROM s UNION ALL SELECT lower(en), 'again' FROM s WHERE seq % 2 = 0) GROUP BY en, bn""")
def learned_append(spark: SparkSession, sf: str) -> DataFrame:
    """Rows appended to the file of a store; nothing is freed of duplicates."""
    path, store = place(spark), t.few_learned(spark, sf)
    words.export_learned(store, path)
    words.append_learned(store.where("seq % 2 = 0").select("en", F.lit("again").alias("bn")), path)
    return words.load_learned(spark, path).groupBy("en", "bn").count().withColumnRenamed("count", "n")


@query("learned_then_found", f"""WITH s AS ({t.FEW_LEARNED_SQL}), n AS (SELECT p_type AS en, min(p_partkey) AS k FROM part GROUP BY p_type)
 SELECT lower(en) AS en, 'taught' AS bn, CAST(1025 AS INTEGER) AS score FROM n WHERE lower(en) NOT IN (SELECT en FROM s)""")
def learned_then_found(spark: SparkSession, sf: str) -> DataFrame:
    """Words taught one after the other, decided in one plan, are found by the next query, the store being read anew."""
    from ..operators import lookup

    path = place(spark)
    words.export_learned(t.few_learned(spark, sf), path)
    kinds = t.table(spark, sf, "part").groupBy(F.col("p_type").alias("en")).agg(F.min("p_partkey").alias("ord"))
    words.append_learned(words.learn_all(words.load_learned(spark, path), kinds.withColumn("bn", F.lit("taught"))), path)
    asked = kinds.select(F.col("ord").alias("qid"), F.col("en").alias("q"))
    return lookup.top_learned(asked, words.load_learned(spark, path), 1).select("en", "bn", F.col("score").cast("int").alias("score"))


@query("sqlite_dictionary", f"SELECT no, word, meaning FROM ({t.DICTIONARY_SQL})")
def sqlite_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary as a SQLite file, read by ranges of its rows. The file is made here, so this query needs driver and executors on one machine."""
    path = str(Path(tempfile.mkdtemp(prefix="dictionary-")) / "dictionary.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE dictionary (no INTEGER, word TEXT, meaning TEXT)")
        db.executemany("INSERT INTO dictionary VALUES (?, ?, ?)", t.dictionary(spark, sf).select("no", "word", "meaning").toLocalIterator())
    return words.open_dictionary(spark, path)


@query("dictionary_rows", f"SELECT count(*) AS n, CAST(-1 AS BIGINT) AS absent FROM ({t.DICTIONARY_SQL})")
def dictionary_rows(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(words.row_count(t.dictionary(spark, sf)), words.row_count(None))], "n long, absent long")


# frames and blobs

_BYTES = f"px AS ({t.PIXELS_SQL}), fb AS (SELECT frame, string_agg(printf('%02X', v), '' ORDER BY y, x) AS h FROM px GROUP BY frame)"


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    """(frame, pixels): frames as bytes."""
    hexed = F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v), 2, "0")), "")
    return t.frames(spark, sf).select("frame", F.unhex(hexed).alias("pixels"))


@query("frame_errors", """SELECT vec_id AS frame, CASE WHEN vec_id % 11 = 0 OR vec_id % 7 > 5 THEN 'dimensions' WHEN vec_id % 5 = 0 THEN 'length' WHEN vec_id % 3 = 0 THEN 'crc' END AS error FROM embeddings WHERE len(embedding) = 64""")
def frame_errors(spark: SparkSession, sf: str) -> DataFrame:
    """What a reader of raw frames says of wrong sizes, lengths and checksums."""
    k, crc = F.col("frame"), F.crc32("pixels")
    w = F.when(k % 11 == 0, F.lit(None)).when(k % 7 > 5, frames.WIDTH + 1).otherwise(8)
    size = F.octet_length("pixels") + F.when(k % 5 == 0, 1).otherwise(0)
    return blobs(spark, sf).select("frame", frames.frame_error(w, F.lit(8), size, F.when(k % 3 == 0, crc + 1).otherwise(crc), crc).alias("error"))


@query("frame_hex_dump", f"WITH {_BYTES} SELECT frame, array_to_string(list_transform(range(0, 8), lambda r: substr(h, CAST(r * 16 + 1 AS BIGINT), 16)), chr(10)) AS dump FROM fb")
def frame_hex_dump(spark: SparkSession, sf: str) -> DataFrame:
    return blobs(spark, sf).select("frame", frames.hex_dump(F.col("pixels"), 8).alias("dump"))


@query("frame_bytes", f"WITH px AS ({t.PIXELS_SQL}) SELECT frame, CAST(y * 8 + x AS INTEGER) AS i, v FROM px")
def frame_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return blobs(spark, sf).select("frame", F.posexplode(frames.pixel_array(F.col("pixels"))).alias("i", "v"))


_HEAD = "424D" + "F6000000" + "00000000" + "36000000" + "28000000" + "08000000" + "08000000" + "01001800" + "00" * 24


@query("frame_bitmap", f"""WITH px AS ({t.PIXELS_SQL}), c AS (SELECT frame, y, x, v * 257 AS c FROM px),
 r AS (SELECT frame, y, string_agg(printf('%02X%02X%02X', (c & 31) << 3, ((c >> 5) & 63) << 2, ((c >> 11) & 31) << 3), '' ORDER BY x) AS h FROM c GROUP BY frame, y)
 SELECT frame, '{_HEAD}' || string_agg(h, '' ORDER BY y DESC) AS bitmap FROM r GROUP BY frame""")
def frame_bitmap(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of RGB565 values as 24-bit bitmaps, in hexadecimal."""
    px = t.frames(spark, sf).select("frame", F.transform("px", lambda v: v * 257).alias("c"))
    return px.select("frame", F.hex(frames.bmp(F.col("c"), t.SIDE, t.SIDE)).alias("bitmap"))


_TABLE = "list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes}), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])))"


@query("install_check", f"""WITH px AS ({t.PIXELS_SQL}), fb AS (SELECT frame, list(CAST(v AS BIGINT) ORDER BY y, x) AS b FROM px GROUP BY frame), tb AS MATERIALIZED (SELECT {_TABLE} AS tab)
 SELECT frame, CAST(64 AS INTEGER) AS received, {_CRC.format(bytes='b')} AS crc, CASE WHEN frame % 5 = 0 THEN 'size' WHEN frame % 3 = 0 THEN 'crc' END AS error FROM fb, tb""")
def install_check(spark: SparkSession, sf: str) -> DataFrame:
    """Received files against the size and CRC-32 that were announced; the sum is SQL's own, table and all."""
    size, crc = F.octet_length("content") + F.when(F.col("frame") % 5 == 0, 1).otherwise(0), F.crc32("content") + F.when(F.col("frame") % 3 == 0, 1).otherwise(0)
    staged = blobs(spark, sf).withColumnRenamed("pixels", "content")
    return frames.installed(staged, size, crc).select("frame", "received", F.crc32("content").alias("crc"), "error")


@query("crc_of_chunks", f"""WITH tb AS MATERIALIZED (SELECT {_TABLE} AS tab), d AS (SELECT item_id AS id, list_transform(range(0, strlen(text)), lambda i: CAST('0x' || substr(hex(encode(text)), CAST(i * 2 + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM benchmark)
 SELECT id, CAST(greatest(1, ceil(len(b) / 50)) AS BIGINT) AS chunks, {_CRC.format(bytes='b')} AS crc FROM d, tb""")
def crc_of_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A transfer's checksum carried from chunk to chunk, as it arrives in pieces of 50 bytes."""
    chunks = ring.pieces(t.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), 50)
    return ring.chained_crc(chunks)


# settings, commands, replies


@query("settings", """WITH s AS (SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS value FROM nation WHERE n_nationkey % 2 = 0) SELECT n_name AS name, coalesce(value, 1000) AS value FROM nation LEFT JOIN s ON n_name = name""")
def settings(spark: SparkSession, sf: str) -> DataFrame:
    """Saved settings over their defaults, written and read back."""
    rows = [(r[0], r[1]) for r in t.table(spark, sf, "nation").select("n_name", "n_nationkey").orderBy("n_nationkey").collect()]  # 25 settings
    path = place(spark)
    frames.save_settings({k: int(v) for k, v in rows if v % 2 == 0}, spark, path)
    return frames.settings(spark.read.parquet(path), {k: 1000 for k, _ in rows})


@query("settings_of_another_version", "SELECT n_name AS name, CAST(1000 AS BIGINT) AS value FROM nation")
def settings_of_another_version(spark: SparkSession, sf: str) -> DataFrame:
    names = [r[0] for r in t.table(spark, sf, "nation").select("n_name").collect()]  # 25 settings
    path = place(spark)
    frames.save_settings(dict.fromkeys(names, 5), spark, path, version=1)
    return frames.settings(spark.read.parquet(path), dict.fromkeys(names, 1000))


@query("cleared_store", f"SELECT count(*) AS held, CAST(0 AS BIGINT) AS after FROM ({t.FEW_LEARNED_SQL})")
def cleared_store(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark)
    t.few_learned(spark, sf).write.parquet(path)
    held = frames.clear(spark, path)
    return spark.createDataFrame([(held, spark.read.parquet(path).count())], "held long, after long")


_LINE = "CASE WHEN event_id % 7 = 0 THEN '  ' ELSE ' F ' || event_id || ' ' || printf('%x', event_id * 31) || ' ' END"


@query("serial_commands", f"""WITH l AS (SELECT event_id, trim({_LINE}) AS line FROM events) SELECT line[1] AS command, trim(substr(line, 2)) AS argument, event_id AS size, event_id * 31 AS crc FROM l WHERE line <> ''""")
def serial_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Command lines and the header of the transfer that they announce."""
    k = F.col("event_id")
    line = F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" F "), k.cast("string"), F.lit(" "), F.lower(F.hex(k * 31)), F.lit(" ")))
    c = frames.commands(t.table(spark, sf, "events").select(line.alias("value")))
    size, crc = frames.transfer_header(F.col("argument"))
    return c.select("command", "argument", size.alias("size"), crc.alias("crc"))


_HELD = "WITH r AS (SELECT CAST(o_orderkey % 4 AS INTEGER) AS slot, max(o_orderkey) AS generation, arg_max(CAST(floor(o_totalprice) AS BIGINT), o_orderkey) AS bytes FROM orders GROUP BY 1)"


@query("photo_list_json", _HELD + """ SELECT '{"count":' || count(*) || ',"photos":[' || string_agg('{"path":"/photo' || slot || '.jpg","bytes":' || bytes || ',"generation":' || generation || '}', ',' ORDER BY generation DESC) || ']}' AS json FROM r WHERE bytes > 0""")
def photo_list_json(spark: SparkSession, sf: str) -> DataFrame:
    return ring.list_json(ring.newest_first(ring.latest(od.writes(spark, sf))))


@query("error_json", """SELECT event_id, '{"ok":false,"error":"' || event_type || ' \\"x\\" failed"}' AS json FROM events""")
def error_json(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "events").select("event_id", panel.error_json(F.concat("event_type", F.lit(' "x" failed'))).alias("json"))


@query("detector_report", """SELECT p_partkey AS box, 'CAND ' || p_partkey % 4 || ' ' || p_name || ' -> ' || p_type || ' score=' || printf('%.3f', p_size / 50.0) AS cand, 'URUN chars=' || length(p_name) || ' unread=' || p_size AS urun FROM part""")
def detector_report(spark: SparkSession, sf: str) -> DataFrame:
    p, k = t.table(spark, sf, "part"), F.col("p_partkey")
    return p.select(k.alias("box"), panel.candidate_line(k % 4, F.col("p_name"), F.col("p_type"), F.col("p_size") / 50.0).alias("cand"), panel.run_line(F.length("p_name"), F.col("p_size")).alias("urun"))


# small numbers and texts


@query("whole_quotients", "SELECT p_partkey AS k, least(greatest(p_size, 10), 40) AS clamped, CAST((p_partkey + p_size - 1) // p_size AS BIGINT) AS up, CAST((p_partkey + p_size // 2) // p_size AS BIGINT) AS nearest FROM part")
def whole_quotients(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    return t.table(spark, sf, "part").select(k.alias("k"), tf.clamp(n, 10, 40).alias("clamped"), tf.ceil_div(k, n).alias("up"), tf.round_div(k, n).alias("nearest"))


@query("gaussian_kernels", """WITH s AS (SELECT DISTINCT p_size AS n FROM part), r AS (SELECT n, 0.4 + n / 10.0 AS sigma, 1 + n // 8 AS radius FROM s), x AS (SELECT *, unnest(range(-radius, radius + 1)) AS i FROM r),
 e AS (SELECT *, exp(-0.5 * (i / CAST(sigma AS DOUBLE)) * (i / CAST(sigma AS DOUBLE))) AS g FROM x), f AS (SELECT n, radius, i, CAST(floor(g / sum(g) OVER (PARTITION BY n) * 32768 + 0.5) AS BIGINT) AS q FROM e)
 SELECT n, CAST(i AS INTEGER) AS i, q + CASE WHEN i = 0 THEN 32768 - CAST(sum(q) OVER (PARTITION BY n) AS BIGINT) ELSE 0 END AS q FROM f""")
def gaussian_kernels(spark: SparkSession, sf: str) -> DataFrame:
    sizes = [r[0] for r in t.table(spark, sf, "part").select("p_size").distinct().collect()]  # fifty sizes
    rows = [(n, i - (1 + n // 8), q) for n in sizes for i, q in enumerate(arrays.gaussian_q15(0.4 + n / 10.0, 1 + n // 8))]
    return spark.createDataFrame(rows, "n int, i int, q long").withColumn("n", F.col("n").cast(dict(t.table(spark, sf, "part").dtypes)["p_size"]))


_ADVANCES = "list_transform(range(1, length(p_name) + 1), lambda i: CAST(4 + ascii(p_name[i]) % 7 AS BIGINT))"


@query("clipped_runs", f"""WITH a AS (SELECT p_partkey AS k, p_size AS budget, {_ADVANCES} AS a FROM part), s AS (SELECT *, CAST(list_sum(a) AS BIGINT) AS width, list_transform(range(1, len(a) + 1), lambda n: list_sum(a[1:n])) AS upto FROM a)
 SELECT k, width, CAST(CASE WHEN width <= budget THEN len(a) ELSE len(list_filter(upto, lambda x: x <= budget - 5)) END AS INTEGER) AS kept FROM s""")
def clipped_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Widths of runs of glyphs, and how many of each fit with an ellipsis."""
    a = F.transform(F.split("p_name", ""), lambda c: (F.lit(4) + F.ascii(c) % 7).cast("long"))
    p = t.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_size", a.alias("a"))
    return p.select("k", tf.run_width(F.col("a")).alias("width"), tf.clip_prefix(F.col("a"), F.col("p_size").cast("long"), 5).alias("kept"))


@query("leading_numbers", r"""SELECT k, coalesce(TRY_CAST(regexp_extract(s, '^[ \t]*([+-]?[0-9]+)', 1) AS INTEGER), 0) AS n FROM (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN ' -' || p_size || 'px' WHEN 1 THEN p_name WHEN 2 THEN '99999999999' ELSE '+' || p_size END AS s FROM part)""")
def leading_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    s = F.when(k % 4 == 0, F.concat(F.lit(" -"), n, F.lit("px"))).when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, "99999999999").otherwise(F.concat(F.lit("+"), n))
    return t.table(spark, sf, "part").select(k.alias("k"), tf.leading_int(s).alias("n"))


@query("byte_order", f"SELECT qid, CAST(row_number() OVER (PARTITION BY length(q) ORDER BY encode(q), qid) AS INTEGER) AS rk FROM ({t.QUERIES_SQL})")
def byte_order(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each length in the order of their bytes."""
    return t.queries(spark, sf).select("qid", F.row_number().over(Window.partitionBy(F.length("q")).orderBy(F.encode("q", "UTF-8"), "qid")).alias("rk"))


@query("decoded_texts", """SELECT doc_id, length(text) AS characters, length(regexp_replace(text, '[^ঀ-৿]', '', 'g')) AS bengali FROM documents WHERE text IS NOT NULL""")
def decoded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes decoded to code points; malformed ones become U+FFFD each."""
    points = tf.code_points(F.encode("text", "UTF-8"))
    return t.table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(points).cast("long").alias("characters"), F.size(F.filter(points, lambda p: p.between(0x980, 0x9FF))).cast("long").alias("bengali"))


@query("height_medians", f"""WITH ln AS (SELECT item_id AS frame, length(text) AS n FROM benchmark) SELECT frame, CAST(18 AS INTEGER) AS height_x2, CAST(0 AS INTEGER) AS flagged FROM ln""")
def height_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Twice the median height of each drawn page's words; letters are nine rows high."""
    from ..operators import vision
    from .vision import pages

    boxes = vision.detect(pages(spark, sf))
    twice = arrays.medians(F.collect_list(F.col("ink_y2") - F.col("ink_y1") + 1))["x2"]
    return boxes.groupBy("frame").agg(twice.cast("int").alias("height_x2"), F.count_if(F.col("flags") != 0).cast("int").alias("flagged"))


# taps


_PRESS = "pr AS (SELECT user_id AS key, event_id AS seq, event_id * 37 % 480 AS px, event_id * 53 % 320 AS py, event_id * 37 % 480 + event_id % 41 - 20 AS x, event_id * 53 % 320 + event_id % 53 - 26 AS y FROM events)"


@query("deliberate_taps", f"""WITH {_PRESS}, b AS (SELECT *, CASE WHEN py >= 280 THEN px // 120 ELSE -1 END AS held, CASE WHEN y >= 280 AND y < 320 AND x >= 0 AND x < 480 THEN x // 120 ELSE -1 END AS under FROM pr)
 SELECT key, seq, CASE WHEN held >= 0 AND held = under THEN 'button' WHEN held >= 0 THEN 'none' WHEN abs(x - px) < 28 AND abs(y - py) < 22 THEN 'tap' ELSE 'slide' END AS what, CAST(CASE WHEN held >= 0 AND held = under THEN held END AS INTEGER) AS target,
  CASE WHEN held < 0 AND abs(x - px) < 28 AND abs(y - py) < 22 THEN px END AS tap_x, CASE WHEN held < 0 AND abs(x - px) < 28 AND abs(y - py) < 22 THEN py END AS tap_y FROM b""")
def deliberate_taps(spark: SparkSession, sf: str) -> DataFrame:
    """Releases against their presses, over four buttons at the foot of the screen."""
    k = F.col("event_id")
    e = t.table(spark, sf, "events").select(F.col("user_id").alias("key"), k.alias("seq"), (k * 37 % 480).alias("press_x"), (k * 53 % 320).alias("press_y"))
    e = e.withColumn("x", F.col("press_x") + F.col("seq") % 41 - 20).withColumn("y", F.col("press_y") + F.col("seq") % 53 - 26)
    rects = spark.createDataFrame([(i, 120 * i, 280, 120, 40) for i in range(4)], "rect int, x int, y int, w int, h int")
    return ordered.releases(e, rects)
