"""Streaming forms of the batch queries; each has the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import photos
from ..streaming import lookup, stateful, transfers
from . import ordered as batch
from . import words as batch_words
from . import tables as t

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _stream(spark: SparkSession, rows: DataFrame, path: str | None = None) -> DataFrame:
    """The twin's input, written to a folder and followed."""
    path = path or stateful.place(spark) + "/in"
    rows.write.parquet(path)
    return stateful.follow(spark, path)


@query("stream_debounce", batch.ORACLES["debounce_batch"])
def stream_debounce(spark: SparkSession, sf: str) -> DataFrame:
    return stateful.drain(stateful.run_machine(_stream(spark, batch.samples(spark, sf)), "debounce"))


@query("stream_double_tap", f"SELECT key, seq, role = 'double' AS double FROM ({batch.ORACLES['double_tap_batch']})")
def stream_double_tap(spark: SparkSession, sf: str) -> DataFrame:
    return stateful.drain(stateful.run_machine(_stream(spark, batch.touches(spark, sf)), "double_tap"))


@query("stream_live_search", batch.ORACLES["live_search_throttle"])
def stream_live_search(spark: SparkSession, sf: str) -> DataFrame:
    return stateful.drain(stateful.run_machine(_stream(spark, batch.touches(spark, sf).withColumnRenamed("kind", "q")), "live_search"))


@query("stream_upload", f"SELECT id AS key, received, error, complete FROM ({batch.ORACLES['chunk_assembly']})")
def stream_upload(spark: SparkSession, sf: str) -> DataFrame:
    """Transfers have their own numbers, which meet the ids again afterwards: ids may repeat."""
    pieces = batch.transfers(spark, sf).select(F.col("transfer").alias("key"), "id", F.col("seq").cast("long").alias("seq"), F.coalesce("status", F.lit("END")).alias("status"), F.octet_length("data").alias("size"), "expected")
    path = stateful.place(spark) + "/in"
    stream = _stream(spark, pieces, path)
    done = stateful.drain(stateful.run_machine(stream.drop("id"), "upload", stateful.SHARDS))
    ids = spark.read.parquet(path).where("seq = 0").select("key", "id")
    return done.join(ids, "key").select(F.col("id").alias("key"), "received", "error", F.when(F.col("id").isNotNull(), F.col("complete")).alias("complete"))


@query("stream_history", f"""WITH {batch._PUSH} SELECT key, seq, CAST(least(48, island) AS INTEGER) AS held, en AS "last", ocr FROM i""")
def stream_history(spark: SparkSession, sf: str) -> DataFrame:
    """After each push: how many entries are held, and the last."""
    return stateful.drain(stateful.run_machine(_stream(spark, batch.pushes(spark, sf)), "history"))


@query("stream_windows", "SELECT * FROM (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY event_type, date_trunc('hour', ts)) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Event-time windows of an hour under a watermark of ten minutes; windows still open at the end are not given out."""
    e = _stream(spark, t.table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts")))
    n = e.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "event_type").count()
    out = stateful.drain(n.select("event_type", F.col("window.start").alias("hour"), F.col("count").alias("n")))
    return out.select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "n")


# A single tap fires at its device's next tap, or when time has gone on for 400 ms.
@query("stream_single_taps", f"""WITH RECURSIVE {batch._TOUCH}, r AS (SELECT key, seq, role FROM ({batch.ORACLES['double_tap_batch']})), o AS (SELECT key, seq, ms, lead(seq) OVER (PARTITION BY key ORDER BY ms, seq) AS later FROM tt)
 SELECT key, seq, role = 'double' AS double FROM r JOIN o USING (key, seq) WHERE role = 'double' OR (role = 'single' AND (later IS NOT NULL OR ms + 401 < (SELECT max(ms) FROM tt)))""")
def stream_single_taps(spark: SparkSession, sf: str) -> DataFrame:
    """Taps as they fire: a pair at its second tap, a single one when 400 ms passed without a partner, by event time."""
    return stateful.drain(stateful.run_taps(_stream(spark, batch.touches(spark, sf))))


@query("stream_stalled", """WITH e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id * 70 + 1000 AS ms FROM events), w AS (SELECT *, lead(ms) OVER (PARTITION BY key ORDER BY seq) AS after FROM e),
 d AS (SELECT *, sum(CASE WHEN after - ms > 5000 OR after IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS broken FROM w)
 SELECT key, count(*) AS received, 'timeout' AS error FROM d WHERE coalesce(broken, 0) = 0 GROUP BY key HAVING bool_or(after - ms > 5000) OR max(ms) + 5001 < (SELECT max(ms) FROM e)""")
def stream_stalled(spark: SparkSession, sf: str) -> DataFrame:
    """Transfers of pieces that never end: each is given up 5 s after its last piece in time, by a timer. (Nothing stands at time zero, where the watermark begins.)"""
    e = t.table(spark, sf, "events")
    seq = F.row_number().over(batch.ordered.Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    pieces = e.select(F.col("user_id").alias("key"), seq.alias("seq"), (F.col("event_id") * 70 + 1000).alias("ms"), F.lit("WRITE").alias("status"))
    return stateful.drain(stateful.run_transfers(_stream(spark, pieces)))


@query("stream_answers", batch_words.ORACLES["learned_topk"].replace("rk <= 6", "rk <= 10"))
def stream_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Queries that arrive in micro-batches, ranked against the store as it is then."""
    return lookup.answers_of(_stream(spark, t.queries(spark, sf)), lambda: t.learned(spark, sf), stateful.place(spark)).select("qid", "rk", "en", "bn", F.col("score").cast("int").alias("score"))


@query("stream_import", f"{batch_words._ROUTE} SELECT lower(en) AS en, bn FROM routed WHERE outcome = 'added'")
def stream_import(spark: SparkSession, sf: str) -> DataFrame:
    """Word lists that land in a folder are imported file by file; what was learned is in the store's file afterwards."""
    return lookup.imported(_stream(spark, t.import_lines(spark, sf).withColumn("file", F.lit("a"))), t.few_learned(spark, sf), t.dictionary(spark, sf), stateful.place(spark), batch_words.CAPACITY)


@query("stream_mailbox", "SELECT user_id % 16 AS slot, max(event_id) AS generation, count(*) - 1 AS replaced FROM events GROUP BY 1")
def stream_mailbox(spark: SparkSession, sf: str) -> DataFrame:
    """A single-slot mailbox for each writer: what is put in replaces what was not taken."""
    e = t.table(spark, sf, "events").select((F.col("user_id") % 16).alias("slot"), F.col("event_id").alias("generation"))
    return stateful.mailbox(_stream(spark, e), stateful.place(spark))


@query("stream_tap_queue", "SELECT user_id AS key, event_id AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS waited FROM events")
def stream_tap_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Taps queue while one request of their device is in flight; each waits for those before it."""
    e = t.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"))
    return stateful.drain(stateful.run_machine(_stream(spark, e), "tap_queue"))


_SCREEN = "SELECT user_id AS key, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'reply' WHEN 'error' THEN 'reply' WHEN 'signup' THEN CASE WHEN event_id % 7 = 0 THEN 'capture' ELSE 'reply' END ELSE 'tap' END AS kind, CAST(event_id % 9 AS INTEGER) AS box FROM events"


@query("stream_tap_replies", f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM ({_SCREEN})),
 r AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS told, CAST(NULL AS INTEGER) AS box, CAST(NULL AS VARCHAR) AS sent, CAST([] AS INTEGER[]) AS rd, CAST([] AS INTEGER[]) AS qu, CAST([] AS INTEGER[]) AS fl FROM (SELECT DISTINCT key FROM e)
  UNION ALL SELECT key, n, seq, told, box, CASE WHEN len(fl) = 0 AND len(qu) > 0 THEN array_to_string(list_sort(qu), ' ') END, rd, CASE WHEN len(fl) = 0 THEN CAST([] AS INTEGER[]) ELSE qu END, CASE WHEN len(fl) = 0 THEN list_sort(qu) ELSE fl END
  FROM (SELECT e.key, e.n, e.seq,
    CASE e.kind WHEN 'capture' THEN 'captured' WHEN 'tap' THEN CASE WHEN list_contains(rd, e.box) THEN 'read' WHEN list_contains(qu, e.box) OR list_contains(fl, e.box) THEN 'pending' ELSE 'queued' END ELSE CASE WHEN len(fl) > 0 THEN 'answered' ELSE 'stray' END END AS told,
    CASE e.kind WHEN 'tap' THEN e.box WHEN 'reply' THEN fl[1] END AS box,
    CASE e.kind WHEN 'capture' THEN CAST([] AS INTEGER[]) WHEN 'reply' THEN list_concat(rd, fl[1:1]) ELSE rd END AS rd,
    CASE WHEN e.kind = 'capture' THEN CAST([] AS INTEGER[]) WHEN e.kind = 'tap' AND NOT (list_contains(rd, e.box) OR list_contains(qu, e.box) OR list_contains(fl, e.box)) THEN list_append(qu, e.box) ELSE qu END AS qu,
    CASE e.kind WHEN 'capture' THEN CAST([] AS INTEGER[]) WHEN 'reply' THEN fl[2:] ELSE fl END AS fl
   FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))
 SELECT key, seq, told, box, sent, CAST(len(qu) AS INTEGER) AS queued, CAST(len(fl) AS INTEGER) AS flying FROM r WHERE n > 0""")
def stream_tap_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Taps of each user's screen and the replies to them, as one stream: what waits, what is sent when the one request in flight has ended."""
    e = t.table(spark, sf, "events")
    kind = (
        F.when(F.col("event_type").isin("purchase", "error"), "reply").when((F.col("event_type") == "signup") & (F.col("event_id") % 7 == 0), "capture")
        .when(F.col("event_type") == "signup", "reply").otherwise("tap")
    )
    return stateful.drain(stateful.run_machine(_stream(spark, e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 9).cast("int").alias("box"))), "reader"))


@query("stream_slot_takes", """WITH e AS (SELECT user_id AS key, event_id AS seq, event_type IN ('purchase', 'error') AS take FROM events),
 l AS (SELECT *, lag(take) OVER w AS before, lag(seq) OVER w AS last FROM e WINDOW w AS (PARTITION BY key ORDER BY seq)), h AS (SELECT *, CASE WHEN before = false THEN last END AS held FROM l)
 SELECT key, seq, CASE WHEN take THEN CASE WHEN held IS NULL THEN 'idle' ELSE 'taken' END ELSE CASE WHEN held IS NULL THEN 'put' ELSE 'replaced' END END AS told, held AS generation,
  CASE WHEN take AND held IS NOT NULL THEN CAST((count(*) FILTER (take AND held IS NOT NULL) OVER (PARTITION BY key ORDER BY seq) - 1) % 4 AS INTEGER) END AS place FROM h""")
def stream_slot_takes(spark: SparkSession, sf: str) -> DataFrame:
    """A single-slot mailbox with its background writer: what is put and taken, what was replaced before it was stored, and the ring place that each photo taken goes to."""
    e = t.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("purchase", "error"), "take").otherwise("put").alias("kind"), F.col("event_id").alias("generation"))
    return stateful.drain(stateful.run_machine(_stream(spark, e), "slot"))


@query("stream_slot_waiting", """SELECT key, generation FROM (SELECT user_id AS key, event_id AS generation, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type NOT IN ('purchase', 'error')""")
def stream_slot_waiting(spark: SparkSession, sf: str) -> DataFrame:
    """What waits in each slot when the stream has been read: the last that was put and neither taken nor replaced."""
    rows = stream_slot_takes(spark, sf).groupBy("key").agg(F.max(F.struct("seq", "told")).alias("last"))
    return rows.where("last.told in ('put', 'replaced')").select("key", F.col("last.seq").alias("generation"))


#: A document as a frame of 16 columns, its last row filled with blanks. Every 7th has a wrong CRC, every 11th lacks its last block, every 13th pauses before it.
_FRAMES = f"""f AS (SELECT doc_id AS key, x || repeat(' ', 16 * h - strlen(x)) AS px, h FROM (SELECT doc_id, x, greatest(1, (strlen(x) + 15) // 16) AS h FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))),
 g AS (SELECT *, 16 * h AS want, (16 * h + {transfers.BLOCK - 1}) // {transfers.BLOCK} AS blocks, 70000 * key + 1000 AS begin FROM f),
 b AS (SELECT *, CASE WHEN h > {transfers.MOST_HEIGHT} THEN 'usage' WHEN key % 13 = 0 OR key % 11 = 0 THEN 'timeout' WHEN key % 7 = 0 THEN 'crc' ELSE 'ok' END AS status, {transfers.BLOCK} * (blocks - 1) AS before FROM g)"""


@query("stream_frames", f"""WITH {_FRAMES} SELECT key, status, CAST(16 AS INTEGER) AS w, CAST(h AS INTEGER) AS h, CAST(CASE status WHEN 'usage' THEN 0 WHEN 'timeout' THEN before ELSE want END AS BIGINT) AS got,
 CASE WHEN status = 'ok' THEN sha256(px) END AS digest FROM b WHERE NOT (status = 'timeout' AND key % 13 <> 0 AND begin + 10 * (blocks - 1) + 5001 >= (SELECT max(begin + CASE WHEN key % 11 = 0 THEN 10 * (blocks - 1) ELSE 10 * blocks + CASE WHEN key % 13 = 0 THEN 6000 ELSE 0 END END) FROM b))""")
def stream_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Documents sent as frames in blocks of 1 KiB: assembled byte for byte, their CRC carried on from block to block, silence told by timers."""
    text = F.coalesce("text", F.lit(""))
    d = t.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), text.alias("x"), F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 16)).cast("int").alias("h"))
    px = F.concat(F.encode("x", "UTF-8"), F.encode(F.repeat(F.lit(" "), F.col("h") * 16 - F.octet_length("x")), "UTF-8"))
    frames = d.select("key", F.lit(16).alias("w"), "h", px.alias("pixels")).withColumn("crc", F.crc32("pixels") + F.when(F.col("key") % 7 == 0, 1).otherwise(0))
    last = F.ceil(F.col("h") * 16 / transfers.BLOCK)
    late = F.when((F.col("seq") == last) & (F.col("key") % 13 == 0), 6000).otherwise(0)
    blocks = transfers.sent(frames).where((F.col("seq") < last) | (F.col("key") % 11 != 0)).withColumn("ms", F.col("key") * 70000 + 1000 + F.col("seq") * 10 + late)
    out = transfers.run_frames(_stream(spark, blocks))
    return stateful.drain(out.select("key", "status", "w", "h", "got", F.sha2("pixels", 256).alias("digest")))


def _land(lines: DataFrame, path: str, lists: int) -> None:
    """``lines`` (ord, line) as text files that land one after the other: a list's time says which came first, and tasks that write at once end in any order."""
    cuts = [float("-inf"), *lines.approxQuantile("ord", [k / lists for k in range(1, lists)], 0.01), float("inf")]
    for a, b in zip(cuts, cuts[1:]):
        lines.where((F.col("ord") > a) & (F.col("ord") <= b)).coalesce(1).sortWithinPartitions("ord").select("line").write.mode("append").text(path)


@query("stream_import_text", batch_words._ROUTE + " SELECT lower(en) AS en, bn FROM routed WHERE outcome = 'added'")
def stream_import_text(spark: SparkSession, sf: str) -> DataFrame:
    """Word lists as text files that land in a folder, a few at a time; each batch sees what the ones before it taught."""
    path = stateful.place(spark)
    _land(t.import_lines(spark, sf), f"{path}/lists", 5)
    return lookup.import_text(spark, f"{path}/lists", t.few_learned(spark, sf), t.dictionary(spark, sf), path, batch_words.CAPACITY, files_per_batch=2)


@query("photo_store", """SELECT source AS key, CAST(doc_id % 4 AS INTEGER) AS slot, doc_id AS generation, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS digest FROM documents
 WHERE doc_id IN (SELECT max(doc_id) FROM documents WHERE text IS NOT NULL GROUP BY source, doc_id % 4) AND doc_id % 5 <> 0 AND strlen(text) > 0""")
def photo_store(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a photo of its source's ring, stored in two jobs and recovered by listing; every fifth is a short write, which deletes its slot."""
    path = stateful.place(spark) + "/photos"
    d = t.table(spark, sf, "documents").where("text is not null")
    taken = d.select(F.col("source").alias("key"), F.col("doc_id").alias("generation"), (F.octet_length("text") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).cast("long").alias("declared"), F.encode("text", "UTF-8").alias("data"))
    for half in (1, 0):
        photos.write_photos(taken.where(F.col("generation") % 2 == half), path)
    return photos.recovered(spark, path).select("key", "slot", "generation", "bytes", F.sha2("data", 256).alias("digest"))
