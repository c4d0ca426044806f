"""Keyed state machines over event streams, and their sinks.

Each machine is a fold: (state, event) -> (state, row). The state is one JSON value per
key in the state store, so a restart goes on where it stopped. Events of a micro-batch
are sorted within their key; across batches the order is that of arrival.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import Contact

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys of the state, where keys share them. A shard's part of a micro-batch is in memory at once; more shards make it smaller and cost more calls.
SHARDS = 4096


class Fold(StatefulProcessor):
    """Runs ``step`` over a key's events in order, keeping its state between batches."""

    def __init__(self, start: Callable[[], dict], step: Callable[[dict, dict], tuple[dict, dict | None]], order: list[str], columns: list[str]):
        self.start, self.step, self.order, self.columns = start, step, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.start()
        out = []
        for event in events.to_dict("records"):
            state, row = self.step(state, event)
            if row is not None:
                out.append({"key": key[0]} | row)
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def close(self) -> None:
        pass


class Shard(Fold):
    """The fold for many keys with few events each: a key of the state is a shard, and a map holds its keys' states. Calls, data frames and batches of rows are a shard's."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("states", "key long", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["key", *self.order], kind="stable")
        out = []
        for k, mine in groupby(events.to_dict("records"), itemgetter("key")):
            held = self.states.getValue((k,))
            state = json.loads(held[0]) if held else self.start()
            for event in mine:
                state, row = self.step(state, event)
                if row is not None:
                    out.append({"key": k} | row)
            self.states.updateValue((k,), (json.dumps(state),))
        yield pd.DataFrame(out, columns=self.columns, dtype=object)


def contact_step(state: dict, e: dict) -> tuple[dict, dict]:
    c = Contact()
    c.__dict__ |= state
    c.first = [tuple(p) for p in c.first]
    what = c.sample(int(e["ms"]), bool(e["valid"]), int(e["x"]), int(e["y"]))
    return dict(c.__dict__), {"seq": e["seq"], "state": what, "down": c.down, "conf": c.conf, "press_x": c.press_x, "press_y": c.press_y}


def tap_step(state: dict, e: dict) -> tuple[dict, dict]:
    """A tap completes a pair with the parked one (400 ms, 50 pixels), or is parked itself."""
    ms, x, y = int(e["ms"]), int(e["x"]), int(e["y"])
    pair = state["parked"] and ms - state["ms"] <= 400 and abs(x - state["x"]) < 50 and abs(y - state["y"]) < 50
    return {"parked": not pair, "ms": ms, "x": x, "y": y}, {"seq": e["seq"], "double": bool(pair)}


def search_step(state: dict, e: dict) -> tuple[dict, dict]:
    """Runs a search for changed text, at most once a second."""
    go = e["q"] != state["last"] and (state["ran"] is None or int(e["ms"]) - state["ran"] >= 1000)
    return ({"last": e["q"], "ran": int(e["ms"])} if go else state), {"seq": e["seq"], "ran": bool(go)}


def upload_step(state: dict, e: dict) -> tuple[dict, dict | None]:
    """Adds up pieces; reports once, at the end: complete, or the first error. What came before a piece can overflow before the piece aborts. Without an expected size neither the count nor whether it is complete is known."""
    before, known = state["received"], pd.notna(e["expected"])
    got = before + int(e["size"])
    early = "overflow" if known and before > e["expected"] else "aborted" if e["status"] == "ABORTED" else None
    late = "overflow" if known and got > e["expected"] else "short" if known and e["status"] == "END" and got < e["expected"] else None
    error = state["error"] or early or late
    done = e["status"] in ("END", "ABORTED")
    complete = False if error else e["status"] == "END" if known else None
    return {"received": got, "error": error}, {"received": got if known else None, "error": error, "complete": complete} if done else None


def history_step(state: dict, e: dict) -> tuple[dict, dict | None]:
    """A bounded history: a repeated pair renews the last entry, the 49th entry drops the first."""
    if not e["en"] and not e["bn"]:
        return state, None
    rows = state["rows"]
    if rows and (rows[-1]["en"], rows[-1]["bn"]) == (e["en"], e["bn"]):
        rows[-1]["ocr"] = e["ocr"]
    else:
        rows = [*rows[-47:], {k: e[k] for k in ("en", "bn", "ocr", "src", "day")}]
    return {"rows": rows}, {"seq": e["seq"], "held": len(rows), "last": rows[-1]["en"], "ocr": rows[-1]["ocr"]}


def queue_step(state: dict, e: dict) -> tuple[dict, dict]:
    """One request of a device is answered after the other: a tap waits for all that came before it."""
    return {"sent": state["sent"] + 1}, {"seq": e["seq"], "waited": state["sent"]}


def reader_step(state: dict, e: dict) -> tuple[dict, dict]:
    """Taps and replies of one screen, with one request in flight.

    A tap on a box that is read, queued or in flight changes nothing; others wait in
    the queue. With nothing in flight the whole queue is sent, in ascending order.
    Each reply reads the first box in flight; after the last one the next queue is
    sent. A new capture forgets all.
    """
    read, queue, flight = state["read"], state["queue"], state["flight"]
    box, what, told = int(e["box"]), e["kind"], None
    if what == "capture":
        read, queue, flight, told = [], [], [], "captured"
    elif what == "tap":
        told = "read" if box in read else "pending" if box in queue or box in flight else "queued"
        queue = [*queue, box] if told == "queued" else queue
    else:
        told = "answered" if flight else "stray"
        box = flight[0] if flight else None
        read, flight = (read + flight[:1] if flight else read), flight[1:]
    sent = None
    if queue and not flight:
        flight, queue = sorted(queue), []
        sent = " ".join(map(str, flight))
    row = {"seq": e["seq"], "told": told, "box": box if told != "captured" else None, "sent": sent, "queued": len(queue), "flying": len(flight)}
    return {"read": read, "queue": queue, "flight": flight}, row


def slot_step(state: dict, e: dict) -> tuple[dict, dict]:
    """A single-slot mailbox: what is put pushes out what nobody took; a take empties the slot and writes to the next place of a ring of four."""
    held, n = state["held"], state["taken"]
    if e["kind"] == "put":
        return state | {"held": int(e["generation"])}, {"seq": e["seq"], "told": "put" if held is None else "replaced", "generation": held, "place": None}
    if held is None:
        return state, {"seq": e["seq"], "told": "idle", "generation": None, "place": None}
    return {"held": None, "taken": n + 1}, {"seq": e["seq"], "told": "taken", "generation": held, "place": n % 4}


MACHINES = {
    "reader": (lambda: {"read": [], "queue": [], "flight": []}, reader_step, ["seq"], "key long, seq long, told string, box int, sent string, queued int, flying int"),
    "slot": (lambda: {"held": None, "taken": 0}, slot_step, ["seq"], "key long, seq long, told string, generation long, place int"),
    "tap_queue": (lambda: {"sent": 0}, queue_step, ["seq"], "key long, seq long, waited long"),
    "debounce": (lambda: {}, contact_step, ["ms", "seq"], "key long, seq long, state string, down boolean, conf int, press_x int, press_y int"),
    "double_tap": (lambda: {"parked": False, "ms": 0, "x": 0, "y": 0}, tap_step, ["ms", "seq"], "key long, seq long, double boolean"),
    "live_search": (lambda: {"last": None, "ran": None}, search_step, ["ms", "seq"], "key long, seq long, ran boolean"),
    "upload": (lambda: {"received": 0, "error": None}, upload_step, ["seq"], "key long, received long, error string, complete boolean"),
    "history": (lambda: {"rows": []}, history_step, ["seq"], "key long, seq long, held int, last string, ocr string"),
}


def shard(shards: int) -> Column:
    """The shard of a row's ``key``."""
    return F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")


def run_machine(events: DataFrame, name: str, shards: int | None = None) -> DataFrame:
    """A stream of events with a ``key`` column -> the machine's rows. With ``shards``, keys (whole numbers) share that many keys of the state."""
    start, step, order, schema = MACHINES[name]
    columns = [c.split(" ")[0] for c in schema.split(", ")]
    kind, groups = (Shard, events.select(shard(shards), "*").groupBy("shard")) if shards else (Fold, events.groupBy("key"))
    return groups.transformWithStateInPandas(kind(start, step, order, columns), outputStructType=schema, outputMode="Append", timeMode="None")


class Timed(Fold):
    """A fold whose state also answers to silence: ``quiet`` makes the row that a key gives when its timer runs out.

    A timer stands at the last event's time plus ``idle_ms``; event time passes with the
    watermark. Events that come later than that within one batch find the key timed out.
    """

    def __init__(self, start, step, quiet: Callable[[dict], tuple[dict, dict | None]], idle_ms: int, order: list[str], columns: list[str]):
        super().__init__(start, step, order, columns)
        self.quiet, self.idle_ms = quiet, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.start()
        out = []
        for event in pd.concat(list(rows)).sort_values(self.order, kind="stable").to_dict("records"):  # a key's part of one micro-batch
            if state.get("at") is not None and event["ms"] - state["at"] > self.idle_ms:
                state, row = self.quiet(state)
                out += [{"key": key[0]} | row] if row else []
            state, row = self.step(state, event)
            out += [{"key": key[0]} | row] if row else []
            state["at"] = int(event["ms"])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(state["at"] + self.idle_ms + 1)
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, row = self.quiet(json.loads(self.state.get()[0]))
        self.state.update((json.dumps(state | {"at": None}),))
        yield pd.DataFrame([{"key": key[0]} | row] if row else [], columns=self.columns)


def _parked_step(state: dict, e: dict) -> tuple[dict, dict | None]:
    x, y, parked = int(e["x"]), int(e["y"]), state["parked"]
    if parked and abs(x - parked[1]) < 50 and abs(y - parked[2]) < 50:
        return {"parked": None}, {"seq": int(e["seq"]), "double": True}
    # One that cannot pair fires the tap that was parked, and takes its place.
    return {"parked": [int(e["seq"]), x, y]}, {"seq": parked[0], "double": False} if parked else None


def _parked_quiet(state: dict) -> tuple[dict, dict | None]:
    parked = state["parked"]
    return {"parked": None}, {"seq": parked[0], "double": False} if parked else None


def _transfer_step(state: dict, e: dict) -> tuple[dict, dict | None]:
    if state["over"]:
        return state, None
    return state | {"received": state["received"] + 1, "over": e["status"] != "WRITE"}, None


def _transfer_quiet(state: dict) -> tuple[dict, dict | None]:
    if state["over"]:
        return state, None
    return state | {"over": True}, {"received": state["received"], "error": "timeout"}


def _timed(events: DataFrame, machine: Timed, schema: str) -> DataFrame:
    timed = events.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", "0 seconds")
    return timed.groupBy("key").transformWithStateInPandas(machine, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def run_taps(events: DataFrame, window_ms: int = 400) -> DataFrame:
    """``events`` (key, seq, ms, x, y) -> key, seq, double: pairs and single taps as they fire. The last single tap of all fires when time goes on."""
    return _timed(events, Timed(lambda: {"parked": None}, _parked_step, _parked_quiet, window_ms, ["ms", "seq"], ["key", "seq", "double"]), "key long, seq long, double boolean")


def run_transfers(pieces: DataFrame, idle_ms: int = 5000) -> DataFrame:
    """``pieces`` (key, seq, ms, status) -> key, received, error of each transfer that paused for over ``idle_ms`` before its end."""
    return _timed(pieces, Timed(lambda: {"received": 0, "over": False}, _transfer_step, _transfer_quiet, idle_ms, ["ms", "seq"], ["key", "received", "error"]), "key long, received long, error string")


def mailbox(puts: DataFrame, path: str) -> DataFrame:
    """``puts`` (slot, generation) as a stream -> slot, generation, replaced: the one item that each slot holds at the end of all batches, and how many it pushed out."""
    spark = puts.sparkSession

    def each(batch: DataFrame, epoch: int) -> None:
        held = spark.read.parquet(f"{path}/held-{epoch - 1}").select("slot", "generation", F.col("replaced") + 1) if epoch else None
        new = batch.select("slot", "generation", F.lit(1).cast("long").alias("put"))
        both = new if held is None else new.union(held)
        taken = both.groupBy("slot").agg(F.max("generation").alias("generation"), (F.sum("put") - 1).alias("replaced"))
        taken.write.mode("overwrite").parquet(f"{path}/held-{epoch}")  # a batch that is run again writes the same

    query = puts.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = max(p["batchId"] for p in query.recentProgress)
    return spark.read.parquet(f"{path}/held-{last}")


def place(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; a temporary one only where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Runs a stream over all that its source holds now, into Parquet, and reads the result."""
    spark = stream.sparkSession
    path = path or place(spark)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def follow(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A folder (or file) of Parquet as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
