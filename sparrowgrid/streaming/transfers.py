"""Raw frames that arrive in blocks: assembled in state, with a CRC carried on from block to block."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .stateful import SHARDS, shard

BLOCK, IDLE_MS = 1024, 5000
MOST_WIDTH, MOST_HEIGHT = 480, 640
COLUMNS = ["key", "seq", "ms", "w", "h", "crc", "data"]
SCHEMA = "key long, status string, w int, h int, got long, pixels binary"


class Frames(StatefulProcessor):
    """Transfers, each a head (seq 0: w, h, crc), then blocks of BLOCK bytes, the last one shorter. A key of the state is a shard, which holds many of them.

    The head's size must be in range ("usage"). A block of another size ends the
    transfer ("short"), as do more than ``idle`` ms without one ("timeout", by the next
    block or by a timer) and a wrong CRC after the last ("crc"); else the frame is "ok".
    The first outcome stays; later blocks are ignored.

    A call of the state costs as much as reading many blocks, so the transfers of a shard
    share theirs: ``open`` holds the heads of those under way, ``over`` the keys of those
    that ended, and one timer stands for the first that is due. Blocks wait in ``parts``,
    one part for each micro-batch and transfer under way, so a micro-batch adds its own and
    rewrites none; they go when the outcome is told.
    """

    def __init__(self, idle: int = IDLE_MS):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "value string")
        self.over = handle.getListState("over", "keys binary")
        self.parts = handle.getMapState("parts", "transfer long, part int", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, heads = self._held()
        over = {k for (keys,) in self.over.get() for k in array("q", keys)}
        events = pd.concat(list(rows)).sort_values(["key", "seq"], kind="stable")
        told = []
        for transfer, blocks in groupby(zip(*(events[c].tolist() for c in COLUMNS)), itemgetter(0)):
            if transfer in over:
                continue
            s = heads.setdefault(transfer, {"status": None, "want": None, "got": 0, "sum": 0, "at": None, "parts": 0})
            new = self._fold(s, blocks)
            if s["status"]:
                told.append(self._told(transfer, heads.pop(transfer), new))
            elif new:
                self.parts.updateValue((transfer, s["parts"]), (b"".join(new),))
                s["parts"] += 1
        yield from self._keep(due, heads, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, heads = self._held()
        now = timerValues.getCurrentWatermarkInMs()
        quiet = [k for k, s in heads.items() if self._due(s) <= now]
        told = [self._told(k, heads.pop(k) | {"status": "timeout"}, []) for k in quiet]
        yield from self._keep(None, heads, told)  # Spark deletes the timer that fired

    def _fold(self, s: dict, blocks: Iterable[tuple]) -> list[bytes]:
        """Carries ``s`` over a transfer's next blocks, up to its end; gives the pixels that came."""
        new: list[bytes] = []
        for _, _, ms, w, h, crc, data in blocks:
            if s["at"] is not None and ms - s["at"] > self.idle:
                s["status"] = "timeout"
            elif s["want"] is None:
                s |= {"w": int(w), "h": int(h), "crc": int(crc), "want": int(w) * int(h)}
                if not (0 < s["w"] <= MOST_WIDTH and 0 < s["h"] <= MOST_HEIGHT):
                    s["status"] = "usage"
            elif len(data) != min(BLOCK, s["want"] - s["got"]):
                s["status"] = "short"
            else:
                new.append(bytes(data))
                s |= {"got": s["got"] + len(data), "sum": zlib.crc32(data, s["sum"])}
                if s["got"] == s["want"]:
                    s["status"] = "ok" if s["sum"] == s["crc"] else "crc"
            s["at"] = int(ms)
            if s["status"]:
                break
        return new

    def _due(self, s: dict) -> int:
        return s["at"] + self.idle + 1

    def _held(self) -> tuple[int | None, dict[int, dict]]:
        """When the shard's timer stands, and the transfers under way."""
        due, heads = json.loads((self.open.get() or ("[null, []]",))[0])
        return due, dict(heads)

    def _keep(self, due: int | None, heads: dict[int, dict], told: list[dict]) -> Iterator[pd.DataFrame]:
        first = min(map(self._due, heads.values()), default=None)
        if due is not None and due != first:
            self.handle.deleteTimer(due)
        if first is not None and due != first:
            self.handle.registerTimer(first)
        self.open.update((json.dumps([first, list(heads.items())]),))
        if told:
            self.over.appendValue((array("q", [row["key"] for row in told]).tobytes(),))
            yield pd.DataFrame(told, dtype=object)

    def _told(self, transfer: int, s: dict, new: list[bytes]) -> dict:
        pixels = b"".join([self.parts.getValue((transfer, n))[0] for n in range(s["parts"])] + new) if s["status"] == "ok" else None
        for n in range(s["parts"]):
            self.parts.removeKey((transfer, n))
        return {"key": transfer, "status": s["status"], "w": s.get("w"), "h": s.get("h"), "got": s["got"], "pixels": pixels}

    def close(self) -> None:
        pass


def run_frames(events: DataFrame, idle_ms: int = IDLE_MS, shards: int = SHARDS) -> DataFrame:
    """``events`` (key, seq, ms, w, h, crc, data) as a stream -> one row for each transfer that ended: key, status, w, h, got, pixels."""
    timed = events.select(shard(shards), *COLUMNS, F.timestamp_millis("ms").alias("at")).withWatermark("at", "0 seconds")
    return timed.groupBy("shard").transformWithStateInPandas(Frames(idle_ms), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")


def sent(frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """``frames`` (key, w, h, crc, pixels) -> key, seq, w, h, crc, data: a head, then the pixels in blocks."""
    n = F.ceil(F.octet_length("pixels") / block).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring("pixels", k * block + 1, F.lit(block)))).otherwise(F.array().cast("array<binary>"))
    head = F.array(F.lit(None).cast("binary"))
    return frames.select("key", "w", "h", "crc", F.posexplode(F.concat(head, parts)).alias("seq", "data"))
