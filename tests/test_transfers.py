"""The photo sink, frames in blocks, and text lists as streams, with failures and replays."""

import json
import os
import shutil
import time
import zlib

import pytest
from pyspark.sql import functions as F

from sparrowgrid.sources import photos
from sparrowgrid.streaming import lookup, stateful, transfers

PHOTOS = "key string, generation long, declared long, data binary"


def shots(spark, rows):
    return spark.createDataFrame([(k, g, len(d) + wrong, d) for k, g, d, wrong in rows], PHOTOS).repartition(3)


def held(spark, path):
    return {(r.key, r.slot): (r.generation, bytes(r.data)) for r in photos.recovered(spark, path).collect()}


def test_a_ring_keeps_the_newest_and_short_writes_delete(spark, tmp_path):
    path = str(tmp_path / "ring")
    assert held(spark, path) == {}
    photos.write_photos(shots(spark, [("a/b c", g, b"p%d" % g, 0) for g in range(7)] + [("", 0, b"x", 0), ("k~1", 5, b"y", 0)]), path)
    want = {("a/b c", g % 4): (g, b"p%d" % g) for g in range(3, 7)} | {("", 0): (0, b"x"), ("k~1", 1): (5, b"y")}
    assert held(spark, path) == want
    photos.write_photos(shots(spark, [("a/b c", 8, b"new", 0), ("a/b c", 9, b"cut", 5)]), path)
    want[("a/b c", 0)] = (8, b"new")
    del want[("a/b c", 1)]
    assert held(spark, path) == want
    assert {r.key: r.total for r in photos.photo_count(photos.recovered(spark, path)).collect()} == {"a/b c": 4, "": 1, "k~1": 2}


def test_a_failed_job_leaves_the_ring_as_it_was(spark, tmp_path):
    path = str(tmp_path / "ring")
    photos.write_photos(shots(spark, [("a", g, b"p", 0) for g in range(4)]), path)
    before = held(spark, path)
    rows = shots(spark, [("a", g, b"q", 0) for g in range(10, 40)]).repartition(4, "generation")
    bad = rows.withColumn("data", F.when(F.col("generation") == 33, F.raise_error(F.lit("no light"))).otherwise(F.col("data")))
    spark.dataSource.register(photos.PhotoRing)
    with pytest.raises(Exception, match="no light"):
        bad.write.format("photo_ring").option("path", path).mode("append").save()
    assert held(spark, path) == before
    assert len(os.listdir(tmp_path / "ring" / "_commits")) == 1
    # Files of an attempt that no commit lists do not count either.
    job = next(p for p in (tmp_path / "ring").glob("job=*"))
    (job / "attempt=999999").mkdir()
    (job / "attempt=999999" / "a~99~1.jpg").write_bytes(b"z")
    assert held(spark, path) == before
    with pytest.raises(Exception, match="appended"):
        rows.write.format("photo_ring").option("path", path).mode("overwrite").save()


def test_frames_over_several_batches(spark, tmp_path):
    """Blocks of one frame in four micro-batches: state holds what came before, the CRC goes on, later blocks of a failed one are ignored."""
    px = {k: bytes((k * 31 + i) % 256 for i in range(16 * h)) for k, h in ((1, 200), (2, 64), (3, 130), (4, 64), (5, 700), (6, 100))}
    frames = spark.createDataFrame([(k, 16, len(v) // 16, zlib.crc32(v) + (k == 4), v) for k, v in px.items()], "key long, w int, h int, crc long, pixels binary")
    blocks = transfers.sent(frames).withColumn("ms", 1000 + F.col("seq") * 100).collect()
    assert sum(len(r.data or b"") for r in blocks) == sum(map(len, px.values()))
    rows = [(r.key, r.seq, r.ms, r.w, r.h, r.crc, r.data) for r in blocks if not (r.key == 6 and r.seq == 1)]
    schema = "key long, seq int, ms long, w int, h int, crc long, data binary"
    for n in range(4):
        spark.createDataFrame([r for r in rows if min(r[1], 3) == n] or rows[:0], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    out = stateful.drain(transfers.run_frames(stateful.follow(spark, str(tmp_path / "in"), 1), idle_ms=5000), str(tmp_path / "out")).collect()
    got = {r.key: (r.status, r.got, r.pixels and bytes(r.pixels)) for r in out}
    assert len(out) == len(got)
    assert got[1] == ("ok", 3200, px[1]) and got[2] == ("ok", 1024, px[2]) and got[4] == ("crc", 1024, None) and got[5] == ("usage", 0, None)
    assert got[3] == ("ok", 2080, px[3]) and got[6] == ("short", 0, None)


BLOCKS = "key long, seq int, ms long, w int, h int, crc long, data binary"


def test_frames_that_share_a_shard(spark, tmp_path):
    """One timer, one list of ended transfers and one of heads stand for many transfers; each still has its own outcome."""
    px = {k: bytes((k * 17 + i) % 256 for i in range(16 * 160)) for k in range(1, 7)}  # three blocks each, the last of 512 bytes
    head = {k: (16, 160, zlib.crc32(v) + (k == 6)) for k, v in px.items()}
    at = {  # (batch, ms) of the head and the blocks
        1: [(0, 1000), (0, 1010), (1, 5000), (2, 9500)],  # whole, over three batches
        2: [(0, 1100), (0, 1110)],  # silent: told by the timer
        3: [(0, 1200), (1, 3900)],  # silent too, due later
        4: [(0, 1300), (1, 5500), (2, 9800)],  # under way at the end
        5: [(0, 1000), (0, 1010), (1, 7000), (1, 7010)],  # a pause, told by the next block
        6: [(0, 1000), (0, 1010), (0, 1020), (0, 1030), (1, 8950), (2, 9600)],  # a wrong CRC; what comes later is ignored
    }
    rows = [(b, (k, n, ms, *head[k], None if n == 0 else px[k][1024 * (n - 1) : 1024 * n])) for k, places in at.items() for n, (b, ms) in enumerate(places)]
    for b in range(3):
        spark.createDataFrame([r for x, r in rows if x == b], BLOCKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    want = {1: ("ok", 2560, px[1]), 2: ("timeout", 1024, None), 3: ("timeout", 1024, None), 5: ("timeout", 1024, None), 6: ("crc", 2560, None)}
    for shards in (1, transfers.SHARDS):
        out = stateful.drain(transfers.run_frames(stateful.follow(spark, str(tmp_path / "in"), 1), idle_ms=5000, shards=shards), str(tmp_path / f"out{shards}")).collect()
        assert len(out) == 5
        assert {r.key: (r.status, r.got, r.pixels and bytes(r.pixels)) for r in out} == want


def test_the_state_of_frames_is_one_of_shards(spark, tmp_path):
    """Calls of the state grow with shards, not with transfers: 300 that ended leave no row of their own."""
    px = {k: bytes([k % 256]) * 16 for k in range(300)}
    frames = spark.createDataFrame([(k, 16, 1, zlib.crc32(v), v) for k, v in px.items()], "key long, w int, h int, crc long, pixels binary")
    transfers.sent(frames).withColumn("ms", 1000 + F.col("seq") * 10).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = transfers.run_frames(stateful.follow(spark, str(tmp_path / "in")), shards=5)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 2 * 5
    assert {r.key: (r.status, bytes(r.pixels)) for r in spark.read.parquet(str(tmp_path / "rows")).collect()} == {k: ("ok", v) for k, v in px.items()}


def test_uploads_that_share_a_shard(spark, tmp_path):
    """The upload machine over two batches gives by shards what it gives by keys; its state's calls are a shard's."""
    rows = [(k, n, "ABORTED" if k % 5 == 0 and n == 3 else "END" if n == 3 else "WRITE", 10, 30 + 10 * (k % 3)) for k in range(12) for n in range(4)]
    for b in range(2):
        part = [r for r in rows if r[1] // 2 == b]
        spark.createDataFrame(part, "key long, seq long, status string, size int, expected int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    runs = [stateful.drain(stateful.run_machine(stateful.follow(spark, str(tmp_path / "in"), 1), "upload", shards), str(tmp_path / f"out{shards}")).collect() for shards in (None, 3)]
    assert len(runs[1]) == 12 and sorted(map(tuple, runs[0])) == sorted(map(tuple, runs[1]))
    assert {r.key: (r.received, r.error, r.complete) for r in runs[1]}[1] == (40, None, True)


def test_text_lists_of_several_files_and_a_replayed_batch(spark, tmp_path):
    lists = tmp_path / "lists"
    lists.mkdir()
    gloss = "শব্দ"
    files = {"b.txt": ["\ufeffword,meaning", f"apple,{gloss}", "", f"pear,{gloss}1"], "a.txt": ["word,meaning", f"pear,{gloss}2", f"plum,{gloss}"], "c.txt": [f"apple,{gloss}3", f"fig,{gloss}", f"quince,{gloss}", "bad line"]}
    for k, (name, lines) in enumerate(files.items()):
        (lists / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
        os.utime(lists / name, (1_700_000_000 + k, 1_700_000_000 + k))
    learned = spark.createDataFrame([("fig", gloss)], "en string, bn string")
    none = spark.createDataFrame([], "no long, word string, meaning string")
    path = str(tmp_path / "import")

    def run():
        rows = lookup.import_text(spark, str(lists), learned, none, path, capacity=5, files_per_batch=1).collect()
        assert len(rows) == len({r.en for r in rows})
        return {r.en: r.bn for r in rows}

    want = {"apple": gloss, "pear": gloss + "1", "plum": gloss, "quince": gloss}
    assert run() == want  # files in the order of their times; the second pear and apple are known by then
    commits = sorted((tmp_path / "import" / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    assert len(commits) == 3
    for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # the last batch was done, its commit was lost
        f.exists() and f.unlink()
    assert run() == want
    (lists / "d.txt").write_text(f"date,{gloss}\nlime,{gloss}\n", encoding="utf-8")
    assert run() == want  # the store is full
    shutil.rmtree(lists)


def test_one_request_is_in_flight(spark):
    state, told = {"read": [], "queue": [], "flight": []}, []
    for kind, box in [("tap", 5), ("tap", 3), ("tap", 1), ("tap", 5), ("reply", 0), ("tap", 5), ("reply", 0), ("reply", 0), ("reply", 0), ("tap", 3), ("capture", 0), ("tap", 3)]:
        state, row = stateful.reader_step(json.loads(json.dumps(state)), {"kind": kind, "box": box, "seq": 1})
        told.append((row["told"], row["box"], row["sent"], row["queued"], row["flying"]))
    assert told == [
        ("queued", 5, "5", 0, 1), ("queued", 3, None, 1, 1), ("queued", 1, None, 2, 1), ("pending", 5, None, 2, 1), ("answered", 5, "1 3", 0, 2), ("read", 5, None, 0, 2),
        ("answered", 1, None, 0, 1), ("answered", 3, None, 0, 0), ("stray", None, None, 0, 0), ("read", 3, None, 0, 0), ("captured", None, None, 0, 0), ("queued", 3, "3", 0, 1),
    ]
