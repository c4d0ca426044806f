"""Scalar and fold rules against tables of expectations and small models in plain Python."""

import json
import random
import sqlite3
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowgrid.functions import text as tf
from sparrowgrid.operators import arrays, decode, geometry, ingest, lookup, ordered, ring, simjoin
from sparrowgrid.plans import ordered as plans
from sparrowgrid.plans import streams
from sparrowgrid.plans import words as plans_words
from sparrowgrid.sources import frames, words

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    values = values or {"x": 0}
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("r")).first()["r"]


SCORES = [("water", "water", 1000), ("wat", "water", 698), ("waters", "water", 599), ("water", "saltwater", 400), ("watar", "water", 250), ("wotar", "water", 200), ("zebra", "water", 0), ("", "cat", 697), ("a" * 700, "a", 0), ("é", "e", 200), ("x" * 25, "x" * 24 + "y", 0)]


def test_score_table(spark):
    rows = spark.createDataFrame(SCORES, "q string, en string, want int")
    got = rows.select("q", "en", "want", tf.match_score(F.col("q"), F.col("en")).alias("raw"), tf.learned_score(F.col("q"), F.col("en")).alias("learned")).collect()
    for r in got:
        want = -99 if len(r.q) == 700 else r.want
        assert r.raw == want and r.learned == (want + 25 if want > 0 else 0), r


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_close_words_finds_all_pairs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
    left, right = sorted({word() for _ in range(150)}), sorted({word() for _ in range(60)})
    got = {(r.a, r.b, r.distance) for r in lookup.close_words(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")).collect()}
    assert got == {(a, b, d) for a in left for b in right if (d := edit_distance(a, b)) <= 2}


LINES = [
    ("7,cat,বি", ["7", "cat", "বি"]), ("cat,বি", ["cat", "বি"]), ("cat\tবি", ["cat", "বি"]), ('cat,"বি, বি"', ["cat", "বি, বি"]), ('cat,"say ""hi"" বি"', ["cat", 'say "hi" বি']),
    ("a,বি,c,d,e", ["a", "বি", "c", ""]), ('a"b,c"d,e', ["ab,cd", "e"]), ("", [""]), (",", ["", ""]), ('"a', ["a"]), (' a , b ', ["a", "b"]), ('a\t"b"', ["a", '"b"']), ("a,b,c", ["a", "b", "c"]), ("a,b,c,", ["a", "b", "c", ""]),
]


def test_split_fields(spark):
    rows = spark.createDataFrame(LINES, "line string, want array<string>")
    for r in rows.select("line", "want", tf.split_fields(F.col("line")).alias("got")).collect():
        assert r.got == r.want, r.line


def test_import_rules(spark):
    text = ["﻿id,word,meaning", "", "7,cat,বি", "cat,বি", "dog,english", "cat2,বি", "x" * 33 + ",বি", "o'clock,বি", "well-being,বি", "Known,বি", "listed,বি", "alone", "late,বি", "late,বি"]
    lines = spark.createDataFrame(list(enumerate(text)), "ord long, line string")
    learned = spark.createDataFrame([(0, "known", "g")], "seq long, en string, bn string")
    dictionary = spark.createDataFrame([(1, "Listed", "m")], "no long, word string, meaning string")
    got = [r.outcome for r in ingest.route(ingest.parse(lines), learned, dictionary, 4).orderBy("ord").collect()]
    assert got == ["added", "already_learned", "rejected", "rejected", "rejected", "added", "added", "already_learned", "in_dictionary", "rejected", "no_room", "no_room"]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="aé€😀b", max_size=12), st.integers(2, 12))
def test_truncation_is_by_bytes(spark, text, capacity):
    assert one(spark, tf.truncate_bytes(F.col("s"), capacity), s=text) == text.encode()[: capacity - 1].decode("utf-8", "ignore")


def test_small_scalars(spark):
    assert one(spark, tf.trim_word(F.col("s")), s="(milion!)") == "milion"
    assert one(spark, tf.leading_int(F.col("s")), s=" 12ab") == 12 and one(spark, tf.leading_int(F.col("s")), s="x") == 0
    assert one(spark, tf.json_escape_plain(F.col("s")), s='a"\\\n') == 'a\\"\\\\\\n'
    assert one(spark, tf.json_escape_strict(F.col("s")), s='a"\x01b') == '"a\\"b"'
    assert one(spark, tf.aksharas(F.col("s")), s="বিজ্ঞান") == ["বি", "জ্ঞা", "ন"] and one(spark, tf.aksharas(F.col("s")), s="স্ত্রী কর্ম") == ["স্ত্রী", " ", "ক", "র্ম"]
    assert one(spark, tf.clip_prefix(F.col("a"), F.lit(10), 3), a=[4, 4, 4]) == 1 and one(spark, tf.clip_prefix(F.col("a"), F.lit(12), 3), a=[4, 4, 4]) == 3
    assert one(spark, tf.byte_levenshtein(F.lit("é"), F.lit("e"))) == 2
    assert sum(arrays.gaussian_q15(1.5, 4)) == 32768


def test_offers_can_return_after_eviction(spark):
    """A learned word pushed out by better rows comes back through the dictionary."""
    queries = spark.createDataFrame([(1, "water")], "qid int, q string")
    store = spark.createDataFrame([(i, w, "l") for i, w in enumerate(["saltwater", "waterx"])], "seq long, en string, bn string")
    dictionary = spark.createDataFrame([(1, "water", "d"), (2, "saltwater", "d")], "no long, word string, meaning string")
    got = [(r.en, r.src) for r in lookup.merged(queries, store, dictionary, 2).orderBy("rk").collect()]
    assert got[0] == ("water", "db/fts5") and got[1] == ("waterx", "learned")


def test_contact_follows_the_rules():
    c = ordered.Contact()
    states = [c.sample(8 * k, k < 5, k, 10 * k) for k in range(14)]
    assert states[:2] == ["none", "press"] and (c.press_x, c.press_y) == (1, 10) and "release" in states
    stuck = ordered.Contact()
    states = [stuck.sample(8 * k, True, 1, 1) for k in range(700)]
    assert states.count("release") == 1 and states.count("press") == 2
    assert ordered.Contact().sample(0, True, 0, 0) == "none"


def test_history_stream_ends_like_the_batch(spark):
    last = {r.key: (r.held, r["last"], r.ocr) for r in streams.stream_history(spark, SF).orderBy("seq").collect()}
    batch = {}
    for r in plans.history_last48(spark, SF).orderBy("pos").collect():
        batch[r.key] = (r.pos, r.en, r.ocr)
    assert last == batch


def test_crc_and_chunks(spark):
    rows = spark.createDataFrame([(1, "a" * 3000), (2, ""), (3, None)], "id long, text string")
    got = {(r.id, r.seq): bytes(r.data) for r in ring.pieces(rows).collect()}
    assert b"".join(got[1, k] for k in range(3)) == b"a" * 3000 and got[2, 0] == got[3, 0] == b""
    assert one(spark, F.crc32(F.lit("123456789"))) == zlib.crc32(b"123456789") == 0xCBF43926


def test_word_stores(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("Cat\tg1\n\n\tnone\nno tab\nCAT\tg2\twith tab\n dog\tg3 \r\n")
    store = words.load_learned(spark, str(tmp_path / "l.tsv"))
    assert [(r.en, r.bn) for r in store.orderBy("seq").collect()] == [("cat", "g1"), ("cat", "g2\twith tab"), ("dog", "g3")]
    assert words.learn(store, "cat", "g1") is None and words.learn(store, "Cat", "g2").first().en == "cat"
    assert words.export_learned(store, str(tmp_path / "out")) and not words.export_learned(store.limit(0), str(tmp_path / "no"))
    words.append_learned(spark.createDataFrame([("new", "g")], "en string, bn string"), str(tmp_path / "out"))
    assert words.load_learned(spark, str(tmp_path / "out")).count() == 4


def test_sqlite_dictionary(spark, tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE dictionary (no TEXT, word TEXT, meaning TEXT, n INTEGER)")
        db.executemany("INSERT INTO dictionary VALUES (?, ?, ?, ?)", [(str(i), f"w{i}", "m", i) for i in range(57)])
    d = words.open_dictionary(spark, path)
    assert words.row_count(d) == 57 and d.agg(F.sum("n")).first()[0] == sum(range(57)) and words.row_count(None) == -1


def test_frames_and_settings(spark, tmp_path):
    good = bytes(range(12))
    (tmp_path / "a_4x3.gray").write_bytes(good)
    (tmp_path / f"b_4x3_{zlib.crc32(good):x}.gray").write_bytes(good)
    (tmp_path / "c_4x3_1.gray").write_bytes(good)
    (tmp_path / "d_4x4.gray").write_bytes(good)
    (tmp_path / "e_481x1.gray").write_bytes(good)
    got = {r.id: r.error for r in frames.raw_frames(spark, str(tmp_path)).collect()}
    assert got == {"a": None, "b": None, "c": "crc", "d": "length", "e": "dimensions"}
    px = frames.raw_frames(spark, str(tmp_path)).where("id = 'a'").select(frames.pixel_array(F.col("pixels")).alias("p"), frames.hex_dump(F.col("pixels"), 8).alias("h")).first()
    assert px.p == list(good) and px.h == "0001020304050607\n08090A0B"
    frames.save_settings({"x": 5}, spark, str(tmp_path / "nv"))
    stored = spark.read.parquet(str(tmp_path / "nv"))
    assert {r.name: r.value for r in frames.settings(stored, {"x": 1, "y": 2}).collect()} == {"x": 5, "y": 2}
    assert {r.name: r.value for r in frames.settings(stored, {"x": 1}, version=3).collect()} == {"x": 1}
    assert frames.clear(spark, str(tmp_path / "nv")) == 2 and spark.read.parquet(str(tmp_path / "nv")).count() == 0
    c = frames.commands(spark.createDataFrame([(" F 4 3 ff ",), ("",), ("Q water ",)], "value string")).collect()
    assert [tuple(r) for r in c] == [("F", "4 3 ff"), ("Q", "water")]
    b = one(spark, frames.bmp(F.col("p"), 2, 1), p=[0xF800, 0x001F])
    assert bytes(b[:2]) == b"BM" and len(b) == 62 and bytes(b[54:60]) == b"\x00\x00\xf8\xf8\x00\x00"


def test_quads_and_selection(spark):
    inside = lambda x, y: one(spark, geometry.in_quad(F.array(*map(F.lit, [0, 0, 10, 0, 10, 10, 0, 10])), F.lit(x), F.lit(y)))
    assert inside(5, 5) and inside(0, 5) and not inside(11, 5)
    assert decode.TRUNCATED == 15 and one(spark, decode.greedy_ctc(F.array(*[F.array(*map(F.lit, r)) for r in ([0, 5, 5], [0, 5, 1], [9, 0, 0], [0, 5, 1], [0, 1, 5])]), ["a", "b"])) == "aab"
    assert json.loads('{"a": 1}')["a"] == 1


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_otsu_sorted_matches_a_loop(spark, n):
    rng = random.Random(n)
    xs = sorted(rng.random() for _ in range(n))
    best, want = -1.0, xs[0]
    for i in range(1, n):
        a, b = sum(xs[:i]) / i, sum(xs[i:]) / (n - i)
        if i * (n - i) * (a - b) ** 2 > best:
            best, want = i * (n - i) * (a - b) ** 2, (xs[i - 1] + xs[i]) / 2
    assert one(spark, arrays.otsu_sorted(F.col("x")), x=xs) == pytest.approx(want)


def test_larger_stores_are_met_by_keys(spark, monkeypatch):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(120)})
    store = spark.createDataFrame([(i, w, "g") for i, w in enumerate(names + names[:20])], "seq long, en string, bn string")
    asked = spark.createDataFrame(list(enumerate([*names[::5], "", "abca", "zzz", "abcabcabc"])), "qid long, q string")
    scanned = {(r.qid, r.seq, r.score) for r in lookup.scan_learned(asked, store).collect()}
    monkeypatch.setattr(lookup, "SCAN_ROWS", 10)
    assert {(r.qid, r.seq, r.score) for r in lookup.scan_learned(asked, store).collect()} == scanned and len(scanned) > 500
    assert lookup.scan_learned(asked, store.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "ab" * 500_000), (2, "abcabca"), (3, "c" * 1_000_000), (4, "é")], "qid long, q string")
    few = spark.createDataFrame([(1, "ab", ""), (2, "abab", ""), (3, "ba", ""), (4, "xabcabcax", ""), (5, "c" * 900_000, "")] + [(10 + k, f"w{k}", "") for k in range(20)], "seq long, en string, bn string")
    assert {(r.qid, r.seq) for r in lookup.scan_learned(long, few).where("seq < 10").collect()} == {(2, 1), (2, 4), (4, 1), (4, 3)}  # a query of a megabyte is too long for its beginnings to score


@pytest.mark.parametrize(("floor", "k", "first", "small"), [(0.3, None, None, True), (0.5, 5, 0.8, False), (0.65, None, None, True)])
def test_similar_words_are_those_of_all_pairs(spark, monkeypatch, floor, k, first, small):
    """Against every pair measured; sent to all tasks or dealt by gram; words of no, equal, odd and many bytes."""
    if not small:
        monkeypatch.setattr(simjoin, "INDEX_ROWS", 0)
    rng = random.Random(floor)
    word = lambda: "".join(rng.choice(["a", "b", "c", "é", "অ"]) for _ in range(rng.randint(0, 9)))
    names = [word() for _ in range(90)] + ["a" * 45, "ab" * 29 + "c", "x", None, "", ""]
    asked = [word() for _ in range(50)] + ["a" * 40, "ab" * 30, None, "", "same", "same"]
    words_ = spark.createDataFrame(list(enumerate(names)), "no long, word string")
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, q string")
    pairs = queries.where("q is not null").crossJoin(words_.where("word is not null")).withColumn("s", tf.similarity(F.col("q"), F.col("word"))).where(F.col("s") >= floor)
    by = {}
    for r in pairs.collect():
        by.setdefault(r.qid, []).append((-r.s, r.no))
    want = {(q, no, -s) for q, own in by.items() for s, no in sorted(own)[:k]}
    got = simjoin.most_similar(queries, words_, floor, k, first).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert simjoin.most_similar(queries, words_.limit(0), floor, k, first).count() == 0


def test_the_best_words_are_found_in_blocks_and_shards(spark, monkeypatch):
    """Short, wide and long bit vectors, and a table for the longest; ties over several shards go by number."""
    rng = random.Random(5)
    bytes_ = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    words_ = sorted((bytes_(rng.randint(0, 90)) for _ in range(60)), key=len)
    ends = np.cumsum([0, *map(len, words_)])
    for query in (b"", bytes_(1), bytes_(16), bytes_(17), bytes_(40), bytes_(64), bytes_(65), bytes_(80)):
        got = simjoin.distances(np.frombuffer(query, np.uint8), np.frombuffer(b"".join(words_), np.uint8), ends[:-1], np.diff(ends))
        assert got.tolist() == [edit_distance(query, w) for w in words_]
    monkeypatch.setattr(simjoin, "SHARD_ROWS", 40)
    monkeypatch.setattr(simjoin, "BLOCK_ROWS", 7)
    names = spark.createDataFrame([(k, f"ab{k % 3}") for k in range(200)], "no long, word string")
    asked = spark.createDataFrame([(k, f"ab{k}") for k in range(20)], "qid long, q string")
    best = {(r.qid, r.no) for r in simjoin.most_similar(asked, names, 0.5, 4).collect()}
    assert {no for q, no in best if q == 1} == {1, 4, 7, 10} and {no for q, no in best if q == 9} == {0, 1, 2, 3} and len(best) == 80


def test_the_best_words_need_few_distances(monkeypatch):
    """An edit more at a time: far fewer than all words are measured, by tables of bytes' places or without."""
    rng = random.Random(8)
    stems = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(6, 19))) for _ in range(60)]
    words_ = sorted({"".join(c if rng.random() < 0.85 else rng.choice("xyz") for c in s) for s in stems for _ in range(100)} | {"é" * 20, "z" * 70, "", "x"})
    asked = [*rng.sample(words_, 12), "", "q", "é" * 19, "z" * 66, words_[50] * 5, "ethanol" * 4]
    measured = []
    edits = simjoin.Words.edits
    monkeypatch.setattr(simjoin.Words, "edits", lambda self, texts, rows, many, at: measured.append(len(at)) or edits(self, texts, rows, many, at))
    b = lambda rows: pa.array([w.encode() for w in rows], pa.binary())
    want = []
    for i, q in enumerate(asked):
        q_, n = np.frombuffer(q.encode(), np.uint8), [w.encode() for w in words_]
        rated = sorted((-(1.0 - edit_distance(q_.tobytes(), w) / max(len(q_), len(w), 1)), j) for j, w in enumerate(n) if 2 * min(len(q_), len(w)) >= max(len(q_), len(w)))
        want += [(i, j, -s) for s, j in rated[:30] if s <= -0.5]
    for room in (simjoin.TABLE_BYTES, 0):
        monkeypatch.setattr(simjoin, "TABLE_BYTES", room)
        got = sorted(zip(*(c.tolist() for c in simjoin.best_of(b(asked), b(words_), 0.5, 30)), strict=True))
        assert got == sorted(want) and sum(measured) < len(asked) * len(words_) // 4
        measured.clear()


def test_words_of_documents_count_an_id_once(spark):
    rows = [(1, "a b a"), (1, "b c"), (2, "A d"), (3, None), (None, "a"), (None, "a e")]
    got = {(r.word, r.n) for r in plans_words.words_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {("a", 3), ("b", 1), ("c", 1), ("d", 1), ("e", 1)}
    alone = plans_words.words_of(spark.createDataFrame(rows[2:5], "doc_id long, text string"))
    assert alone._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # counts by word only
    assert {(r.word, r.n) for r in alone.collect()} == {("a", 2), ("d", 1)}


def test_a_floor_of_nothing_is_refused(spark):
    with pytest.raises(ValueError):
        simjoin.most_similar(spark.createDataFrame([(1, "a")], "qid long, q string"), spark.createDataFrame([(1, "a")], "no long, word string"), 0.0, None)


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 40) for k in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("one\r\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = words.ordered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {n: [r.line for r in sorted((r for r in rows if r.file.endswith(n)), key=lambda r: r.ord)] for n in ("a.txt", "b.txt")}
    assert by == {"a.txt": lines, "b.txt": ["one\r", "two"]} and len({(r.file, r.ord) for r in rows}) == len(rows)


def test_malformed_bytes_are_replaced(spark):
    assert one(spark, tf.code_points(F.lit(b"a\xffb\xe0\xa6"))) == [97, 0xFFFD, 98, 0xFFFD]
    assert one(spark, tf.code_points(F.encode(F.lit("ক😀"), "UTF-8"))) == [0x995, 0x1F600]
