"""Queries against their SQL on rows that the test tables lack at small sizes."""

import os
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sparrowgrid import catalog
from sparrowgrid.operators import arrays, geometry
from sparrowgrid.plans import streams


def agrees(spark, folder, name, **tables):
    """Whether a query gives the SQL's rows over ``tables`` (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(folder))
    rel = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted(rel.fetchall(), key=str)
    assert sorted((tuple(r) for r in df.select(names).collect()), key=str) == want
    return want


@pytest.mark.parametrize("name", ["line_words", "line_places"])
def test_a_last_line_of_three_letters_keeps_its_own_step(spark, tmp_path, name):
    """Its height is not taken for capitals, so its step is longer than that of the lines above."""
    full = " ".join(["x" * 40, "y" * 15] * 7)
    want = agrees(spark, tmp_path, name, benchmark=([(n, f"{full} {'z' * n}") for n in (2, 3, 4)], "item_id long, text string"))
    last = {r[0]: r[1] if name == "line_words" else r[2] for r in want if r[-1] == r[0]}
    assert len(want) == 45 and last[4] == max(last.values()) and last[2] == last[3] < last[4]


@pytest.mark.parametrize("name", ["chunk_assembly", "stream_upload"])
def test_an_overflow_before_the_abort_is_the_first_error(spark, tmp_path, name):
    """143 is declared 5 bytes short and aborted: a full piece may overflow before the last piece comes."""
    rows = [(143 * 2, "x" * 1026), (143 * 3, "x" * 1030), (143 * 4, "x" * 900), (143 * 5, "x" * 4097), (11, "x" * 1026), (13, "x" * 1026), (7, ""), (1, "y")]
    want = agrees(spark, tmp_path, name, documents=(rows, "doc_id long, text string"))
    assert sum("overflow" in r for r in want) == 3 and sum("aborted" in r for r in want) == 3


#: Declared below zero bytes (no text, or under five, of 143), without a text, without an id, and with one id for several.
ODD = [(143, ""), (286, "abc"), (429, "abcd"), (572, "abcde"), (11, ""), (22, "abcd"), (1001, "a"), (13, ""), (1, ""), (1, "y" * 2000), (1, None), (1, "y" * 2000), (2, None), (26, None), (143, None), (143, "x" * 1026), (5, "é" * 512), (5, "é" * 513), (None, "z")]


@pytest.mark.parametrize("name", ["chunk_assembly", "stream_upload"])
def test_transfers_of_odd_sizes_and_ids(spark, tmp_path, name):
    """143 is declared 5 bytes short and aborted with its last piece: an empty one has overflowed before it comes."""
    want = agrees(spark, tmp_path, name, documents=(ODD, "doc_id long, text string"))
    assert sum("overflow" in r for r in want) == 6 and sum("aborted" in r for r in want) == 5


def test_otsu_takes_time_in_proportion_to_its_values(spark):
    """Each step once read the sorted values and their total anew."""
    values = F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda k: F.when(k <= 5000, k / 1e6).otherwise(k / 1e6 + 1))
    begin = time.monotonic()
    got = spark.range(1).select(arrays.otsu_sorted(F.when(F.col("id") >= 0, values))).first()[0]
    assert abs(got - 0.5050005) < 1e-9
    assert time.monotonic() - begin < 15


def test_points_are_dealt_once_and_not_joined_again(spark):
    """Two exchanges: the points, and the boxes by their cells; the best box is taken where they meet."""
    points = spark.createDataFrame([(1, 1, 5, 5), (1, 2, 300, 5), (2, 3, 5, 5)], "frame long, pid long, px int, py int")
    boxes = spark.createDataFrame([(1, k, 0, 0, x, 10, False, None) for k, x in enumerate((150, 20, 20))], "frame long, box int, x1 int, y1 int, x2 int, y2 int, geom boolean, quad array<int>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = geometry.box_at(points, boxes)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1, "inside"), (1, 2, None, "none"), (2, 3, None, "none")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_word_lists_land_in_their_order(spark, tmp_path):
    """By time, which is what the stream follows."""
    lines = spark.range(1000).repartition(7).select(F.col("id").alias("ord"), F.format_string("%04d", "id").alias("line"))
    streams._land(lines, str(tmp_path / "lists"), 5)
    files = sorted(Path(tmp_path, "lists").glob("*.txt"), key=os.path.getmtime)
    assert len({os.stat(f).st_mtime_ns // 1_000_000 for f in files}) == len(files) == 5
    assert "".join(f.read_text() for f in files).split() == [f"{k:04d}" for k in range(1000)]
