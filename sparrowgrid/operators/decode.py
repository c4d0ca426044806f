"""Decoding of class scores, and text forms of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = 0
#: Flag bits: ink at one of four edges; padding cut; from a split; unrefined; punctuation.
TRUNCATED, PAD_CLIPPED, SPLIT, UNREFINED, PUNCTUATION = 15, 16, 32, 64, 128


def steps(logits: Column, classes: int) -> Column:
    """Rows of ``classes`` scores each."""
    n = F.floor(F.size(logits) / classes).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(logits, k * classes + 1, F.lit(classes)))


def argmax(row: Column) -> Column:
    """Index from 0 of the greatest, the first of equals."""
    return (F.array_position(row, F.array_max(row)) - 1).cast("int")


def greedy_ctc(rows: Column, alphabet: list[str]) -> Column:
    """The best class of each step; repeats and blanks (class 0) dropped, the rest spelled."""
    best = F.transform(rows, argmax)
    kept = F.filter(F.transform(best, lambda c, i: F.when((c != BLANK) & ~F.coalesce(F.try_element_at(best, F.when(i > 0, i)) == c, F.lit(False)), c)), lambda c: c.isNotNull())
    names = F.array(*map(F.lit, alphabet))
    return F.array_join(F.transform(kept, lambda c: F.element_at(names, c)), "")


def margin(row: Column) -> Column:
    """Best minus second best."""
    s = F.sort_array(row, asc=False)
    return F.element_at(s, 1) - F.element_at(s, 2)


def step_stats(rows: Column) -> dict[str, Column]:
    """How often the blank wins, the mean margin (whole part, at most 127), and the range of scores."""
    total = F.aggregate(F.transform(rows, margin), F.lit(0).cast("long"), lambda a, m: a + m)
    flat = F.flatten(rows)
    return {
        "blank_wins": F.size(F.filter(rows, lambda r: argmax(r) == BLANK)), "mean_margin": F.least(F.lit(127), F.floor(total / F.size(rows))).cast("int"),
        "low": F.array_min(flat), "high": F.array_max(flat),
    }


def recognizable(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(TRUNCATED | PUNCTUATION)) == 0


def edge_flags(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int, border: int) -> Column:
    """A bit for each side (left, top, right, bottom) that the ink comes within ``border`` of."""
    bits = [(x1 < border, 1), (y1 < border, 2), (x2 >= width - border, 4), (y2 >= height - border, 8)]
    out = F.lit(0)
    for near, bit in bits:
        out = out.bitwiseOR(F.when(near, bit).otherwise(0))
    return out


def punctuation_flag(chars: Column, ink_height: Column, char_height: int) -> Column:
    """Set for one or two parts that are lower than 55 % of a character."""
    return F.when(chars.between(1, 2) & (ink_height * 100 < 55 * char_height), PUNCTUATION).otherwise(0)


def select_boxes(boxes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (frame, list): recognizable boxes named in the comma list, in box order; all of them for an empty list.

    What is no number counts as 0; repeats count once; numbers out of range name nothing.
    """
    from ..functions.text import leading_int

    ok = boxes.where(recognizable(F.col("flags")))
    every = ok.join(wanted.where("list = ''").select("frame"), "frame", "left_semi")
    named = wanted.where("list <> ''").select("frame", F.explode(F.array_distinct(F.transform(F.split("list", ","), leading_int))).alias("box"))
    return every.unionByName(ok.join(named, ["frame", "box"], "left_semi").select(*every.columns))


def box_counts(boxes: DataFrame) -> DataFrame:
    f = F.col("flags")
    return boxes.groupBy("frame").agg(
        F.count("*").alias("boxes"), F.count_if(f.bitwiseAND(F.lit(TRUNCATED)) != 0).alias("truncated"), F.count_if(f.bitwiseAND(F.lit(PUNCTUATION)) != 0).alias("punctuation"), F.count_if(recognizable(f)).alias("recognizable"),
    )


def detect_json(boxes: DataFrame) -> DataFrame:
    """One JSON document for each frame, boxes in order."""
    b = F.struct("box", "x1", "y1", "x2", "y2", "flags")
    whole = boxes.groupBy("frame").agg(F.sort_array(F.collect_list(b)).alias("boxes"))
    return whole.select("frame", F.to_json(F.struct(F.size("boxes").alias("count"), "boxes")).alias("json"))


def ndjson(rows: DataFrame, key: str, seq: str, body: Column) -> DataFrame:
    """A begin line, one line for each row, and a done line with the row count, numbered within each key."""
    head = rows.groupBy(key).agg(F.count("*").alias("n"))
    lines = rows.select(key, F.col(seq).cast("long").alias("at"), F.to_json(body).alias("line"))
    begin = head.select(key, F.lit(-1).cast("long").alias("at"), F.to_json(F.struct(F.lit("begin").alias("event"), F.col("n").alias("total"))).alias("line"))
    done = head.select(key, F.lit((1 << 62)).alias("at"), F.to_json(F.struct(F.lit("done").alias("event"), F.col("n").alias("recognized"))).alias("line"))
    return begin.unionByName(lines).unionByName(done)


def box_line() -> Column:
    """A box as a line of a report."""
    return F.format_string("BOX %d x1=%d y1=%d x2=%d y2=%d flags=%d", "box", "x1", "y1", "x2", "y2", "flags")


def read_ndjson(lines: DataFrame, schema: str = "event string, total long, box int, status string, recognized long") -> DataFrame:
    """``lines`` (value, and what else there is) of JSON -> their fields; blank and broken lines are passed over. Works on streams too."""
    row = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    return lines.where(F.trim("value") != "").withColumn("row", row).where("row is not null").select(*[c for c in lines.columns if c != "value"], "row.*").where(" or ".join(f"{f.split(' ')[0]} is not null" for f in schema.split(", ")))
