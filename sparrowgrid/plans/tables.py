"""Stand-ins for the engine's inputs, made from the test tables; each as a plan and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Typed words with slips, blanks, capitals and marks.
QUERY_WORDS = [
    "red widget", "red widgt", "old", "blu bolt", "gear", "zzz", "hot plate", "cold rods", "small rin", "new gizmo?", "x", "RED RING", "large anvils", "anvil hot", "",
    "--blue plate!", "rod", "cold gizmo", "smal bolt", "hot",
]


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, q): the typed words, below zero, and every distinct word of all conversations by where it first stands."""
    typed = spark.createDataFrame([(i - len(QUERY_WORDS), q) for i, q in enumerate(QUERY_WORDS)], "qid long, q string")
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("i", "q"))
    place = F.col("conv_id") * (1 << 28) + F.col("turn") * (1 << 20) + F.col("i")
    return typed.union(said.groupBy("q").agg(F.min(place).alias("qid")).select("qid", "q"))


QUERIES_SQL = (
    "SELECT CAST(qid AS BIGINT) AS qid, q FROM (VALUES " + ", ".join(f"({i - len(QUERY_WORDS)}, '{q}')" for i, q in enumerate(QUERY_WORDS)) + ") AS t(qid, q) UNION ALL "
    f"SELECT min(conv_id * {1 << 28} + turn * {1 << 20} + i - 1) AS qid, q FROM (SELECT conv_id, turn, unnest(ws) AS q, generate_subscripts(ws, 1) AS i "
    "FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM conversations)) GROUP BY q"
)


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_name").alias("word")).agg(F.min("p_partkey").alias("no"), F.min_by("p_type", "p_partkey").alias("meaning"))


DICTIONARY_SQL = "SELECT p_name AS word, min(p_partkey) AS no, arg_min(p_type, p_partkey) AS meaning FROM part GROUP BY p_name"


def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a learned row; words repeat, as in a store that is only appended to."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.lower("p_name").alias("en"), F.col("p_type").alias("bn"))


LEARNED_SQL = "SELECT p_partkey AS seq, lower(p_name) AS en, p_type AS bn FROM part"


def few_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of every part's word once, most of them other than the dictionary's: those not of three colours and ages have "set" added."""
    en = F.when(F.col("en").rlike("^(red|old|hot)"), F.col("en")).otherwise(F.concat("en", F.lit(" set")))
    return learned(spark, sf_dir).groupBy(en.alias("en")).agg(F.min("seq").alias("seq"), F.min_by("bn", "seq").alias("bn")).select("seq", "en", "bn")


FEW_LEARNED_SQL = f"SELECT min(seq) AS seq, w AS en, arg_min(bn, seq) AS bn FROM (SELECT seq, bn, CASE WHEN regexp_matches(en, '^(red|old|hot)') THEN en ELSE en || ' set' END AS w FROM ({LEARNED_SQL})) GROUP BY w"

GLOSS, GLOSS2 = "শব্দ", "দুই"


def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header and one line for each part, of ten kinds."""
    k, name = F.col("p_partkey"), F.col("p_name")
    letters = lambda n: F.translate(n.cast("string"), "0123456789", "abcdefghij")
    kind = k % 10
    line = (
        F.when(kind == 0, F.concat(k.cast("string"), F.lit(","), name, F.lit(f",{GLOSS}")))
        .when(kind == 1, F.concat(F.lit("  "), name, F.lit(f" , {GLOSS} ")))
        .when(kind == 2, F.concat(F.lit("t"), letters(k), F.lit(f'\t"{GLOSS}"')))
        .when(kind == 3, F.concat(F.lit("q"), letters(k), F.lit(f',"{GLOSS}, {GLOSS2}",more')))
        .when(kind == 4, F.concat(name, F.lit(",english only")))
        .when(kind == 5, F.concat(name, k.cast("string"), F.lit(f",{GLOSS}")))
        .when(kind == 6, F.concat(F.lit("W"), letters(k), F.lit(f",{GLOSS}")))
        .when(kind == 7, F.concat(F.lit("s"), letters(k), F.lit(f',"say ""hi"" {GLOSS}"')))
        .when(kind == 8, F.concat(F.lit("w"), letters(k - 2), F.lit(f",{GLOSS2}")))
        .otherwise(name)
    )
    header = spark.createDataFrame([(-1, "﻿id,word,meaning"), (-2, "   ")], "ord long, line string")
    return table(spark, sf_dir, "part").select(k.cast("long").alias("ord"), line.alias("line")).unionByName(header)


def _letters(n: str) -> str:
    return f"translate(CAST({n} AS VARCHAR), '0123456789', 'abcdefghij')"


IMPORT_SQL = f"""
SELECT p_partkey AS ord, CASE p_partkey % 10
  WHEN 0 THEN p_partkey || ',' || p_name || ',{GLOSS}' WHEN 1 THEN '  ' || p_name || ' , {GLOSS} '
  WHEN 2 THEN 't' || {_letters('p_partkey')} || chr(9) || '"{GLOSS}"' WHEN 3 THEN 'q' || {_letters('p_partkey')} || ',"{GLOSS}, {GLOSS2}",more'
  WHEN 4 THEN p_name || ',english only' WHEN 5 THEN p_name || p_partkey || ',{GLOSS}' WHEN 6 THEN 'W' || {_letters('p_partkey')} || ',{GLOSS}'
  WHEN 7 THEN 's' || {_letters('p_partkey')} || ',"say ""hi"" {GLOSS}"' WHEN 8 THEN 'w' || {_letters('(p_partkey - 2)')} || ',{GLOSS2}' ELSE p_name END AS line
FROM part UNION ALL SELECT -1, chr(65279) || 'id,word,meaning' UNION ALL SELECT -2, '   '"""

#: Frames of 8 x 8 pixels: an embedding's components as 0..255.
SIDE = 8


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, px): pixels in row-major order. An embedding of another length than 64 is no frame and is left out, here and in the SQL."""
    e = table(spark, sf_dir, "embeddings").where("size(embedding) = 64")
    px = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.5) * 255).cast("int"))))
    return e.select(F.col("vec_id").alias("frame"), px.alias("px"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, v)."""
    p = frames(spark, sf_dir).select("frame", F.posexplode("px").alias("i", "v"))
    return p.select("frame", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).cast("int").alias("x"), "v")


PIXELS_SQL = """SELECT frame, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.5) * 255))) AS INTEGER) AS v
FROM (SELECT vec_id AS frame, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE len(embedding) = 64)"""
