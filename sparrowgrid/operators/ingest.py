"""Bulk import of word lists: parse, validate, route, count.

Lines have ord (their order) and line. Nothing is ranked over the whole file: the
capacity is a few thousand words, so the order of the last word that fits is found
by a bounded top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tf
from .lookup import bounded


def parse(lines: DataFrame) -> DataFrame:
    """(ord, en, bn) of every data line: blank lines and a leading header go, a byte order mark is stripped.

    With a column ``file`` each file has a header of its own; file names are as many
    as the files of one import.
    """
    of = ["file"] if "file" in lines.columns else []
    some = lines.select(*of, "ord", tf.trim_space(F.col("line")).alias("line")).where("line <> ''")
    fields = some.select(*of, "ord", tf.split_fields(tf.strip_bom(F.col("line"))).alias("f"))
    en, bn = tf.import_pair(F.col("f"))
    rows = fields.select(*of, "ord", en.alias("en"), bn.alias("bn"))
    first = F.broadcast(some.groupBy(*of).agg(F.min("ord").alias("__first")))  # one row a file
    header = (F.col("ord") == F.col("__first")) & tf.ascii_lower(F.col("en")).isin(*tf.HEADER_WORDS)
    return rows.join(first, of or F.lit(True)).where(~header).select("ord", "en", "bn")


def route(rows: DataFrame, learned: DataFrame, dictionary: DataFrame, capacity: int = 2000) -> DataFrame:
    """(ord, en, bn, outcome): rejected, already_learned, in_dictionary, no_room or added, in that order of precedence.

    A word that was added counts as learned for later lines of the same file; one
    that found no room does not. (The byte limit of the store is not modelled.)
    """
    word = tf.ascii_lower(F.col("en"))
    ok = tf.valid_headword(F.col("en")) & tf.has_bengali(F.col("bn"))
    known = bounded(learned.select(F.col("en").alias("word")).distinct().withColumn("__l", F.lit(True)))
    listed = bounded(dictionary.select(tf.ascii_lower(F.col("word")).alias("word")).distinct().withColumn("__d", F.lit(True)))
    seen = rows.withColumn("word", F.when(ok, word)).join(known, "word", "left").join(listed, "word", "left")
    # Lines are parsed once: both readers below share this exchange, so they ask for the same columns. Rejected lines have no word and are dealt by their order.
    dealt = seen.repartition(F.coalesce("word", F.col("ord").cast("string")))
    new = F.col("word").isNotNull() & F.col("__l").isNull() & F.col("__d").isNull()
    first = dealt.groupBy(F.when(new, F.col("word")).alias("word")).agg(F.min(F.struct("ord", "en", "bn", "__l", "__d")).alias("f")).where("word is not null").select("word", F.col("f.ord").alias("__first"))
    room = max(0, capacity - learned.count())
    last = first.orderBy("__first").limit(room).agg(F.coalesce(F.max("__first"), F.lit(-(1 << 62))).alias("__last"))  # one row
    out = dealt.join(first, "word", "left").join(F.broadcast(last), F.lit(True))
    outcome = (
        F.when(F.col("word").isNull(), "rejected").when(F.col("__l"), "already_learned").when(F.col("__d"), "in_dictionary")
        .when(F.col("__first") > F.col("__last"), "no_room").when(F.col("ord") == F.col("__first"), "added").otherwise("already_learned")
    )
    return out.select("ord", "en", "bn", outcome.alias("outcome"))


OUTCOMES = ("added", "in_dictionary", "already_learned", "rejected", "no_room")


def outcome_counts(routed: DataFrame) -> DataFrame:
    """One row: received and the number of each outcome."""
    return routed.agg(F.count("*").alias("received"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
