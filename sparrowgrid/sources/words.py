"""Word lists and dictionaries at rest."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import text as tf

CAPACITY = 2000


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line) of text files; ``ord`` rises with the line inside a file.

    Files are read in splits. A line's place is its split's first byte plus its number
    within the split, which stays below the split's length; in a file of one split it
    is the line number.
    """
    read = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    lines = read.withColumn("n", F.monotonically_increasing_id())
    first = lines.groupBy("file", "block").agg(F.min("n").alias("first"))  # a row for each split
    return lines.join(F.broadcast(first), ["file", "block"]).select("file", (F.col("block") + F.col("n") - F.col("first")).alias("ord"), "line")


def load_learned(spark: SparkSession, path: str, capacity: int | None = None) -> DataFrame:
    """``path``: TSV lines word<TAB>gloss -> seq, en (lower case), bn.

    Lines are trimmed; blank ones and those without a tab after the first character
    are skipped; nothing is freed of duplicates. All rows, or the first ``capacity``
    of them (the device has room for CAPACITY).
    """
    lines = ordered_lines(spark, path).select("file", "ord", tf.trim_space(F.col("line")).alias("line"))
    at = F.instr("line", "\t")
    rows = lines.where(at > 1).select("file", F.col("ord").alias("seq"), tf.ascii_lower(F.substring("line", F.lit(1), at - 1)).alias("en"), F.substring("line", at + 1, F.length("line")).alias("bn"))
    return (rows if capacity is None else rows.orderBy("file", "seq").limit(capacity)).select("seq", "en", "bn")


def append_learned(rows: DataFrame, path: str) -> None:
    """Adds TSV lines en<TAB>bn."""
    rows.select(F.concat_ws("\t", "en", "bn").alias("value")).write.mode("append").text(path)


def export_learned(store: DataFrame, path: str) -> bool:
    """Writes the store as one ordered TSV file; nothing, and False, if it is empty."""
    if store.isEmpty():
        return False
    store.repartition(1).sortWithinPartitions("seq").select(F.concat_ws("\t", "en", "bn").alias("value")).write.mode("overwrite").text(path)  # a store of at most a few thousand rows
    return True


def learn(store: DataFrame, en: str, bn: str) -> DataFrame | None:
    """The row to add for a taught pair, or None if the word's FIRST row has this gloss already."""
    first = store.where(F.col("en") == en.lower()).orderBy("seq").first()
    if first is not None and first["bn"] == bn:
        return None
    return store.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("seq")).select("seq", F.lit(en.lower()).alias("en"), F.lit(bn).alias("bn"))


def learn_all(store: DataFrame, taught: DataFrame) -> DataFrame:
    """``taught`` (ord: unique, en, bn), one after the other -> ord, en, bn of the rows to add: all but those whose word's FIRST row has this gloss by then.

    A word's first row is the store's, else its first taught pair, so one plan
    decides for all; both are small rows by word, whatever repeats.
    """
    pairs = taught.select("ord", tf.ascii_lower(F.col("en")).alias("en"), "bn")
    known = store.groupBy("en").agg(F.min_by("bn", "seq").alias("__known"), F.lit(True).alias("__in"))
    first = pairs.groupBy("en").agg(F.min(F.struct("ord", "bn")).alias("__first"))
    found = pairs.join(first, "en").join(known, "en", "left")
    new = F.when(F.col("__in"), ~F.col("bn").eqNullSafe(F.col("__known"))).otherwise((F.col("ord") == F.col("__first.ord")) | ~F.col("bn").eqNullSafe(F.col("__first.bn")))
    return found.where(new).select("ord", "en", "bn")


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")``: options ``path``, ``table`` (or ``query``), ``partitions``, split by rowid.

    The file must be readable at the same path on every executor.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "BLOB": "binary"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{c[1]}` {kinds.get((c[2] or '').upper(), 'string')}" for c in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(dict(self.options), schema)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = options, [f.name for f in schema.fields]

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("partitions", 4))
        with self._open() as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.options['table'])}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // n))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        columns = ", ".join(map(_quoted, self.names))
        with self._open() as db:
            yield from db.execute(f"SELECT {columns} FROM {_quoted(self.options['table'])} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


def open_dictionary(spark: SparkSession, path: str, table: str = "dictionary") -> DataFrame:
    """A dictionary table of a SQLite file, or of Parquet."""
    if path.endswith((".db", ".sqlite")):
        spark.dataSource.register(SqliteSource)
        return spark.read.format("sqlite").option("path", path).option("table", table).load()
    return spark.read.parquet(path)


def row_count(dictionary: DataFrame | None) -> int:
    """Rows of the dictionary, -1 without one."""
    return -1 if dictionary is None else dictionary.count()
