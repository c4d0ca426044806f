"""Streams that meet the word stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tf
from ..operators import ingest, lookup


def live_answers(queries: DataFrame, store: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, period: str = "1 second") -> StreamingQuery:
    """Ranks each micro-batch of queries (qid, q) against the store as it is then, so words learned meanwhile are found."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(lookup.top_learned(batch, store(), 10), epoch)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=period).start()


def import_files(lines: DataFrame, store: Callable[[], DataFrame], dictionary: DataFrame, learn: Callable[[DataFrame], None], checkpoint: str, capacity: int = 2000) -> StreamingQuery:
    """Imports every file that lands: ``lines`` is a text stream with file and line order (file, ord, line); files of a batch are taken in turn."""

    def each(batch: DataFrame, epoch: int) -> None:
        for r in sorted(batch.select("file").distinct().collect()):  # the files of one micro-batch
            rows = ingest.route(ingest.parse(batch.where(F.col("file") == r[0])), store(), dictionary, capacity)
            learn(rows.where("outcome = 'added'"))

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers_of(queries: DataFrame, store: Callable[[], DataFrame], path: str) -> DataFrame:
    """All answers to the queries that a stream's source holds now, as Parquet; a batch that is run again replaces its own."""
    kept = lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{path}/answers/epoch={epoch}")
    each = lambda batch, epoch: kept(lookup.top_learned(batch, store(), 10), epoch)
    queries.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return queries.sparkSession.read.parquet(f"{path}/answers").drop("epoch")


def imported(lines: DataFrame, learned: DataFrame, dictionary: DataFrame, path: str, capacity: int = 2000) -> DataFrame:
    """Runs ``import_files`` over what the source holds now, with a store in ``path``; the rows that were learned."""
    spark = lines.sparkSession
    learned.select("en", "bn", F.lit(False).alias("new")).write.parquet(f"{path}/store")

    def add(rows: DataFrame) -> None:
        rows.select(tf.ascii_lower(F.col("en")).alias("en"), "bn", F.lit(True).alias("new")).write.mode("append").parquet(f"{path}/store")

    def now() -> DataFrame:
        return spark.read.parquet(f"{path}/store").select("en", "bn")

    import_files(lines, now, dictionary, add, f"{path}/state", capacity).awaitTermination()
    return spark.read.parquet(f"{path}/store").where("new").select("en", "bn")


def text_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The lines of text files that land in ``path``, with where each stands: line, file, changed, split, row."""
    some = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    at = F.col("_metadata")
    return some.select(F.col("value").alias("line"), at["file_path"].alias("file"), at["file_modification_time"].alias("changed"), at["file_block_start"].alias("split"))


def in_file_order(batch: DataFrame) -> DataFrame:
    """``text_lines`` of a micro-batch -> ord, file, line: files by their time, then name, lines as they stand.

    Within a task rows come as they stand in their split; the splits of a batch are
    numbered on the driver, which sees their names only.
    """
    low = (1 << 33) - 1  # what a partition's rows have of a monotonic id
    splits = sorted(tuple(r) for r in batch.select("changed", "file", "split").distinct().collect())
    numbered = batch.sparkSession.createDataFrame([(f, s, n) for n, (_, f, s) in enumerate(splits)], "file string, split long, nth long")
    placed = batch.withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit(low)))
    return placed.join(F.broadcast(numbered), ["file", "split"]).select((F.col("nth") * (low + 1) + F.col("row")).alias("ord"), "file", "line")


def import_text(spark: SparkSession, folder: str, learned: DataFrame, dictionary: DataFrame, path: str, capacity: int = 2000, files_per_batch: int = 1000) -> DataFrame:
    """Imports the word lists that lie in ``folder`` now, and goes on from there when it is called again; all that was ever learned: en, bn.

    The store is a ledger: what a micro-batch taught is the folder of its epoch, and
    an epoch sees earlier ones only. So a batch that is run again after a failure
    learns the same words once more in the same place, and none twice.
    """
    store = f"{path}/store"

    def known(epoch: int) -> DataFrame:
        return spark.read.parquet(store).where(F.col("epoch") < epoch).select("en", "bn")

    def each(batch: DataFrame, epoch: int) -> None:
        rows = ingest.route(ingest.parse(in_file_order(batch)), known(epoch), dictionary, capacity)
        added = rows.where("outcome = 'added'").select(tf.ascii_lower(F.col("en")).alias("en"), "bn")
        added.write.mode("overwrite").parquet(f"{store}/epoch={epoch}")

    learned.select("en", "bn").write.mode("ignore").parquet(f"{store}/epoch=-1")
    text_lines(spark, folder, files_per_batch).writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(store).where("epoch >= 0").select("en", "bn")
