"""A store of photos in rings of slots: a sink with commit and abort, and its recovery by listing.

``df.write.format("photo_ring").option("path", folder).mode("append").save()`` takes
key, generation, declared (bytes) and data. Photo number ``generation`` goes to slot
generation % slots of its key's ring, where the newest counts. A photo whose data are
not as long as declared is a short write: it deletes its slot.

Tasks write their photos as they come, each under a name that says job, task attempt,
key, generation and size; the commit adds one small file that lists the attempts that
count. A failed attempt's or job's files are in no list, so they were never written;
an abort removes them. Commit and abort touch as many names as there are tasks, not
photos. ``recovered`` lists the files, in Spark, and reads what each slot holds.

The folder is any that pyarrow's file systems and Spark reach by one address.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

SLOTS = 4
NAME = r"/job=([^/]+)/attempt=(\d+)/([^/]*)~(-?\d+)~(\d+)\.jpg$"


@dataclass
class Attempt(WriterCommitMessage):
    attempt: int
    photos: int


class PhotoRing(DataSource):
    """The sink; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "photo_ring"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a photo ring is only appended to; new generations replace old ones")
        return _RingWriter(self.options["path"])


class _RingWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else "file://" + self.path.removeprefix("file:"))

    def write(self, rows: Iterator) -> Attempt:
        store, root = self._place()
        attempt, photos = TaskContext.get().taskAttemptId(), 0
        folder = f"{root}/job={self.job}/attempt={attempt}"
        store.create_dir(folder, recursive=True)
        for r in rows:
            data = b"" if r["data"] is None or len(r["data"]) != r["declared"] else bytes(r["data"])
            with store.open_output_stream(f"{folder}/{quote(str(r['key']), safe='')}~{r['generation']}~{len(data)}.jpg") as f:
                f.write(data or b"-")  # readers skip files of no bytes
            photos += 1
        return Attempt(attempt, photos)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, root = self._place()
        done = [{"attempt": m.attempt, "photos": m.photos} for m in messages if m]
        store.create_dir(f"{root}/_commits", recursive=True)
        with store.open_output_stream(f"{root}/_commits/_{self.job}") as f:  # a reader sees the list once it has its name
            f.write("".join(json.dumps({"job": self.job} | d) + "\n" for d in done).encode())
        store.move(f"{root}/_commits/_{self.job}", f"{root}/_commits/{self.job}.json")

    def abort(self, messages: list[Attempt | None]) -> None:
        store, root = self._place()
        if store.get_file_info(f"{root}/job={self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/job={self.job}")


def write_photos(photos: DataFrame, path: str, slots: int = SLOTS) -> None:
    """``photos`` (key, generation, declared, data): the newest of each slot goes to the store, older ones would be replaced at once."""
    photos.sparkSession.dataSource.register(PhotoRing)
    slot = F.pmod("generation", F.lit(slots))
    newest = photos.groupBy("key", slot.alias("slot")).agg(F.max_by(F.struct("declared", "data"), "generation").alias("p"), F.max("generation").alias("generation"))
    newest.select("key", "generation", "p.declared", "p.data").write.format("photo_ring").option("path", path).mode("append").save()


def recovered(spark: SparkSession, path: str, slots: int = SLOTS) -> DataFrame:
    """key, slot, generation, bytes and data of every slot in use. A store without a commit is empty."""
    store, root = _RingWriter(path)._place()
    if store.get_file_info(f"{root}/_commits").type == fs.FileType.NotFound:
        return spark.createDataFrame([], "key string, slot int, generation long, bytes long, data binary")
    done = spark.read.schema("job string, attempt long, photos long").json(f"{path}/_commits/*.json").select("job", "attempt")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jpg").load(path)
    part = lambda k: F.regexp_extract("path", NAME, k)
    listed = files.select("path", part(1).alias("job"), part(2).cast("long").alias("attempt"), F.url_decode(F.url_decode(part(3))).alias("key"), part(4).cast("long").alias("generation"), part(5).cast("long").alias("bytes"))
    slot = F.pmod("generation", F.lit(slots)).cast("int")
    counted = listed.join(done, ["job", "attempt"], "left_semi").withColumn("slot", slot)
    latest = counted.withColumn("__n", F.row_number().over(Window.partitionBy("key", "slot").orderBy(F.desc("generation"), "path"))).where("__n = 1 and bytes > 0")
    return latest.join(files.select("path", F.col("content").alias("data")), "path").select("key", "slot", "generation", "bytes", "data")


def photo_count(held: DataFrame) -> DataFrame:
    """key, total: what a restart counts on from, the highest slot in use plus one."""
    return held.groupBy("key").agg((F.max("slot") + 1).cast("int").alias("total"))
