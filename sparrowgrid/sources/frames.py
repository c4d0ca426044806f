"""Frames, photos, settings and command lines at rest; their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 480, 640


def raw_frames(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Raw gray frames named ``<id>_<width>x<height>[_<crc>].gray`` -> id, w, h, crc, pixels, error.

    An error names dimensions out of range, a length other than w * h, or a wrong CRC.
    """
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", "*.gray").load(path)
    part = lambda k: F.regexp_extract("path", r"([^/_]+)_(\d+)x(\d+)(?:_([0-9a-fA-F]{1,8}))?\.gray$", k)
    f = files.select(part(1).alias("id"), part(2).try_cast("int").alias("w"), part(3).try_cast("int").alias("h"), F.when(part(4) != "", F.conv(part(4), 16, 10).cast("long")).alias("crc"), F.col("content").alias("pixels"))
    return f.withColumn("error", frame_error(F.col("w"), F.col("h"), F.octet_length("pixels"), F.col("crc"), F.crc32("pixels")))


def frame_error(w: Column, h: Column, size: Column, crc: Column, real: Column) -> Column:
    return (
        F.when(w.isNull() | h.isNull() | (w < 1) | (w > WIDTH) | (h < 1) | (h > HEIGHT), "dimensions")
        .when(size != w * h, "length").when(crc.isNotNull() & (crc != real), "crc")
    )


def pixel_array(pixels: Column) -> Column:
    """Bytes as an array of 0..255."""
    return F.transform(F.regexp_extract_all(F.hex(pixels), F.lit(".."), 0), lambda x: F.conv(x, 16, 10).cast("int"))


def photos(spark: SparkSession, path: str) -> DataFrame:
    """Stored photos: slot (from photo<slot>), path, bytes, written."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.select(F.regexp_extract("path", r"photo(\d+)\.\w+$", 1).try_cast("int").alias("slot"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("written")).where("slot is not null")


def photo(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The bytes of one photo; no row if there is none of that name."""
    return spark.read.format("binaryFile").option("pathGlobFilter", name).load(path).select("path", "content")


def commands(lines: DataFrame) -> DataFrame:
    """``lines`` (value) -> command (the first character) and its trimmed argument; works on streams too."""
    line = F.regexp_replace("value", r"^[ \t-\r]+|[ \t-\r]+$", "")
    return lines.where(line != "").select(F.substring(line, 1, 1).alias("command"), F.trim(F.substring(line, F.lit(2), F.length(line))).alias("argument"))


def transfer_header(argument: Column) -> tuple[Column, Column]:
    """Size and CRC (hexadecimal) of an upload command's argument; nulls where missing."""
    part = F.split(F.trim(argument), r"\s+")
    return F.try_element_at(part, F.lit(1)).try_cast("long"), F.conv(F.try_element_at(part, F.lit(2)), 16, 10).try_cast("long")


def settings(stored: DataFrame, defaults: dict[str, int], version: int = 2) -> DataFrame:
    """``stored`` (name, value) -> every setting; the defaults where it is missing, or everywhere if the stored version differs."""
    spark = stored.sparkSession
    base = spark.createDataFrame(list(defaults.items()), "name string, fallback long")
    current = stored.where((F.col("name") == "ver") & (F.col("value") == version)).limit(1).select(F.lit(True).alias("__ok"))
    own = stored.select("name", "value").join(F.broadcast(current), F.lit(True))  # one row, or none
    return base.join(own, "name", "left").select("name", F.coalesce("value", "fallback").alias("value"))


def save_settings(values: dict[str, int], spark: SparkSession, path: str, version: int = 2) -> None:
    spark.createDataFrame([*values.items(), ("ver", version)], "name string, value long").coalesce(1).write.mode("overwrite").parquet(path)


def clear(spark: SparkSession, path: str) -> int:
    """Empties a store of Parquet rows; how many there were."""
    held = spark.read.parquet(path)
    n, schema = held.count(), held.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return n


def installed(staged: DataFrame, size: Column, crc: Column) -> DataFrame:
    """``staged`` (content, ...) with received, error and ok: each file against its announced size and CRC."""
    error = F.when(F.octet_length("content") != size, "size").when(F.crc32("content") != crc, "crc")
    return staged.withColumns({"received": F.octet_length("content"), "error": error}).withColumn("ok", F.col("error").isNull())


def install(staged: DataFrame, size: int, crc: int) -> DataFrame:
    """``staged`` (content) -> received, error and ok of one file."""
    return installed(staged, F.lit(size), F.lit(crc)).select("received", "error", "ok")


def hex_dump(pixels: Column, columns: int) -> Column:
    """Lines of hexadecimal, ``columns`` bytes each."""
    return F.array_join(F.regexp_extract_all(F.hex(pixels), F.lit(f".{{1,{2 * columns}}}"), 0), "\n")


def bmp(pixels565: Column, width: int, height: int) -> Column:
    """A 24-bit bitmap (rows from the bottom) of an array of RGB565 values."""
    row = -(-width * 3 // 4) * 4
    number = lambda v, n: v.to_bytes(n, "little").hex()
    header = "424d" + number(54 + row * height, 4) + number(0, 4) + number(54, 4) + number(40, 4) + number(width, 4) + number(height, 4) + number(1, 2) + number(24, 2) + number(0, 24)

    def pixel(v: Column) -> Column:
        r, g, b = F.shiftleft(F.shiftright(v, 11).bitwiseAND(F.lit(31)), 3), F.shiftleft(F.shiftright(v, 5).bitwiseAND(F.lit(63)), 2), F.shiftleft(v.bitwiseAND(F.lit(31)), 3)
        return F.concat(*[F.lpad(F.hex(c), 2, "0") for c in (b, g, r)])

    line = lambda y: F.concat(F.array_join(F.transform(F.slice(pixels565, y * width + 1, F.lit(width)), pixel), ""), F.lit("00" * (row - width * 3)))
    return F.unhex(F.concat(F.lit(header), F.array_join(F.transform(F.sequence(F.lit(height - 1), F.lit(0)), line), "")))
