"""What the operators share: scratch tables in the cluster's shared folder, and small expressions."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.shipping import ship

__all__ = ["drop", "give_back", "giving_back", "join_hot", "lower_ascii", "maybe_among", "partitions", "scratch_dir", "ship", "stage", "total", "whole", "words"]

#: White space between words, as a regular expression class and as the characters themselves.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Bits of a hash that maybe_among() tells apart.
BITS = 26
#: Keys with over one in so many rows are hot.
HOT = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; in local mode without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and returns a reader of it, which cuts its lineage.

    The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")  # scratch tables hold whole texts and stay until the end
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    held = spark.read.schema(df.schema).parquet(path)
    held._scratch = path
    return held


def drop(*tables: DataFrame) -> None:
    """Deletes tables of stage() when all that is read from them has been written itself."""
    for held in tables:
        spark = held.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(held._scratch)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """left joined with right, which has one row for each of left's keys, and how many rows of left that is (the column rows).

    Keys with over 1 / HOT of left's rows, HOT at most, are broadcast, so that no task gets all rows of one of them.
    """
    hot = F.col(rows) * HOT > left.count()
    most, fewer = right.where(hot).drop(rows), right.where(~hot).drop(rows)
    found = left.join(F.broadcast(most), key)
    rest = left.join(F.broadcast(most.select(key)), key, "left_anti").join(fewer, key)
    return found.unionByName(rest)


def give_back() -> None:
    """Returns a worker's free memory to the system; workers stay alive between tasks, beside those of other stages."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives back what run's own variables held too; large arrays are returned as soon as they are freed."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which grows with use if it is not set
        yield from run(batches)
        give_back()

    return outer


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df with a column maybe, false only where column is not in keys; both hold 64-bit hashes.

    A bitmap over the first BITS bits of keys is broadcast: 8 MB at most at any size. More keys let more rows through and lose none.
    """
    bit = lambda c: F.shiftrightunsigned(c, 64 - BITS)
    one = keys.toDF("_key").select(F.shiftright(bit("_key"), 15).alias("_cell"), bit("_key").bitwiseAND(F.lit(32767)).alias("_at"))
    maps = one.groupBy("_cell").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    at = bit(column).bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = df.withColumn("_cell", F.shiftright(bit(column), 15)).join(F.broadcast(maps), "_cell", "left")
    return held.withColumn("maybe", F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1, F.lit(False))).drop("_cell", "_bits")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def whole(text: Column) -> Column:
    """The text, and an empty one for null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters other than white space; none for an empty or null text."""
    trimmed = F.btrim(whole(text), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+"))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)
