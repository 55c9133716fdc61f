"""Sharding by global byte-size prefix sums, in DataFrame operations only.

Rows are put in order of their id by range partitioning. Each partition reports its bytes and rows; running sums over these few
totals give every row its offset in the whole table, and cutting the byte axis at equal targets gives contiguous shards of nearly
equal size. No row crosses the driver, and no step holds more than a range partition's narrow rows together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import partitions, stage, whole

OVERHEAD = 16
N_SHARDS = 40


def assign_shards(df: DataFrame, n_shards: int = N_SHARDS, id_column: str = "doc_id", text_column: str = "text", carry: bool = False) -> DataFrame:
    """A shard and a place in it for every row.

    Returns the id, size (UTF-8 bytes of the text plus OVERHEAD), text_crc32, law ("bytes"), shard (0 to n_shards - 1, contiguous in
    order of the id), slot (from 0, without gaps in a shard) and grown_shard (null: this law moves rows when a shard is added).
    With carry, a column named row holds the input's columns as a struct, whatever their names.

    Null texts count as empty. Rows with equal ids are ordered by CRC, then size, then place in the input, so that repeated rows
    each get their own slot; null ids come first. A row lies in the shard in which its middle byte falls; a row larger than a
    shard's share leaves shards empty. An empty table gives an empty result.
    """
    text = whole(F.col(f"input.`{text_column}`"))
    held = df.alias("input").select(
        F.col(f"input.`{id_column}`").alias("id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
        *([F.struct("input.*").alias("row")] if carry else []),
    )
    order = ["id", "text_crc32", "size", "place"]
    spread = held.repartitionByRange(partitions(df.sparkSession), *order)
    rows = stage(spread.withColumn("part", F.spark_partition_id()))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    offsets = parts.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("bytes_in_all"),
    )
    so_far = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        rows.withColumns({"upto": F.sum("size").over(so_far), "nth": F.row_number().over(so_far)})
        .join(F.broadcast(offsets), "part")  # one row for each range partition
        .withColumn("middle", F.col("bytes_before") + F.col("upto") - F.col("size") / 2)
        .withColumn("shard", F.least(F.floor(F.col("middle") / F.col("bytes_in_all") * n_shards), F.lit(n_shards - 1)).cast("int"))
        .withColumn("nth", F.col("rows_before") + F.col("nth") - 1)
    )
    first = placed.groupBy("shard").agg(F.min("nth").alias("first_nth"))
    return placed.join(F.broadcast(first), "shard").select(  # one row for each shard
        F.col("id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") - F.col("first_nth")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["row"] if carry else []),
    )


def write_shards(df: DataFrame, path: str, n_shards: int = N_SHARDS, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes df's rows as Parquet, a folder for each shard; its files, in order of their names, hold its rows in order of their slots.

    Rows are dealt by ranges of shard and slot, so a large shard is written by many tasks. All rows and columns are written, nulls
    included, but for a column named shard, whose name the folders take; an empty table writes no shards.
    """
    sharded = assign_shards(df, n_shards, id_column, text_column, carry=True)
    dealt = sharded.select("shard", "slot", "row").repartitionByRange(max(n_shards, partitions(df.sparkSession)), "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select("shard", *[F.col(f"row.`{c}`") for c in df.columns if c != "shard"]).write.partitionBy("shard").parquet(path)
