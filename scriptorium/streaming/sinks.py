"""Stream sinks: keyed upserts and pairs of tables, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.writes import latest
from scriptorium.sources.scratch import file_system
from scriptorium.streaming.commits import commit, last_commit

#: Buckets of keys in a table that a stream updates; a batch rewrites those that it has keys of.
BUCKETS = 64


def _run(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(stream: DataFrame, path: str, checkpoint: str, **stamps) -> StreamingQuery:
    """Appends batches as Parquet, a folder for each batch, so that a batch which runs again replaces itself.

    stamps: columns with one value each that tell what wrote a row; readers find the batch as the partition column batch.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumns({k: F.lit(v) for k, v in stamps.items()}).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return _run(stream, checkpoint, write)


def _versions(spark: SparkSession, path: str, kept: dict[str, int], buckets: list[int]) -> DataFrame | None:
    """The rows of some buckets in the version that a mark names; None if it names none of them."""
    some = [f"{path}/bucket={b}/batch={kept[str(b)]}" for b in buckets if str(b) in kept]
    return spark.read.option("basePath", path).parquet(*some).drop("bucket", "batch") if some else None


def upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that upsert_stream keeps, as of its last mark; None before the first batch."""
    _, mark = last_commit(spark, path)
    kept = mark.get("buckets", {})
    return _versions(spark, path, kept, [int(b) for b in kept])


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, stamp: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps one row for each key, the one with the greatest order; upserted() reads the table.

    Rows lie in buckets by a hash of their key. A batch reads and rewrites only the buckets of its own keys, as new versions beside the old
    ones, and a mark makes them visible together; the version before goes with the next mark. Of rows with equal order, the one of the later
    batch stays, and within a batch the one with the greater hash of all its columns. A batch that is marked already does nothing, so
    running it again changes nothing.

    stamp: a column that tells when a row was written; rows that stay keep theirs. buckets belongs to the table and never changes.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        last, mark = last_commit(spark, path)
        if last >= n:
            return
        kept = mark.get("buckets", {})
        fresh = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())  # buckets rows at most
        fresh = latest(fresh.withColumn("_hash", F.xxhash64(*batch.columns)), keys, F.desc(order), F.desc("_hash")).drop("_hash")
        if stamp:
            fresh = fresh.withColumn(stamp, F.current_timestamp())
        old = _versions(spark, path, kept, touched)
        if old is not None:
            old = old.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            both = old.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
            fresh = latest(both, keys, F.desc(order), F.desc("_new")).drop("_new")
        out = fresh.withColumn("batch", F.lit(n)).withColumnRenamed("_bucket", "bucket").repartition("bucket")
        out.write.partitionBy("bucket", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        replaced = [f"bucket={b}/batch={kept[str(b)]}" for b in touched if str(b) in kept]
        commit(spark, path, n, {"buckets": kept | {str(b): n for b in touched}, "replaced": replaced})
        for folder in mark.get("replaced", []):
            fs, at = file_system(spark, f"{path}/{folder}")
            fs.delete(at, True)

    return _run(stream, checkpoint, write)


def two_tables(stream: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], paths: tuple[str, str], checkpoint: str) -> StreamingQuery:
    """Writes two projections of each batch, such as orders and their audit rows, which both() shows together or not at all.

    One mark, beside the first table, is set when both are written. A batch that runs again replaces its files in both, if it is not marked.
    """

    def write(batch: DataFrame, n: int) -> None:
        if last_commit(batch.sparkSession, paths[0])[0] >= n:
            return
        batch.persist()
        try:
            for project, path in zip((first, second), paths, strict=True):
                project(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")
        finally:
            batch.unpersist()
        commit(batch.sparkSession, paths[0], n, {})

    return _run(stream, checkpoint, write)


def both(spark: SparkSession, paths: tuple[str, str]) -> tuple[DataFrame, DataFrame] | None:
    """The two tables of two_tables(), both up to the last marked batch, with the column batch; None before the first."""
    last, _ = last_commit(spark, paths[0])
    if last < 0:
        return None
    a, b = (spark.read.parquet(path).where(F.col("batch") <= last) for path in paths)
    return a, b
