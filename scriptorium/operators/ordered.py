"""Folds over the ordered rows of each key.

A key with few rows is folded in one pass. The rows of a key with many are cut into blocks in their order: a first pass sums each block up
as a function from the state before it to the state after it, a second one runs through these sums, and a third folds all blocks at once,
each from its own first state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.scratch import scratch_dir
from scriptorium.sources.shipping import ship

TYPES = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}
#: Rows of a block at least; keys with more are cut. There are at most MOST_BLOCKS blocks, and so at most as many cut keys.
BLOCK_ROWS, MOST_BLOCKS = 100_000, 10_000


class Summary(Protocol):
    """What a block of rows does to any state. Sums and states are of what JSON holds; a state that is a tuple comes back as a list."""

    def add(self, row: dict) -> None: ...

    def result(self) -> object: ...

    @staticmethod
    def after(result: object, state: object) -> object: ...


def _fold(rows: DataFrame, by: list[str], reads: list[str], keep: list[str], start: Callable[[dict], object], step: Callable, out: dict[str, str]) -> DataFrame:
    """The fold over rows that lie sorted in their partitions; by tells where a new fold begins, from the state that start gives."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{n}` {k}" for n, k in [*((c, kinds[c]) for c in keep), *out.items()])
    columns = list(dict.fromkeys([*by, *keep, *reads]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, None
        for batch in batches:
            found = []
            for row in batch.select(list(dict.fromkeys([*by, *reads]))).to_pylist():
                own = [row[c] for c in by]
                if own != held:
                    held, now = own, start(row)
                now, values = step(now, row)
                found.append(values)
            own = [pa.array([v[i] for v in found], TYPES[k]) for i, k in enumerate(out.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *own], names=[*keep, *out])

    return rows.select(*columns).mapInArrow(run, schema)


def ordered_fold(
    rows: DataFrame, key: str, order: list[str], reads: list[str], keep: list[str], start: object, step: Callable[[object, dict], tuple[object, tuple]], out: dict[str, str]
) -> DataFrame:
    """key, keep and out for every row: step gives the next state and the row's out values from a state and the row's key and reads.

    Each key begins with start. Spark sorts the rows by key and order, which spills, and they stream through Python with one state, so
    nothing of a key is gathered, however many rows it has. All rows of a key pass through one task; segmented_fold() spreads them.
    """
    ship(rows.sparkSession)
    held = rows.repartition(key).sortWithinPartitions(key, *order)
    return _fold(held, [key], reads, list(dict.fromkeys([key, *keep])), lambda _: start, step, out)


def _checkpointed(df: DataFrame) -> DataFrame:
    """df in the folder that spark.checkpoint.dir names; partitions and their order stay."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(spark))
    return df.checkpoint(eager=True)


def segmented_fold(
    rows: DataFrame,
    key: str,
    order: list[str],
    reads: list[str],
    keep: list[str],
    start: object,
    step: Callable[[object, dict], tuple[object, tuple]],
    out: dict[str, str],
    summary: Callable[[], Summary],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """As ordered_fold, for keys that may hold any share of all rows: their blocks lie in as many tasks as they fill.

    Keys with over block_rows rows are cut by ranges of (key, order); order must tell all rows of a key apart. Sums of blocks are folded in
    order of their blocks, a row for each block. States are of what JSON holds.
    """
    spark: SparkSession = rows.sparkSession
    ship(spark)
    sizes = rows.groupBy(key).count()
    total, largest = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
    most = max(block_rows, -(-total // MOST_BLOCKS))
    if (largest or 0) <= most:
        return ordered_fold(rows, key, order, reads, keep, start, step, out)
    hot = [(r[0], r[1]) for r in sizes.where(F.col("count") > most).collect()]  # under MOST_BLOCKS keys
    kind = dict(rows.dtypes)[key]
    keys = F.broadcast(spark.createDataFrame([(k,) for k, _ in hot], f"`{key}` {kind}").withColumn("_hot", F.lit(True)))
    marked = rows.join(keys, rows[key].eqNullSafe(keys[key]), "left").drop(keys[key])
    few = ordered_fold(marked.where("_hot is null").drop("_hot"), key, order, reads, keep, start, step, out)
    columns = list(dict.fromkeys([key, *keep, *reads, *order]))
    blocks = -(-sum(n for _, n in hot) // most)
    ranged = marked.where("_hot").select(*columns).repartitionByRange(blocks, key, *order).sortWithinPartitions(key, *order)
    held = _checkpointed(ranged.withColumn("_block", F.spark_partition_id()))
    sums = _sums(held, key, reads, summary)
    after = summary().after

    def through(state: object, row: dict) -> tuple[object, tuple]:
        return after(json.loads(row["_sum"]), state), (json.dumps(state),)

    firsts = ordered_fold(sums, key, ["_block"], ["_sum"], ["_block"], start, through, {"_start": "string"})
    begun = firsts.withColumnRenamed("_block", "_of").withColumnRenamed(key, "_key")
    joined = held.join(F.broadcast(begun), (F.col(key).eqNullSafe(F.col("_key"))) & (F.col("_block") == F.col("_of")))  # keeps partitions and order
    many = _fold(joined, [key, "_block"], [*reads, "_start"], list(dict.fromkeys([key, *keep])), lambda row: json.loads(row["_start"]), step, out)
    return few.unionByName(many)


def _sums(held: DataFrame, key: str, reads: list[str], summary: Callable[[], Summary]) -> DataFrame:
    """key, _block and the sum of each block as JSON."""
    kind = dict(held.dtypes)[key]
    columns = list(dict.fromkeys([key, "_block", *reads]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = None, None
        row_of = lambda: pa.RecordBatch.from_arrays([own[0], pa.array([own[1]], pa.int32()), pa.array([json.dumps(now.result())])], names=[key, "_block", "_sum"])
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                if own is None or (row["_block"], row[key]) != own[1:]:
                    if own is not None:
                        yield row_of()
                    own, now = (batch.column(0).slice(i, 1), row["_block"], row[key]), summary()
                now.add(row)
        if own is not None:
            yield row_of()

    return held.select(*columns).mapInArrow(run, f"`{key}` {kind}, _block int, _sum string")
