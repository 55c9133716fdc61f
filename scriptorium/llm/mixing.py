"""Mixing sources to target weights by Pfair scheduling.

A source of weight a out of Q gets block k not before slot floor(k Q / a) and not after slot ceil((k + 1) Q / a). Weights are whole
numbers that add up to Q, so the schedule repeats after Q slots; earliest deadline first fills one such period on the driver, from
counts by source alone, and arithmetic extends it to every block. Each source is then less than one block away from its share at
all times. When a source runs out, the rest start a new phase with the weights they have, so that no row is dropped or repeated.

Sources beyond MOST_SOURCES share one place of the schedule and are scheduled inside it by the same rule, each by its own weight. Those
with equally many rows and equal weights are one kind and go in rounds, a row of each, which keeps every one of them less than one row
away from its share. Kinds have different numbers of rows or named weights, so n rows make about the root of 2 n of them at most.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import partitions, whole

BLOCK = 16
GRAIN = 1024
TEMPERATURE = 0.7
#: Sources beyond so many, those of the fewest rows, share a place and take their own turns inside it.
MOST_SOURCES = 2048
#: So many kinds of sources are scheduled at once inside a shared place; those beyond share a place inside it, and so on.
MOST_KINDS = 512
REST = "*"
#: The period's table goes to all executors only up to so many slots; it has at most GRAIN + 1 slots for each source.
BROADCAST_SLOTS = 1_000_000


def whole_weights(weights: dict, grain: int) -> dict:
    """Positive whole numbers nearly proportional to weights, adding up to grain or the number of sources if that is more."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    scale = grain / sum(weights.values()) if weights else 0
    found = {s: max(1, int(w * scale)) for s, w in weights.items()}
    left = grain - sum(found.values())
    for s in sorted(weights, key=lambda s: (int(weights[s] * scale) - weights[s] * scale, str(s)))[: max(0, left)]:
        found[s] += 1
    return found


def period(weights: dict) -> list:
    """The source of each of the Q slots: of the blocks released, the one with the earliest deadline."""
    q = sum(weights.values())
    waiting, ready, slots = [(0, str(s), s, 0) for s in weights], [], []
    heapq.heapify(waiting)
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            _, name, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * q // weights[s]), name, s, k))
        _, name, s, k = heapq.heappop(ready)
        slots.append(s)
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * q // weights[s], name, s, k + 1))
    return slots


def phases(rows: dict, weights: dict, block: int) -> dict:
    """For each source, its share in each phase: (first block, end, weight, Q, first slot, first row, slots of a period)."""
    left, out = {s: -(-n // block) for s, n in rows.items() if n}, {s: [] for s in rows}
    done, t0, d0 = dict.fromkeys(left, 0), 0, 0
    while left:
        own = {s: weights[s] for s in left}
        slots, q = period(own), sum(own.values())
        at = {s: [] for s in left}
        for t, s in enumerate(slots):
            at[s].append(t)
        ends = {s: (n - 1) // own[s] * q + at[s][(n - 1) % own[s]] + 1 for s, n in left.items()}
        last = min(left, key=ends.get)
        for s in left:
            taken = ends[last] // q * own[s] + sum(t < ends[last] % q for t in at[s])
            if taken:
                out[s].append((done[s], done[s] + taken, own[s], q, t0, d0, at[s]))
                done[s] += taken
                left[s] -= taken
        t0 += ends[last]
        d0 += ends[last] * block - (-rows[last] % block)
        del left[last]
    return out


def timetable(spark: SparkSession, rows: dict, target: dict, grain: int, block: int) -> DataFrame:
    """key, weight and shares (one for each phase) of every place with rows; a hint to broadcast it, if it is small."""
    own = whole_weights(target, grain)
    share = "array<struct<first: long, end: long, a: long, q: long, t0: long, d0: long, at: array<int>>>"
    plan = phases(rows, own, block)
    q = sum(own.values())
    table = spark.createDataFrame([(s, own[s] / q, plan[s]) for s in rows], f"key string, weight double, shares {share}")
    return F.broadcast(table) if len(rows) * q <= BROADCAST_SLOTS else table


def scheduled(df: DataFrame, table: DataFrame, block: int, how: str = "inner") -> DataFrame:
    """df (key, and nth within it) with what timetable() says on its blocks: in_phase is the slot of the row's block within the phase."""
    return (
        df.withColumn("block", F.expr(f"nth div {block}"))
        .join(table, "key", how)
        .withColumn("phase", F.expr("size(filter(shares, x -> x.end <= block))"))
        .withColumn("share", F.get("shares", F.col("phase")))
        .withColumn("k", F.col("block") - F.col("share.first"))
        .withColumn("in_phase", F.expr("k div share.a * share.q + share.at[cast(k % share.a as int)]"))
    )


def cell(spark: SparkSession, hashed: Column) -> Column:
    """About as many ranges of a 64-bit hash as there are partitions."""
    return F.shiftrightunsigned(hashed, 64 - max(1, (partitions(spark) - 1).bit_length()))


def numbered(df: DataFrame, name: str, group: list[str], order: list[str]) -> DataFrame:
    """df with a row's number (from 0) in its group, in order of the column cell and then of order; a group is spread by its cells."""
    before = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*group, "cell").agg(F.count("*").alias("in_cell"))
    offsets = cells.select(*group, "cell", F.coalesce(F.sum("in_cell").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*group, "cell").orderBy(*order))
    return df.withColumn(name, own).join(offsets, [*group, "cell"]).withColumn(name, F.col("before") + F.col(name) - 1).drop("before", "cell")


def sharing(held: DataFrame, sources: DataFrame, kinds: list, grain: int) -> DataFrame:
    """held, the rows of sources that share a place, with nth, the row's number in that place when every source takes its own turns.

    sources: key, n and target of each. kinds: n, target and members of those that are alike, the kinds with the most rows first.
    """
    spark = held.sparkSession
    known = spark.createDataFrame([(i, r["n"], r["target"], r["members"]) for i, r in enumerate(kinds)], "kind int, n long, target double, members long")
    turns = numbered(sources.join(F.broadcast(known), ["n", "target"]).withColumn("cell", cell(spark, F.xxhash64("key"))), "turn", ["kind"], ["key"])
    own = F.row_number().over(Window.partitionBy("key").orderBy("h", "id", "h_row")) - 1  # such sources have few of all rows
    rows = held.withColumn("round", own).join(turns.select("key", "kind", "members", "turn"), "key")
    rows = rows.withColumn("nth", F.col("round") * F.col("members") + F.col("turn")).select(*held.columns, "kind", "nth").drop("key")
    for first in reversed(range(0, len(kinds), MOST_KINDS)):  # the innermost place first, whose rows are then those of one in the next
        end = first + MOST_KINDS
        alone = list(enumerate(kinds[first:end], first))
        n, target = {str(i): r["n"] * r["members"] for i, r in alone}, {str(i): r["target"] * r["members"] for i, r in alone}
        if kinds[end:]:
            n[REST], target[REST] = (sum(r[c] * r["members"] for r in kinds[end:]) for c in ("n", "target"))
        key = F.when(F.col("kind") >= end, REST).when(F.col("kind") >= first, F.col("kind").cast("string"))
        placed = scheduled(rows.withColumn("key", key), timetable(spark, n, target, grain, 1), 1, "left")
        rows = placed.select(*[c for c in rows.columns if c != "nth"], F.coalesce(F.expr("share.d0 + in_phase"), "nth").alias("nth"))
    return rows.drop("kind").withColumn("key", F.lit(REST))


def mix(df: DataFrame, weights: dict | None = None, block: int = BLOCK, source_column: str = "source", id_column: str = "doc_id", text_column: str = "text", grain: int = GRAIN, temperature: float = TEMPERATURE, carry: bool = False) -> DataFrame:
    """The place of every row in the mixture.

    weights: the target weight of each source, in any unit; sources it does not name weigh as much as the least that it does. None
    gives each source its number of rows to the power temperature. Weights are rounded to parts of grain. Of more than MOST_SOURCES
    sources, those with the most rows are scheduled each; the others share a place that has the sum of their weights, and in it each
    takes its turns by its own weight, row by row. Their weight, phase, block, release, deadline and slot are those of the place.

    Returns the id, the source, weight (share of the first phase's slots), phase, block (within the source), release, deadline and
    slot (of the block, counted over the whole mixture) and position (of the row, from 0, without gaps). With carry, a column named
    row holds the input's columns as a struct. Rows of a source are taken in order of a hash of id and text.

    Null sources form a source of their own, null ids and texts are values like others, repeated rows keep their own positions and
    an empty table gives an empty result. The counts of MOST_SOURCES sources and of the kinds of the others pass through the driver.
    """
    spark = df.sparkSession
    alone = df.alias("input")
    values = [F.col(f"input.`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    held = alone.select(
        F.col(f"input.`{id_column}`").alias("id"),
        F.col(f"input.`{source_column}`").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(f"input.`{source_column}`").cast("string")), F.lit("")).alias("key"),
        F.xxhash64(F.col(f"input.`{id_column}`"), whole(F.col(f"input.`{text_column}`"))).alias("h"),
        F.xxhash64(*values).alias("h_row"),
        *([F.struct("input.*").alias("row")] if carry else []),
    )
    by_source = held.groupBy("key").agg(F.count("*").alias("n"))
    least = F.lit(float(min(weights.values(), default=1))) if weights is not None else F.pow("n", F.lit(temperature))
    named = F.create_map(*[F.lit(x) for s, w in weights.items() for x in ("" if s is None else f"={s}", float(w))]) if weights else F.lit(None).cast("map<string,double>")
    weighed = by_source.withColumn("target", F.coalesce(F.try_element_at(named, F.col("key")), least) if weights else least)
    counted = weighed.orderBy(F.desc("n"), "key").limit(MOST_SOURCES + 1).collect()
    by_hash = ["h", "id", "h_row"]
    if len(counted) > MOST_SOURCES:
        kept = F.broadcast(spark.createDataFrame([(r["key"],) for r in counted[:MOST_SOURCES]], "key string"))
        others = weighed.join(kept, "key", "left_anti")
        alike = others.groupBy("n", "target").agg(F.count("*").alias("members"))
        kinds = alike.orderBy(F.desc(F.col("n") * F.col("members")), "n", "target").collect()
        rest = {c: sum(r[c] * r["members"] for r in kinds) for c in ("n", "target")}
        counted = [*counted[:MOST_SOURCES], {"key": REST, **rest}]
        alone_rows = numbered(held.join(kept, "key", "left_semi").withColumn("cell", cell(spark, F.col("h"))), "nth", ["key"], by_hash)
        held = alone_rows.unionByName(sharing(held.join(kept, "key", "left_anti"), others, kinds, grain))
    else:
        held = numbered(held.withColumn("cell", cell(spark, F.col("h"))), "nth", ["key"], by_hash)
    rows, target = ({r["key"]: r[c] for r in counted} for c in ("n", "target"))
    placed = scheduled(held, timetable(spark, rows, target, grain, block), block)
    return placed.select(
        F.col("id").alias(id_column),
        F.col("source").alias(source_column),
        "weight",
        "phase",
        "block",
        F.expr("share.t0 + k * share.q div share.a").alias("release"),
        F.expr("share.t0 + ((k + 1) * share.q + share.a - 1) div share.a").alias("deadline"),
        F.expr("share.t0 + in_phase").alias("slot"),
        F.expr(f"share.d0 + in_phase * {block} + nth % {block}").alias("position"),
        *(["row"] if carry else []),
    )


def mixed_rows(df: DataFrame, **options) -> DataFrame:
    """df's rows in order of the mixture: partitions are contiguous ranges of positions, each sorted.

    Rows are neither dropped nor repeated nor changed, whatever their columns hold; nulls, ties and an empty table are as in mix().
    """
    n = partitions(df.sparkSession)
    placed = mix(df, **options, carry=True).select("position", "row")
    rows = df.count()
    dealt = placed.repartitionById(n, F.expr(f"cast(least(position * {n} div {max(rows, 1)}, {n - 1}) as int)"))
    return dealt.sortWithinPartitions("position").select("row.*")


def lag(placed: DataFrame, source_column: str = "source") -> DataFrame:
    """The largest deviation of each source from its share, in blocks, at the ends of its blocks within the first phase."""
    blocks = placed.where("phase = 0").select(source_column, "weight", "block", "slot").distinct()
    gap = F.greatest(F.abs(F.col("block") + 1 - (F.col("slot") + 1) * F.col("weight")), F.abs(F.col("block") - F.col("slot") * F.col("weight")))
    return blocks.groupBy(source_column).agg(F.max(gap).alias("max_lag"))
