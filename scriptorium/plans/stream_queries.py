"""Queries that run a stream over a given table and return what its sinks hold.

The table is dealt into files, each of which arrives as a micro-batch of its own; results equal those over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.plans.registry import query
from scriptorium.sources.scratch import file_system, scratch
from scriptorium.sources.views import table
from scriptorium.streaming import alerts as AL
from scriptorium.streaming import retries as RT
from scriptorium.streaming import sinks
from scriptorium.streaming import usage as US

BATCHES = 4


def arriving(spark: SparkSession, df: DataFrame, order: str, batches: int = BATCHES) -> DataFrame:
    """df as a stream: a micro-batch for each range of the column order, in that order, as files are read in order of their times."""
    path = scratch(spark)
    df.repartitionByRange(batches, order).sortWithinPartitions(order).write.parquet(path)
    fs, at = file_system(spark, path)
    parts = sorted((s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for i, part in enumerate(parts):
        fs.setTimes(part, 1_700_000_000_000 + 60_000 * i, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as nth from events where event_type <> 'error') where nth = 1")
def stream_upsert(spark, d):
    """The last event of each user, kept by upserts that rewrite only touched buckets."""
    rows = table(spark, d, "events").where("event_type <> 'error'").select("user_id", "event_id", "event_type")
    path = scratch(spark)
    sinks.upsert_stream(arriving(spark, rows, "event_id"), path, scratch(spark), ["user_id"], "event_id").awaitTermination()
    return sinks.upserted(spark, path).select("user_id", "event_id", "event_type")


@query(
    """select order_id, amount, stage, event_type from (select 'transfer-' || event_id as order_id, round(value, 2) as amount, 'billing' as stage, 'manual_transfer_requested' as event_type from events where event_type = 'purchase')"""
)
def stream_two_tables(spark, d):
    """Transfers: an order and its audit row, written as two tables that appear together, and joined again."""
    rows = table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "value")
    paths = scratch(spark), scratch(spark)
    key = F.concat(F.lit("transfer-"), F.col("event_id").cast("string"))
    order = lambda b: b.select(key.alias("order_id"), F.round("value", 2).alias("amount"), F.lit("PENDING_VERIFICATION").alias("status"))
    audit = lambda b: b.select(key.alias("audit_id"), F.lit("billing").alias("stage"), F.lit("manual_transfer_requested").alias("event_type"))
    sinks.two_tables(arriving(spark, rows, "event_id"), order, audit, paths, scratch(spark)).awaitTermination()
    orders, audits = sinks.both(spark, paths)
    return orders.join(audits, F.col("order_id") == F.col("audit_id")).select("order_id", "amount", "stage", "event_type")


@query(
    """select id, value, place from (select user_id as id, arg_max(event_id, event_id) as value, row_number() over (order by min(event_id) desc) as place from events where event_type <> 'error' group by user_id) where place <= 200"""
)
def stream_alerts(spark, d):
    """The alerts on display after a stream of versions: as alerts_merge, from state."""
    rows = table(spark, d, "events").where("event_type <> 'error'").select("user_id", "event_id")
    path = scratch(spark)
    AL.merged_stream(arriving(spark, rows, "event_id"), path, scratch(spark), "user_id", "event_id").awaitTermination()
    return AL.displayed(spark, path).select(F.col("user_id").alias("id"), F.col("event_id").alias("value"), "place")


TIER = "case when user_id % 3 = 0 then 'pro' when user_id % 3 = 1 then 'academico' else 'free' end"
LIMIT = "case tier when 'pro' then 1000 when 'academico' then 20 else 3 end"


@query(
    f"""select event_id, nth, nth <= {LIMIT} as allowed, greatest({LIMIT} - nth, 0) as remaining from (
        select event_id, {TIER} as tier, row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as nth from events)"""
)
def stream_quota(spark, d):
    """Every request of a user's day counted as it arrives; past days leave no state."""
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.expr(TIER).alias("tier"))
    path = scratch(spark)
    found = US.quota_stream(arriving(spark, rows, "ts"), "user_id", "ts", "tier", "event_id")
    found.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("event_id", "nth", "allowed", "remaining")


SAID = "case when event_id % 17 = 0 then 'SYNCED' when event_id % 23 = 0 then 'REJECTED' when event_type = 'click' then 'NETWORK_ERROR' else 'APPROVAL_PENDING' end"
ASKER = "concat(user_id, ':', extract(week from ts))"


def polling_sql() -> str:
    """Answers of each asker one after another; state is (attempts, due, ended)."""
    return f"""with recursive o as (select *, row_number() over (partition by user_id order by ts, event_id) as n from (select {ASKER} as user_id, ts, event_id, epoch_us(ts) // 1000 as ms, {SAID} as said from events)),
        fold as (select user_id, 0::bigint as n, null::bigint as event_id, 0::bigint as attempts, 0::bigint as due, false as ended, null::varchar as decision from (select distinct user_id from o)
          union all select user_id, n, event_id, attempts, case when decision = 'wait' then ms + 12000 when decision = 'ignored' then due else 0 end, ended or decision in ('done', 'error', 'gave_up'), decision from (
            select *, case when ended or due > 0 then 'ignored' when said = 'SYNCED' then 'done' when said not in ('APPROVAL_PENDING', 'NETWORK_ERROR') then 'error' when attempts < 8 then 'wait' when said = 'NETWORK_ERROR' then 'error' else 'gave_up' end as decision from (
              select o.user_id, o.n, o.event_id, o.ms, o.said, f.ended, case when f.due > 0 and o.ms >= f.due then f.attempts + 1 when f.attempts = 0 then 1 else f.attempts end as attempts, case when f.due > 0 and o.ms >= f.due then 0 else f.due end as due
              from fold f join o on o.user_id = f.user_id and o.n = f.n + 1)))
        select event_id, attempts as attempt, decision, case when decision = 'wait' then due end as due_ms from fold where n > 0"""


@query(polling_sql())
def retry_polling(spark, d):
    """A user's events of a day as answers to a polling that starts with the first of them."""
    rows = table(spark, d, "events").select(F.expr(ASKER).alias("user_id"), "event_id", "ts", F.expr(SAID).alias("said"))
    return RT.replayed(rows, "user_id", "ts", "said", "event_id").select("event_id", "attempt", "decision", "due_ms")
