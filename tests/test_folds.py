"""Folds in blocks against folds row by row."""

import json
import random
from functools import partial

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import ledger as L
from scriptorium.operators import usage as U
from scriptorium.plans.catalogue import ORACLES, QUERIES

KINDS = list(dict.fromkeys(L.KINDS.values()))


def events(r, n, subs):
    out = []
    for i in range(n):
        status, transition = r.choice(KINDS)
        out.append({"event_id": i, "sub_id": r.choice(subs), "tier": r.choice(L.TIERS), "new_status": status, "transition": transition, "grants": r.random() < 0.3})
    return out


def through(state, block):
    for e in block:
        state, _ = L.advanced(state, e)
    return state


@pytest.mark.parametrize("seed", range(40))
def test_a_block_of_events_does_to_every_state_what_its_events_do(seed):
    r = random.Random(seed)
    subs = r.choice([["A"], ["A", "B", None], ["A", "B", "C", "D", "="], [None], [f"S{i}" for i in range(30)]])
    block = events(r, r.randrange(0, 40), subs)
    own = L.BlockOfEvents()
    for e in block:
        own.add(e)
    result = json.loads(json.dumps(own.result()))
    states = [(None, None, None, None)] + [(sub, tier, status, usage) for sub in [None, "A", "B", "=", "S7", "never"] for status in L.STATUSES for tier, usage in (("pro", None), ("free", "free"), ("academico", "pro"))]
    for state in states:
        assert L.BlockOfEvents.after(result, list(state)) == through(state, block)


def test_the_sum_of_a_block_grows_with_its_subscriptions_and_not_with_its_events():
    sizes = []
    for n, subs in ((60_000, 20_000), (60_000, 20), (6_000, 20)):
        own = L.BlockOfEvents()
        for i in range(n):
            own.add({"event_id": i, "sub_id": f"S{i % subs}", "tier": "pro", "new_status": "active", "transition": "apply", "grants": True})
        sizes.append(len(own.result()))
    assert sizes[0] <= 9 + 4 * 20_000 and sizes[1] == sizes[2] <= 9 + 4 * 20


def accepted(times, last, window):
    for t in times:
        if t is not None and (last is None or t - last >= window):
            last = t
    return last


@pytest.mark.parametrize("seed", range(30))
def test_a_block_of_attempts_does_to_every_time_what_its_attempts_do(seed):
    r = random.Random(seed)
    window = r.choice([1, 5, 10])
    times = sorted(r.randrange(100, 100 + r.choice([10, 60, 400])) for _ in range(r.randrange(0, 80)))
    own = U.BlockOfAttempts(window)
    for t in [None, *times] if r.random() < 0.3 else times:
        own.add({"ms": t})
    result = json.loads(json.dumps(own.result()))
    for last in [None, *range(60, (times or [100])[0] + 1)]:
        assert U.BlockOfAttempts.after(result, last) == accepted(times, last, window)


def test_a_burst_sums_up_to_few_times():
    own = U.BlockOfAttempts(10_000)
    for t in range(0, 400_000, 2):
        own.add({"ms": t})
    assert len(own.result()["starts"]) <= 5_002 and len(own.live) <= 5_002


def hot(spark, n):
    u = F.expr("case when id % 3 = 0 then 'hot' when id % 3 = 1 then concat('u', id % 50) end")  # a third of all rows; and a null user
    kinds = F.element_at(F.array(*[F.lit(k) for k in (*L.KINDS, "OTHER")]), (F.xxhash64("id") % 10 + 10).cast("int") % 10 + 1)
    return spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_millis(F.xxhash64("id", F.lit(1)) % 50_000 + 60_000).alias("ts"), u.alias("user_identifier"), F.expr("if(xxhash64(id, 2) % 7 = 0, null, concat('S', abs(xxhash64(id, 3)) % 4))").alias("sub_id"),
        F.expr("if(id % 2 = 0, 'pro', 'academico')").alias("tier"), kinds.alias("kind"), F.expr("xxhash64(id, 4) % 3 = 0").alias("grants"),
    )


def test_a_user_with_a_third_of_all_rows_is_folded_in_many_tasks(spark):
    rows = hot(spark, 9_000).cache()
    found = L.folded(rows, block_rows=300)
    assert sorted(map(str, found.collect())) == sorted(map(str, L.folded(rows).collect()))
    tasks = found.withColumn("task", F.spark_partition_id()).where("user_identifier = 'hot'").groupBy("task").count().collect()
    assert len(tasks) >= 8 and max(t["count"] for t in tasks) <= 900


def test_throttle_in_blocks_equals_throttle_in_one_pass(spark):
    rows = hot(spark, 9_000).withColumn("ts", F.when(F.col("event_id") % 97 != 0, F.col("ts"))).cache()
    for window in (30, 4_000):
        one = U.throttled(rows, "user_identifier", "ts", "event_id", window)
        many = U.throttled(rows, "user_identifier", "ts", "event_id", window, block_rows=300)
        assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))


def test_attempts_are_ordered_by_their_stamps_and_not_by_milliseconds_and_those_without_come_last(spark):
    at = lambda us: None if us is None else 1_700_000_000_000_000 + us
    given = [("a", 1, 900), ("a", 2, 100), ("a", 3, None), ("a", 4, 5_000_050), ("b", 1, None), ("b", 2, None), ("c", None, 7), ("c", 1, 7)]
    rows = spark.createDataFrame([(u, e, at(us)) for u, e, us in given], "u string, e int, us long").withColumn("ts", F.timestamp_micros("us"))
    want = {("a", 1): False, ("a", 2): True, ("a", 3): None, ("a", 4): True, ("b", 1): True, ("b", 2): None, ("c", None): False, ("c", 1): True}
    for block_rows in (100, 1):
        assert {(r["u"], r["e"]): r["accepted"] for r in U.throttled(rows, "u", "ts", "e", 5_000, block_rows).collect()} == want


def test_throttle_query_equals_its_sql_at_half_milliseconds_and_without_users(spark, tmp_path):
    window = 7_200_000_000
    near = [f for half in (0, 400, 499, 500, 501, 999) for f in (half, half + window - 1000, half + window - 500, half + window - 1, half + window, half + window + 499)]
    given = [(u, base + us) for u, base in ((1, 1_700_000_000_000_000), (2, -7 * window), (3, -window // 2)) for us in near]
    given += [(u + 10 * i, 1_700_000_000_000_000 + us) for i, us in enumerate(near, 1) for u, us in ((1, 700), (1, us))] + [(u, None) for u in (1, 4, 4)] + [(None, us) for us in (5, None, 4, 3 * window)]
    rows = spark.createDataFrame([(i, u, us) for i, (u, us) in enumerate(given)], "event_id long, user_id long, us long")
    rows.select("event_id", "user_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    found = [tuple(r) for r in QUERIES["verification_throttle"](spark, str(tmp_path)).select("user_id", "event_id", "accepted").collect()]
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = duck.sql(f"select user_id, event_id, accepted from ({ORACLES['verification_throttle']})").fetchall()
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_no_rows(spark):
    assert L.folded(hot(spark, 0), block_rows=1).count() == 0
    assert partial(U.BlockOfAttempts, 5)().result()["starts"] == []
