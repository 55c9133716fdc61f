import datetime as dt

import pytest

from scriptorium.operators import ledger as L
from scriptorium.operators import usage as U
from scriptorium.sources.views import view
from scriptorium.streaming.ledger import audit_stream, exactly_once

EVENT = "event_id long, ts timestamp, user_identifier string, sub_id string, tier string, kind string, grants boolean"


def events(spark, *rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + dt.timedelta(hours=i), "u", sub, tier, kind, grants) for i, (kind, sub, tier, grants) in enumerate(rows)], EVENT)


def audit(spark, *rows):
    return L.folded(events(spark, *rows)).orderBy("event_id").collect()


CREATED, ACTIVATED, CANCELLED, FAILED = ("BILLING.SUBSCRIPTION.CREATED", "A", "pro", False), ("BILLING.SUBSCRIPTION.ACTIVATED", "A", "pro", True), ("BILLING.SUBSCRIPTION.CANCELLED", "A", "pro", False), ("BILLING.SUBSCRIPTION.PAYMENT.FAILED", "A", "pro", False)


@pytest.mark.parametrize(
    "rows, reasons, status",
    [
        ([CREATED], ["created"], "trialing"),
        ([CREATED, CREATED], ["created", "updated"], "trialing"),
        ([CREATED, ACTIVATED, CREATED], ["created", "updated", "ignored_no_downgrade"], "active"),
        ([ACTIVATED, ("BILLING.SUBSCRIPTION.ACTIVATED", "B", "academico", True)], ["created", "duplicate_active_subscription"], "active"),
        ([ACTIVATED, CANCELLED], ["created", "downgraded"], "cancelled"),
        ([CANCELLED], ["no_matching_subscription"], None),
        ([ACTIVATED, FAILED], ["created", "past_due"], "past_due"),
        ([ACTIVATED, CANCELLED, ("BILLING.SUBSCRIPTION.ACTIVATED", "B", "pro", True)], ["created", "downgraded", "reactivated_new_subscription"], "active"),
        ([CREATED, ("BILLING.SUBSCRIPTION.CREATED", "B", "pro", False)], ["created", "new_attempt_registered"], "trialing"),
        ([ACTIVATED, CANCELLED, ("PAYMENT.SALE.COMPLETED", "B", "pro", False)], ["created", "downgraded", "stale_event_ignored"], "cancelled"),
    ],
)
def test_decisions(spark, rows, reasons, status):
    got = audit(spark, *rows)
    assert [r["reason"] for r in got] == reasons
    assert got[-1]["after_status"] == status


def test_unknown_tier_writes_nothing(spark):
    assert audit(spark, ("BILLING.SUBSCRIPTION.CREATED", "A", "gold", False)) == []


def test_downgrade_frees_usage(spark):
    assert [r["usage_tier"] for r in audit(spark, ACTIVATED, CANCELLED)] == ["pro", "free"]


def test_order_of_created_and_activated_does_not_matter(spark):
    for rows in ([CREATED, ACTIVATED], [ACTIVATED, CREATED]):
        assert audit(spark, *rows)[-1]["after_status"] == "active"


def test_stream_equals_batch(spark, tmp_path):
    billing = view(spark, "/root/testdata/sf0.001", "billing")
    billing.orderBy("ts", "event_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(billing.schema).parquet(str(tmp_path / "in"))
    run = audit_stream(exactly_once(stream)).writeStream.format("memory").queryName("audit").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    columns = ["event_id", "reason", "applied", "before_status", "after_status", "after_sub", "usage_tier"]
    got = sorted(map(str, spark.table("audit").select(*columns).collect()))
    assert got == sorted(map(str, L.folded(billing).select(*columns).collect())) and got


def test_access_without_usage_row_is_inconsistent(spark):
    usage = spark.createDataFrame([], "user_identifier string, tier string")
    subs = spark.createDataFrame([("u", "pro", "active")], "user_identifier string, tier string, status string")
    row = U.access(usage, subs).first()
    assert (row["granted"], row["reason"], row["pending_tier"]) == (False, "billing_state_inconsistent", "pro")


def test_guard(spark):
    from pyspark.sql import functions as F

    subs = spark.createDataFrame([("a", "pro", "pending", 300_000), ("b", "pro", "pending", 1_200_000), ("c", "pro", "active", 0), ("d", "academico", "active", 0)], "u string, tier string, status string, age_ms long")
    got = {r["u"]: (r["code"], r["retry_after_s"]) for r in U.purchase_guard(subs, F.lit("pro")).collect()}
    assert got == {"a": ("PENDING_ATTEMPT_EXISTS", 600), "b": (None, None), "c": ("ALREADY_SUBSCRIBED", None), "d": ("PLAN_CHANGE_REQUIRED", None)}


def test_hot_keys_fold_without_arrays(spark):
    from pyspark.sql import functions as F

    n = 25_000  # more than two Arrow batches of one user
    attempts = spark.range(n).select(F.expr("if(id % 5 = 0, 'other', 'hot')").alias("u"), F.timestamp_millis(F.col("id") * 700).alias("ts"), F.col("id").alias("e"))
    found = U.throttled(attempts, "u", "ts", "e", window_ms=3000)
    last, wanted = {}, {}
    for i in range(n):
        u = "hot" if i % 5 else "other"
        if wanted.setdefault(i, u not in last or i * 700 - last[u] >= 3000):
            last[u] = i * 700
    assert {r["e"]: r["accepted"] for r in found.collect()} == wanted
    kinds = F.expr("case when id % 5 = 0 then 'BILLING.SUBSCRIPTION.CREATED' when id % 5 > 2 then 'BILLING.SUBSCRIPTION.CANCELLED' else 'BILLING.SUBSCRIPTION.ACTIVATED' end")
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_millis("id").alias("ts"), F.lit("hot").alias("user_identifier"), F.expr("concat('S', id div 5)").alias("sub_id"), F.lit("pro").alias("tier"), kinds.alias("kind"), F.lit(False).alias("grants")
    )
    audit = L.folded(rows)
    cycle = ["created", "updated", "updated", "downgraded", "downgraded"]
    assert [r["reason"] for r in audit.orderBy("event_id").collect()] == [*cycle, *(["new_attempt_registered"] + cycle[1:]) * (n // 5 - 1)]
    for df in (found, audit):
        assert "collect_list" not in df._jdf.queryExecution().toString()
