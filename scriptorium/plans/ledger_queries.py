"""The subscription-event ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import ledger as L
from scriptorium.plans.registry import query
from scriptorium.sources.views import VIEWS, table, view

DISPATCHED = """(select *, case kind when 'BILLING.SUBSCRIPTION.CREATED' then 'trialing' when 'PAYMENT.SALE.DENIED' then 'past_due' when 'BILLING.SUBSCRIPTION.PAYMENT.FAILED' then 'past_due'
      when 'BILLING.SUBSCRIPTION.CANCELLED' then 'cancelled' when 'BILLING.SUBSCRIPTION.EXPIRED' then 'cancelled' when 'BILLING.SUBSCRIPTION.SUSPENDED' then 'cancelled' else 'active' end as new_status,
    case when kind in ('PAYMENT.SALE.DENIED', 'BILLING.SUBSCRIPTION.PAYMENT.FAILED') then 'fail' when kind in ('BILLING.SUBSCRIPTION.CANCELLED', 'BILLING.SUBSCRIPTION.EXPIRED', 'BILLING.SUBSCRIPTION.SUSPENDED') then 'downgrade' else 'apply' end as transition
    from billing where kind <> 'CUSTOMER.DISPUTE.CREATED')"""


def step(state: str) -> str:
    """The reason for event o on the state of row s, as SQL."""
    same = f"({state}.after_sub is null or {state}.after_sub = o.sub_id)"
    owns = f"({state}.after_status is not null and {state}.after_sub = o.sub_id)"
    return f"""case when o.transition = 'apply' then case when {state}.after_status is null then 'created'
        when {same} and o.new_status = 'trialing' and {state}.after_status in ('active', 'past_due') and not o.grants then 'ignored_no_downgrade' when {same} then 'updated'
        when {state}.after_status = 'active' then 'duplicate_active_subscription' when o.grants then 'reactivated_new_subscription' when o.new_status = 'trialing' then 'new_attempt_registered' else 'stale_event_ignored' end
      when o.transition = 'fail' then case when coalesce({owns}, false) then 'past_due' else 'payment_without_row' end
      else case when coalesce({owns}, false) then 'downgraded' else 'no_matching_subscription' end end"""


APPLIED = "reason in ('created', 'updated', 'reactivated_new_subscription', 'new_attempt_registered', 'past_due', 'downgraded')"


def after(state: str) -> str:
    takes = f"({APPLIED} and transition = 'apply')"
    return f"""event_id, user_identifier, n, reason, {APPLIED} as applied, before_status, case when {APPLIED} then new_status else before_status end as after_status, before_sub,
        case when {takes} then sub_id else before_sub end as after_sub, case when {takes} then event_tier when reason = 'downgraded' then 'free' else before_tier end as tier,
        case when {takes} and new_status = 'active' then event_tier when reason = 'downgraded' then 'free' else before_usage end as usage_tier"""


FOLD = f"""o as (select *, row_number() over (partition by user_identifier order by ts, event_id) as n from {DISPATCHED}),
    zero as (select null::varchar as after_sub, null::varchar as after_status, null::varchar as tier, null::varchar as usage_tier),
    fold as (select {after("zero")} from (select o.event_id, o.user_identifier, o.n, o.sub_id, o.tier as event_tier, o.new_status, o.transition, {step("zero")} as reason,
        zero.after_status as before_status, zero.after_sub as before_sub, zero.tier as before_tier, zero.usage_tier as before_usage from o, zero where o.n = 1)
      union all select {after("f")} from (select o.event_id, o.user_identifier, o.n, o.sub_id, o.tier as event_tier, o.new_status, o.transition, {step("f")} as reason,
        f.after_status as before_status, f.after_sub as before_sub, f.tier as before_tier, f.usage_tier as before_usage from fold f join o on o.user_identifier = f.user_identifier and o.n = f.n + 1))"""


def with_fold(sql: str) -> str:
    return f"with recursive billing as ({VIEWS['billing']}), {FOLD} {sql}"


def audit(spark, d):
    return L.folded(view(spark, d, "billing"))


@query(with_fold("select event_id, user_identifier, reason, applied, before_status, after_status from fold"))
def ledger_audit(spark, d):
    return audit(spark, d).select("event_id", "user_identifier", "reason", "applied", "before_status", "after_status")


@query(with_fold("select user_identifier, arg_max(after_status, n) as status, arg_max(tier, n) as tier, coalesce(arg_max(coalesce(usage_tier, 'none'), n), 'none') as usage_tier, max(n) as n_events from fold group by user_identifier"))
def ledger_fold(spark, d):
    """The final state of each user: the last audit row in event order."""
    order = view(spark, d, "billing").select("event_id", "ts")
    rows = audit(spark, d).join(order, "event_id")
    last = rows.groupBy("user_identifier").agg(F.max_by(F.struct("after_status", "tier", "usage_tier"), F.struct("ts", "event_id")).alias("s"), F.count("*").alias("n_events"))
    return last.select("user_identifier", F.col("s.after_status").alias("status"), F.col("s.tier").alias("tier"), F.coalesce("s.usage_tier", F.lit("none")).alias("usage_tier"), "n_events")


@query(with_fold("select f.event_id, f.user_identifier, f.after_sub as active_sub, b.sub_id as attempted_sub, b.kind from fold f join billing b on b.event_id = f.event_id where f.reason = 'duplicate_active_subscription'"))
def ledger_duplicates(spark, d):
    return L.duplicate_attempts(audit(spark, d), view(spark, d, "billing"))


@query(with_fold("select event_id, reason from fold where reason = 'ignored_no_downgrade'"))
def late_event_rule(spark, d):
    """Late creations are recognised by the state that they meet, not by a watermark."""
    return audit(spark, d).where("reason = 'ignored_no_downgrade'").select("event_id", "reason")


DELIVERIES = "(select case when event_id % 10 = 0 then null else cast(event_id // 2 as varchar) end as event_id, concat('tx', event_id) as transmission_id, ts from events)"


@query(
    f"""select key, transmission_id from (select *, row_number() over (partition by key order by ts, transmission_id) as nth from (
        select coalesce(event_id, 'no-event-id:' || transmission_id) as key, transmission_id, ts from {DELIVERIES})) where nth = 1"""
)
def ledger_dedupe(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.when(F.col("event_id") % 10 != 0, F.expr("event_id div 2").cast("string")).alias("event_id"), F.concat(F.lit("tx"), F.col("event_id").cast("string")).alias("transmission_id"), "ts")
    return L.intake(rows, "ts").select("key", "transmission_id")


VERIFIED = """(select s.*, case when c.sub_id is null or c.http = 404 then 'not_found' when c.http is null or c.http <> 200 then 'provider_error' when c.answered_id <> s.provider_sub_id then 'id_mismatch' when c.status <> 'ACTIVE' then 'not_active' when c.plan_tier <> s.tier then 'plan_mismatch' when c.custom_uid <> s.user_identifier then 'owner_mismatch'
    else 'verified' end as outcome from subs s left join canonical c on c.sub_id = s.provider_sub_id where s.provider_sub_id is not null)"""
ACTION = """case when outcome = 'not_found' then 'missing_at_provider' when outcome = 'provider_error' then 'retry_later' when (outcome = 'verified') = (status = 'active') then 'match'
    when outcome = 'verified' then 'candidate' else 'manual_review' end"""


@query(f"select user_identifier, outcome, {ACTION} as action from {VERIFIED}", "subs canonical")
def ledger_reconcile(spark, d):
    return L.reconciled(view(spark, d, "subs"), view(spark, d, "canonical")).select("user_identifier", "outcome", "action")


@query(f"select action, count(*) as n, count(*) filter (action <> 'match') as discrepancies from (select {ACTION} as action from {VERIFIED}) group by action", "subs canonical")
def reconcile_counters(spark, d):
    rows = L.reconciled(view(spark, d, "subs"), view(spark, d, "canonical"))
    return rows.groupBy("action").agg(F.count("*").alias("n"), F.count_if(F.col("action") != "match").alias("discrepancies"))


@query(f"select user_identifier, '| *** | ***' || right(provider_sub_id, 4) || ' | ' || tier || ' | ' || status || ' | ' || outcome || ' | ' || {ACTION} || ' |' as line from {VERIFIED}", "subs canonical")
def markdown_report(spark, d):
    return L.report_lines(L.reconciled(view(spark, d, "subs"), view(spark, d, "canonical"))).select("user_identifier", "line")


ASKED = "case when age_ms % 7 = 0 then provider_sub_id when age_ms % 7 = 1 then 'SUB-other' end"
TRIED = "case when age_ms % 3 = 0 then 'duplicate_active_subscription' when age_ms % 3 = 1 then 'updated' end"


@query(
    f"""select user_identifier, case when since_ms < 10000 then 'throttled' when requested_id <> provider_sub_id then 'reconciliation_required' when status = 'active' then 'already_active' when outcome <> 'verified' then outcome
        when reason = 'duplicate_active_subscription' then reason when reason = 'updated' then 'activated' else 'pending' end as decision
        from (select *, {ASKED.replace("age_ms", "n")} as requested_id, {TRIED.replace("age_ms", "n")} as reason, case when n % 11 = 0 then 5000 end as since_ms from (select *, age_ms // 60000 as n from {VERIFIED}))""",
    "subs canonical",
)
def verification_decision(spark, d):
    rows = L.verified(view(spark, d, "subs"), view(spark, d, "canonical")).withColumn("n", F.expr("age_ms div 60000"))
    asked = {"requested_id": F.expr(ASKED.replace("age_ms", "n")), "reason": F.expr(TRIED.replace("age_ms", "n")), "since_ms": F.expr("case when n % 11 = 0 then 5000 end")}
    return L.manual_checks(rows.withColumns(asked)).select("user_identifier", "decision")


@query("select event_id, coalesce(b.uid, s.user_identifier, 'unknown') as resolved from (select event_id, case when event_id % 3 = 0 then user_identifier end as uid, concat('SUB-', event_id % 200) as sub from billing) b left join subs s on s.provider_sub_id = b.sub", "billing subs")
def identity_resolution(spark, d):
    b = view(spark, d, "billing").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("user_identifier")).alias("uid"), F.concat(F.lit("SUB-"), (F.col("event_id") % 200).cast("string")).alias("provider_sub_id"))
    return b.join(view(spark, d, "subs").select("provider_sub_id", "user_identifier"), "provider_sub_id", "left").select("event_id", F.coalesce("uid", "user_identifier", F.lit("unknown")).alias("resolved"))


@query("select event_id, case when event_id % 6 = 0 then 'received' when event_id % 6 = 1 then 'failed' when event_id % 6 = 2 then 'processing' else 'processed' end as status from billing", "billing")
def event_status(spark, d):
    """Every event as a delivery; a worker took those whose id is no multiple of six."""
    events = view(spark, d, "billing").select(F.col("event_id").alias("key"))
    turn = F.col("key") % 6
    results = events.where(turn != 0).select("key", F.lit(True).alias("started"), F.when(turn == 1, "no answer").alias("error"), (turn > 2).alias("done"))
    return L.lifecycle(events, results).select(F.col("key").alias("event_id"), F.col("processing_status").alias("status"))


@query("select event_id, coalesce(case when event_id % 4 <> 0 then cast(event_id as varchar) end, 'legacy-tx:tx' || event_id) as key from events")
def key_backfill(spark, d):
    key = F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", F.coalesce(key, F.concat(F.lit("legacy-tx:tx"), F.col("event_id").cast("string"))).alias("key"))


@query(
    """select user_identifier, outcome, case when outcome = 'cancelled' then 'cancelled' else status end as status, case when outcome = 'cancelled' then 'free' else tier end as tier from (
        select *, case when provider_sub_id is null then 'no_subscription' when status <> 'active' then 'not_active' when http is null then 'provider_unreachable'
            when http = 204 or http = 422 then 'cancelled' else 'provider_error' end as outcome
        from (select *, case age_ms // 60000 % 4 when 0 then 204 when 1 then 422 when 2 then 500 end as http from subs))""",
    "subs",
)
def cancel_decision(spark, d):
    http = F.expr("case age_ms div 60000 % 4 when 0 then 204 when 1 then 422 when 2 then 500 end")
    return L.cancelled(view(spark, d, "subs"), http).select("user_identifier", "outcome", "status", "tier")


@query("select sub_id, coalesce(plan = case tier when 'pro' then 'P-1' when 'academico' then 'P-2' end, false) as matches from (select sub_id, plan_tier as tier, case when status = 'ACTIVE' then 'P-1' when custom_uid <> 'user:0' then 'P-2' end as plan from canonical)", "canonical")
def plan_match(spark, d):
    plan = F.expr("case when status = 'ACTIVE' then 'P-1' when custom_uid <> 'user:0' then 'P-2' end")
    return view(spark, d, "canonical").select("sub_id", L.plan_matches(plan, F.col("plan_tier"), {"pro": "P-1", "academico": "P-2"}).alias("matches"))
