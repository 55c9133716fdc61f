"""The subscription-event ledger: idempotent intake, the ordered fold, verification and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators.ordered import BLOCK_ROWS, segmented_fold

TIERS, STATUSES = ("pro", "academico"), ("trialing", "active", "cancelled", "past_due")
#: Event types: (new status, transition). Fixed values; all others are ignored.
KINDS = {
    "BILLING.SUBSCRIPTION.CREATED": ("trialing", "apply"),
    "BILLING.SUBSCRIPTION.ACTIVATED": ("active", "apply"),
    "PAYMENT.SALE.COMPLETED": ("active", "apply"),
    "INVOICE.PAYMENT_SUCCEEDED": ("active", "apply"),
    "BILLING.SUBSCRIPTION.CANCELLED": ("cancelled", "downgrade"),
    "BILLING.SUBSCRIPTION.EXPIRED": ("cancelled", "downgrade"),
    "BILLING.SUBSCRIPTION.SUSPENDED": ("cancelled", "downgrade"),
    "PAYMENT.SALE.DENIED": ("past_due", "fail"),
    "BILLING.SUBSCRIPTION.PAYMENT.FAILED": ("past_due", "fail"),
}
APPLIED = {"created", "updated", "reactivated_new_subscription", "new_attempt_registered", "past_due", "downgraded"}
AUDIT = {"reason": "string", "applied": "boolean"} | dict.fromkeys(("before_status", "after_status", "before_sub", "after_sub", "usage_tier", "tier"), "string")


def dispatched(events: DataFrame) -> DataFrame:
    """events with new_status and transition by kind; other kinds are ignored."""
    status = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[0])) for k, v in KINDS.items()])
    transition = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[1])) for k, v in KINDS.items()])
    return events.withColumns({"new_status": status, "transition": transition}).where("transition is not null")


def intake(deliveries: DataFrame, received: str) -> DataFrame:
    """The first delivery of each event; one without an id gets its transmission's."""
    key = F.coalesce("event_id", F.concat(F.lit("no-event-id:"), "transmission_id"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(received, "transmission_id"))
    return deliveries.withColumn("key", key).withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def reason_for(state: tuple, e: dict) -> str:
    sub, _, status, _ = state
    if e["transition"] != "apply":
        owns = status is not None and sub == e["sub_id"]
        return ("past_due" if owns else "payment_without_row") if e["transition"] == "fail" else ("downgraded" if owns else "no_matching_subscription")
    if status is None:
        return "created"
    if sub is None or sub == e["sub_id"]:
        return "ignored_no_downgrade" if e["new_status"] == "trialing" and status in ("active", "past_due") and not e["grants"] else "updated"
    if status == "active":
        return "duplicate_active_subscription"
    if e["grants"]:
        return "reactivated_new_subscription"
    return "new_attempt_registered" if e["new_status"] == "trialing" else "stale_event_ignored"


def advanced(state: tuple, e: dict) -> tuple[tuple, tuple]:
    """The next state, and the audit row of event e."""
    sub, tier, status, usage = state
    reason = reason_for(state, e)
    applied = reason in APPLIED
    if applied:
        status = e["new_status"]
        if e["transition"] == "apply":
            sub, tier = e["sub_id"] if e["sub_id"] is not None else sub, e["tier"]
            usage = e["tier"] if status == "active" else usage
        elif reason == "downgraded":
            tier = usage = "free"
    return (sub, tier, status, usage), (e["event_id"], reason, applied, state[2], status, state[0], sub, usage, tier)


#: What a block of events leaves of the state before it, and a subscription that no event of the block names.
KEPT, OTHER = "=", ("other",)


class BlockOfEvents:
    """What a block of a user's events does to any state before it.

    Tiers are only passed on, and of two subscriptions it only matters whether they are the same. So states before the block fall into
    classes: by status, and by whether the subscription is missing, named in the block, or another one. Classes that an event sends to the
    same state stay together from then on; an event moves all classes at once that do not hold its own subscription.
    """

    def __init__(self):
        self.leads: list[int] = []  # for each class, the class that it has come together with
        self.first: list[tuple] = []  # (status before, subscription before) of each class
        self.places: dict[tuple, dict] = {}  # (status, tier, usage tier) now: subscription now: class
        self.named: set = set()
        self.others: list[int] = []  # classes of states whose subscription the block does not name, by status
        for status in (None, *STATUSES):
            for sub in (None,) if status is None else (None, OTHER):
                self.places.setdefault((status, KEPT, KEPT), {})[sub] = c = self.started(status, sub)
                if sub is OTHER:
                    self.others.append(c)

    def started(self, status: str | None, sub: object) -> int:
        self.leads.append(len(self.leads))
        self.first.append((status, sub))
        return len(self.leads) - 1

    def lead(self, c: int) -> int:
        while self.leads[c] != c:
            self.leads[c] = c = self.leads[self.leads[c]]
        return c

    def put(self, place: tuple, sub: object, c: int) -> None:
        held = self.places.setdefault(place, {})
        if sub in held:
            self.leads[c] = held[sub]
        else:
            held[sub] = c

    def add(self, e: dict) -> None:
        own = e["sub_id"]
        if own is not None and own not in self.named:  # states before the block that hold this subscription part from the others here
            self.named.add(own)
            apart: dict[int, int] = {}
            for c in self.others:
                lead = self.lead(c)
                place = next((p for p, held in self.places.items() if held.get(OTHER) == lead), None)
                if place is not None:
                    new = self.started(self.first[c][0], own)
                    if lead in apart:
                        self.leads[new] = apart[lead]
                    else:
                        apart[lead] = new
                        self.put(place, own, new)
        moves = []
        for place in list(self.places):
            held = self.places[place]
            status, tier, usage = place
            for sub in [s for s in dict.fromkeys((None, own)) if s in held]:
                moves.append((advanced((sub, tier, status, usage), e)[0], held.pop(sub)))
            if held:
                to, to_tier, to_status, to_usage = advanced((OTHER, tier, status, usage), e)[0]
                if to is OTHER and (to_status, to_tier, to_usage) == place:
                    continue
                del self.places[place]
                moves += [((sub if to is OTHER else to, to_tier, to_status, to_usage), c) for sub, c in held.items()]
        for (sub, tier, status, usage), c in moves:
            self.put((status, tier, usage), sub, c)

    def result(self) -> list:
        """[status before, subscription before, state after] of each class; a named subscription only where it differs from others.

        A subscription is [id], null for none, or KEPT: before, one that the block does not name, and after, the one before.
        """
        ends = {c: ([sub] if isinstance(sub, str) else KEPT if sub is OTHER else None, tier, status, usage) for (status, tier, usage), held in self.places.items() for sub, c in held.items()}
        found = {f: ends[self.lead(c)] for c, f in enumerate(self.first)}
        rows = []
        for (status, sub), end in found.items():
            if isinstance(sub, str):
                end = (KEPT if end[0] == [sub] else end[0], *end[1:])
                if end != found[status, OTHER]:
                    rows.append([status, [sub], end])
            else:
                rows.append([status, None if sub is None else KEPT, end])
        return rows

    @staticmethod
    def after(result: list, state: list | tuple) -> tuple:
        sub, tier, status, usage = state
        ends = {(s, tuple(x) if isinstance(x, list) else x): end for s, x, end in result}
        kind = None if sub is None else (sub,) if (status, (sub,)) in ends else KEPT
        to, to_tier, to_status, to_usage = ends[status, kind]
        kept = lambda new, old: old if new == KEPT else new
        return (to[0] if isinstance(to, list) else kept(to, sub), kept(to_tier, tier), to_status, kept(to_usage, usage))


def folded(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The audit rows of every user's events in order of (ts, event_id): one row for each event, applied or not.

    Users with over block_rows events are folded in blocks, at once in many tasks.
    """
    rows = dispatched(events).where(F.col("tier").isin(*TIERS) & F.col("new_status").isin(*STATUSES))
    fields = ["ts", "event_id", "sub_id", "tier", "new_status", "transition", "grants"]

    def step(state: tuple, e: dict) -> tuple[tuple, tuple]:
        now, row = advanced(state, e)
        return now, row[1:]

    held = rows.select("user_identifier", *fields)
    return segmented_fold(held, "user_identifier", ["ts", "event_id"], fields[1:], ["event_id"], (None, None, None, None), step, AUDIT, BlockOfEvents, block_rows)


def duplicate_attempts(audit: DataFrame, events: DataFrame) -> DataFrame:
    """The active and the attempted subscription of each refused purchase."""
    refused = audit.where("reason = 'duplicate_active_subscription'").select("event_id", "user_identifier", F.col("after_sub").alias("active_sub"))
    return refused.join(events.select("event_id", F.col("sub_id").alias("attempted_sub"), "kind"), "event_id")


def final_state(audit: DataFrame) -> DataFrame:
    """The last audit row of each user as a subscription row."""
    last = F.max_by(F.struct("after_sub", "tier", "after_status", "usage_tier", "n"), "n")
    return audit.groupBy("user_identifier").agg(last.alias("s")).select("user_identifier", F.col("s.after_sub").alias("sub_id"), F.col("s.tier").alias("tier"), F.col("s.after_status").alias("status"), F.col("s.usage_tier").alias("usage_tier"))


def verified(subs: DataFrame, canonical: DataFrame) -> DataFrame:
    """subs with the first check against the provider's answers that fails, or verified.

    canonical: sub_id (the id asked for), http (the answer's status, null if the provider was not reached), answered_id (the id in the
    answer), status, plan_tier and custom_uid. An id without an answer counts as one that the provider does not know.
    """
    c = canonical.select(F.col("sub_id").alias("c_id"), "http", "answered_id", F.col("status").alias("c_status"), "plan_tier", "custom_uid")
    joined = subs.where("provider_sub_id is not null").join(c, F.col("provider_sub_id") == F.col("c_id"), "left")
    same = lambda a, b: F.col(a).eqNullSafe(b)
    outcome = (
        F.when(F.col("c_id").isNull() | same("http", F.lit(404)), "not_found").when(~F.coalesce(F.col("http").between(200, 299), F.lit(False)), "provider_error")
        .when(~same("answered_id", F.col("provider_sub_id")), "id_mismatch").when(~same("c_status", F.lit("ACTIVE")), "not_active")
        .when(~same("plan_tier", F.col("tier")), "plan_mismatch").when(~same("custom_uid", F.col("user_identifier")), "owner_mismatch").otherwise("verified")
    )
    return joined.withColumn("outcome", outcome)


def reconciled(subs: DataFrame, canonical: DataFrame) -> DataFrame:
    """verified() with what to do: nothing where both sides agree on whether it is active, else propose a change or look by hand.

    A subscription that the provider does not know, or whose check failed, is not compared.
    """
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    sure = F.col("outcome") == "verified"
    action = (
        F.when(F.col("outcome") == "not_found", "missing_at_provider").when(F.col("outcome") == "provider_error", "retry_later")
        .when(sure == active, "match").when(sure, "candidate").otherwise("manual_review")
    )
    return verified(subs, canonical).withColumn("action", action)


def cancelled(subs: DataFrame, answer: Column) -> DataFrame:
    """subs with the outcome of a user's request to cancel, and the status and tier that it leaves.

    answer: the provider's HTTP status, null if it could not be reached. 422 means that nothing was left to cancel, which is success.
    """
    done = answer.between(200, 299) | (answer == 422)
    outcome = (
        F.when(F.coalesce("provider_sub_id", F.lit("")) == "", "no_subscription").when(~F.col("status").eqNullSafe(F.lit("active")), "not_active")
        .when(answer.isNull(), "provider_unreachable").when(done, "cancelled").otherwise("provider_error")
    )
    held = subs.withColumn("outcome", outcome)
    ends = F.col("outcome") == "cancelled"
    return held.withColumns({"status": F.when(ends, "cancelled").otherwise(F.col("status")), "tier": F.when(ends, "free").otherwise(F.col("tier"))})


def plan_matches(plan_id: Column, tier: Column, plans: dict[str, str]) -> Column:
    """Whether the provider's plan is the one that is configured for the tier; a missing plan never is."""
    wanted = F.coalesce(*[F.when(tier == t, F.lit(p)) for t, p in plans.items()])
    return F.coalesce(plan_id == wanted, F.lit(False))


def manual_checks(requests: DataFrame, window_ms: int = 10_000) -> DataFrame:
    """What a user's request to check a subscription leads to, by the first case that fits.

    requests: requested_id (null: none), provider_sub_id, status, outcome (of verified()), reason (of the transition, if it was tried)
    and since_ms (since the last request, null: none before). A request for an id other than the linked one is never looked up.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    decision = (
        F.when(F.coalesce(F.col("since_ms") < window_ms, F.lit(False)), "throttled").when(~some("provider_sub_id"), "nothing_linked")
        .when(some("requested_id") & (F.col("requested_id") != F.col("provider_sub_id")), "reconciliation_required").when(F.col("status") == "active", "already_active")
        .when(F.col("outcome") != "verified", F.col("outcome")).when(F.col("reason") == "duplicate_active_subscription", "duplicate_active_subscription")
        .when(F.coalesce(F.col("reason").isin(*APPLIED), F.lit(False)), "activated").otherwise("pending")
    )
    return requests.withColumn("decision", decision)


def lifecycle(deliveries: DataFrame, results: DataFrame) -> DataFrame:
    """deliveries (key) with processing_status: received until a worker took one (started), then processing, processed or failed.

    results: key, started and error (null: none yet or success) and done.
    """
    held = deliveries.join(results, "key", "left")
    status = F.when(~F.coalesce("started", F.lit(False)), "received").when(F.col("error").isNotNull(), "failed").when(F.coalesce("done", F.lit(False)), "processed").otherwise("processing")
    return held.withColumn("processing_status", status)


def report_lines(reconciled_rows: DataFrame) -> DataFrame:
    """One table line of a report for each reconciled subscription, with ids and addresses that tell nobody who it is."""
    cells = F.concat_ws(" | ", T.bare_email(F.substring_index("user_identifier", ":", -1)), T.redacted_id(F.col("provider_sub_id")), "tier", "status", "outcome", "action")
    return reconciled_rows.withColumn("line", F.concat(F.lit("| "), cells, F.lit(" |")))
