"""Usage metering, access resolution and guards."""

from __future__ import annotations

import bisect
from collections import deque
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.ordered import BLOCK_ROWS, segmented_fold

#: Daily limits by tier (fixed values).
LIMITS = {"free": 3, "academico": 20, "pro": 1000, "admin": 9999}
PAID = ("pro", "academico", "admin")
PENDING_WINDOW_MS = 15 * 60 * 1000
THROTTLE_MS = 10_000
#: The state before a user's first attempt; null is that after attempts without a time only.
NO_ATTEMPT = "none"


def limit_of(tier: Column) -> Column:
    return F.coalesce(*[F.when(tier == t, F.lit(n)) for t, n in LIMITS.items()], F.lit(LIMITS["free"]))


def daily_stats(usage: DataFrame) -> DataFrame:
    return usage.groupBy("query_date").agg(
        F.count_distinct("user_identifier").alias("users"), F.sum("query_count").alias("queries"), F.count_if(F.col("tier") == "free").alias("free_users"), F.count_if(F.col("tier") == "pro").alias("pro_users")
    )


def quota_replay(events: DataFrame, user: str, ts: str, tier: str, order: list[str]) -> DataFrame:
    """events with nth request of the day, allowed and remaining. One user's day is one window, so users spread over tasks.

    An admin is never limited and always has the whole limit left.
    """
    day = F.to_date(ts)
    nth = F.row_number().over(Window.partitionBy(user, day).orderBy(*order))
    limit = limit_of(F.col(tier))
    admin = F.coalesce(F.col(tier) == "admin", F.lit(False))
    left = F.when(admin, F.lit(LIMITS["admin"])).otherwise(F.greatest(limit - F.col("nth"), F.lit(0)))
    return events.withColumns({"day": day, "nth": nth}).withColumn("allowed", admin | (F.col("nth") <= limit)).withColumn("remaining", left)


def usage_status(usage: DataFrame) -> DataFrame:
    """usage with used, limit, resets_on (the next day), remaining and allowed, without counting a request."""
    limit = limit_of(F.col("tier"))
    admin = F.coalesce(F.col("tier") == "admin", F.lit(False))
    rows = usage.withColumns({"used": F.col("query_count"), "limit": limit, "resets_on": F.date_add("query_date", 1)})
    left = F.when(admin, F.lit(LIMITS["admin"])).otherwise(F.greatest(limit - F.col("query_count"), F.lit(0)))
    return rows.withColumns({"remaining": left, "allowed": admin | (F.col("query_count") < limit)})


def access(usage_today: DataFrame, subs: DataFrame) -> DataFrame:
    """Access of every user that either side knows. The usage tier alone grants; the subscription explains."""
    usage_side = usage_today.select("user_identifier", F.col("tier").alias("usage_tier"), F.lit(True).alias("has_usage"))
    sub_side = subs.select("user_identifier", F.col("tier").alias("sub_tier"), F.col("status").alias("billing_status"), F.lit(True).alias("has_sub"))
    both = usage_side.join(sub_side, "user_identifier", "full_outer")
    tier = F.coalesce("usage_tier", F.lit("free"))
    status = F.col("billing_status")
    granted = tier.isin(*PAID)
    inconsistent = F.coalesce(status == "active", F.lit(False)) & ~granted
    pending = inconsistent | (~granted & F.coalesce(status.isin("trialing", "pending"), F.lit(False)))
    reason = (
        F.when(granted, "active_subscription").when(inconsistent, "billing_state_inconsistent").when(pending, "verification_pending").when(status == "past_due", "payment_failed")
        .when(status == "cancelled", "cancelled").when(F.col("has_sub").isNull(), "no_subscription").otherwise("free_tier")
    )
    billing_tier = F.when(F.col("sub_tier").isin("academico", "pro"), F.col("sub_tier"))
    source = F.when(F.col("has_usage"), "usage").when(F.col("has_sub"), "subscriptions").otherwise("none")
    return both.select("user_identifier", granted.alias("granted"), tier.alias("tier"), "billing_status", F.when(pending, billing_tier).alias("pending_tier"), source.alias("source"), pending.alias("pending"), reason.alias("reason"))


def account_label(df: DataFrame) -> DataFrame:
    """access() with the status that an account page shows."""
    label = (
        F.when(F.col("pending"), "verifying").when(F.col("granted"), "active").when(F.col("billing_status") == "past_due", "payment due").when(F.col("billing_status") == "cancelled", "cancelled").otherwise("free")
    )
    return df.withColumns({"label": label, "daily_limit": limit_of(F.col("tier"))})


def purchase_guard(subs: DataFrame, wanted: Column) -> DataFrame:
    """subs with the code that blocks a purchase, or null, and the seconds after which to try again."""
    young = F.col("status").isin("pending", "trialing") & (F.col("age_ms") < PENDING_WINDOW_MS)
    active = F.col("status") == "active"
    code = F.when(active & (F.col("tier") == wanted), "ALREADY_SUBSCRIBED").when(active, "PLAN_CHANGE_REQUIRED").when(young, "PENDING_ATTEMPT_EXISTS")
    return subs.withColumns({"code": code, "retry_after_s": F.when(young, F.ceil((PENDING_WINDOW_MS - F.col("age_ms")) / 1000))})


class BlockOfAttempts:
    """What a block of a user's attempts does to the time of the last accepted one.

    From any attempt that is accepted, the next ones follow. The first that is accepted in a block is the first one window_ms after the last
    one before it, which lies before the block; so only attempts up to window_ms after the block's first can be it. For each of those, the
    block keeps the last one that follows; where paths have met, they go on as one.
    """

    def __init__(self, window_ms: int = THROTTLE_MS):
        self.window = window_ms
        self.starts: list[int] = []  # times that may be the first accepted, in order
        self.paths: list[int] = []  # the path that each begins or joins
        self.last: list[int] = []  # for each path, its last accepted time
        self.into: list[int] = []  # for each path, the one that it has met, or itself
        self.live: deque[tuple[int, int]] = deque()  # (last accepted time, path) of paths that have not met another, by time

    def add(self, row: dict) -> None:
        ms, path = row["ms"], None
        if ms is None:
            return
        while self.live and ms - self.live[0][0] >= self.window:
            own = self.live.popleft()[1]
            path = own if path is None else path
            self.into[own] = path
        begins = not self.starts or (ms != self.starts[-1] and self.starts[-1] - self.starts[0] <= self.window)
        if begins and path is None:
            path = len(self.last)
            self.last.append(ms)
            self.into.append(path)
        if path is not None:
            self.last[path] = ms
            self.live.append((ms, path))
        if begins:
            self.starts.append(ms)
            self.paths.append(path)

    def result(self) -> dict:
        """Times and the last accepted one from there on; of times in a row that end alike, the last."""

        def end(path: int) -> int:
            while self.into[path] != path:
                path = self.into[path]
            return self.last[path]

        ends = [end(p) for p in self.paths]
        kept = [i for i, e in enumerate(ends) if i + 1 == len(ends) or e != ends[i + 1]]
        return {"window": self.window, "starts": [self.starts[i] for i in kept], "ends": [ends[i] for i in kept]}

    @staticmethod
    def after(result: dict, last: int | str | None) -> int | None:
        """The last accepted time after the block."""
        if last is None or last == NO_ATTEMPT:
            return result["ends"][0] if result["ends"] else None
        i = bisect.bisect_left(result["starts"], last + result["window"])
        return result["ends"][i] if i < len(result["ends"]) else last


def throttled(attempts: DataFrame, user: str, ts: str, order: str, window_ms: int = THROTTLE_MS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """attempts with accepted: at least window_ms, of times rounded to milliseconds, after the user's last accepted one; a user's first is accepted.

    A fold over a user's attempts, ordered by ts and order with nulls last, where an attempt without ts is neither accepted nor refused unless
    it is the first; users with over block_rows of them are folded in blocks, at once in many tasks.
    """
    at = F.col(ts).cast("timestamp")
    half = F.when(F.unix_micros(at) < 0, 499).otherwise(500)  # unix_millis cuts off; halves go away from 1970
    rows = attempts.select(user, F.unix_millis(F.timestamp_micros(F.unix_micros(at) + half)).alias("ms"), at.alias("_at"), order, F.col(ts).isNull().alias("_untimed"), F.col(order).isNull().alias("_unnamed"))

    def step(last: int | str | None, x: dict) -> tuple[int | str | None, tuple]:
        ok = True if last == NO_ATTEMPT else None if x["ms"] is None or last is None else x["ms"] - last >= window_ms
        return x["ms"] if ok else last, (ok,)

    return segmented_fold(rows, user, ["_untimed", "_at", "_unnamed", order], ["ms"], [order], NO_ATTEMPT, step, {"accepted": "boolean"}, partial(BlockOfAttempts, window_ms), block_rows)
