"""Polling again for an answer that is still open: a timer for each request, in keyed state.

The first attempt of a request is its start. Each answer that is open, and each failure to get one, sets a timer; when it goes off, the
next attempt is due. Any other answer is final. Time is event time: timers go off as the watermark passes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptorium.operators.ordered import ordered_fold
from scriptorium.sources.shipping import ship

# The pause between attempts, the number of attempts, the answer that is still open, and the one that is not an answer.
PAUSE_MS, MOST_ATTEMPTS = 12_000, 8
OPEN, FAILURE, SYNCED = "APPROVAL_PENDING", "NETWORK_ERROR", "SYNCED"


class Polling(NamedTuple):
    """Attempts made, the time at which the next is due (0: none is), and whether an answer was final."""

    attempts: int = 0
    due: int = 0
    done: bool = False


def answered(now: Polling, at_ms: int, answer: str | None, pause_ms: int = PAUSE_MS, most: int = MOST_ATTEMPTS) -> tuple[Polling, str]:
    """The state and the decision after an answer to the running attempt: wait, done, error, gave_up, or ignored.

    A null answer is final, as is any that is not known to be open. After the last attempt an open answer leaves the request waiting
    for a manual check, which ends the polling as gave_up; a failure then is an error. Answers that no attempt waits for are ignored.
    """
    if now.done or now.due:
        return now, "ignored"
    attempts = max(now.attempts, 1)
    if answer == SYNCED:
        return Polling(attempts, 0, True), "done"
    if answer not in (OPEN, FAILURE):
        return Polling(attempts, 0, True), "error"
    if attempts < most:
        return Polling(attempts, at_ms + pause_ms, False), "wait"
    return Polling(attempts, 0, True), "error" if answer == FAILURE else "gave_up"


def rung(now: Polling, at_ms: int) -> Polling | None:
    """The state once the next attempt is made, if it is due at that time."""
    return Polling(now.attempts + 1, 0, False) if now.due and at_ms >= now.due and not now.done else None


def replayed(answers: DataFrame, key: str, ts: str, answer: str, order: str, pause_ms: int = PAUSE_MS, most: int = MOST_ATTEMPTS) -> DataFrame:
    """key, order, attempt, decision and due_ms (of the next attempt, else null) for every recorded answer, each key in order of (ts, order).

    An attempt is made when it is due, so an answer before that time is to no attempt and is ignored.
    """
    rows = answers.select(key, F.unix_millis(F.col(ts).cast("timestamp")).alias("_ms"), F.col(answer).alias("_answer"), order)

    def step(state: list, x: dict) -> tuple[tuple, tuple]:
        now = rung(Polling(*state), x["_ms"]) or Polling(*state)
        now, decision = answered(now, x["_ms"], x["_answer"], pause_ms, most)
        return tuple(now), (now.attempts, decision, now.due if decision == "wait" else None)

    return ordered_fold(rows, key, ["_ms", order], ["_ms", "_answer"], [order], tuple(Polling()), step, {"attempt": "long", "decision": "string", "due_ms": "long"})


def poll_stream(answers: DataFrame, key: str, ts: str, answer: str, late: str = "0 seconds", pause_ms: int = PAUSE_MS, most: int = MOST_ATTEMPTS) -> DataFrame:
    """key, attempt, decision and at_ms over a stream of answers: a row for each answer, and a row poll when an attempt is due.

    An attempt is made when its timer goes off or an answer of a later time shows that it was, whichever comes first, so the rows are the same
    however the answers are cut into batches. State goes once a request has been silent for as long as most pauses; answers behind the
    watermark are left out.
    """
    ship(answers.sparkSession)
    kind = dict(answers.dtypes)[key]
    held = answers.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = held.select(F.col(key), F.col(answer).alias("_answer"), F.unix_millis(F.col(ts).cast("timestamp")).alias("_ms"), F.col(ts))

    def update(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Polling(*state.get) if state.exists else Polling()
        out, clock = [], state.getCurrentWatermarkMs()

        def ring(at_ms: int) -> bool:
            nonlocal now
            made = rung(now, at_ms)
            if made is not None:
                out.append((own[0], made.attempts, "poll", now.due))
                now = made
            return made is not None

        if state.hasTimedOut:
            if not ring(clock):
                state.remove()
                return
        else:
            for x in pd.concat(list(batches)).sort_values("_ms", kind="stable").itertuples(index=False):
                at_ms, said = int(x[2]), None if pd.isna(x[1]) else x[1]
                clock = max(clock, at_ms)
                ring(at_ms)
                now, decision = answered(now, at_ms, said, pause_ms, most)
                out.append((own[0], now.attempts, decision, at_ms))
        state.update(tuple(now))
        state.setTimeoutTimestamp(max(now.due or clock + most * pause_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "attempt", "decision", "at_ms"])

    return rows.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, attempt int, decision string, at_ms long", "attempts int, due long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)
