"""The ledger over a stream: exactly-once intake and the ordered fold with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptorium.operators.ledger import STATUSES, TIERS, advanced, dispatched
from scriptorium.sources.shipping import ship

STATE = "sub_id string, tier string, status string, usage_tier string"
AUDIT = "user_identifier string, event_id long, reason string, applied boolean, before_status string, after_status string, before_sub string, after_sub string, usage_tier string, tier string"


def exactly_once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """The first delivery of each event. State holds the keys seen; retries may come at any time, so it has no watermark."""
    return events.dropDuplicates([key])


def within(events: DataFrame, ts: str, delay: str, key: str = "event_id") -> DataFrame:
    """As exactly_once, with state bounded by a watermark, for sources that retry for no longer than delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def audit_stream(events: DataFrame) -> DataFrame:
    """An audit row for every event, as in the batch fold, with each user's subscription as state.

    Events of a user within a micro-batch are put in order of (ts, event_id); across batches they count in order of arrival.
    """
    ship(events.sparkSession)
    columns = AUDIT.replace(",", "").split()[::2]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, None, None, None)
        out = []
        for e in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            now, row = advanced(now, e._asdict())
            out.append((key[0], *row))
        state.update(now)
        yield pd.DataFrame(out, columns=columns)

    rows = dispatched(events)
    rows = rows.where(rows["tier"].isin(*TIERS) & rows["new_status"].isin(*STATUSES))
    return rows.groupBy("user_identifier").applyInPandasWithState(update, AUDIT, STATE, "append", GroupStateTimeout.NoTimeout)
