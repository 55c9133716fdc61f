"""Quotas as requests arrive: a counter for each user and day, which goes when the day is over."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptorium.operators.usage import LIMITS, limit_of
from scriptorium.sources.shipping import ship

DAY_MS = 86_400_000
#: Groups of users that are counted together, for each day: a call of Python and a row of state for each, however many users there are.
GROUPS = 256


def quota_stream(requests: DataFrame, user: str, ts: str, tier: str, request_id: str, late: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """request_id, user, ts, tier, day, nth, allowed and remaining of every request, as quota_replay() gives them.

    Requests of a user within a micro-batch are put in order of (ts, request_id); across batches they count in order of arrival. The
    watermark follows the requests by late: the counters of a day that it has passed go, and requests of such a day are left out.
    Days are those of UTC, as the session's time zone must be. Counters are kept by groups of users, dealt by a hash; a stream that goes on
    must keep the number of groups.
    """
    ship(requests.sparkSession)
    columns = [request_id, user, ts, tier]
    held = requests.select(*columns).withColumn(ts, F.col(ts).cast("timestamp"))
    kinds = dict(held.dtypes)
    group = F.when(F.col(user).isNull(), -1).otherwise(F.pmod(F.xxhash64(user), F.lit(groups)).cast("int"))  # rows without user stand apart, as pandas turns numbers beside nulls into floats
    rows = held.withWatermark(ts, late).withColumns({"day": F.to_date(ts), "_group": group})

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counted = json.loads(state.get[0]) if state.exists else {}
        held = pd.concat(list(batches)).sort_values([ts, request_id], kind="stable")  # a group's requests in one micro-batch
        names = held[user].astype(str)
        held["nth"] = (held.groupby(names, sort=False).cumcount() + 1 + names.map(counted).fillna(0).astype("int64")).astype("int32")
        for name, n in names.value_counts(sort=False).items():
            counted[name] = counted.get(name, 0) + int(n)
        state.update((json.dumps(counted),))
        over = (pd.Timestamp(key[1]) - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1) + DAY_MS
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        yield held[[*columns, "day", "nth"]]

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", day date, nth int"
    found = rows.groupBy("_group", "day").applyInPandasWithState(update, schema, "counted string", "append", GroupStateTimeout.EventTimeTimeout)
    limit, admin = limit_of(F.col(tier)), F.coalesce(F.col(tier) == "admin", F.lit(False))
    left = F.when(admin, F.lit(LIMITS["admin"])).otherwise(F.greatest(limit - F.col("nth"), F.lit(0)))
    return found.withColumns({"allowed": admin | (F.col("nth") <= limit), "remaining": left})
