"""Streams with keyed state against the same rows as a table, for different cuts into batches."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import usage as U
from scriptorium.streaming import alerts, retries
from scriptorium.streaming import usage as US

START = dt.datetime(2024, 3, 1)


def arriving(spark, folder, cuts, schema):
    for i, rows in enumerate(cuts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"round{i:03}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def run(stream, tmp_path):
    name = "t" + uuid.uuid4().hex
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name), query


def test_alerts_on_display_equal_the_merge_of_every_prefix(spark, tmp_path):
    random.seed(5)
    ids = [f"a{i}" for i in range(40)]
    rows = [(random.choice(ids[: 8 + i // 4]), i, f"v{i}") for i in range(120)]
    cuts = [rows[:1], rows[1:50], rows[50:60], rows[60:]]
    schema = "id string, seq int, v string"
    for n in range(1, len(cuts) + 1):
        folder = tmp_path / "in"
        spark.createDataFrame(cuts[n - 1], schema).coalesce(1).write.parquet(str(folder / f"round{n:03}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
        alerts.merged_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "id", "seq", keep=10).awaitTermination()
        want = alerts.merged(spark.createDataFrame([r for c in cuts[:n] for r in c], schema), "id", "seq", keep=10)
        got = alerts.displayed(spark, str(tmp_path / "out"))
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert len(list((tmp_path / "out").glob("batch=*"))) == 2  # the display and the one before


REQUEST = "u string, ts timestamp, tier string, e int"


def requests(n=240):
    random.seed(6)
    at = sorted(START + dt.timedelta(minutes=random.randrange(0, 4 * 1440)) for _ in range(n))
    return [(random.choice(["a", "b", "c"]), t, {"a": "free", "b": "academico", "c": "admin"}[random.choice("abc")], i) for i, t in enumerate(at)]


@pytest.mark.parametrize("places", [[], [1, 100, 101, 230], list(range(24, 240, 24))])
def test_quotas_equal_the_replay_for_any_cuts_and_past_days_go(spark, tmp_path, places):
    rows = requests()
    edges = [0, *places, len(rows)]
    stream = arriving(spark, tmp_path / "in", [rows[a:b] for a, b in zip(edges, edges[1:], strict=False)], REQUEST)
    found, query = run(US.quota_stream(stream, "u", "ts", "tier", "e"), tmp_path)
    columns = ["e", "u", "day", "nth", "allowed", "remaining"]
    want = U.quota_replay(spark.createDataFrame(rows, REQUEST), "u", "ts", "tier", ["ts", "e"]).select(columns)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, want.collect()))
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert states[-1] <= 3  # users of the last day; 12 user-days have been counted


def test_quotas_of_many_users_keep_a_row_of_state_for_each_group_and_day(spark, tmp_path):
    rows = [(None if i % 7 == 0 else f"u{i % 500}", START + dt.timedelta(seconds=i), "free", i) for i in range(1500)]
    stream = arriving(spark, tmp_path / "in", [rows[:700], rows[700:]], REQUEST)
    found, query = run(US.quota_stream(stream, "u", "ts", "tier", "e", groups=4), tmp_path)
    want = U.quota_replay(spark.createDataFrame(rows, REQUEST), "u", "ts", "tier", ["ts", "e"])
    assert sorted(map(str, found.select("e", "u", "nth").collect())) == sorted(map(str, want.select("e", "u", "nth").collect()))
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 5  # 501 users


ANSWER = "k string, e int, ts timestamp, said string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_decisions_of_one_request():
    now, seen = retries.Polling(), []
    for second, said in [(0, "APPROVAL_PENDING"), (5, "SYNCED"), (13, "NETWORK_ERROR"), (30, "APPROVAL_PENDING"), (50, "SYNCED"), (70, "SYNCED")]:
        now = retries.rung(now, second * 1000) or now
        now, decision = retries.answered(now, second * 1000, said)
        seen.append((now.attempts, decision, now.due))
    assert seen == [(1, "wait", 12_000), (1, "ignored", 12_000), (2, "wait", 25_000), (3, "wait", 42_000), (4, "done", 0), (4, "ignored", 0)]


@pytest.mark.parametrize(("last", "want"), [("APPROVAL_PENDING", "gave_up"), ("NETWORK_ERROR", "error"), (None, "error"), ("MISMATCH", "error"), ("SYNCED", "done")])
def test_the_eighth_attempt_is_the_last(last, want):
    now = retries.Polling()
    for i in range(7):
        now, decision = retries.answered(retries.rung(now, i * 12_000) or now, i * 12_000, "APPROVAL_PENDING")
        assert decision == "wait" and now.attempts == i + 1
    assert retries.rung(now, now.due - 1) is None
    now, decision = retries.answered(retries.rung(now, now.due), now.due, last)
    assert (now.attempts, decision) == (8, want) and retries.rung(now, 10**12) is None


def test_timers_go_off_as_time_passes(spark, tmp_path):
    """The watermark is the clock: other requests move it on while k says nothing."""
    cuts = [[("k", 0, at(0), "APPROVAL_PENDING")], [("x", 1, at(11), "SYNCED")], [("y", 2, at(13), "SYNCED")], [("z", 3, at(14), "SYNCED")], [("k", 4, at(15), "APPROVAL_PENDING"), ("w", 5, at(40), "SYNCED")], [("v", 6, at(41), "SYNCED")]]
    rows = [r for c in cuts for r in c]
    found, _ = run(retries.poll_stream(arriving(spark, tmp_path / "in", cuts, ANSWER), "k", "ts", "said"), tmp_path)
    base = int(START.replace(tzinfo=dt.UTC).timestamp() * 1000)
    got = sorted((r["k"], r["at_ms"] - base, r["attempt"], r["decision"]) for r in found.collect())
    assert [g for g in got if g[0] == "k"] == [("k", 0, 1, "wait"), ("k", 12_000, 2, "poll"), ("k", 15_000, 2, "wait"), ("k", 27_000, 3, "poll")]
    table = retries.replayed(spark.createDataFrame(rows, ANSWER), "k", "ts", "said", "e").where(F.col("decision") != "").collect()
    assert sorted((r["k"], r["attempt"], r["decision"]) for r in table) == sorted((g[0], g[2], g[3]) for g in got if g[3] != "poll")
