import json

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import writes as W
from scriptorium.sources import files
from scriptorium.streaming import alerts


def test_manifest_and_uploads(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"10": {"estado": "limpio", "motivo": "x"}, "9": {"estado": "contaminado", "motivo": "y"}}))
    got = files.manifest(spark, str(tmp_path / "m.json")).orderBy(F.col("num_articulo").cast("int")).collect()
    assert [r["num_articulo"] for r in got] == ["9", "10"]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.txt").write_bytes(b"one\r\n\r\n\r\n\r\ntwo ")
    (tmp_path / "up" / "b.exe").write_text("no")
    rows = files.uploads(spark, str(tmp_path / "up")).collect()
    assert [(r["text"], r["truncated"]) for r in rows] == [("one\n\ntwo", False)]


def test_webhooks_leave_out_what_is_no_event(spark):
    lines = [json.dumps({"id": "e1", "event_type": "X", "resource": {"id": "s"}}), "broken", json.dumps({"id": "e2"})]
    got = files.webhooks(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["event_id"], r["sub_id"]) for r in got] == [("e1", "s")]


def test_lookups(spark):
    df = spark.range(3)
    assert files.exactly_one(df.where("id = 1")) == {"id": 1}
    assert files.at_most_one(df.where("id = 9")) is None
    with pytest.raises(LookupError):
        files.exactly_one(df)


def test_alert_merge_keeps_first_places(spark):
    rows = [(i, f"a-{i}", 0) for i in range(201)] + [(300, "a-5", 1)]
    df = spark.createDataFrame(rows, "seq long, id string, v int")
    got = alerts.merged(df, "id", "seq").orderBy("place").collect()
    assert len(got) == 200 and got[0]["id"] == "a-200" and {r["id"]: r["v"] for r in got}["a-5"] == 1


def test_alert_lines(spark):
    good = json.dumps({"id": "1", "kind": "warning", "message": "m", "timestamp": "t"})
    df = spark.createDataFrame([(good,), ("plain text",), (json.dumps({"id": "2", "kind": "odd", "message": "m"}),)], "value string")
    assert sorted(r["kind"] for r in alerts.parsed(df).collect()) == ["info", "warning"]


def test_deltas_join_over_partial_lines(spark):
    chunks = [("k", 0, 'data: {"del'), ("k", 1, 'ta":"a"}\ndata: {"delta":"b"}\nnoise\ndata: {bad\n'), ("k", 2, 'data: [DONE]\ndata: {"delta":"c"}\n')]
    got = alerts.joined_deltas(spark.createDataFrame(chunks, "k string, s int, c string"), "k", "s", "c").first()
    assert got["text"] == "ab" and got["n_chunks"] == 3


def test_keyed_writes(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert {tuple(r) for r in W.upsert(target, changes, ["k"]).collect()} == {(1, "a"), (2, "x"), (3, "y")}
    assert [tuple(r) for r in W.insert_ignore(target, changes, ["k"], F.col("v")).collect()] == [(3, "y")]
    checked = W.checked(target, small=F.col("k") < 2).orderBy("k").collect()
    assert [r["violations"] for r in checked] == [[], ["small"]]


def test_jsonl(spark, tmp_path):
    W.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1,"b":null}'
