import json
import random
import time
import uuid

import pytest

from scriptorium.streaming import tokens as TK

CHUNKS = "k string, s int, c binary"


def data(content=None, **usage):
    return "data: " + json.dumps({"choices": [{"delta": {"content": content}}], **({"usage": usage} if usage else {})}, ensure_ascii=False) + "\n"


STREAMS = {
    "marks in deltas": (data("say data: [DONE] now") + data(" and more\ndata: [DONE]\n") + "data: [DONE]\n" + data("late"), "say data: [DONE] now and more\ndata: [DONE]\n", True, None, None),
    "usage by field": (data("a", prompt_tokens=5) + data("b", completion_tokens=7) + data("c", prompt_tokens=6, completion_tokens=None), "abc", False, 6, 7),
    "noise": (": ping\n\ndata: {broken\ndata: null\ndata: 5\ndata:no blank\ndata: {\"choices\": \"x\"}\ndata: NaN\n" + data("é日𝔘") + "data: \t[DONE] \r\n", "é日𝔘", True, None, None),
    "open line": (data("kept") + data("lost")[:-1], "kept", False, None, None),
    "no end": (data("x") * 3, "xxx", False, None, None),
    "not text": ('data: {"choices":[{"delta":{"content":5}}]}\ndata: {"choices":[]}\ndata: {"usage":{"prompt_tokens":true}}\n' + data("y", prompt_tokens=0), "y", False, 0, None),
    "half characters": ('data: {"choices":[{"delta":{"content":"a\\ud835"}}]}\ndata: {"choices":[{"delta":{"content":"\\udd18b"}}]}\n' + "data: [DONE]\n", "a\U0001d518b", True, None, None),
    "mark at the start": ("\ufeff" + data("z"), "z", False, None, None),
    "nothing": ("", "", False, None, None),
    "deep": ("data: " + "[" * 100_000 + "\n" + data("q"), "q", False, None, None),
}


def cut(raw, places):
    edges = [0, *sorted(places), len(raw)]
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def read(chunks, source=TK.Source()):
    now, text = TK.Progress(), ""
    for c in chunks:
        now, piece = TK.received(now, c, source)
        text += piece
    return text, now.done, *(now.counts or (None, None))


@pytest.mark.parametrize("name", sorted(STREAMS))
def test_cuts_at_any_byte_change_nothing(name):
    raw, *want = STREAMS[name]
    raw = raw.encode()
    assert list(read([raw])) == want
    random.seed(1)
    places = range(len(raw) + 1) if len(raw) < 2000 else random.sample(range(len(raw)), 20)
    for p in places:
        assert list(read([raw[:p], None, raw[p:]])) == want
    if len(raw) < 2000:
        assert list(read([raw[i : i + 1] for i in range(len(raw))])) == want


def rows(seed):
    random.seed(seed)
    out = []
    for name, (raw, *_) in STREAMS.items():
        raw = raw.encode()
        out += [(name, i, c) for i, c in enumerate(cut(raw, random.sample(range(len(raw) + 1), min(len(raw), 9))))]
    return out


def wanted():
    return {name: tuple(want) for name, (_, *want) in STREAMS.items()}


def test_tables(spark):
    mixed = rows(2)
    random.shuffle(mixed)
    df = spark.createDataFrame(mixed, CHUNKS)
    got = TK.answers(TK.pieces(df, "k", "s", "c"), "k", "s").collect()
    assert {r["k"]: (r["text"], r["done"], r["prompt_tokens"], r["completion_tokens"]) for r in got} == wanted()
    assert sum(r["n_chunks"] for r in got) == len(mixed)
    assert "collect_list" not in TK.pieces(df, "k", "s", "c")._jdf.queryExecution().toString()


def test_other_paths_and_text_chunks(spark):
    source = TK.Source(("delta",), ("meta", 0), ("n",))
    df = spark.createDataFrame([("k", 0, 'data: {"del'), ("k", 1, 'ta":"a"}\ndata: {"delta":"b","meta":[{"n":3}]}\nnoise\ndata: {bad\n'), ("k", 2, 'data: [DONE]\ndata: {"delta":"c"}\n')], "k string, s int, c string")
    got = TK.answers(TK.pieces(df, "k", "s", "c", source), "k", "s", source).first()
    assert (got["text"], got["n"], got["done"], got["n_chunks"]) == ("ab", 3, True, 3)


def test_streams_hold_partial_lines_between_batches(spark, tmp_path):
    mixed = rows(3)
    for turn in range(3):  # chunks of a stream are dealt over three files in their order
        own = [r for r in mixed if (r[1] * 3) // 10 == turn]
        spark.createDataFrame(own, CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = "t" + uuid.uuid4().hex
    query = TK.piece_stream(stream, "k", "s", "c").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    found = spark.table(name)
    got = TK.answers(found, "k", "s").collect()
    assert {r["k"]: (r["text"], r["done"], r["prompt_tokens"], r["completion_tokens"]) for r in got} == wanted()
    assert found.count() == len(mixed)


def test_state_of_an_idle_stream_goes(spark, tmp_path):
    spark.createDataFrame([("k", 0, b"data: [DO")], CHUNKS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in"))
    query = TK.piece_stream(stream, "k", "s", "c", idle=1000).writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    held, until = [], time.time() + 60
    while time.time() < until and not (max(held, default=0) == 1 and held[-1] == 0):
        time.sleep(0.5)
        held += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    assert max(held) == 1 and held[-1] == 0


def test_a_long_stream_takes_the_memory_of_a_line(spark):
    n = 120_000
    df = spark.range(n).selectExpr("'k' as k", "id as s", """concat('ata: {"choices":[{"delta":{"content":"', id % 10, '"}}]}\nd') as c""")
    found = TK.pieces(df.union(spark.createDataFrame([("k", -1, "d")], "k string, s long, c string")), "k", "s", "c")
    assert found.agg({"text": "count"}).first()[0] == n + 1
    assert TK.answers(found, "k", "s").first()["text"] == "".join(str(i % 10) for i in range(n))
