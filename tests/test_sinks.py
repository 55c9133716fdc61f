import random

import pytest
from pyspark.sql import functions as F

from scriptorium.streaming import sinks
from scriptorium.streaming.commits import last_commit

ROW = "k int, v string, at int"


def stream_of(spark, folder, rounds, schema=ROW):
    """A stream with a micro-batch for each list of rows that is not there yet."""
    done = len(list(folder.glob("*"))) if folder.exists() else 0
    for i, rows in enumerate(rounds[done:], done):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(folder / f"round{i:03}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "*"))


def upsert(spark, tmp_path, rounds, checkpoint="cp", **options):
    sinks.upsert_stream(stream_of(spark, tmp_path / "in", rounds), str(tmp_path / "out"), str(tmp_path / checkpoint), ["k"], "at", **options).awaitTermination()


def table(spark, tmp_path):
    return {r["k"]: (r["v"], r["at"]) for r in sinks.upserted(spark, str(tmp_path / "out")).collect()}


def plain(rounds):
    out = {}
    for rows in rounds:
        for k, v, at in rows:
            if k not in out or at >= out[k][1]:
                out[k] = (v, at)
    return out


def folders(tmp_path):
    return {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").glob("bucket=*/batch=*")}


def test_upserts_equal_a_plain_version_and_touch_few_buckets(spark, tmp_path):
    random.seed(1)
    rounds = [[(k, f"r0-{k}", 0) for k in range(200)]] + [[(k, f"r{i}-{k}", random.choice([i, 0, -1])) for k in random.sample(range(250), 3)] for i in (1, 2, 3)]
    upsert(spark, tmp_path, rounds)
    assert table(spark, tmp_path) == plain(rounds)
    written = [f for f in folders(tmp_path) if not f.endswith("batch=0")]
    assert 1 <= len(written) <= 9  # three buckets a batch at most, of 64
    assert last_commit(spark, str(tmp_path / "out"))[0] == 3 and len([p for p in (tmp_path / "out" / "_commits").iterdir() if p.name.isdigit()]) == 2


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rounds = [[(1, "a", 1), (2, "b", 1)], [(1, "c", 1)]]
    upsert(spark, tmp_path, rounds)
    before, files = table(spark, tmp_path), sorted((tmp_path / "out").rglob("*.parquet"))
    assert before == {1: ("c", 1), 2: ("b", 1)}
    upsert(spark, tmp_path, rounds, checkpoint="other")  # all batches once more
    assert table(spark, tmp_path) == before and sorted((tmp_path / "out").rglob("*.parquet")) == files


def test_ties_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    rows = [(1, f"v{i}", 5) for i in range(20)]
    upsert(spark, tmp_path / "a", [rows])
    upsert(spark, tmp_path / "b", [rows[::-1]])
    assert table(spark, tmp_path / "a") == table(spark, tmp_path / "b")


def test_files_of_a_batch_that_failed_are_not_read(spark, tmp_path, monkeypatch):
    rounds = [[(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (3, "d", 2)]]
    upsert(spark, tmp_path, rounds[:1])
    with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):  # noqa: PT012
        m.setattr(sinks, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        upsert(spark, tmp_path, rounds)
    assert table(spark, tmp_path) == plain(rounds[:1]) and any(f.endswith("batch=1") for f in folders(tmp_path))
    upsert(spark, tmp_path, rounds)
    assert table(spark, tmp_path) == plain(rounds)


def test_stamps_of_rows_that_stay_are_kept(spark, tmp_path):
    upsert(spark, tmp_path, [[(1, "a", 1), (2, "b", 1)]], stamp="updated_at", buckets=1)
    old = {r["k"]: r["updated_at"] for r in sinks.upserted(spark, str(tmp_path / "out")).collect()}
    upsert(spark, tmp_path, [[(1, "a", 1), (2, "b", 1)], [(1, "z", 2)]], stamp="updated_at", buckets=1)
    new = {r["k"]: r["updated_at"] for r in sinks.upserted(spark, str(tmp_path / "out")).collect()}
    assert new[2] == old[2] and new[1] > old[1]


def two(spark, tmp_path, rounds, second=lambda b: b.select("k", F.lit("requested").alias("kind"))):
    paths = (str(tmp_path / "orders"), str(tmp_path / "audit"))
    stream = stream_of(spark, tmp_path / "in", rounds)
    sinks.two_tables(stream, lambda b: b.select("k", "v"), second, paths, str(tmp_path / "cp")).awaitTermination()
    return paths


def seen(spark, paths):
    return [sorted(r["k"] for r in t.collect()) for t in sinks.both(spark, paths)]


def test_two_tables_appear_together(spark, tmp_path):
    rounds = [[(1, "a", 1), (2, "b", 1)], [(3, "c", 1)]]
    paths = (str(tmp_path / "orders"), str(tmp_path / "audit"))
    assert sinks.both(spark, paths) is None
    two(spark, tmp_path, rounds[:1])
    assert seen(spark, paths) == [[1, 2], [1, 2]]

    def fails(batch):
        raise RuntimeError("between the writes")

    with pytest.raises(Exception, match="between"):
        two(spark, tmp_path, rounds, fails)
    assert spark.read.parquet(paths[0]).count() == 3  # the first table has its files already
    assert seen(spark, paths) == [[1, 2], [1, 2]]
    two(spark, tmp_path, rounds)
    assert seen(spark, paths) == [[1, 2, 3], [1, 2, 3]]


def test_appends_have_one_batch_column_and_stamps(spark, tmp_path):
    stream = stream_of(spark, tmp_path / "in", [[(1, "a", 1)], [(2, "b", 1)]])
    sinks.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), run="r1").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.columns) == ["at", "batch", "k", "run", "v"] and sorted(r["batch"] for r in got.collect()) == [0, 1]
