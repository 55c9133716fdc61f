import zlib

from scriptorium.llm import sharding
from tests.llm.helpers import ODD, SCHEMA, documents


def rows(df, **options):
    return sharding.assign_shards(df, **options).collect()


def test_contiguous_balanced_and_gapless(spark):
    df = documents(spark, [f"{i} " * (i % 37) for i in range(800)])
    got = sorted(rows(df, n_shards=7), key=lambda r: r["doc_id"])
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    sizes = {s: sum(r["size"] for r in got if r["shard"] == s) for s in range(7)}
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_equals_one_pass_over_sorted_rows(spark):
    texts = [f"text {i % 11} " * (i % 5) for i in range(300)]
    total, so_far, want = sum(len(t) + 16 for t in texts), 0, []
    for t in texts:
        want.append(min(int((so_far + (len(t) + 16) / 2) / total * 5), 4))
        so_far += len(t) + 16
    assert [r["shard"] for r in sorted(rows(documents(spark, texts), n_shards=5), key=lambda r: r["doc_id"])] == want


def test_odd_rows(spark):
    got = sorted(rows(documents(spark, ODD, extra=True), n_shards=3), key=lambda r: r["doc_id"])
    assert [r["size"] for r in got] == [len((t or "").encode()) + 16 for t in ODD]
    assert [r["text_crc32"] for r in got] == [zlib.crc32((t or "").encode()) for t in ODD]
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_repeated_and_null_ids_get_their_own_slots(spark):
    got = rows(documents(spark, [(None, "a"), (None, "a"), (5, "b"), (5, "b"), (5, "c")]), n_shards=2)
    assert len({(r["shard"], r["slot"]) for r in got}) == 5


def test_empty_table(spark):
    assert rows(spark.createDataFrame([], SCHEMA)) == []


def test_files_hold_every_row(spark, tmp_path):
    df = documents(spark, [f"t{i}" * i for i in range(50)], extra=False)
    sharding.write_shards(df, str(tmp_path / "out"), n_shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(50)) and back.select("shard").distinct().count() == 4
