"""The bitmap filter lets every key through and few others."""

from pyspark.sql import functions as F

from scriptorium.llm._common import maybe_among


def test_maybe_among(spark):
    rows = spark.range(4000).select("id", F.xxhash64("id").alias("k"))
    found = maybe_among(rows, "k", rows.where("id % 5 = 0").select("k"))
    assert found.columns == ["id", "k", "maybe"]
    assert found.where("id % 5 = 0 and not maybe").count() == 0
    assert found.where("id % 5 <> 0 and maybe").count() <= 5
    assert found.count() == 4000


def test_no_keys(spark):
    rows = spark.range(10).select(F.xxhash64("id").alias("k"))
    assert maybe_among(rows, "k", rows.limit(0)).where("maybe").count() == 0
    assert maybe_among(rows.limit(0), "k", rows).count() == 0
