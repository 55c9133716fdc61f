import numpy as np

from scriptorium.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 as id", "2 as x", "3 as shard", "4 as block")
    return sorted(tuple(r) for r in topk.top_k(df, **options).collect())


def test_equals_brute_force_with_ties(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(-2, 3, 6).astype(float).tolist()) for i in range(400)]
    assert found(spark, rows, every=20, shard=64) == brute(rows, 20, 5)


def test_clustered_vectors_in_many_shards(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(5, 16))
    rows = [(i, (centres[i % 5] + 0.1 * r.normal(size=16)).tolist()) for i in range(500)]
    assert found(spark, rows, every=50, shard=90) == brute(rows, 50, 5)


def test_queries_go_to_the_shards_that_could_hold_better(spark):
    r = np.random.default_rng(4)
    centres = 20 * r.normal(size=(8, 6))
    x = [np.floor(256 * (centres[i % 8] + 0.2 * r.normal(size=6))).tolist() for i in range(1600)]
    held = spark.createDataFrame([(i, 6, v) for i, v in enumerate(x)], "id long, dims int, x array<double>")
    points = topk.placed(held, {6: 1600}, shard=200).selectExpr("*", "0 as part")
    shards = [tuple(b) for b in topk.boxes(points).collect()]
    assert len(shards) == 8 and points.groupBy("leaf").count().selectExpr("max(count)").first()[0] <= 600
    asked = held.where("id % 50 = 0").selectExpr("*", "cast(null as long) as floor")
    assert topk.routed(asked, shards, first=True).count() == 32
    best = topk.search(points, topk.routed(asked, shards, first=True), 5)
    floors = best.groupBy("query_id").agg({"score": "min"}).toDF("id", "floor")
    sent = topk.routed(asked.drop("floor").join(floors, "id"), shards, first=False).count()
    assert sent < 32 * 2  # of 32 * 7
    assert topk.routed(asked, shards, first=False).count() == 32 * 7


def test_many_queries_of_a_shard_fill_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 10)
    monkeypatch.setattr(topk, "BLOCK", 4)
    r = np.random.default_rng(5)
    rows = [(i, r.integers(-9, 9, 3).astype(float).tolist()) for i in range(300)] + [(1000 + i, [1.0, 1.0, 1.0]) for i in range(200)]
    assert found(spark, rows, every=5, shard=40) == brute(rows, 5, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, float("nan")]), (100, [1.0, float("inf")]), (150, None), (200, [1.0, None]), (250, []), (300, []), (1, [2.0, 2.0]), (2, [-1.0, 0.0]), (3, [1.0]), (None, [1.0, 1.0])]
    assert found(spark, rows, every=50) == brute(rows, 50, 5)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e6 + i, 3e5]) for i in range(0, 60)]
    assert found(spark, rows, every=50) == brute(rows, 50, 5)


def test_tree_prunes():
    r = np.random.default_rng(3)
    points = np.floor(r.normal(size=(4000, 3)) * 256)
    tree = topk.Tree(np.arange(4000), points, leaf=16)
    visited = []
    products = topk.products
    topk.products = lambda a, b: visited.append(len(b)) or products(a, b)
    try:
        got = tree.search(points[:1], np.array([0]), 5, np.array([-np.inf]))
    finally:
        topk.products = products
    scores = points @ points[0]
    assert [-s for s, _ in got[0]] == sorted(np.delete(scores, 0), reverse=True)[:5] and sum(visited) < 1000


def test_empty_table(spark):
    assert found(spark, []) == []
