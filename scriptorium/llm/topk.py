"""Exact top-k search by inner product with a KD-tree for each shard.

Median splits of a bounded sample cut space into cells, and each cell's vectors are a shard with a tight box (very full cells have
several). A query first searches the shard whose box promises most; the k-th score found there is propagated, and only the shards whose
boxes could hold better go on to be searched. A task builds its shard's tree once, by median splits on the widest component, keeps the
tight box of each node and takes the queries as a stream: for each query the tree is walked best bound first, where a bound is the
largest inner product that a point of the box could have, until no open node can reach the query's k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import partitions, ship, stage

SHARD, BLOCK, LEAF = 4096, 1024, 64
#: Cells of one length of vectors at most, sampled vectors for each of them, and queries that one copy of a shard takes.
MOST_LEAVES, SAMPLE, QUERIES = 2048, 8, 65_536
K = 5
#: Sums of products below this are exact in double precision.
EXACT = 2.0**53


class Tree:
    """A KD-tree over whole-number vectors; rows of a leaf are ordered by id."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        self.ids, self.points = ids, points
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        self.build(np.arange(len(ids)), leaf)
        self.low_matrix, self.high_matrix = np.array(self.low), np.array(self.high)

    def build(self, rows: np.ndarray, leaf: int) -> int:
        own = self.points[rows]
        at = len(self.low)
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.children.append(None)
        self.rows.append(None)
        spread = self.high[at] - self.low[at]
        if len(rows) <= leaf or not len(spread) or spread.max() == 0:
            self.rows[at] = rows
            return at
        half = len(rows) // 2
        order = np.argpartition(own[:, spread.argmax()], half)
        self.children[at] = (self.build(rows[order[:half]], leaf), self.build(rows[order[half:]], leaf))
        return at

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query its best (-score, id) in order, without its own id; scores below floor are left out."""
        bounds = corner_bounds(queries, self.low_matrix, self.high_matrix)
        out: list[list[tuple[int, int]]] = [[] for _ in queries]
        kth = floor.astype(np.float64).copy()
        open_nodes: list[list[int]] = [[0] for _ in queries]
        active = np.arange(len(queries))
        while len(active):
            # Each active query opens its best node; queries that open the same leaf share a product.
            leaves: dict[int, list[int]] = {}
            still = []
            for q in active.tolist():
                own, bound = open_nodes[q], bounds[q]
                while own:
                    best = max(own, key=bound.__getitem__)
                    if bound[best] < kth[q]:
                        own.clear()
                        break
                    own.remove(best)
                    if self.children[best] is None:
                        leaves.setdefault(best, []).append(q)
                        still.append(q)
                        break
                    own.extend(self.children[best])
            for leaf, some in leaves.items():
                rows = self.rows[leaf]
                scores = products(queries[some], self.points[rows])
                for q, line in zip(some, scores, strict=True):
                    near = np.flatnonzero((line >= kth[q]) & (self.ids[rows] != query_ids[q]))
                    if len(near):
                        found = sorted([*out[q], *((-int(line[i]), int(self.ids[rows[i]])) for i in near)])[:k]
                        out[q] = found
                        if len(found) == k:
                            kth[q] = max(kth[q], -found[-1][0])
            active = np.array(still, dtype=np.int64)
        return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return a @ b.T
    exact = np.array([[int(x) for x in r] for r in a], dtype=object) @ np.array([[int(x) for x in r] for r in b], dtype=object).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1)


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(df: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """id, dims and x (doubles that are whole numbers) of the rows whose vectors take part."""
    vector = F.col(f"input.`{vector_column}`")
    good = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    held = df.alias("input").where(F.col(f"input.`{id_column}`").isNotNull() & good)
    return held.select(F.col(f"input.`{id_column}`").cast("long").alias("id"), F.size(vector).alias("dims"), whole_numbers(vector, scale).alias("x"))


class Cells:
    """Median splits of a sample of vectors of one length; every vector falls into one leaf."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.at, self.below, self.above = [], [], [], []
        self.leaves = 0
        self.build(sample, leaves)
        self.arrays = [np.array(a) for a in (self.axis, self.at, self.below, self.above)]

    def build(self, own: np.ndarray, leaves: int) -> int:
        """The number of a split, or minus one minus that of a leaf."""
        spread = own.max(axis=0) - own.min(axis=0) if len(own) and own.shape[1] else np.zeros(0)
        if leaves < 2 or len(own) < 2 or not len(spread) or spread.max() == 0:
            self.leaves += 1
            return -self.leaves
        axis = int(spread.argmax())
        middle = np.median(own[:, axis])
        under = own[:, axis] < middle
        if not under.any():
            middle, under = middle + 0.5, own[:, axis] <= middle
        here = len(self.axis)
        for a, v in zip((self.axis, self.at, self.below, self.above), (axis, middle, 0, 0), strict=True):
            a.append(v)
        self.below[here] = self.build(own[under], leaves // 2)
        self.above[here] = self.build(own[~under], leaves - leaves // 2)
        return here

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        axis, at, below, above = self.arrays
        now = np.full(len(x), 0 if len(axis) else -1)
        while (open_ := now >= 0).any():
            n = now[open_]
            now[open_] = np.where(x[open_, axis[n]] < at[n], below[n], above[n])
        return -1 - now


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // max(1, rows))


def by_length(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches cut into rows of one length of vectors, which stands in column at."""
    for batch in batches:
        dims = batch.column(at).to_numpy()
        for d in np.unique(dims).tolist():
            yield d, batch.filter(pa.array(dims == d))


def placed(held: DataFrame, sizes: dict[int, int], shard: int = SHARD) -> DataFrame:
    """held (id, dims, x) with leaf: the cell of its length's median splits, which a bounded sample decides.

    sizes: the rows of each length. A length has MOST_LEAVES cells at most, and all of them SAMPLE sampled vectors a cell.
    """
    leaves = {d: min(MOST_LEAVES, -(-n // shard)) for d, n in sizes.items()}
    split = [d for d, n in leaves.items() if n > 1]
    cells = {d: Cells(np.zeros((0, d)), 1) for d in leaves}
    for d in split:
        share = min(1.0, 2 * SAMPLE * leaves[d] / sizes[d])
        h = F.xxhash64("id", "x", F.lit(2))
        some = held.where((F.col("dims") == d) & (F.pmod(h, F.lit(1 << 20)) < max(1, int(share * (1 << 20))))).orderBy(h).limit(SAMPLE * leaves[d]).select("x").toArrow().column(0).combine_chunks()
        cells[d] = Cells(matrix(some, len(some)), leaves[d])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, rows in by_length(batches, 1):
            leaf = cells[d].leaf_of(matrix(rows.column(2), rows.num_rows))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(leaf, pa.int32())], names=["id", "dims", "x", "leaf"])

    return held.mapInArrow(run, "id long, dims int, x array<double>, leaf int")


def boxes(points: DataFrame) -> DataFrame:
    """The tight box of each leaf: dims, leaf, part, low, high. A leaf with more rows than a shard holds has parts, each with its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for d, rows in by_length(batches, 0):
            x, leaf, part = matrix(rows.column(3), rows.num_rows), rows.column(1).to_numpy(), rows.column(2).to_numpy()
            for key in {*zip(leaf.tolist(), part.tolist(), strict=True)}:
                own = x[(leaf == key[0]) & (part == key[1])]
                low, high = own.min(axis=0), own.max(axis=0)
                if (d, *key) in found:
                    low, high = np.minimum(low, found[d, *key][0]), np.maximum(high, found[d, *key][1])
                found[d, *key] = (low, high)
        keys, sides = list(found), [[v[i].tolist() for v in found.values()] for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], pa.int32()) for i in range(3)], *[pa.array(s, pa.list_(pa.float64())) for s in sides]], names=["dims", "leaf", "part", "low", "high"])

    keys = ["dims", "leaf", "part"]
    return points.select(*keys, "x").repartition(partitions(points.sparkSession), *keys).mapInArrow(run, "dims int, leaf int, part int, low array<double>, high array<double>")


def corner_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product that a point of each box could have with each query: that of its best corner."""
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    return bounds + (np.abs(bounds) * 1e-9 if np.abs(bounds).max(initial=0) >= EXACT else 0)


def routed(queries: DataFrame, held: list[tuple], first: bool) -> DataFrame:
    """queries (id, dims, x, floor) once for each shard to search, with its leaf and part: the most promising one, or the others.

    The others are those whose bound reaches the query's floor, all of them if it has none. held: boxes() rows, one for each shard.
    """
    of: dict = {}
    for d, leaf, part, low, high in held:
        of.setdefault(d, []).append((leaf, part, low, high))
    table = {d: (np.array([r[:2] for r in rows], dtype=np.int32), *(np.array([r[i] for r in rows], dtype=np.float64) for i in (2, 3))) for d, rows in of.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, many in by_length(batches, 1):
            keys, low, high = table[d]
            for begin in range(0, many.num_rows, BLOCK):
                rows = many.slice(begin, BLOCK)
                bounds = corner_bounds(matrix(rows.column(2), rows.num_rows), low.reshape(len(keys), -1), high.reshape(len(keys), -1))
                best = bounds.argmax(axis=1)
                wanted = np.zeros(bounds.shape, dtype=bool)
                if not first:
                    floor = rows.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                    wanted = bounds >= np.where(np.isnan(floor), -np.inf, floor)[:, None]
                wanted[np.arange(len(best)), best] = first
                q, s = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([*rows.take(pa.array(q)).columns, pa.array(keys[s, 0]), pa.array(keys[s, 1])], names=["id", "dims", "x", "floor", "leaf", "part"])

    return queries.select("id", "dims", "x", "floor").mapInArrow(run, "id long, dims int, x array<double>, floor long, leaf int, part int")


def search(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k of each query in each shard that it is sent to. A shard with very many queries is copied for blocks of them."""
    keys = ["dims", "leaf", "part", "block"]
    asked = stage(queries)
    blocks = asked.groupBy("dims", "leaf", "part").agg(F.expr(f"cast((count(*) - 1) div {QUERIES} + 1 as int)").alias("blocks"))  # one row for each shard
    asked = asked.join(F.broadcast(blocks), ["dims", "leaf", "part"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    copies = points.join(F.broadcast(blocks), ["dims", "leaf", "part"]).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for batch in batches:
            marks = list(zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True))
            start = 0
            for i in range(1, len(marks) + 1):
                if i < len(marks) and marks[i] == marks[start]:
                    continue
                own, now, asks = batch.slice(start, i - start), marks[start][:4], marks[start][4]
                start = i
                if now != key:
                    key, held, tree = now, [], None
                if not asks:
                    held.append(own)  # the points of a shard come before its queries
                elif held or tree:
                    if tree is None:
                        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        order = np.argsort(rows.column(5).to_numpy(), kind="stable")
                        tree, held = Tree(rows.column(5).to_numpy()[order], matrix(rows.column(6), rows.num_rows)[order]), []
                    for begin in range(0, own.num_rows, BLOCK):
                        yield from answer(tree, own.slice(begin, BLOCK))

    def answer(tree: Tree, own: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = own.column(5).to_numpy()
        floor = own.column(7).to_numpy(zero_copy_only=False).astype(np.float64)
        found = tree.search(matrix(own.column(6), own.num_rows), ids, k, np.where(np.isnan(floor), -np.inf, floor))
        out = [(q, i, -s) for q, best in zip(ids.tolist(), found, strict=True) for s, i in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["query_id", "id", "score"])

    both = copies.select(*keys, F.lit(False).alias("asks"), "id", "x", F.lit(None).cast("long").alias("floor")).unionByName(asked.select(*keys, F.lit(True).alias("asks"), "id", "x", "floor"))
    return both.repartition(partitions(points.sparkSession), *keys).sortWithinPartitions(*keys, "asks").mapInArrow(run, "query_id long, id long, score long")


def top_k(df: DataFrame, every: int = 50, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256, shard: int = SHARD) -> DataFrame:
    """query_id, rank, id and score of the k best rows for every query: the rows whose id is divisible by every.

    Components become floor(scale * x); the score is the inner product, and ties go to the smaller id. A query meets all rows of its
    number of components but those of its own id. Rows with a null id, a null vector or a null or non-finite component take no part.
    Rows with equal ids each count as a candidate; of queries with equal ids one counts, that with the least vector. A table without
    queries or candidates gives an empty result. Sums beyond the range of long stay at its ends. Vectors have few different lengths:
    counts for each of them, and a box for each shard (MOST_LEAVES cells of a length, with a part for each two shards' rows), pass
    through the driver.
    """
    ship(df.sparkSession)
    held = stage(usable(df, id_column, vector_column, scale))
    sizes = {r["dims"]: r["n"] for r in held.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("asked")).where("asked > 0").collect()}
    known = stage(placed(held.where(F.col("dims").isin(*sizes)), sizes, shard))
    parts = known.groupBy("dims", "leaf").agg(F.expr(f"cast((count(*) - 1) div {2 * shard} + 1 as int)").alias("parts"))
    points = known.join(F.broadcast(parts), ["dims", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "x"), F.col("parts")).cast("int"))  # one row for each leaf
    shards = [tuple(r) for r in boxes(points).collect()]
    asked = held.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("dims", "x")).alias("q")).select("id", "q.*")
    best = stage(search(points, routed(asked.withColumn("floor", F.lit(None).cast("long")), shards, first=True), k))
    floors = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    rest = asked.join(floors, asked["id"] == floors["query_id"], "left")
    found = best.union(search(points, routed(rest, shards, first=False), k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_column), "score")
