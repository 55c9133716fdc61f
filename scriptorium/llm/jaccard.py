"""Exact n-gram Jaccard join in metric space.

Distance here is Jaccard distance, and RADIUS the largest distance of a link.

1. A bounded sample of the documents are pivots. Each set lies in the Voronoi cell of its nearest pivot, if that is within REACH, and
   else in the outer cell. By the triangle inequality, both ends of a link lie in the cell of either end's nearest pivot, if a set is
   also put into each cell whose pivot is within RADIUS of its nearest distance plus RADIUS, and within REACH + RADIUS; sets whose
   nearest pivot is farther than REACH - RADIUS also go into the outer cell.
2. Members of a cell within RADIUS of its pivot link to it. They are connected thereby, so they stay in the cell only if their
   distance is within RADIUS of that of the nearest member beyond; a cell without members beyond is done.
3. Cells of bounded weight are joined in one task, again around a pivot. A heavier cell gets several pivots of its own: members go to
   the nearest and into each further one within the window of 2 * RADIUS, and the parts join recursively. Where that splits nothing
   (all within reach of each other), members outside all balls meet all members in blocks, a pair of blocks to a task.
4. Documents that resemble no other are at distance near 1 from all pivots, so the outer cell holds most of them and new pivots would
   not divide it. Inside it, signatures tell apart what is compared: sizes are cut into bands, a band's hash space into more classes
   than linked sets can have differing elements, and sets that have a class's elements in common form a region. There are half as many
   classes again, and each set leaves out that many of its thinnest ones, so that common passages make few regions. A sketch, one byte for
   each of about twice as many classes, then tells which members could link to another of their region, as each differing element
   changes one class; the rest leave before any text moves. Regions are joined like cells, around the member of least name; regions of
   one band and pivot are one region.

Inside a task, a set meets those that have one of its rarest shingles: so many that a linked set cannot lack them all. Texts are
shuffled rather than shingles, as they are smaller. Links go on as spanning trees, so equal or near copies never make pairs. Sets and
shingles are named by 64-bit hashes; the chance that any two of n documents are confused is about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import shingles
from scriptorium.llm._common import SPACE_CHARS, drop, giving_back, join_hot, maybe_among, partitions, ship, stage, whole
from scriptorium.llm.components import components

WIDTH = 3
#: A link has 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Shingles of a region, with repetition, that one task takes.
WEIGHT = 1_500_000
PIVOTS, DEPTH = 8, 3
#: Rows that are described at a time.
SLICE = 1000
#: More than a set's size can have bands; a power of two.
BANDS = 128
#: First-level pivots: one for so many rows, so many at most, with texts of so many bytes and so many shingles together at most.
ROWS_A_CELL, CELLS, LONGEST, PIVOT_SHINGLES = 64, 1024, 16_384, 1 << 19
#: A set farther from all pivots lies in the outer cell. Pivots are farther than APART from each other, as far as a cell reaches when a
#: link has 80 of 100: those of one group, whose members may be far from each other too, would all get the whole group.
REACH, APART = 0.7, 0.9
#: Below this share of its parent's weight, a subregion counts as smaller.
SHRINKS = 0.7
U = np.uint64


def bands(percent: int) -> Iterator[tuple[int, int, int, int]]:
    """(first size, last size, last size with the window, classes) of each band, upwards."""
    low = 1
    while True:
        high = max(low, low * 8 // 5 - 1)
        window = high * 100 // percent
        # The size of a symmetric difference of linked sets is at most (a + b) (100 - percent) / (100 + percent).
        differing = (high + window) * (100 - percent) // (100 + percent)
        yield low, high, window, differing
        low = high + 1


@lru_cache(maxsize=4096)
def band_of(size: int, percent: int) -> tuple[int, int]:
    """The number of the band of a size, and of the lowest band in whose window it lies."""
    at = lowest = -1
    for k, (low, high, window, _) in enumerate(bands(percent)):
        if lowest < 0 and low <= size <= window:
            lowest = k
        if low <= size <= high:
            at = k
            break
    return at, lowest


@lru_cache(maxsize=256)
def classes(band: int, percent: int) -> tuple[int, np.ndarray]:
    """The number of classes that a set leaves out, and where the classes begin."""
    differing = next(d for k, (_, _, _, d) in enumerate(bands(percent)) if k == band)
    slack = 1 + differing // 2 if differing else 0
    n = differing + 1 + slack
    return slack, np.array([(j << 64) // n for j in range(n)], dtype=np.uint64)


def fragments(own: np.ndarray, percent: int) -> np.ndarray:
    """Names of the regions of a set, as signed 64-bit numbers that end in the number of their band.

    Linked sets agree in slack + 1 classes or more. A set leaves out the slack of its classes that have the fewest elements, ties by
    name. Of the classes that linked sets agree in, the last in this order has slack others before it in both, so both keep it; and no
    region gathers the sets that lack a class, or that have one shingle of a common passage there and nothing else.
    """
    out = []
    at, lowest = band_of(len(own), percent)
    upto = np.concatenate([[U(0)], np.cumsum(shingles.mix(own ^ U(0x5851F42D4C957F2D)))])
    for band in range(lowest, at + 1):
        slack, begins = classes(band, percent)
        first = np.searchsorted(own, begins)
        last = np.append(first[1:], len(own))
        sums = upto[last] - upto[first]
        number = np.arange(len(begins), dtype=np.uint64) + U(band << 32)
        named = shingles.mix(sums ^ shingles.mix(number * U(0x9E3779B97F4A7C15) + U(1))) & ~U(BANDS - 1) | U(band)
        out.append(named[np.lexsort((named, last - first))[slack:]])
    return np.concatenate(out).view(np.int64)


class Cells:
    """The Voronoi cells of pivot sets, with an index of the pivots' shingles."""

    def __init__(self, pivots: list[np.ndarray], percent: int, reach: float):
        self.percent, self.reach, self.radius = percent, reach, 1 - percent / 100
        self.sizes = np.array([len(p) for p in pivots], dtype=np.int64)
        self.nodes = [shingles.fingerprint(p) for p in pivots]
        flat = np.concatenate([np.zeros(0, dtype=np.uint64), *pivots])
        order = np.argsort(flat, kind="stable")
        self.shingles, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.owners = np.repeat(np.arange(len(pivots), dtype=np.int32), self.sizes)[order]

    def overlaps(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pivots that share shingles with a set, and how many."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.shingles):
            return none, none
        at = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1)
        at = at[self.shingles[at] == own]
        if not len(at):
            return none, none
        counts = self.count[at]
        ends = np.cumsum(counts)
        return np.unique(self.owners[np.arange(ends[-1]) + np.repeat(self.first[at] - (ends - counts), counts)], return_counts=True)

    def place(self, own: np.ndarray) -> tuple[list[tuple[int, float, bool]], bool]:
        """The cells of a set as (pivot's node, distance, whether it links), and whether it also lies in the outer cell."""
        some, shared = self.overlaps(own)
        if not len(some):
            return [], True
        union = len(own) + self.sizes[some] - shared
        far = 1 - shared / union
        nearest = far.min()
        inside = far <= min(self.reach, nearest + self.radius) + self.radius + 1e-9
        linked = 100 * shared >= self.percent * union
        return [(self.nodes[p], d, b) for p, d, b in zip(some[inside].tolist(), far[inside].tolist(), linked[inside].tolist(), strict=True)], bool(nearest > self.reach - self.radius - 1e-9)


def first_pivots(held: DataFrame, width: int) -> list[np.ndarray]:
    """The sets of a sample of texts, by a hash of the text, APART from each other.

    There are CELLS at most, of texts of LONGEST bytes at most and PIVOT_SHINGLES shingles together.
    """
    rows = held.count()
    n = min(CELLS, max(1, rows // ROWS_A_CELL))
    h = F.xxhash64("text", F.lit(1))
    least = -(2**63) + min(2**64 - 1, 2**64 // max(1, rows) * n * 2)
    some = held.where(F.col("text").isNotNull() & (F.octet_length("text") <= LONGEST) & (h <= F.lit(least))).select(h.alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [own.view(np.int64) for own in shingles.sets((t.encode() for t in batch.column(0).to_pylist()), width)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], names=["own"])

    found, total = [], 0
    for r in some.dropDuplicates(["h"]).orderBy("h").limit(n).select("text").mapInArrow(giving_back(run), "own array<long>").toArrow().column(0):
        own = np.array(r.as_py(), dtype=np.int64).view(np.uint64)
        if len(own) and total + len(own) <= PIVOT_SHINGLES:
            total += len(own)
            found.append(own)
    index, apart = Cells(found, 0, 0), np.zeros(len(found), dtype=bool)
    for i, own in enumerate(found):
        some, shared = index.overlaps(own)
        near = shared > (1 - APART) * (len(own) + index.sizes[some] - shared)
        apart[i] = not apart[some[near]].any()
    return [own for own, a in zip(found, apart.tolist(), strict=True) if a]


@lru_cache(maxsize=256)
def sketch_classes(band: int, percent: int) -> np.ndarray:
    differing = next(d for k, (_, _, _, d) in enumerate(bands(percent)) if k == band)
    return np.array([(j << 64) // (2 * differing + 1) for j in range(2 * differing + 1)], dtype=np.uint64)


def sketches(own: np.ndarray, percent: int) -> list[tuple[int, bytes]]:
    """(band, sketch) of a set for each of its bands: a byte for each class, which depends on the set's elements in the class alone."""
    at, lowest = band_of(len(own), percent)
    upto = np.concatenate([[U(0)], np.cumsum(shingles.mix(own ^ U(0x3C79AC492BA7B653)))])
    out = []
    for band in range(lowest, at + 1):
        first = np.searchsorted(own, sketch_classes(band, percent))
        sums = upto[np.append(first[1:], len(own))] - upto[first]
        out.append((band, shingles.mix(sums).astype(np.uint8).tobytes()))
    return out


def describe(df: DataFrame, width: int, percent: int, pivots: list[np.ndarray], reach: float = REACH) -> DataFrame:
    """id, k (hash of id and text), n, node (name of the set), cells, regions of the outer cell and sketches for each row of id, k, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voronoi = Cells(pivots, percent, reach)
        none = np.zeros(0, dtype=np.int64)
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            texts = batch.column(2).cast(pa.binary())
            n, node, cells, regions, own_sketches = [], [], [], [], []
            for own in shingles.sets((t.as_py() for t in texts), width):
                n.append(len(own))
                node.append(shingles.fingerprint(own) if len(own) else None)
                inside, outer = voronoi.place(own) if len(own) else ([], False)
                cells.append(inside)
                regions.append(fragments(own, percent) if outer else none)
                own_sketches.append(sketches(own, percent) if outer else [])

            def lists(held: list, flat: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)), flat)

            def structs(held: list, **kinds: pa.DataType) -> pa.Array:
                flat = [pa.array([x[i] for some in held for x in some], kind) for i, kind in enumerate(kinds.values())]
                return lists(held, pa.StructArray.from_arrays(flat, names=list(kinds)))

            columns = [structs(cells, cell=pa.int64(), far=pa.float64(), ball=pa.bool_()), lists(regions, pa.array(np.concatenate([none, *regions]))), structs(own_sketches, band=pa.int32(), sketch=pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), *columns], names=["id", "k", "n", "node", "cells", "regions", "sketches"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "k", "text").mapInArrow(giving_back(run), f"id {kind}, k long, n long, node long, cells array<struct<cell: long, far: double, ball: boolean>>, regions array<long>, sketches array<struct<band: int, sketch: binary>>")


class Region:
    """The sets of one region's texts, with the places of each shingle."""

    def __init__(self, nodes: list[int], texts: list[bytes], width: int, percent: int):
        self.nodes, self.percent = nodes, percent
        sets = list(shingles.sets(texts, width))
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        flat = np.concatenate(sets)
        del sets
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(nodes), dtype=np.int32), self.sizes)[order]
        flat = flat[order]
        edge = np.concatenate([[True], flat[1:] != flat[:-1]])
        del flat
        self.first = np.flatnonzero(edge)
        self.count = np.diff(np.append(self.first, len(edge)))
        self.numbers = np.empty(len(edge), dtype=np.int32)
        self.numbers[order] = np.cumsum(edge, dtype=np.int32) - 1
        self.mark = np.zeros(len(self.first), dtype=bool)
        self.root = list(range(len(nodes)))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def shared(self, i: int, prefix: bool = True) -> np.ndarray:
        """The number of shingles that each set has in common with set i; with prefix, 0 for some that cannot link to it.

        A linked set has at least PERCENT of set i's shingles, so it cannot lack all of its rarest ones, one more than the rest.
        """
        own = self.numbers[self.ends[i] - self.sizes[i] : self.ends[i]]
        counts = self.count[own]
        if prefix and counts.sum() > 4 * len(self.nodes):
            few = len(own) - -(-self.percent * len(own) // 100) + 1
            rare = np.argpartition(counts, few - 1)[:few] if few < len(own) else np.arange(len(own))
            some = np.unique(self.owners[self.places(own[rare], counts[rare])])
            if counts[rare].sum() + self.sizes[some].sum() < counts.sum():
                self.mark[own] = True
                out = np.zeros(len(self.nodes), dtype=np.int64)
                for j in some.tolist():
                    out[j] = self.mark[self.numbers[self.ends[j] - self.sizes[j] : self.ends[j]]].sum()
                self.mark[own] = False
                return out
        return np.bincount(self.owners[self.places(own, counts)], minlength=len(self.nodes))

    def places(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        ends = np.cumsum(counts)
        return np.arange(ends[-1]) + np.repeat(self.first[own] - (ends - counts), counts)

    def linked(self, i: int, shared: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * (self.sizes + self.sizes[i] - shared)

    def links(self, pivot: int, others: range | None = None) -> Iterator[tuple[int, int]]:
        """A spanning forest of all links; with others, only of those with a member of others."""

        def join(i: int, found: np.ndarray) -> Iterator[tuple[int, int]]:
            for j in np.flatnonzero(found).tolist():
                if (a := self.find(i)) != (b := self.find(j)):
                    self.root[a] = b
                    yield self.nodes[i], self.nodes[j]

        shared = self.shared(pivot, prefix=False)
        ball = self.linked(pivot, shared)
        yield from join(pivot, ball)
        # Two in the ball are connected through the pivot, so each further link has an end outside it. That end may lie beyond others;
        # the ball's members among others then ask for it, unless all beyond are in the ball too.
        asked = ~ball
        if others is not None:
            beyond = np.ones(len(ball), dtype=bool)
            beyond[others.start : others.stop] = False
            asked = ~beyond & (~ball | (beyond & ~ball).any())
        near = 1 - shared / (self.sizes + self.sizes[pivot] - shared)
        radius = 1 - self.percent / 100 + 1e-9
        for i in np.flatnonzero(asked).tolist():
            if i != pivot and (np.abs(near - near[i]) <= radius).sum() > 1:
                yield from join(i, self.linked(i, self.shared(i)))


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns, of batches that are sorted by them."""
    key, rows = None, []
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def by_region(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, "node")


def join_small(regions: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of regions that fit a task. regions: region, node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            own = {node: text for node, text in rows}
            if len(own) > 1:
                region = Region(list(own), [t.encode() for t in own.values()], width, percent)
                found = list(region.links(0))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return by_region(regions.select("region", "node", "text"), "region").mapInArrow(giving_back(run), "a long, b long")


def split(regions: DataFrame, width: int, percent: int, depth: int) -> DataFrame:
    """One row for each subregion of each member of regions (region, node, n, text, chunks): a link to the pivot as b if in its ball.

    Pivots are the PIVOTS members of a region with the least hashes. Each chunk of a region gets them all.
    """
    order = F.xxhash64("node", F.lit(depth))
    least = F.slice(F.sort_array(F.collect_list(F.struct(order.alias("h"), "node"))), 1, PIVOTS)
    some = regions.where(F.pmod(order, F.greatest(F.lit(1), F.expr(f"members div {64 * PIVOTS}"))) == 0)  # a bounded sample of each
    pivots = some.groupBy("region").agg(least.alias("own")).select("region", F.posexplode("own").alias("pivot", "own")).select("region", "pivot", F.col("own.node").alias("node"))
    held = regions.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    marked = held.join(pivots, ["region", "node"]).select("region", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), "pivot", "node", "n", "text")
    rows = marked.unionByName(held.select("region", "chunk", F.lit(PIVOTS).alias("pivot"), "node", "n", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (region, _), own in grouped(batches, 2):
            centres = [r for r in own if r[0] < PIVOTS]
            pivot_sets = list(shingles.sets([r[3].encode() for r in centres], width))
            out: list[tuple] = []
            members = [r for r in own if r[0] == PIVOTS]
            for (_, node, n, text), s in zip(members, shingles.sets([r[3].encode() for r in members], width), strict=True):
                shared = np.array([len(np.intersect1d(p, s, assume_unique=True)) for p in pivot_sets])
                union = np.array([len(p) for p in pivot_sets]) + len(s) - shared
                far = 1 - shared / union
                linked = 100 * shared >= percent * union
                for k in np.flatnonzero(far <= far.min() + 2 * (1 - percent / 100) + 1e-9).tolist():
                    out.append((region, centres[k][1], node, n, text, bool(linked[k])))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=["parent", "pivot", "node", "n", "text", "ball"])

    dealt = rows.repartition(partitions(regions.sparkSession), "region", "chunk").sortWithinPartitions("region", "chunk", "pivot", "node")
    return dealt.select("region", "chunk", "pivot", "node", "n", "text").mapInArrow(giving_back(run), "parent long, pivot long, node long, n long, text string, ball boolean")


def join_blocks(regions: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of dense regions (region, node, n, text, ball, chunks), all of whose ball members are connected already.

    Members outside the ball fill blocks that meet each other and the blocks of the ball, each pair of blocks in a task of its own.
    """
    held = regions.withColumn("block", F.pmod(F.xxhash64("node"), F.col("chunks")) + F.when(F.col("ball"), F.col("chunks")).otherwise(0))
    outside = held.where("not ball").select("region", "block").distinct().withColumnRenamed("block", "one")
    pairs = outside.join(held.select("region", F.col("block").alias("two")).distinct(), "region").where("one <= two")
    sides = pairs.select("region", "one", "two", F.explode(F.array("one", "two")).alias("block")).distinct()
    rows = held.join(sides, ["region", "block"]).select("region", "one", "two", "node", "block", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, one, _), own in grouped(batches, 3):
            own.sort(key=lambda r: (r[1] != one, r[0]))
            n = sum(r[1] == one for r in own)
            if n and len(own) > 1:
                region = Region([r[0] for r in own], [r[2].encode() for r in own], width, percent)
                found = list(region.links(0, range(n)))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return by_region(rows, "region", "one", "two").mapInArrow(giving_back(run), "a long, b long")


def join_split(regions: DataFrame, large: DataFrame, width: int, percent: int, weight: int) -> DataFrame:
    """Links (a, b) of regions (region, node, n, text) that are too heavy for a task; large: their region, heavy and members."""
    found = None
    for depth in range(DEPTH):
        rest = stage(regions.join(large, "region").withColumn("chunks", F.expr(f"heavy div {weight} + 1")))
        parts = stage(split(rest, width, percent, depth))
        links = parts.where("ball and node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        found = links if found is None else found.union(links)
        parts = parts.withColumn("region", F.xxhash64("parent", "pivot", F.lit(depth)))
        after = parts.groupBy("region", "parent").agg(F.sum("n").alias("heavy"), F.count("*").alias("members"))
        before = large.select(F.col("region").alias("parent"), F.col("heavy").alias("was"))
        stuck = (F.col("heavy") > SHRINKS * F.col("was")) | F.lit(depth == DEPTH - 1)
        kind = F.when(F.col("heavy") <= weight, "small").when(stuck, "dense").otherwise("large")
        sizes = stage(after.join(before, "parent").select("region", "heavy", "members", kind.alias("kind"), F.expr(f"heavy div {weight} + 1").alias("chunks")))
        parts = stage(parts.join(sizes.select("region", "kind", "chunks"), "region"))
        found = found.union(join_small(parts.where("kind = 'small'"), width, percent)).union(join_blocks(parts.where("kind = 'dense'"), width, percent))
        large = sizes.where("kind = 'large'").select("region", "heavy", "members")
        if large.isEmpty():
            break
        regions = parts.where("kind = 'large'").select("region", "node", "n", "text")
    return found


def cell_members(named: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members (region, band, node) of the inner cells, which have no band, that have to be joined, and links (a, b) of members to their pivots."""
    inside = stage(named.select("node", F.explode("cells").alias("c")).select("node", "c.*").distinct())
    outside = inside.groupBy("cell").agg(F.min(F.when(~F.col("ball"), F.col("far"))).alias("outside"))
    near = inside.join(F.broadcast(outside), "cell")  # one row for each of at most CELLS pivots
    needed = near.where(~F.col("ball") | (F.col("far") >= F.col("outside") - (1 - percent / 100) - 1e-9))
    return needed.select(F.xxhash64("cell", F.lit("cell")).alias("region"), F.lit(None).cast("int").alias("band"), "node"), inside.where("ball and node != cell").select(F.col("node").alias("a"), F.col("cell").alias("b"))


def region_members(named: DataFrame) -> DataFrame:
    """Members (region, band, node) of the outer cell's regions that have more than one.

    Signatures are counted first, copies and all; a bitmap of those that occur again lets the few others' rows through.
    """
    held = named.select("node", F.explode("regions").alias("fragment"))
    again = held.groupBy("fragment").agg(F.count("*").alias("rows")).where("rows > 1").select("fragment")
    some = stage(maybe_among(held, "fragment", again).where("maybe").select("fragment", "node").distinct())
    pivots = some.groupBy("fragment").agg(F.min("node").alias("region"), F.max("node").alias("most")).where("region < most").select("fragment", "region")
    band = F.pmod("fragment", F.lit(BANDS)).cast("int")
    members = stage(some.join(pivots, "fragment").select(F.xxhash64("region", band).alias("region"), band.alias("band"), "node").distinct())
    drop(some)
    return members


def with_partners(located: DataFrame, percent: int) -> DataFrame:
    """The members (region, node, k, n, sketch) that could link to another one of their region, by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (region,), rows in grouped(batches):
            sizes = np.array([r[2] for r in rows], dtype=np.int64)
            own = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
            stays = np.zeros(len(rows), dtype=bool)
            for i in range(len(rows) - 1):
                # Rows come by size, so those that are small enough to link follow directly.
                end = i + 1 + np.searchsorted(sizes[i + 1 :], sizes[i] * 100 // percent, side="right")
                asked = i + 1 + (np.flatnonzero(~stays[i + 1 : end]) if stays[i] else np.arange(end - i - 1))  # two that stay need no comparison
                if not len(asked):
                    continue
                differing = (sizes[i] + sizes[asked]) * (100 - percent) // (100 + percent)
                near = asked[(own[asked] != own[i]).sum(axis=1) <= differing]
                stays[near] = True
                stays[i] |= len(near) > 0
            kept = [r for r, s in zip(rows, stays.tolist(), strict=True) if s]
            yield pa.RecordBatch.from_arrays([pa.array([region] * len(kept), pa.int64()), *[pa.array([r[i] for r in kept], pa.int64()) for i in range(3)]], names=["region", "node", "k", "n"])

    dealt = located.repartition(partitions(located.sparkSession), "region").sortWithinPartitions("region", "n", "node")
    return dealt.select("region", "node", "k", "n", "sketch").mapInArrow(giving_back(run), "region long, node long, k long, n long")


def placed(df: DataFrame, id_column: str, text_column: str, width: int, percent: int, weight: int) -> tuple[DataFrame, DataFrame]:
    """id, k, n and node (null without shingles) of every row, where k is a hash of id and text; and node and component of linked nodes."""
    ship(df.sparkSession)
    held = keyed(df, id_column, text_column)
    described = stage(describe(held, width, percent, first_pivots(held, width)))
    rows = stage(described.select("id", "k", "n", "node"))
    named = described.where("node is not null")
    in_cells, to_pivots = cell_members(named, percent)
    members = stage(in_cells.union(region_members(named)))

    # One row stands for each set; its text follows only where regions are joined.
    standing = maybe_among(named.select("node", "k", "n", "sketches"), "node", members.select("node")).where("maybe").groupBy("node").agg(F.min(F.struct("k", "n", "sketches")).alias("one"))
    sketch = F.get(F.filter("one.sketches", lambda s: s["band"] == F.col("band")), F.lit(0))["sketch"]
    sketched = members.join(standing, "node").select("region", "node", "one.k", "one.n", sketch.alias("sketch"))
    located = stage(with_partners(sketched.where("sketch is not null"), percent).union(sketched.where("sketch is null").select("region", "node", "k", "n")))
    to_pivots = stage(to_pivots)
    drop(described, members)  # before texts are shuffled, which takes the most room
    large = stage(located.groupBy("region").agg(F.sum("n").alias("heavy"), F.count("*").alias("members")).where(f"heavy > {weight}"))

    def with_text(some: DataFrame) -> DataFrame:
        near = maybe_among(held.select("k", "text"), "k", some.select("k")).where("maybe and text is not null")
        # A row for each k meets a text, with the regions that it lies in: at most one for each class and cell. Repeated rows have one k.
        places = some.groupBy("k").agg(F.collect_set(F.struct("region", "node", "n")).alias("places"))
        joined = near.select("k", "text").join(places, "k").dropDuplicates(["k"])
        return joined.select("text", F.inline("places")).select("region", "node", "n", "text")

    if large.isEmpty():
        links = join_small(with_text(located), width, percent)
    else:
        links = join_small(with_text(located.join(large, "region", "left_anti")), width, percent)
        links = links.union(join_split(with_text(located.join(large.select("region"), "region", "left_semi")), large, width, percent, weight))
    links = stage(links.union(to_pivots))
    drop(to_pivots, located)
    found = stage(components(links))
    drop(links)
    return rows, found


def keyed(df: DataFrame, id_column: str, text_column: str, carry: bool = False) -> DataFrame:
    return df.alias("input").select(
        F.col(f"input.`{id_column}`").alias("id"),
        F.xxhash64(F.col(f"input.`{id_column}`"), whole(F.col(f"input.`{text_column}`"))).alias("k"),
        *([F.struct("input.*").alias("row")] if carry else [F.col(f"input.`{text_column}`").alias("text")]),
    )


def similar(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, percent: int = PERCENT, weight: int = WEIGHT) -> DataFrame:
    """id, n_shingles and component_id (the smallest id that a row reaches by links, its own included) for every row.

    A set holds the distinct shingles of width words of a text lower-cased in A to Z; a shorter text is one shingle. Null texts and
    those without words have no shingles and link with nothing: their component is their own id. Equal sets link. Rows with equal ids
    are told apart by their texts; a null id is larger than all others, so a component of null ids alone has a null name. An empty
    table gives an empty result.
    """
    rows, component = placed(df, id_column, text_column, width, percent, weight)
    named = rows.where("node is not null")
    nodes = stage(named.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("rows")).join(component, "node", "left"))
    linked = nodes.where("component is not null")
    least = stage(linked.groupBy("component").agg(F.min("least").alias("reached"), F.count("*").alias("nodes")))
    reached = join_hot(linked.select("component", "node", "rows"), least, "component", "nodes").select("node", "rows", "reached")
    alone = nodes.where("component is null").select("node", "rows", F.col("least").alias("reached"))
    found = join_hot(named, stage(reached.union(alone)), "node", "rows").select("id", "n", "reached")
    every = found.union(rows.where("node is null").select("id", "n", F.col("id").alias("reached")))
    return every.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("reached").alias("component_id"))


def dedupe(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, percent: int = PERCENT, weight: int = WEIGHT) -> DataFrame:
    """df with one row of each component: that of the smallest id, null ids last. Rows without shingles all stay.

    Of rows with equal ids and texts one stays, whatever their other columns. Sets, links and an empty table are as in similar().
    """
    rows, component = placed(df, id_column, text_column, width, percent, weight)
    named = rows.where("node is not null")
    best = F.min(F.struct(F.col("id").isNull(), "id", "k"))
    nodes = stage(named.groupBy("node").agg(best.alias("best"), F.count("*").alias("rows")).join(component, "node", "left"))
    first = nodes.groupBy(F.coalesce("component", "node")).agg(F.min("best").alias("best"))
    stay = stage(first.select("best.k"))
    # Most rows are alone in their component and stay where they are; only those that may have company are shuffled.
    company = maybe_among(named.select("node", "k"), "node", nodes.where("rows > 1 or component is not null").select("node")).where("maybe")
    marked = maybe_among(keyed(df, id_column, text_column, carry=True), "k", company.select("k"))
    asked = F.col("maybe") & (F.btrim(whole(F.col(f"row.`{text_column}`")), F.lit(SPACE_CHARS)) != "")
    kept = marked.where(asked).select("k", "row").dropDuplicates(["k"]).join(stay, "k", "left_semi")
    return marked.where(~asked).select("row.*").unionByName(kept.select("row.*"))
