"""Collocations: phrases of two to five words that occur often and far more often than their parts suggest.

Phrases are found length by length. A pass over the texts counts phrases of one length exactly and, into hashed buckets, those of the next
length. A phrase is counted only if its bucket reached the least count in the pass before and if both phrases that it holds, one word
shorter, may be frequent; bitmaps of buckets and of frequent phrases, of one size for any input, tell that. From the second pass on, a
pass also writes the runs of words that longer phrases may come from, and the next one reads those instead of the texts. Hashes only
prune: what they let through is counted by its words. Bucket counts stop at the least count, so that a task passes on a byte a bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import drop, giving_back, ship, stage
from scriptorium.llm.shingles import U, mix

LONGEST, LEAST, MOST = 5, 100, 2000
#: Buckets are 2^BITS, told by the first bits of a hash; a bitmap has 2 MB. CELL buckets go into one row.
BITS, CELL = 24, 32768
#: Bytes of text whose words are held at once.
WINDOW = 4_000_000
#: First numbers into which bucket counts are merged for each cell before they meet.
FAN = 16
#: Every end of a piece is a full stop, every blank a space, letters are in lower case.
TABLE = bytes(ord(".") if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Totals of up to so many languages are broadcast; more are joined by shuffling.
BROADCAST_LANGUAGES = 10_000
PASS = "lang string, phrase string, hash long, n long, cell int, counts binary, text binary, carried int"
KINDS = {"phrase": pa.string(), "hash": pa.int64(), "n": pa.int64(), "cell": pa.int32(), "counts": pa.binary(), "text": pa.binary(), "carried": pa.int32()}


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> U(64 - BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def parts(raw: bytes) -> Iterator[tuple[bytes, bool]]:
    """A text in parts of about WINDOW bytes, cut at a blank or the end of a piece, and whether a piece goes on in the next part."""
    start = 0
    while start < len(raw):
        cut = re.compile(rb"[ .]").search(raw, start + WINDOW)
        end = cut.start() if cut else len(raw)
        yield raw[start:end], bool(cut) and cut[0] == b" "
        start = end


class Pass:
    """Counts phrases of one length exactly, and those of the next length by bucket."""

    def __init__(self, length: int, longest: int, least: int, allowed: np.ndarray | None, known: np.ndarray | None):
        self.length, self.least, self.allowed, self.known = length, least, allowed, known
        self.buckets = np.zeros(1 << BITS, dtype=np.min_scalar_type(least)) if length < longest else None

    def count(self, lang: str, words: list[bytes], carried: int) -> Iterator[pa.RecordBatch]:
        """Phrases that end behind the first carried words, which a part before this one has counted; and the words that the next length needs."""
        k, n = self.length, len(words)
        if n < k:
            return
        index = dict(zip(dict.fromkeys(words), range(n), strict=False))
        names = list(index)
        ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        of_name = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in names), np.uint64, len(names))
        own, hashes, shorter = of_name[ids], mix(of_name)[ids], None
        place = np.arange(n)
        ends = np.where(ids == index.get(b".", -1), place, n)
        left = np.minimum.accumulate(ends[::-1])[::-1] - place  # words from here to the end of the piece
        for j in range(1, k):
            shorter, hashes = hashes, mix(hashes[:-1] * U(0xD1342543DE82EF95) + own[j:])
        may = left[: n - k + 1] >= k
        if k > 1:
            may &= has(self.allowed, hashes) & has(self.known, shorter[:-1]) & has(self.known, shorter[1:])
        if self.buckets is not None and n > k:
            both = may[:-1] & may[1:] & (left[: n - k] > k)
            at = np.flatnonzero(both & (place[: n - k] + k >= carried))
            bucket, times = np.unique(mix(hashes[at] * U(0xD1342543DE82EF95) + own[at + k]) >> U(64 - BITS), return_counts=True)
            bucket = bucket.astype(np.int64)
            self.buckets[bucket] = np.minimum(self.buckets[bucket] + times, self.least)
            if k > 1:
                yield from self.trimmed(lang, words, both, carried)
        at = np.flatnonzero(may & (place[: n - k + 1] + k - 1 >= carried))
        if not len(at):
            return
        key = ids[at]
        for j in range(1, k):
            key = np.unique(key, return_inverse=True)[1] * len(names) + ids[at + j]
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        first = at[first]
        phrases = map(b" ".join, zip(*(map(names.__getitem__, ids[first + j].tolist()) for j in range(k)), strict=True))
        yield record(len(first), lang=lang, phrase=pa.array(phrases, pa.binary()).cast(pa.string()), hash=pa.array(hashes[first].view(np.int64)), n=pa.array(times))

    def trimmed(self, lang: str, words: list[bytes], both: np.ndarray, carried: int) -> Iterator[pa.RecordBatch]:
        """The runs of words of which phrases longer by one word may be frequent; other words need not be read again."""
        edge = np.diff(np.concatenate([[0], both.astype(np.int8), [0]]))
        out: list[bytes] = []
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + self.length).tolist(), strict=True):
            if a >= carried:
                out += words[a:b]
                out.append(b".")
            elif b > carried:
                yield record(1, lang=lang, text=pa.array([b" ".join(words[a:b])]), carried=pa.array([carried - a], pa.int32()))
        if out:
            yield record(1, lang=lang, text=pa.array([b" ".join(out)]), carried=pa.array([0], pa.int32()))

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text, carried in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.translate(TABLE)
                if carried:
                    yield from self.count(lang, raw.split(), carried)
                elif len(raw) > WINDOW:
                    yield from self.long(lang, raw)
                else:
                    held.setdefault(lang, []).append(raw)
                    size += len(raw)
                if size > WINDOW:
                    yield from self.short(held)
                    held, size = {}, 0
        yield from self.short(held)
        if self.buckets is not None:
            for i in range(0, 1 << BITS, CELL):
                if self.buckets[i : i + CELL].any():
                    yield record(1, cell=pa.array([i // CELL], pa.int32()), counts=pa.array([self.buckets[i : i + CELL].tobytes()]))

    def short(self, held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            yield from self.count(lang, b".".join(texts).replace(b".", b" . ").split(), 0)

    def long(self, lang: str, raw: bytes) -> Iterator[pa.RecordBatch]:
        before: list[bytes] = []
        for part, goes_on in parts(raw):
            words = before + part.replace(b".", b" . ").split()
            yield from self.count(lang, words, len(before))
            before = words[-LONGEST:] if goes_on else []


def record(rows: int, lang: str | None = None, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of PASS, with nulls where nothing is given."""
    lang = pa.nulls(rows, pa.string()) if lang is None else pa.array([lang] * rows)
    return pa.record_batch([lang, *(columns.get(c, pa.nulls(rows, k)) for c, k in KINDS.items())], names=["lang", *KINDS])


def merged(cells: DataFrame, least: int) -> DataFrame:
    """One row for each cell, whose counts are sums that stop at least: first in FAN parts for each cell, then all."""
    kind = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        row = lambda: pa.record_batch([pa.array([now], pa.int32()), pa.array([total.astype(kind).tobytes()], pa.binary())], names=["cell", "counts"])
        for batch in batches:
            for cell, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(counts, dtype=kind)
                if cell == now:
                    total = np.minimum(total + own, least)
                    continue
                if now is not None:
                    yield row()
                now, total = cell, own.astype(np.int64)
        if now is not None:
            yield row()

    once = lambda df, *keys: df.repartition("cell", *keys).sortWithinPartitions("cell").select("cell", "counts").mapInArrow(giving_back(run), "cell int, counts binary")
    fan = F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("fan")
    return once(once(cells.select("cell", "counts", fan), "fan"))


def bucket_bits(cells: DataFrame, least: int) -> np.ndarray:
    """The bitmap of buckets that reached least; 2^BITS bits whatever the input."""
    kind = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [np.packbits(np.frombuffer(c, dtype=kind) >= least, bitorder="little").tobytes() for c in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(full, pa.binary())], names=["cell", "bits"])

    return assembled(merged(cells, least).mapInArrow(run, "cell int, bits binary"))


def phrase_bits(found: DataFrame) -> np.ndarray:
    """The bitmap of the hashes of frequent phrases."""
    at = F.shiftrightunsigned("hash", 64 - BITS)
    held = found.select((F.shiftright(at, 15)).cast("int").alias("cell"), at.bitwiseAND(F.lit(CELL - 1)).alias("at"))
    return assembled(held.groupBy("cell").agg(F.bitmap_construct_agg("at").alias("bits")))


def assembled(cells: DataFrame) -> np.ndarray:
    bits = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    for cell, own in cells.collect():  # at most 2^BITS / CELL rows of CELL / 8 bytes
        bits[cell * CELL // 8 : (cell + 1) * CELL // 8] = np.frombuffer(own, dtype=np.uint8)
    return bits


def frequent(df: DataFrame, text_column: str = "text", lang_column: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, length, n for every phrase of up to longest words with n >= least occurrences; and lang, n of all words.

    longest is LONGEST at most, which parts of a long text share.

    Nulls, repeated rows and empty tables as in collocations().
    """
    if longest > LONGEST:
        raise ValueError(f"phrases have {LONGEST} words at most")
    spark = df.sparkSession
    ship(spark)
    held = df.select(F.coalesce(F.col(f"`{lang_column}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary").alias("text"), F.lit(0).alias("carried"))
    levels, before, totals, allowed, known = [], [], None, None, None
    for length in range(1, longest + 1):
        bitmaps = None if length == 1 else spark.sparkContext.broadcast((allowed, known))

        def run(batches: Iterator[pa.RecordBatch], length: int = length, bitmaps=bitmaps) -> Iterator[pa.RecordBatch]:
            yield from Pass(length, longest, least, *(bitmaps.value if bitmaps else (None, None))).run(batches)

        seen = stage(held.mapInArrow(giving_back(run), PASS))
        counted = seen.where("phrase is not null")
        sums = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.first("hash").alias("hash")).where(F.col("n") >= least)
        levels.append(stage(sums.withColumn("length", F.lit(length))))
        if length == 1:
            totals = stage(counted.groupBy("lang").agg(F.sum("n").alias("n")))
        if length < longest:
            allowed, known = bucket_bits(seen.where("cell is not null"), least), phrase_bits(levels[-1])
        drop(*before)
        before = [seen]
        if length > 1:
            held = seen.where("text is not null").select("lang", "text", "carried")
    drop(*before)
    return reduce(DataFrame.union, levels).select("lang", "phrase", "length", "n"), totals


def collocations(df: DataFrame, text_column: str = "text", lang_column: str = "lang", longest: int = LONGEST, least: int = LEAST, most: int = MOST, cover: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of 2 to longest words by score.

    a, l and r are occurrences of the phrase and of the two parts at the cut that gives the lowest floor(1000 * a * n / (l * r)), the
    earliest of equal ones; n counts all words. A phrase inside a longer one with at least cover of 100 of its occurrences goes. As a
    phrase inside another occurs at least as often, only phrases longer by one word need to be looked at.

    Null texts are empty, a null language is und, repeated rows count each time, further columns of any name do nothing; a language
    without frequent phrases has no rows, as has an empty table. Texts of any length are counted whole, in parts.
    """
    found, totals = frequent(df, text_column, lang_column, longest, least)
    words = found.where("length > 1").withColumn("w", F.split("phrase", " "))
    join = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    shorter = words.where("length > 2").select("lang", F.col("n").alias("longer"), F.explode(F.array(join(F.lit(1), F.col("length") - 1), join(F.lit(2), F.col("length") - 1))).alias("phrase"))
    covered = shorter.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = words.join(covered, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {int(cover)} * n")
    cuts = held.select("lang", "phrase", F.col("n").alias("a"), "w", "length", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("first"), join(F.col("k") + 1, F.col("length") - F.col("k")).alias("rest"))
    side = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_LANGUAGES else totals
    both = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    whole = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(cast(1000 as decimal(4,0)) * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})")
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n")).alias("cut"))
    rows = best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
