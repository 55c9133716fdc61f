"""A linear classifier over character n-grams, each scaled by its naive Bayes log-count ratio, and its scores.

Texts become sets of hashed n-grams. In how many training documents of either label each occurs gives the log-count ratio r; those
with the surest ratios are kept, and logistic regression weighs them, each worth r where a document has it and 0 where not. Tables have
fixed sizes, so scoring is one pass over the texts that needs nothing else. Training rows are bounded by a parameter, the scored ones not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import drop, giving_back, partitions, ship, stage
from scriptorium.llm.shingles import U, mix

#: Lengths of n-grams in characters, and bits of the hash that names one.
ORDERS, BITS = (4, 5, 6), 20
#: Training rows of each label at most, chosen by a hash of their id; weights make up for rows left out.
MOST_ROWS = 25_000
#: N-grams that the regression weighs at most, each in at least so many training documents; what is added to each count.
FEATURES, LEAST_DOCUMENTS, SMOOTH = 1 << 14, 3, 1.0
#: Errors by which a ratio must lie off 0; the FEW surest are weighed in any case.
SURE, FEW = 3.0, 300
#: Strength of the penalty on weights, and rounds of the regression.
PENALTY, ROUNDS = 3e-4, 60
#: Characters that are hashed at once.
CHUNK = 500_000
FOLDS = 5


@dataclass(frozen=True)
class Model:
    """What each hashed n-gram adds, and what every text starts with."""

    table: np.ndarray
    bias: float


def held_out(id_column: Column) -> Column:
    """Rows that no label may be learned from: crc32 of the id as text, 0 modulo FOLDS; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % FOLDS == 0


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which text, and which bucket, for each n-gram of short texts; texts begin and end with a blank."""
    lengths = np.array([len(t) for t in texts])
    codes = mix(np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + U(1))
    owner = np.repeat(np.arange(len(texts)), lengths)
    run, at, bucket = codes, [], []
    for k in range(2, max(ORDERS) + 1):
        run = mix(run[:-1] * U(0xD1342543DE82EF95) + codes[k - 1 :])
        if k in ORDERS:
            inside = owner[: len(run)] == owner[k - 1 :]
            at.append(owner[: len(run)][inside])
            bucket.append((run[inside] >> U(64 - BITS)).astype(np.int64))
    return np.concatenate(at), np.concatenate(bucket)


def features(texts: list[str | None], wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, text within these, bucket) a chunk at a time, each bucket once a text and only where it is wanted."""

    def distinct(at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        if wanted is not None:
            held = wanted[bucket]
            at, bucket = at[held], bucket[held]
        return np.unique((at << BITS) + bucket)

    first, held, size = 0, [], 0
    for text in [*texts, None]:
        last = first + len(held) == len(texts)
        own = "" if last else f" {' '.join((text or '').lower().split())} "
        if held and (last or size + len(own) > CHUNK):
            keys = distinct(*grams(held))
            yield first, len(held), keys >> BITS, keys & ((1 << BITS) - 1)
            first, held, size = first + len(held), [], 0
        if len(own) > CHUNK:  # in parts that share what an n-gram across their border needs
            keys = np.zeros(0, dtype=np.int64)
            for start in range(0, len(own), CHUNK):
                keys = np.union1d(keys, distinct(*grams([own[start : start + CHUNK + max(ORDERS) - 1]])))
            yield first, 1, np.zeros(len(keys), dtype=np.int64), keys
            first += 1
        elif not last:
            held.append(own)
            size += len(own)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket, in how many training documents of label 0 and of label 1 it occurs."""
    found = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        labels = np.array(batch.column(0).to_pylist(), dtype=np.int64)
        for first, _, at, bucket in features(batch.column(1).to_pylist()):
            np.add.at(found, (labels[first + at], bucket), 1)
    some = np.flatnonzero(found.any(axis=0))
    for i in range(0, len(some), 100_000):
        own = some[i : i + 100_000]
        yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(found[0, own]), pa.array(found[1, own])], names=["bucket", "clean", "toxic"])


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, most_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """label and text of the documents to learn from, and the number of labelled rows of each label, chosen or not."""
    known = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = known.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most_rows).drop("nth")  # 2 * most_rows rows at most
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("label", "text"), totals


def ratios(counts: DataFrame, most: int) -> list[tuple[int, float]]:
    """(bucket, r) of the buckets whose log-count ratio lies SURE or more of its own errors from 0, the surest first."""
    held = counts.select("bucket", (F.col("toxic") + SMOOTH).alias("p"), (F.col("clean") + SMOOTH).alias("q"))
    p, q = held.agg(F.sum("p"), F.sum("q")).first()
    r = F.log(F.col("p") / p) - F.log(F.col("q") / q)
    held = held.where(F.col("p") + F.col("q") >= LEAST_DOCUMENTS + 2 * SMOOTH).withColumn("r", r)
    sure = F.abs("r") / F.sqrt(1 / F.col("p") + 1 / F.col("q"))
    found = held.withColumn("sure", sure).orderBy(F.desc("sure"), "bucket").limit(most).collect()
    return [(x["bucket"], x["r"]) for i, x in enumerate(found) if i < FEW or x["sure"] >= SURE]


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", most_rows: int = MOST_ROWS, most_features: int = FEATURES) -> Model:
    """The model of labels (id_column, label_column 0 or 1) joined to docs; rows in the held-out fold, null labels and null ids are left out.

    Labelled twice, a document counts twice. Without rows of both labels the model knows no n-gram and gives everything that one label, 0 if
    there is none at all.
    """
    spark = docs.sparkSession
    ship(spark)
    table = np.zeros(1 << BITS, dtype=np.float32)
    rows, totals = training_rows(docs, labels, id_column, text_column, label_column, most_rows)
    rows = stage(rows.repartition(partitions(spark)))
    have = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(have) < 2:
        return Model(table, 30.0 if 1 in have else -30.0)
    counts = rows.select("label", "text").mapInArrow(giving_back(counted), "bucket int, clean long, toxic long")
    counts = stage(counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    found = ratios(counts, most_features)
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[[b for b, _ in found]] = np.arange(len(found))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[list[str]] = []
            for _, n, at, bucket in features(batch.column(1).to_pylist(), place >= 0):
                ends = np.searchsorted(at, np.arange(n + 1))
                own += [[str(x) for x in place[bucket[a:b]]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(own, pa.list_(pa.string()))], names=["label", "grams"])

    weight = {k: totals[k] / n for k, n in have.items()}  # documents of a label for each one that is learned from
    marked = stage(rows.select("label", "text").mapInArrow(giving_back(indexed), "label int, grams array<string>").withColumn("weight", F.when(F.col("label") == 1, weight[1]).otherwise(weight[0])))
    present = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(found))], inputCol="grams", outputCol="present", binary=True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense([r for _, r in found]), inputCol="present", outputCol="scaled")
    regression = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", regParam=PENALTY, maxIter=ROUNDS, standardization=False)
    learned = regression.fit(scaled.transform(present.transform(marked)))
    table[[b for b, _ in found]] = learned.coefficients.toArray() * np.array([r for _, r in found])
    drop(rows, counts, marked)
    return Model(table, float(learned.intercept))


def score(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, held_out, score (0 to 1, higher where label 1 is likelier) and predicted (1 from 0.5 on) of every row.

    Whole texts are scored; null and empty ones and those without n-grams get what the model starts with. Repeated rows get equal scores; an
    empty table gives an empty result; other columns are left out.
    """
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast((model.table, model.bias))  # 4 bytes a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = held.value
        wanted = table != 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sums = np.full(len(texts), bias)
            for first, n, at, bucket in features(texts, wanted):
                sums[first : first + n] += np.bincount(at, weights=table[bucket], minlength=n)
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -500, 500))))], names=["id", "score"])

    kind = df.select(F.col(f"`{id_column}`")).schema[0].dataType.simpleString()
    found = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).mapInArrow(giving_back(run), f"id {kind}, score double")
    return found.select(F.col("id").alias(id_column), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
