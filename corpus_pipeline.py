"""The training-data pipeline: quality rules, near duplicates, secrets, source mixing and byte-level BPE over documents.

All stages take an empty table, null and empty texts, null ids, sources and languages, repeated rows and further columns of any name;
each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, jaccard, mixing, quality, secrets
from scriptorium.llm._common import stage, whole


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie far from their language's references go.

    Null and empty texts have under 50 words, so they go; repeated rows are judged alike, a null language is one of its own.
    """
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by 80 % of 5-word shingles in common, the one with the smallest doc_id stays.

    Null ids count as the largest; of repeated rows one stays. Texts without words, were there any, all stay.
    """
    return jaccard.dedupe(docs, width=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked parts of credentials are replaced by a mark; n_chars follows the text. All rows stay, null texts as they are."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in order of the mixture; null sources are one source. byte_bpe names each one's place in it."""
    return mixing.mixed_rows(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, position (in the mixture, from 0), the token ids and their number, and whether they decode to the text.

    Files don't keep the mixture's order when they are read again, so the place of each row is taken from the same schedule once more.
    Null and empty texts have no ids; repeated rows keep a row each, with places of their own.
    """
    digest = lambda c: F.unhex(F.sha2(c, 256))
    placed = mixing.mix(docs, carry=True).select("position", "row.doc_id", "row.lang", "row.source", "row.n_chars", "row.text")
    kept = placed.select("doc_id", "lang", "source", "n_chars", "position", digest(whole(F.col("text")).cast("binary")).alias("digest"), "text")
    found = bpe.encode(kept, bytes_column="decoded")
    same = F.col("digest") == digest(F.coalesce("decoded", F.lit(b"")))
    return found.select("doc_id", "lang", "source", "n_chars", "position", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: Neither Pfair schedules nor byte-level BPE have a form in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
