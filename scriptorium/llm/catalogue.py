"""The queries of this subpackage, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, divergence, jaccard, licenses, mixing, phrases, quality, quoting, secrets, sharding, topk, toxicity, urls
from scriptorium.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_prefix_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), n_shards=40)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), bytes_column="decoded"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(documents(spark, sf_dir))


def op4_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir)).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secrets.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), urls.rule_table(spark))


#: Target weights of the mixture; all other sources weigh 1.
TARGETS = {"src0": 4, "src1": 8, "src2": 2, "src3": 1}


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=TARGETS)


def op8_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).drop("chars_distance", "common_distance")


def op10_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoting.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_prefix_sharding,
        op2_byte_bpe,
        op3_jaccard_join,
        op4_license_templates,
        op5_linked_secrets,
        op6_url_rules,
        op7_pfair_mixing,
        op8_kd_search,
        op9_divergence_rules,
        op10_quote_linking,
        op11_source_divergence,
        op12_phrase_collocations,
        op13_toxicity,
    )
}
