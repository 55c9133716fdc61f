"""URL filtering against host and path rules, in DataFrame operations only.

A URL is expanded into all its host suffixes times those prefixes of its path that are as long as some rule's path. The expressions
meet the rules by an equi-join on the first bytes of their digests; the full digest then confirms each meeting, and the longest rule
decides. The work is done once for each distinct host and path, so a host with a third of all pages costs no more than its paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm._common import lower_ascii

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"
PREFIX_HEX = 8
#: Rule tables of up to so many rows are broadcast; larger ones are joined by shuffling.
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, url_column: str = "url", keep: tuple = ("page_id",), default: str = DEFAULT) -> DataFrame:
    """The columns in keep, then host, path, rule (host and path of the deciding rule, or null) and verdict for every row.

    rules: verdict, host and path. A rule fits its host and all subdomains if the URL's path starts with the rule's path. The longest
    path among those of the longest host wins; of equal rules, block wins. Null URLs and those without :// have an empty host and
    path and get the default, as does every URL that no rule fits. Rules with a null host or path fit nothing. Repeated rows keep
    a row each; an empty table, or an empty rule table, is no error. Columns in keep that are named like the others are left out.
    """
    spark = pages.sparkSession
    keep = tuple(c for c in keep if c not in ("host", "path", "rule", "verdict"))
    digest = F.sha2(F.concat("rule_host", F.lit("\x00"), "rule_path").cast("binary"), 256)
    known = (
        rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .dropna(subset=["rule_host", "rule_path"])
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))  # of allow and block, block
        .withColumn("digest", digest)
        .withColumn("start", F.left("digest", F.lit(PREFIX_HEX)))
    )
    n_rules = known.count()
    lengths = [r[0] for r in known.select(F.length("rule_path")).distinct().collect()]  # at most the longest rule's length
    if n_rules <= BROADCAST_RULES:
        known = F.broadcast(known)

    url = F.col(f"input.`{url_column}`")
    held = pages.alias("input").select(*[F.col(f"input.`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)], host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.left("path", F.lit(n))) for n in sorted(lengths)]).cast("array<string>")
    met = (
        held.select("host", "path")
        .where("host != ''")
        .distinct()
        .select("host", "path", F.explode(suffixes).alias("rule_host"))
        .select("host", "path", "rule_host", F.explode(F.array_compact(prefixes)).alias("rule_path"))
        .select("host", "path", digest.alias("digest"))
        .withColumn("start", F.left("digest", F.lit(PREFIX_HEX)))
        .join(known.withColumnRenamed("digest", "rule_digest"), "start")
        .where("digest = rule_digest")
    )
    rank = F.struct(F.length("rule_host"), F.length("rule_path"), "rule_verdict", F.concat("rule_host", "rule_path").alias("rule"))
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return held.join(best, ["host", "path"], "left").select(
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )
