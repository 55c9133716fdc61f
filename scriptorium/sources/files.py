"""Readers of manifests, uploads, vectors, webhook events and alerts, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEBHOOK = (
    "id string, event_type string, create_time string, "
    "resource struct<id: string, billing_agreement_id: string, custom_id: string, subscriber: struct<email_address: string, payer_id: string>>"
)
EXTENSIONS = ("txt", "md")
UPLOAD_LENGTH = 20_000


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """num_articulo, estado and motivo of a JSON file that maps article numbers to statuses."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, struct<estado: string, motivo: string>>")
    return text.select(F.explode(entries).alias("num_articulo", "s")).select("num_articulo", "s.*")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, text and truncated of the text files with an allowed extension: line ends and runs of empty lines are made one."""
    files = spark.read.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    allowed = F.lower(F.substring_index("path", ".", -1)).isin(*EXTENSIONS)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", r"\x00", ""), "\r\n?", "\n"), r"\n{3,}", "\n\n")
    return files.where(allowed).select("path", F.substring(F.trim(clean), 1, UPLOAD_LENGTH).alias("text"), (F.length(F.trim(clean)) > UPLOAD_LENGTH).alias("truncated"))


def webhooks(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON lines, from a batch or a stream; lines that are no JSON object with a type go."""
    e = lines.select(F.from_json(column, WEBHOOK).alias("e"))
    return e.where("e.event_type is not null").select(
        F.col("e.id").alias("event_id"), F.col("e.event_type").alias("event_type"), F.try_to_timestamp(F.col("e.create_time")).alias("created"),
        F.coalesce("e.resource.billing_agreement_id", "e.resource.id").alias("sub_id"), F.col("e.resource.custom_id").alias("custom_id"),
        F.col("e.resource.subscriber.email_address").alias("email"), F.col("e.resource.subscriber.payer_id").alias("payer_id"),
    )


def text_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Lines of the files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def dump(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def missing_columns(spark: SparkSession, name: str, *columns: str) -> list[str]:
    """Those of columns that a table of the catalog lacks; all of them if there is no such table."""
    held = {c.name for c in spark.catalog.listColumns(name)} if spark.catalog.tableExists(name) else set()
    return [c for c in columns if c not in held]


def key_violations(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that are not unique or hold a null, with their number of rows; none if keys are a primary key."""
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | some_null)


def exactly_one(df: DataFrame) -> dict:
    """The only row of a point lookup; another number of rows is an error."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"expected one row, found {'none' if not rows else 'several'}")
    return rows[0].asDict(recursive=True)


def at_most_one(df: DataFrame) -> dict | None:
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise LookupError("expected one row at most, found several")
    return rows[0].asDict(recursive=True) if rows else None
