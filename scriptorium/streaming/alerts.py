"""Alerts: parsing, merging and progress, over tables and over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.sources.scratch import file_system
from scriptorium.streaming.commits import commit, last_commit
from scriptorium.streaming.tokens import joined_deltas

__all__ = ["KEEP", "console", "displayed", "joined_deltas", "merged", "merged_stream", "parsed", "progress"]

#: Alerts kept, newest first (fixed value).
KEEP = 200
ALERT = "id string, kind string, message string, timestamp string, metadata map<string,string>"
KINDS = ("info", "warning", "critical")
# The words of a message that name a stage, in the order in which they are looked for, with its share of the whole.
STAGES = (("MiniMax", 40), ("Tavily", 60), ("Claude", 100), ("Ollama", 20))
START = 20
FINDING, RESOLUTION = "FINDING_DISCOVERED", "RESOLUTION_RECOMMENDED"


def merged(alerts: DataFrame, key: str, seq: str, keep: int = KEEP) -> DataFrame:
    """The latest version of each alert at the place where it first appeared; the keep newest places, newest first.

    Places are ordered after aggregation, by a top-n that each partition cuts before the shuffle.
    """
    others = [c for c in alerts.columns if c not in (key, seq)]
    grouped = alerts.groupBy(key).agg(F.min(seq).alias("_first"), F.max(F.struct(seq, *others)).alias("_last"))
    newest = grouped.orderBy(F.desc("_first")).limit(keep)
    place = F.row_number().over(Window.orderBy(F.desc("_first")))  # over keep rows
    return newest.select(key, "_last.*", place.alias("place"))


def merged_stream(alerts: DataFrame, path: str, checkpoint: str, key: str, seq: str, keep: int = KEEP) -> StreamingQuery:
    """merged() over a stream: after each micro-batch, displayed() has what merged() gives for all alerts so far.

    State holds the first place and the last version of every alert, by key, as an alert that has left the display keeps its place if it
    comes again. A batch's changed alerts meet the keep rows on display, and the keep newest places of both are the next display; a mark
    shows it, and the one before goes with the next. A batch that runs again makes the same display.
    """
    others = [c for c in alerts.columns if c not in (key, seq)]
    changed = alerts.groupBy(key).agg(F.min(seq).alias("_first"), F.max(F.struct(seq, *others)).alias("_last")).select(key, "_first", "_last.*")

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        last, mark = last_commit(spark, path)
        if last >= n:
            return
        shown = batch.orderBy(F.desc("_first")).limit(keep)
        if mark:
            old = spark.read.schema(batch.schema).parquet(f"{path}/{mark['shown']}")
            shown = old.join(batch.select(key), key, "left_anti").select(batch.columns).unionByName(batch).orderBy(F.desc("_first")).limit(keep)
        shown.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={n}")  # keep rows
        commit(spark, path, n, {"shown": f"batch={n}", "before": mark.get("shown")})
        if mark.get("before"):
            fs, at = file_system(spark, f"{path}/{mark['before']}")
            fs.delete(at, True)

    return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def displayed(spark: SparkSession, path: str) -> DataFrame | None:
    """The alerts that merged_stream() shows now, with place from 1, newest first; None before the first batch."""
    _, mark = last_commit(spark, path)
    if not mark:
        return None
    place = F.row_number().over(Window.orderBy(F.desc("_first")))  # over keep rows
    return spark.read.parquet(f"{path}/{mark['shown']}").withColumn("place", place).drop("_first")


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Alerts of JSON lines; a line that is no JSON becomes an info alert, an alert of an unknown kind or without id goes."""
    held = lines.withColumn("_a", F.from_json(column, ALERT))
    plain = ~F.trim(column).startswith("{")
    wrapped = F.struct(F.sha2(column, 256).alias("id"), F.lit("info").alias("kind"), F.col(column).alias("message"), F.lit("").alias("timestamp"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return held.select(F.when(plain, wrapped).otherwise(F.col("_a")).alias("a")).select("a.*").where(F.col("id").isNotNull() & F.col("kind").isin(*KINDS) & F.col("message").isNotNull())


def progress(alerts: DataFrame, message: str = "message", metadata: str = "metadata", stages: tuple[tuple[str, int], ...] = STAGES, start: int = START) -> DataFrame:
    """alerts with progress (the share of the first stage word in the message, else null), is_finding and is_resolution."""
    share = F.coalesce(*[F.when(F.contains(F.col(message), F.lit(word)), F.lit(v)) for word, v in stages])
    kind = F.coalesce(F.col(metadata)["eventType"], F.lit(""))
    return alerts.withColumns({"progress": share, "is_finding": kind == FINDING, "is_resolution": kind == RESOLUTION})


def console(alerts: DataFrame, key: str, order: str, start: int = START, **columns) -> DataFrame:
    """For each key: the progress of its first alert (by order) that names a stage, start without one, and its findings and resolutions."""
    marked = progress(alerts, start=start, **columns)
    first = F.min_by("progress", F.when(F.col("progress").isNotNull(), F.col(order)))
    return marked.groupBy(key).agg(F.coalesce(first, F.lit(start)).alias("progress"), F.count_if("is_finding").alias("findings"), F.count_if("is_resolution").alias("resolutions"))
