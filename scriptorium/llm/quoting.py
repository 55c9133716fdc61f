"""Quotation linking of messages, in DataFrame operations only.

Lines that begin with quote marks are parsed into levels. A quoted passage is a run of lines of one level; it, its paragraphs and its
lines are normalised and hashed, and meet the passages, paragraphs and lines that messages of the same conversation wrote themselves.
White space and line ends count as single spaces, so a passage that a mail client wrapped anew still meets its original. The latest
earlier writer is found by running maxima over blocks of turns, so a line that everyone quotes makes one row for each use and no pairs.
A message replies to the writer of most of the lines it quotes at level 1. Threads follow these links to their first message, and
conversations come out in thread order, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import SPACE_CLASS, lower_ascii, maybe_among, partitions, stage, whole

#: One class and no repeated group, in which the matcher would go one call deeper for each mark.
MARKS = rf"^[{SPACE_CLASS}>]*>"
#: Quoted lines and paragraphs of fewer characters, once normalised, link only as a whole passage.
LEAST = 4
#: Turns of a conversation that are searched together for an earlier writer.
TURNS = 1024


def normal(line: Column) -> Column:
    """Lower case, with white space and punctuation reduced to single spaces."""
    return F.btrim(F.regexp_replace(lower_ascii(line), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def parsed(text: Column) -> Column:
    """The lines of a text as (level, line): the number of quote marks before it, and the rest."""
    marks = lambda line: F.regexp_extract(line, MARKS, 0)
    return F.transform(
        F.split(text, "\n"),
        lambda line: F.struct(F.length(F.regexp_replace(marks(line), "[^>]+", "")).alias("level"), F.substr(line, F.length(marks(line)) + 1).alias("line")),
    )


def units(lines: Column) -> Column:
    """What a message writes or quotes, of the lines of parsed(): level, run, paragraph, kind, place, n (lines) and text (normalised).

    Each run of lines of one level is a passage; empty lines part its paragraphs. A passage, paragraph or line without words is none.
    """
    changes = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))

    def of_run(start: Column, k: Column, starts: Column) -> Column:
        own = F.slice(lines, start + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - start)
        level = F.get(lines, start)["level"]
        text = F.btrim(F.array_join(F.transform(own, lambda x: normal(x["line"])), "\n"), F.lit("\n"))
        unit = lambda paragraph, kind, place, n, t: F.struct(level.alias("level"), k.alias("run"), paragraph.alias("paragraph"), F.lit(kind).alias("kind"), place.alias("place"), n.alias("n"), t.alias("text"))
        none = F.lit(-1)
        paragraphs = F.filter(F.split(text, "\n{2,}"), lambda p: p != "")
        flat = lambda p: F.translate(p, "\n", " ")
        whole_run = F.array(unit(none, "run", none, F.aggregate(paragraphs, F.lit(0), lambda t, p: t + F.size(F.split(p, "\n"))), F.array_join(F.transform(paragraphs, flat), " ")))
        each = F.transform(paragraphs, lambda p, i: unit(i, "paragraph", none, F.size(F.split(p, "\n")), flat(p)))
        single = F.flatten(F.transform(paragraphs, lambda p, i: F.transform(F.split(p, "\n"), lambda x, j: unit(i, "line", j, F.lit(1), x))))
        return F.when(F.size(paragraphs) > 0, F.concat(whole_run, each, single)).otherwise(F.filter(whole_run, lambda u: F.lit(False)))

    runs = F.transform(changes, lambda start, k: F.struct(start.alias("start"), k.alias("k"), changes.alias("starts")))
    return F.flatten(F.transform(runs, lambda r: of_run(r["start"], r["k"], r["starts"])))


def earlier_writers(used: DataFrame) -> DataFrame:
    """used (conv, turn, level, h1, h2 and more), quoted rows alone, with writer: the latest earlier turn that wrote the same, if any.

    Turns fall into blocks of TURNS; what blocks before have written is one running maximum over blocks, so no window holds more of a
    conversation than a block, or one row for each block.
    """
    same = ["conv", "h1", "h2"]
    held = used.withColumn("block", F.floor(F.col("turn") / TURNS))
    wrote = F.when(F.col("level") == 0, F.col("turn"))
    before = Window.partitionBy(*same).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = held.groupBy(*same, "block").agg(F.max(wrote).alias("last")).withColumn("past", F.max("last").over(before)).drop("last")
    inside = Window.partitionBy(*same, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = held.withColumn("near", F.max(wrote).over(inside)).where("level > 0")
    return near.join(blocks, [*same, "block"]).withColumn("writer", F.coalesce("near", "past")).where("writer is not null")


def roots(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """key and root for messages with links (key to parent), by pointer doubling; parents are always earlier, so chains end."""
    now = stage(links.select("key", F.col("parent").alias("root")))
    for _ in range(most_rounds):
        if now.isEmpty():
            break
        further = now.select(F.col("key").alias("root"), F.col("root").alias("beyond"))
        after = stage(now.join(further, "root", "left").select("key", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return now


def positions(rows: DataFrame) -> DataFrame:
    """rows with position, from 0, of each row in its conversation by (thread, turn, h), also where one conversation has most rows."""
    order = ["conv", "thread", "turn", "h", "place"]
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *order)
    held = stage(dealt.withColumn("part", F.spark_partition_id()))
    counts = held.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    nth = F.row_number().over(Window.partitionBy("conv", "part").orderBy("thread", "turn", "h", "place"))
    return held.withColumn("nth", nth).join(offsets, ["conv", "part"]).withColumn("position", F.col("rows_before") + F.col("nth") - 1)


def conversations(df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", least: int = LEAST) -> DataFrame:
    """One row for each message: conv_id, turn, role, body, n_quoted, n_linked, max_level, parent_turn, thread_turn, position.

    body: the lines without quote marks, without empty lines at the ends. n_quoted: quoted lines; n_linked: those with words that an
    earlier message wrote, as part of the passage, else of the paragraph, else alone; paragraphs and lines of under least characters
    link only as a whole passage. parent_turn: the message that wrote most lines quoted at level 1 (of equals the latest), else null. thread_turn: the
    first message that parents lead to, the message's own if it quotes none. position: its place in the conversation by thread, then
    turn, from 0. Null texts have an empty body. Messages with a null conversation or turn have no parents and are none; null
    conversations are one conversation, null turns come first. Repeated messages keep a row each. An empty table gives an empty
    result.
    """
    text = whole(F.col(f"input.`{text_column}`"))
    held = df.alias("input").select(
        F.coalesce(F.concat(F.lit("="), F.col(f"input.`{conv_column}`").cast("string")), F.lit("")).alias("conv"),
        F.col(f"input.`{conv_column}`").alias("conv_value"),
        F.col(f"input.`{turn_column}`").cast("long").alias("turn"),
        F.col(f"input.`{role_column}`").alias("role"),
        text.alias("text"),
    )
    held = held.withColumn("h", F.xxhash64("conv", "turn", "role", "text")).withColumn("key", F.xxhash64("conv", "turn"))
    held = held.withColumn("lines", parsed(F.col("text")))
    body = F.btrim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), F.lit("\r\n"))
    messages = held.withColumns({"body": body, "n_quoted": F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long"), "max_level": F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0))})

    # Only conversations in which someone quotes take part in linking.
    quoting = held.where(F.col("text").rlike(rf"(?m){MARKS}")).select(F.xxhash64("conv")).distinct()
    asked = maybe_among(held.where("turn is not null and conv != ''").withColumn("c", F.xxhash64("conv")), "c", quoting).where("maybe")
    parts = asked.select("conv", "turn", "key", "h", F.explode(units(F.col("lines"))).alias("u")).select("conv", "turn", "key", "h", "u.*")
    parts = parts.where((F.col("level") == 0) | (F.col("kind") == "run") | (F.length("text") >= least))
    used = parts.withColumns({"h1": F.xxhash64("text"), "h2": F.crc32(F.col("text").cast("binary"))}).drop("text").distinct()
    run, paragraph = Window.partitionBy("key", "h", "run"), Window.partitionBy("key", "h", "run", "paragraph")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("writer")))
    met = earlier_writers(used).withColumns({"run_writer": of("run").over(run), "paragraph_writer": of("paragraph").over(paragraph)})
    largest = (F.col("kind") == "run") | (F.col("run_writer").isNull() & ((F.col("kind") == "paragraph") | F.col("paragraph_writer").isNull()))
    met = stage(met.where(largest).select("conv", "key", "h", "turn", "level", "writer", "n"))
    linked = met.groupBy("key", "h").agg(F.sum("n").alias("n_linked"))
    votes = met.where("level = 1").groupBy("conv", "key", "writer").agg(F.sum("n").alias("n"))
    chosen = votes.groupBy("conv", "key").agg(F.max(F.struct("n", "writer")).alias("best"))
    links = stage(chosen.select("key", F.col("best.writer").alias("parent_turn"), F.xxhash64("conv", "best.writer").alias("parent"), "conv"))
    turns = links.select(F.col("parent").alias("root"), F.col("parent_turn").alias("thread")).distinct()
    threads = roots(links).join(turns, "root").select("key", "thread")

    found = messages.drop("lines", "text").join(linked, ["key", "h"], "left").join(links.select("key", "parent_turn"), "key", "left").join(threads, "key", "left")
    placed = positions(found.withColumn("thread", F.coalesce("thread", "turn")))
    return placed.select(
        F.col("conv_value").alias(conv_column),
        F.col("turn").alias(turn_column),
        F.col("role").alias(role_column),
        "body",
        "n_quoted",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "max_level",
        "parent_turn",
        F.col("thread").alias("thread_turn"),
        "position",
    )
