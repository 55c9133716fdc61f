"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong patterns (assigned secrets, access identifiers, long hexadecimal runs) are reported wherever they match. Parts that mean
little alone, such as user names, 40-character keys and endpoints, become rows of an interval table; an equi-join on document and
scope cell, then an exact distance test, reports a weak part only where the parts that complete a credential stand near it.
Texts are read once, for the parts; only the few parts are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import stage, whole

#: Base kinds in their order: pattern, the group whose length counts, and its least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Cheap tests that every text with a match passes.
HINTS = {"assign": r"(?i)passw|secret|token|api_?key", "access": "AKIA", "hex": "[0-9a-f]{32}"}
#: Weak kinds, in their order after the base kinds.
WEAK = {
    "login": (r"""((?i:user_?name|user|login|account|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 2, 3),
    "key40": (r"(?<![A-Za-z0-9+/=_.-])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])", 0, 40),
    "endpoint": (r"""(?i:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\x20\x09-\x0D"'<>]+""", 0, 8),
}
KINDS = [*BASE, *WEAK]
#: Which kinds stand for which part of a credential.
PARTS = {"access": "identifier", "login": "identifier", "assign": "secret", "hex": "secret", "key40": "secret", "endpoint": "endpoint"}
#: A weak part counts if a part of each of these roles lies in its scope.
NEEDS = {"login": ("secret",), "key40": ("identifier",), "endpoint": ("identifier", "secret")}
#: Code points between two parts of one scope, at most.
SCOPE = 200
SPAN = "array<struct<start: long, kind: int, stop: long>>"


def spans_of(text: Column, kind: str) -> Column:
    """The matches of a kind as (start, kind, stop) in code points; the gap before each match gives its place.

    Gaps are anchored to the end of the match before, or the search beyond the last match would start again at every character.
    """
    pattern, group, least = (BASE | WEAK)[kind]
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.regexp_extract_all(text, F.lit(rf"\G([\s\S]*?)(?:{pattern})"), F.lit(1))
    counted = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1))
    both = F.zip_with(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), counted, lambda m, c: F.struct(F.length(m["gap"]).alias("gap"), F.length(m["match"]).alias("n"), F.length(c).alias("counted")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("found"))

    def step(a: Column, m: Column) -> Column:
        begin = a["at"] + m["gap"]
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (begin + m["n"]).alias("stop"))
        found = F.when(m["counted"] >= least, F.concat(a["found"], F.array(span))).otherwise(a["found"])
        return F.struct((begin + m["n"]).alias("at"), found.alias("found"))

    return F.aggregate(both, start, step, lambda a: a["found"])


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that complete a credential. parts: k1, k2 (the document), start, kind, stop; columns k1, k2, weak come back.

    A part lies in every cell of width scope that its span, widened by scope on the left, touches; a complement is looked up in the
    cells that its own span touches, its end included, so two parts with at most scope code points between them meet in at least one cell.
    """
    role = F.coalesce(*[F.when(F.col("kind") == KINDS.index(k), F.lit(v)) for k, v in PARTS.items()])
    cells = lambda first, last: F.explode(F.sequence(F.expr(f"cast(floor(({first}) / {scope}) as long)"), F.expr(f"cast(floor(({last}) / {scope}) as long)")))
    needed = F.coalesce(*[F.when(F.col("kind") == KINDS.index(k), F.array(*[F.lit(x) for x in v])) for k, v in NEEDS.items()])
    weak = parts.where(F.col("kind") >= len(BASE)).withColumn("needed", needed).withColumn("role", F.explode("needed"))
    weak = weak.withColumn("cell", cells(f"start - {scope}", f"stop + {scope}"))
    # A weak part meets every part of a cell. Parts of one kind do not overlap, so a cell of scope code points holds few, bounded by scope.
    held = parts.select("k1", "k2", role.alias("role"), F.col("start").alias("b"), F.col("stop").alias("e"))
    held = held.withColumn("cell", cells("b", "e"))
    met = weak.join(held, ["k1", "k2", "role", "cell"]).where(f"b <= stop + {scope} and e >= start - {scope} and (b >= stop or e <= start)")
    found = met.groupBy("k1", "k2", "start", "kind", "stop").agg(F.count_distinct("role").alias("met"), F.first("needed").alias("needed"))
    return found.where("met = size(needed)").groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("weak"))


def scan(df: DataFrame, text_column: str = "text", id_column: str = "doc_id", scope: int = SCOPE, carry: bool = False) -> DataFrame:
    """The id, counts of the base kinds, base (their spans) and spans (all spans), for every row; with carry also the input as row.

    Base spans are the leftmost non-overlapping matches of each kind; weak ones that overlap a base span are left out. Null and empty
    texts have no spans. Rows with equal id and text share their spans, repeated rows keep a row each, null ids are ids like others
    and an empty table gives an empty result.
    """
    text = whole(F.col("text"))
    held = df.alias("input").select(
        F.col(f"input.`{id_column}`").alias("k1"),
        F.xxhash64(F.col(f"input.`{id_column}`"), whole(F.col(f"input.`{text_column}`"))).alias("k2"),
        F.col(f"input.`{text_column}`").alias("text"),
        *([F.struct("input.*").alias("row")] if carry else []),
    )
    none = F.array().cast(SPAN)
    for kind in BASE:
        hint = F.contains(text, F.lit("AKIA")) if kind == "access" else text.rlike(HINTS[kind])
        held = held.withColumn(kind, F.when(hint, spans_of(text, kind)).otherwise(none))
    for kind in WEAK:
        held = held.withColumn(kind, F.when(text.rlike(WEAK[kind][0]), spans_of(text, kind)).otherwise(none))
    held = held.withColumn("base", F.concat(*BASE))
    held = held.withColumn("weak", F.filter(F.concat(*WEAK), lambda w: ~F.exists("base", lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"]))))
    kept = ["k1", "k2", "base", F.when(F.size("weak") > 0, F.concat("base", "weak")).alias("parts"), *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE]]
    rows = stage(held.select(*kept, *(["row"] if carry else [])))
    parts = rows.where("size(parts) > 1").select("k2", F.coalesce(F.hash("k1"), F.lit(0)).alias("k1"), F.explode("parts").alias("p")).select("k1", "k2", "p.*").distinct()
    linked = link(parts, scope).withColumnRenamed("k1", "hashed")
    some = rows.where("size(parts) > 1").withColumn("hashed", F.coalesce(F.hash("k1"), F.lit(0))).join(linked, ["hashed", "k2"], "left")
    found = rows.where("coalesce(size(parts), 0) <= 1").withColumn("weak", F.lit(None).cast(SPAN)).unionByName(some.drop("hashed"))
    spans = F.when(F.col("weak").isNull(), F.col("base")).otherwise(F.concat("base", "weak"))
    return found.select(F.col("k1").alias(id_column), *[f"n_{k}" for k in BASE], "base", spans.alias("spans"), *(["row"] if carry else []))


def redact(df: DataFrame, text_column: str = "text", id_column: str = "doc_id", mark: str = "[secret]", length_column: str | None = "n_chars") -> DataFrame:
    """df with every reported span replaced by mark and, if df has length_column, that column brought up to date.

    Overlapping spans are replaced once. Rows without spans stay as they are, null and empty texts included; repeated rows, null ids and
    other columns, whatever their names, stay too, and an empty table gives an empty result.
    """
    found = scan(df, text_column, id_column, carry=True)
    old = F.col(f"row.`{text_column}`")
    ordered = F.array_sort("spans")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.substring(old, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        fresh = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(a["out"], piece, F.lit(mark))).otherwise(a["out"]).alias("out"))

    clean = F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(old, (a["at"] + 1).cast("int"), F.length(old))))
    found = found.withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(old))
    columns = [F.col("clean").alias(c) if c == text_column else F.col(f"row.`{c}`") for c in df.columns]
    if length_column in df.columns:
        kind = dict(df.dtypes)[length_column]
        at = df.columns.index(length_column)
        columns[at] = F.when(F.size("spans") > 0, F.length("clean").cast(kind)).otherwise(F.col(f"row.`{length_column}`")).alias(length_column)
    return found.select(*columns)
