"""Quality rules by distribution divergence, in DataFrame operations only.

Every document gets a histogram of its characters by class and one of its words over the common words of its language. The sums of
these histograms over all documents of a language are the language's references, and a document whose Jensen-Shannon distance from
a reference is large fails, if it is long enough to tell. Base counts (symbols, repeated lines, repeated windows of words) and the
base rule stand beside it. Features are computed in one pass over the texts and staged; the references are one small row a language.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import SPACE_CLASS, stage, total, whole, words

SYMBOLS = r"#*$%&|<>"
#: Common words of each language that has a list; other languages are compared by characters alone.
COMMON = {
    "en": "the of and to in is that for it with on as".split(),
    "fr": "le la de et les des un une du en que pour".split(),
    "es": "el la de que y los se del las un para con".split(),
    "de": "der die das und in den von zu mit sich des ist".split(),
}
MIN_WORDS = 50
#: Distances from 0 to 1. Characters are compared from MIN_WORDS words on, common words from MIN_COMMON words on.
MAX_CHARS, MAX_COMMON, MIN_COMMON = 0.32, 0.3, 150
#: References of up to so many languages (under 1 kB each) are broadcast; more are joined by shuffling.
BROADCAST_LANGUAGES = 10_000
CLASSES = ("lower", "upper", "digit", "symbol", "punctuation", "other", "space")


def repeated_words(w: Column) -> dict[str, Column]:
    """Columns, each using the ones before, of which n_repeat_words counts the words in 3-word windows that occur twice or more.

    Windows are told apart by a 64-bit hash. Windows that occur once are the rule, so their number is compared before any sorting.
    """
    n = F.size(w)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    h, s, at = F.col("_h"), F.col("_s"), F.col("_at")
    return {
        "_h": F.coalesce(windows, F.array().cast("array<bigint>")),
        "_s": F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))),
        "_at": F.sort_array(
            F.transform(
                F.filter(s, lambda e, k: (e["x"] == F.get(s, k - 1)["x"]) | (e["x"] == F.get(s, k + 1)["x"])),
                lambda e: e["i"],
            )
        ),
        "n_repeat_words": F.coalesce(total(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))).cast("long"))), F.lit(0)).cast("long"),
    }


def features(df: DataFrame, text_column: str = "text", lang_column: str = "lang", keep: tuple = ("doc_id",), carry: bool = False) -> DataFrame:
    """keep, lang, the base counts, and chars and common as arrays of counts (common is null for languages without a list)."""
    x = whole(F.col("text"))
    only = lambda unwanted: F.length(F.regexp_replace(x, f"[^{unwanted}]+", "")).cast("long")
    held = df.alias("input").select(
        *[F.col(f"input.`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)],
        F.coalesce(F.col(f"input.`{lang_column}`"), F.lit("")).alias("lang"),
        F.col(f"input.`{text_column}`").alias("text"),
        *([F.struct("input.*").alias("row")] if carry else []),
    )
    lines = F.filter(F.split(x, "\n"), lambda line: F.btrim(line, F.lit("\x20\x09\x0b\x0c\x0d")) != "")
    held = held.withColumns({"_w": words(F.col("text")), "_lines": lines})
    held = held.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "n_chars": F.length(x).cast("long"),
            "word_chars": F.length(F.regexp_replace(x, f"[{SPACE_CLASS}]+", "")).cast("long"),
            "n_symbols": only(SYMBOLS),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_upper": only("A-Z"),
            "_digit": only("0-9"),
            "_punctuation": only(r"!\"'()+,./:;=?@\[\\\]^_`{}~-"),
            "_other": only(r"\x{80}-\x{10FFFF}"),
        }
    )
    for name, column in repeated_words(F.col("_w")).items():
        held = held.withColumn(name, column)
    every = sorted({w for ws in COMMON.values() for w in ws})
    held = held.withColumn("_common", F.filter("_w", lambda w: w.isin(every)))
    count = lambda w: F.size(F.filter("_common", lambda c: c == w)).cast("long")
    bins = reduce(lambda found, item: found.when(F.col("lang") == item[0], F.array(*[count(w) for w in item[1]])), COMMON.items(), F)
    space = F.col("n_chars") - F.col("word_chars")
    lower = F.col("word_chars") - F.col("_upper") - F.col("_digit") - F.col("n_symbols") - F.col("_punctuation") - F.col("_other")
    held = held.withColumn("_bins", bins)
    return held.select(
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
        F.col("lang").alias("_lang"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.array(lower, "_upper", "_digit", "n_symbols", "_punctuation", "_other", space).alias("_chars"),
        F.when(F.col("_bins").isNotNull(), F.concat("_bins", F.array(F.col("n_words") - total(F.col("_bins"))))).alias("_common"),
        *(["row"] if carry else []),
    )


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance with logarithms to base 2, from 0 to 1; null if either side is empty."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    a, b = total(counts), total(reference)
    terms = F.zip_with(counts, reference, lambda x, y: (part(x / a, y / b) + part(y / b, x / a)) / 2)
    divergence = F.aggregate(terms, F.lit(0.0), lambda t, x: t + x)
    return F.when((a > 0) & (b > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def summed(found: DataFrame) -> DataFrame:
    sums = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n)])
    n_common = 1 + len(next(iter(COMMON.values())))
    return found.groupBy("_lang").agg(sums("_chars", len(CLASSES)).alias("_ref_chars"), sums("_common", n_common).alias("_ref_common"))


def reference_histograms(df: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """lang, chars and common: the histograms of all documents of each language, as references for others; one row for each language.

    Null and empty texts add nothing, a null language is the empty one, repeated rows count each time, and an empty table has none.
    """
    return summed(features(df, text_column, lang_column, keep=())).select(F.col("_lang").alias("lang"), F.col("_ref_chars").alias("chars"), F.col("_ref_common").alias("common"))


def judge(df: DataFrame, text_column: str = "text", lang_column: str = "lang", keep: tuple = ("doc_id",), max_chars: float = MAX_CHARS, max_common: float = MAX_COMMON, carry: bool = False, references: DataFrame | None = None) -> DataFrame:
    """keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chars_distance, common_distance.

    base_failed: fewer than 50 words, or over half of them in windows that repeat. kept: not base_failed, and no distance over its
    limit. A null distance (no words, a language without a list, a text too short to tell) rejects nothing. Null and empty texts
    have no words and fail. A null language is a language of its own. Repeated rows are judged alike; an empty table gives an empty
    result. Columns in keep that are named like the others are left out.

    references: lang, chars and common, as reference_histograms() makes them of trusted or held-out documents; None takes the histograms
    of df itself, all rows. A language that references lack has null distances.
    """
    outputs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_distance", "common_distance")
    keep = tuple(c for c in keep if c not in outputs)
    found = stage(features(df, text_column, lang_column, keep, carry))
    known = summed(found) if references is None else references.select(F.col("lang").alias("_lang"), F.col("chars").alias("_ref_chars"), F.col("common").alias("_ref_common"))
    if known.count() <= BROADCAST_LANGUAGES:
        known = F.broadcast(known)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far_chars = (F.col("n_words") >= MIN_WORDS) & (F.col("chars_distance") > max_chars)
    far_common = (F.col("n_words") >= MIN_COMMON) & (F.col("common_distance") > max_common)
    return (
        found.join(known, "_lang", "left")
        .withColumn("chars_distance", js_distance(F.col("_chars"), F.col("_ref_chars")))
        .withColumn("common_distance", js_distance(F.col("_common"), F.col("_ref_common")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~(failed | F.coalesce(far_chars, F.lit(False)) | F.coalesce(far_common, F.lit(False))))
        .select(*[F.col(f"`{c}`") for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_distance", "common_distance", *(["row"] if carry else []))
    )


def filtered(df: DataFrame, **options) -> DataFrame:
    """The rows of df that judge() keeps, with all their columns; nulls, repeated rows and an empty table are as there."""
    return judge(df, keep=(), carry=True, **options).where("kept").select("row.*")
