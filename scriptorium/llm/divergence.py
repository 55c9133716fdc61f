"""How far the words of each source lie from those of the other sources of its language.

Terms are counted by (lang, source) in one pass over the texts: each task sums the counts of its documents before they are shuffled, so
that a source with a third of all rows, or a term that is everywhere, arrives as a few rows from each task. An inverted index of
(lang, term) postings holds the counts above zero. The value of a pair of sources starts at V times the value of two zero counts, and
only corrections are added: one for each source's counts against the other's zero, taken from a histogram of counts, and one for terms
that both have, from the postings. Terms that neither has cost nothing. Work on pairs grows with the result, which has them all.
All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import drop, giving_back, ship, stage

SCALE = 1_000_000_000
LEAST_DOCUMENTS, MOST_TERMS = 3, 200
#: Table of groups up to so many rows (under 100 bytes each) is broadcast to the postings; a larger one is joined by shuffling.
BROADCAST_GROUPS = 100_000
#: Distinct terms that a task holds before it passes them on, and bytes of a text that are split at once.
HELD, WINDOW = 200_000, 4_000_000
#: Letters in lower case, bytes of characters beyond ASCII as they are, everything else a blank.
TABLE = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def windows(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded part at a time; parts end at blanks."""
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + WINDOW)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (lang, source) and term, how often it occurs in these documents and in how many of them."""
    n: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)
    held = 0

    def flush() -> pa.RecordBatch:
        rows = [(*group, term, k, docs[group][term]) for group, own in n.items() for term, k in own.items()]
        n.clear()
        docs.clear()
        lang, source, term, k, d = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(k, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            own: Counter = Counter()
            for terms in windows(text.translate(TABLE)):
                own.update(terms)
            before = len(n[lang, source])
            n[lang, source].update(own)
            docs[lang, source].update(own.keys())
            held += len(n[lang, source]) - before
            if held > HELD:
                yield flush()
                held = 0
    yield flush()


def share(n: str, total: str, terms: str) -> str:
    """1 + floor(SCALE * (n + 1) / (total + terms)), in decimals, as products may pass 64 bits; null without terms."""
    whole = lambda x: f"cast({x} as decimal(20,0))"
    return f"case when {terms} > 0 then 1 + (cast({SCALE} as decimal(10,0)) * {whole(f'{n} + 1')}) div {whole(f'{total} + {terms}')} end"


def f(p: str, q: str) -> str:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so squares fit 64 bits."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def postings(df: DataFrame, text_column: str, lang_column: str, source_column: str, least_documents: int) -> DataFrame:
    """lang, source, term, n and lang_n (occurrences in the source and in the language) of terms in enough documents of a language."""
    ship(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary").alias("text")
    held = df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(x) for c, x in ((lang_column, "lang"), (source_column, "source"))), text)
    sums = held.mapInArrow(giving_back(counted), COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = Window.partitionBy("lang", "term")  # as many rows as a language has sources
    both = sums.withColumns({"lang_n": F.sum("n").over(of_lang), "lang_docs": F.sum("docs").over(of_lang)})
    return both.where(F.col("lang_docs") >= least_documents).select("lang", "source", "term", "n", "lang_n")


def pair_values(known: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for each ordered pair of groups of a language; known are postings with p and z, groups have z and terms."""
    a = groups.select("lang", "source", F.col("z").alias("za"), "terms")
    b = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("zb"))
    base = a.join(b, "lang").where("source <> item").selectExpr("lang", "source", "item", f"case when terms > 0 then terms * ({f('za', 'zb')}) else 0 end as value")
    counts = known.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("k"))
    against = counts.join(b, "lang").where("source <> item")
    one_sided = against.selectExpr(
        "lang",
        f"inline(array(struct(source, item, k * ({f('p', 'zb')} - {f('z', 'zb')}) as value), struct(item as source, source as item, k * ({f('zb', 'p')} - {f('zb', 'z')}) as value)))",
    )
    left = known.select("lang", "term", F.col("source").alias("sa"), F.col("p").alias("pa"), F.col("z").alias("za"))
    right = known.select("lang", "term", F.col("source").alias("sb"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    more = lambda p, q, z, w: f"{f(p, q)} - {f(p, w)} - {f(z, q)} + {f(z, w)}"
    met = left.join(right, ["lang", "term"]).where("sa < sb").selectExpr("lang", "sa", "sb", f"{more('pa', 'pb', 'za', 'zb')} as ab", f"{more('pb', 'pa', 'zb', 'za')} as ba")
    met = met.groupBy("lang", "sa", "sb").agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"))
    two_sided = met.selectExpr("lang", "inline(array(struct(sa as source, sb as item, ab as value), struct(sb as source, sa as item, ba as value)))")
    every = base.unionByName(one_sided.where("value <> 0")).unionByName(two_sided.where("value <> 0"))
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(df: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", least_documents: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: each source of a language against the others, and the terms it has more of than its language.

    Part pair has every other source of the language, whose value is summed over all kept terms; part term the most_terms highest of the
    terms that occur in the source with a larger share than in the language. Ranks go by value, then item in the order of its bytes.

    Null texts are empty; a null language or source is one named by the empty text. A group without terms has a row for each other source
    (value 0 where the whole language keeps no term). Repeated rows are documents of their own. Further columns of any name do nothing;
    an empty table gives an empty result.
    """
    found = stage(postings(df, text_column, lang_column, source_column, least_documents))
    langs = found.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    every = df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(x) for c, x in ((lang_column, "lang"), (source_column, "source")))).distinct()
    groups = every.join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "terms", "lang_total"]).withColumn("z", F.expr(share("0", "total", "terms")))
    groups = stage(groups.select("lang", "source", "total", "terms", "lang_total", "z"))
    few = groups.count() <= BROADCAST_GROUPS
    joined = found.join(F.broadcast(groups) if few else groups, ["lang", "source"])
    known = stage(joined.selectExpr("lang", "source", "term", "z", f"{share('n', 'total', 'terms')} as p", f"{share('lang_n', 'lang_total', 'terms')} as q"))
    drop(found)
    pairs = pair_values(known, groups).withColumn("part", F.lit("pair"))
    above = known.where("p > q").selectExpr("lang", "source", "term as item", f"{f('p', 'q')} as value", "'term' as part")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    nth = F.row_number().over(order)  # the limit on ranks reaches the tasks before the shuffle
    ranked = pairs.withColumn("rank", nth).unionByName(above.withColumn("rank", nth).where(F.col("rank") <= most_terms))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
