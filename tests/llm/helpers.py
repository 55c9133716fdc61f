"""Small tables with the cases that every operator must stand."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=False):
    """Documents of texts, or of (doc_id, text) pairs, with three sources; extra adds columns whose names operators use inside."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    data = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, len(t or "")) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    if extra:
        for name in ("id", "k", "n", "row", "part", "shard", "node", "h", "size", "kept", "n_words", "weak", "base", "key", "position", "ids"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


ODD = [None, "", " \n\t ", "one", "one two", "Ünïcödé 日本語 𝔘", "a\x00b", "x" * 50_000, "word " * 20_000, "same text here", "same text here"]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")
