import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from scriptorium.llm import divergence
from tests.llm.helpers import ODD, SCHEMA, documents

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least=3, most=200):
    """Every term against every group, zeros included."""
    counts, frequency = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        own = terms(text)
        counts[lang or "", source or ""].update(own)
        frequency[lang or ""].update(set(own))
    out = set()
    for lang in {g[0] for g in counts}:
        kept = sorted((t for t, n in frequency[lang].items() if n >= least), key=str.encode)
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // y
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            own = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", own, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:limit])}
    return out


def audited(df, **options):
    got = [tuple(r) for r in divergence.audit(df, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force_on_odd_and_random_rows(spark):
    random.seed(11)
    texts = [*ODD, *ODD, "Ünïcödé Ünïcödé 日本語", "a-b_c9d ÀB", "x" * 50_000]
    texts += [" ".join(random.choices("the of cat Dog naïve été x1y 日本 zz".split(), weights=[40, 20, 9, 5, 3, 2, 2, 1, 1], k=random.randint(0, 60))) for _ in range(150)]
    df = documents(spark, texts, extra=True)
    rows = [(r["text"], r["lang"], r["source"]) for r in df.collect()]
    got = audited(df)
    assert got == brute(rows) and {r[2] for r in got} == {"pair", "term"}
    assert audited(df, least_documents=1, most_terms=3) == brute(rows, 1, 3)


def test_groups_without_terms_and_languages_without_kept_terms(spark):
    rows = [("a a b", "en", "x"), ("a b", "en", "y"), ("a", "en", "y"), ("12 34", "en", "z"), (None, "en", None), ("once", "fr", "x"), ("only", "fr", "y"), ("", None, None), ("q", None, None)]
    df = spark.createDataFrame([(i, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows)], SCHEMA)
    got = audited(df)
    assert got == brute(rows)
    assert {r[4] for r in got if r[0] == "fr"} == {0} and len([r for r in got if r[:3] == ("en", "z", "pair")]) == 3


def test_a_hot_source(spark):
    random.seed(3)
    rows = [(" ".join(random.choices("abcdefghij", k=40)) + f" {'w' * (i % 30 + 1)}", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(300)]
    df = spark.createDataFrame([(i, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows)], SCHEMA)
    assert audited(df) == brute(rows)


def test_texts_in_parts_and_counts_passed_on_early(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "WINDOW", 20)
    random.seed(5)
    texts = [" ".join(random.choices(["ab", "cé", "日本語", "D1e"], k=random.randint(0, 50))) + " " + "x" * (i % 40) for i in range(100)]
    batch = pa.record_batch([pa.array(["en"] * 100), pa.array([f"s{i % 4}" for i in range(100)]), pa.array([t.encode() for t in texts])], names=["lang", "source", "text"])
    n, docs, flushes = Counter(), Counter(), 0
    for found in divergence.counted(iter([batch, batch])):
        flushes += 1
        for r in found.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert flushes > 1
    assert n == Counter((f"s{i % 4}", t) for i, x in enumerate(texts) for t in terms(x) * 2)
    assert docs == Counter((f"s{i % 4}", t) for i, x in enumerate(texts) for t in [*set(terms(x))] * 2)


def test_counts_beyond_64_bit_products(spark):
    n = 6 * 10**12
    df = spark.createDataFrame([(n, 7 * 10**12, 12345)], "n long, total long, v long")
    got = df.selectExpr(divergence.share("n", "total", "v")).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (7 * 10**12 + 12345)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
