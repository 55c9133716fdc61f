import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from scriptorium.llm import phrases
from tests.llm.helpers import ODD, SCHEMA, documents


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", lowered)]


def plain_counts(texts, longest):
    f = Counter()
    for words in (p for t in texts for p in pieces(t)):
        for k in range(1, longest + 1):
            f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f


def brute(rows, longest=5, least=100, most=2000, cover=100):
    by_lang = defaultdict(list)
    for text, lang in rows:
        by_lang["und" if lang is None else lang].append(text)
    out = set()
    for lang, texts in by_lang.items():
        f = plain_counts(texts, longest)
        n = sum(v for p, v in f.items() if len(p) == 1)
        often = {p: v for p, v in f.items() if v >= least and len(p) > 1}
        inside = lambda p, o: any(o[i : i + len(p)] == p for i in range(len(o) - len(p) + 1))
        found = []
        for p, a in often.items():
            if any(len(o) > len(p) and 100 * v >= cover * a and inside(p, o) for o, v in often.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, left, r, n, -s) for i, (s, a, p, left, r) in enumerate(sorted(found)[:most])}
    return out


def mined(df, **options):
    got = [tuple(r) for r in phrases.collocations(df, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def sentences(seed, n):
    random.seed(seed)
    fixed = ["in the middle of nowhere", "New York City", "as far as", "naïve été 日本", "a a a a"]
    words = "the of in cat dog x1 été % -".split()
    out = []
    for _ in range(n):
        run = [random.choice(fixed) if random.random() < 0.3 else random.choice(words) for _ in range(random.randint(0, 30))]
        out.append("".join(w + random.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n"]) for w in run))
    return out


def test_equals_brute_force_on_odd_and_random_rows(spark):
    df = documents(spark, [*ODD, *sentences(12, 120)], extra=True)
    rows = [(r["text"], r["lang"]) for r in df.collect()]
    want = brute(rows, least=10)
    assert {len(r[2].split(" ")) for r in want} == {2, 3, 4, 5} and {r[0] for r in want} == {"en", "und"}
    assert mined(df, least=10) == want
    assert mined(df, least=4, most=7, longest=3, cover=60) == brute(rows, 3, 4, 7, 60)


def test_production_parameters_on_copies(spark):
    texts = sentences(7, 40) * 12
    df = spark.createDataFrame([(i, t, "en" if i % 3 else "fr", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    want = brute([(r["text"], r["lang"]) for r in df.collect()])
    assert want and mined(df) == want


def test_a_least_count_beyond_a_byte(spark):
    df = spark.createDataFrame([(i, "one two three", "en", "s", 0) for i in range(300)], SCHEMA)
    assert mined(df, least=300) == brute([("one two three", "en")] * 300, least=300)
    assert mined(df, least=301) == set()


def test_long_texts_are_counted_in_parts_as_a_whole(monkeypatch):
    texts = [*sentences(5, 30), "p q r s t u v w x y z " * 50, "word" * 100 + " a b. c d " * 40]
    full = np_ones()
    for length in range(1, 5):
        monkeypatch.setattr(phrases, "WINDOW", 1 << 30)
        whole = run(texts, length, full)
        for window in (15, 60, 400):
            monkeypatch.setattr(phrases, "WINDOW", window)
            counts, buckets = run(texts, length, full)
            assert counts == whole[0] and (buckets == whole[1]).all()
            assert trimmed_counts(texts, length, full) == plain_of(texts, length + 1)
        assert whole[0] == plain_of(texts, length)


def plain_of(texts, length):
    return {" ".join(p): v for p, v in plain_counts(texts, length).items() if len(p) == length}


def trimmed_counts(texts, length, full):
    """Phrases longer by one word, counted in what a pass leaves of the texts for the next; everything may be frequent."""
    own = phrases.Pass(length, 5, 200, full, full)
    rows = [r for b in own.run(iter([batch_of(texts)])) for r in b.to_pylist() if r["text"] is not None] if length > 1 else None
    left = batch_of(texts) if rows is None else pa.record_batch([pa.array([r[c] for r in rows]) for c in ("lang", "text", "carried")], names=["lang", "text", "carried"])
    counts = Counter()
    for found in phrases.Pass(length + 1, 5, 200, full, full).run(iter([left])):
        for r in found.to_pylist():
            if r["phrase"] is not None:
                counts[r["phrase"]] += r["n"]
    return counts


def np_ones():
    return phrases.np.full((1 << phrases.BITS) // 8, 255, dtype="uint8")


def batch_of(texts):
    return pa.record_batch([pa.array(["en"] * len(texts)), pa.array([t.encode() for t in texts]), pa.array([0] * len(texts), pa.int32())], names=["lang", "text", "carried"])


def run(texts, length, full):
    batch = batch_of(texts)
    own = phrases.Pass(length, 5, 200, full, full)
    counts = Counter()
    for found in own.run(iter([batch])):
        for r in found.to_pylist():
            if r["phrase"] is not None:
                counts[r["phrase"]] += r["n"]
    return counts, own.buckets


def test_bucket_counts_reach_what_the_phrases_do():
    """The sum of a bucket, stopped at the least count, is at least each of its phrases', stopped there."""
    texts = sentences(3, 60)
    own = phrases.Pass(1, 5, 50, None, None)
    batch = batch_of(texts)
    list(own.run(iter([batch])))
    full = np_ones()
    for r in (r for b in phrases.Pass(2, 5, 50, full, full).run(iter([batch])) for r in b.to_pylist()):
        if r["phrase"] is not None:
            assert own.buckets[(r["hash"] % 2**64) >> (64 - phrases.BITS)] >= min(r["n"], 50)


def test_pruning_leaves_few_phrases_to_count(spark):
    """Phrases whose bucket stays below the least count are not passed on."""
    random.seed(1)
    texts = [" ".join(f"w{random.randrange(3000)}" for _ in range(200)) + " often seen phrase" for _ in range(60)]
    batch = batch_of(texts)
    first = phrases.Pass(1, 5, 50, None, None)
    list(first.run(iter([batch])))
    allowed = phrases.np.packbits(first.buckets >= 50, bitorder="little")
    held = [r for b in phrases.Pass(2, 5, 50, allowed, np_ones()).run(iter([batch])) for r in b.to_pylist() if r["phrase"]]
    assert {"often seen", "seen phrase"} <= {r["phrase"] for r in held} and len(held) < 20


def test_empty_table(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == set()
    assert mined(documents(spark, [None, "", " . "])) == set()
