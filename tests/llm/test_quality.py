import math
import random
import re
from collections import Counter

from scriptorium.llm import quality
from tests.llm.helpers import ODD, SCHEMA, documents, words


def base(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if words(line)]
    n_symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), n_symbols, len(lines) - len(set(lines)), len(covered), failed


def judged(spark, texts, **options):
    got = quality.judge(documents(spark, texts, **options)).collect()
    return {r["doc_id"]: r for r in got}


def test_base_counts_equal_a_plain_count(spark):
    random.seed(9)
    texts = [*ODD, "a b c a b c d", "x\nx\n\nx \n", "a\x0bb\x0cc\x1cd", *(" ".join(random.choices("ab cd # $ \n", k=random.randint(0, 150))) for _ in range(150))]
    got = judged(spark, texts, extra=True)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t), t
        assert not (r["base_failed"] and r["kept"])


def sentence(seed, n):
    r = random.Random(seed)
    own = quality.COMMON["en"]
    return " ".join(r.choice(own) if r.random() < 0.4 else "".join(r.choices("abcdeinorst", k=r.randint(2, 9))) for _ in range(n))


def test_divergent_documents_go_and_clean_ones_stay(spark):
    texts = [sentence(i, 120 + i) for i in range(60)]
    texts += [" ".join(w + "###" for w in sentence(99, 150).split()), sentence(98, 200).upper(), " ".join("%d" % (i * 7919) for i in range(200))]
    df = documents(spark, texts).selectExpr("doc_id", "text", "'en' as lang", "source", "n_chars")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 63))


def test_distance_is_the_textbook_one(spark):
    df = spark.createDataFrame([([3.0, 1.0, 0.0], [1.0, 1.0, 2.0])], "a array<double>, b array<double>")
    p, q = [0.75, 0.25, 0.0], [0.25, 0.25, 0.5]
    half = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / m) for a, m in zip(x, half, strict=True) if a)
    got = df.select(quality.js_distance(df["a"].cast("array<bigint>"), df["b"].cast("array<bigint>"))).first()[0]
    assert abs(got - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def test_filtered_keeps_columns(spark):
    df = documents(spark, [sentence(1, 200), None, "short"], extra=True)
    got = quality.filtered(df)
    assert got.columns == df.columns and [r["doc_id"] for r in got.collect()] == [0]


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
