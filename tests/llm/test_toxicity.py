import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import toxicity
from tests.llm.helpers import ODD, SCHEMA, documents

SF_DIR = "/root/testdata/sf0.1"


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def own_grams(text):
    own = f" {' '.join((text or '').lower().split())} "
    return {own[i : i + k] for k in toxicity.ORDERS for i in range(len(own) - k + 1)}


def bucket_of(gram):
    """The bucket of a single n-gram, as the first one of a text made of it alone."""
    at, bucket = toxicity.grams([gram])
    return int(bucket[sum(len(gram) - k + 1 for k in toxicity.ORDERS if k < len(gram))])


def plain(texts):
    return [{bucket_of(g) for g in own_grams(t)} for t in texts]


def found(texts, wanted=None):
    out = [set() for _ in texts]
    for first, n, at, bucket in toxicity.features(texts, wanted):
        assert len(set(zip(at.tolist(), bucket.tolist(), strict=True))) == len(at) and (not len(at) or at.max() < n)
        for a, b in zip(at.tolist(), bucket.tolist(), strict=True):
            out[first + a].add(b)
    return out


def test_features_equal_plain_sets(monkeypatch):
    random.seed(4)
    texts = [None, "", " \n", "a", "abc", "Ünïcödé 日本語 𝔘 X", *("".join(random.choices("ab é\t𝔘", k=random.randint(0, 90))) for _ in range(60)), None]
    want = plain(texts)
    for chunk in (7, 40, 500_000):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert found(texts) == want
        some = np.zeros(1 << toxicity.BITS, dtype=bool)
        some[list(set().union(*want))[::3]] = True
        assert found(texts, some) == [{b for b in w if some[b]} for w in want]


def sentence(seed, bad=0):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeinorst", k=r.randint(2, 8))) for _ in range(r.randint(5, 60))]
    for _ in range(bad):
        words.insert(r.randrange(len(words)), r.choice(["grobnik", "Vlostra", "pestulant"]))
    return " ".join(words)


def learned(spark, n=300):
    texts = [(i, sentence(i, 2 if i % 4 == 0 else 0)) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)], "doc_id long, toxic int")
    return documents(spark, texts), labels


def test_learned_words_are_found_in_other_texts(spark):
    model = toxicity.fit(*learned(spark))
    new = [(1000 + i, sentence(5000 + i, 1 if i % 2 else 0)) for i in range(100)] + [(2000, sentence(77) + " " + "quiet " * 200_000 + "vlostra"), (2001, "quiet " * 200_000)]
    got = {r["doc_id"]: r for r in toxicity.score(documents(spark, new, extra=True), model).collect()}
    wrong = [i for i in range(100) if got[1000 + i]["predicted"] != i % 2]
    assert len(wrong) <= 4 and got[2000]["predicted"] == 1 and got[2001]["predicted"] == 0
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_scores_are_the_sums_of_the_table(spark):
    model = toxicity.fit(*learned(spark))
    texts = [*ODD, sentence(3, 2)]
    got = toxicity.score(documents(spark, [*texts, *texts]), model).collect()
    assert len(got) == 2 * len(texts)
    want = [1 / (1 + math.exp(-(model.bias + sum(float(model.table[b]) for b in own)))) for own in plain(texts)]
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert all(abs(by_id[i + k * len(texts)] - w) < 1e-6 for i, w in enumerate(want) for k in (0, 1))


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = learned(spark)
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert np.allclose(a.table, b.table, atol=1e-6) and abs(a.bias - b.bias) < 1e-6


def test_ratios_are_the_textbook_ones(spark):
    docs, labels = learned(spark, 120)
    rows, totals = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 1000)
    rows = rows.collect()
    assert sum(totals.values()) == len(rows) == sum(not held_out(i) for i in range(120))
    counts = spark.createDataFrame(list(toxicity.counted(iter([toxicity.pa.record_batch([toxicity.pa.array([r["label"] for r in rows]), toxicity.pa.array([r["text"] for r in rows])], names=["label", "text"])])))[0].to_pandas())
    p, q = Counter(), Counter()
    for r in rows:
        for b in plain([r["text"]])[0]:
            (p if r["label"] else q)[b] += 1
    every = p.keys() | q.keys()
    np_, nq = sum(p[b] + 1 for b in every), sum(q[b] + 1 for b in every)
    for b, r in toxicity.ratios(counts, 500):
        assert abs(r - math.log((p[b] + 1) / np_ / ((q[b] + 1) / nq))) < 1e-9 and p[b] + q[b] >= 3


def test_a_bound_on_training_rows_keeps_the_share_of_labels(spark):
    docs, labels = learned(spark, 400)
    model = toxicity.fit(docs, labels, most_rows=60)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.9 * len(got)


@pytest.mark.parametrize(("kept", "want"), [("toxic = 1", 1), ("toxic = 0", 0), ("false", 0)])
def test_labels_of_one_kind_or_none(spark, kept, want):
    docs, labels = learned(spark, 40)
    got = toxicity.score(docs, toxicity.fit(docs, labels.where(kept))).collect()
    assert len(got) == 40 and {r["predicted"] for r in got} == {want}


def test_nulls_repeats_and_an_empty_table(spark):
    docs, labels = learned(spark)
    odd = labels.union(spark.createDataFrame([(None, 1), (1, None), (2, 7), (4, 1), (9999, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(docs, odd)
    got = toxicity.score(documents(spark, [(None, "vlostra vlostra"), (None, None), (5, ""), (5, "")]), model).collect()
    assert sorted(r["predicted"] for r in got) == [0, 0, 0, 1] and [r["held_out"] for r in got if r["doc_id"] is None] == [True, True]
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_held_out_accuracy_on_the_given_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit >= 0.8 * sum(r["toxic"] for r in got) and hit >= 0.95 * sum(r["predicted"] for r in got)
