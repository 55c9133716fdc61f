"""Text functions on long runs, which must take time linear in the text, and against plain versions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import articles as A


def values(spark, texts, function):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("t"))).collect()]


LONG = ["a" * 300_000, "a" * 300_000 + "@x.com", "@" + "b" * 300_000, " " * 100_000 + "x" + " " * 100_000 + "y" + " " * 100_000, "x" + " \t" * 100_000 + "y\n", "a@b" * 50_000, "a.b-" * 100_000 + "@", "1" * 300_000]


@pytest.mark.parametrize("function", [T.has_structured, T.has_residue, T.sanitised_error, T.trimmed, T.normalised, T.anonymised, T.anonymised_question, T.has_private_data, T.sanitised_query], ids=lambda f: f.__name__)
def test_long_runs_take_seconds(spark, function):
    spark.range(1).count()
    began = time.time()
    assert len(values(spark, LONG, function)) == len(LONG)
    assert time.time() - began < 30


def pieces(seed, n=400):
    r = random.Random(seed)
    parts = ["a@b.com", "x.y+z", "@", ".", "_", "-", "ab", "c.org", " ", "\t", "\n", " ", "1", "%", "é", "a@b", ".co"]
    return ["".join(r.choices(parts, k=r.randrange(0, 14))) for _ in range(n)]


def test_addresses_equal_the_plain_pattern(spark):
    texts = pieces(1)
    plain = re.compile(T.EMAIL)
    assert values(spark, texts, lambda c: F.regexp_replace(c, T.EMAIL_SEARCH, "[email]")) == [plain.sub("[email]", t) for t in texts]
    assert values(spark, texts, lambda c: c.rlike(T.EMAIL_SEARCH)) == [bool(plain.search(t)) for t in texts]


def test_trimming_equals_the_plain_pattern(spark):
    texts = [*pieces(2), " \n\t ", "x \n", "x \n "]
    blank = "\x09\x0a\x0b\x0c\x0d  "
    assert values(spark, texts, T.trimmed) == [t.strip(blank) for t in texts]


def test_a_line_separator_at_the_end_stays(spark):
    texts = ["x \u2028", "x \u0085", " \u2029 ", None]
    assert values(spark, texts, T.trimmed) == ["x \u2028", "x \u0085", "\u2029", None]


def test_private_data_equals_the_plain_patterns(spark):
    r = random.Random(3)
    parts = ["1234-5678", "12345", "-", "RTN", "rtn", ": ", "#", "DNI", "dni ", "1" * 13, "1" * 14, " ", "x", "_", "é", "[Cliente_Anonimo", "[Empresa_Anónimo", "Telefono_Oculto", "Expediente_Anonimizado]", "\n"]
    texts = ["".join(r.choices(parts, k=r.randrange(0, 6))) for _ in range(1500)]
    got = values(spark, texts, T.has_private_data)
    assert got == values(spark, texts, lambda c: c.rlike(T.CONTAMINATED) | c.rlike("(?i)" + T.PRIVATE)) and 300 < sum(got) < 1200


def test_a_control_character_begins_no_article(spark):
    df = spark.createDataFrame([(1, "ARTICULO 1.- uno \u0001 dos\nARTICULO 2.- tres\u0001")], "i int, text string")
    got = A.segmented(df).orderBy("seq").collect()
    assert [(r["num_articulo"], r["contenido"]) for r in got] == [("1", "ARTICULO 1.- uno   dos"), ("2", "ARTICULO 2.- tres")]
