from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import vectors as V


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_article_numbers(spark):
    asked = ["artículo 12 del código", "art. 7", "art 9", "ARTÍCULO 30", "arte 5", "sin número", None]
    assert values(spark, asked, T.article_number) == ["12", "7", "9", "30", None, None, None]


def test_instrument_prefers_procedural_codes(spark):
    asked = ["código procesal penal", "Código Penal", "el CPP", "código de familia", "nada"]
    assert values(spark, asked, lambda c: T.first_match(c, T.INSTRUMENTS)) == ["CODIGO_PROCESAL_PENAL", "CODIGO_PENAL", "CODIGO_PROCESAL_PENAL", "CODIGO_FAMILIA", None]


def test_contamination_is_case_sensitive(spark):
    assert values(spark, ["[Cliente_Anónimo]", "[Empresa_Anonimo]", "Telefono_Oculto", "[cliente_anónimo]", None], T.contaminated) == [True, True, True, False, False]


def test_anonymising_runs_in_order(spark):
    text = "id 1234567890123 tel 2234-5678 a.b@c.hn RTN: 12345678901234 Exp. 123-456"
    assert values(spark, [text], T.anonymised) == ["id [DNI] tel [TELEFONO] [EMAIL] [RTN] [EXPEDIENTE]"]
    assert values(spark, [text, "nada", None], T.has_structured) == [True, False, False]


def test_normalised_text(spark):
    assert values(spark, ["a  \r\n\n\n\nb\nPágina 3 de 9\nc \n"], T.normalised) == ["a\n\nb\n\nc"]


def test_routes(spark):
    asked = ["hola", "cuál es el plazo de apelación", "qué dice el código penal sobre eso", "el plazo según el artículo 5", "una consulta cualquiera larga"]
    assert values(spark, asked, lambda c: T.route(c, F.lit("chat"))) == ["D", "A", "B", "C", "A"]
    assert values(spark, asked[4:], lambda c: T.route(c, F.lit("analisis"))) == ["C"]
    assert values(spark, asked[1:2], lambda c: T.route(c, F.lit("sala_ia"))) == ["D"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    unit, none = [r[0] for r in df.select(V.l2_normalised(F.col("v"))).collect()]
    assert [round(x, 6) for x in unit] == [0.6, 0.8] and none == [0.0, 0.0]
    assert df.select(V.cosine_similarity(F.col("v"), V.vector([3, 4]))).collect()[1][0] is None


def test_seeded_vectors_depend_on_the_text_alone(spark):
    a, b, c = values(spark, ["x", "x", "y"], lambda t: V.seeded_vector(t, 8))
    assert a == b != c and abs(sum(x * x for x in a) - 1) < 1e-9
