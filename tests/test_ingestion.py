"""Ingestion rules one by one, whole codes against a plain parser, contributions, templates and what else the queries do not reach."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scriptorium.functions import text as T
from scriptorium.functions import vectors as V
from scriptorium.operators import articles as A
from scriptorium.operators import corpus as C
from scriptorium.operators import ledger as L
from scriptorium.operators import retrieval as R
from scriptorium.operators import writes as W
from scriptorium.streaming import alerts

TEXT = "ARTICULO 1.- Uno y dos.\nARTICULO 2.- Tres y cuatro."
GOOD = {"norm_id": "n", "texto": TEXT, "url": "u", "autoridad": "a", "decreto": "d", "publicacion": "p", "materia": "m", "estado": "vigente", "responsable": "r", "checksum": "", "approved_by": "x"}
CASES = [
    ({}, None, 16), ({"texto": "  "}, "no_text", 1), ({"texto": None}, "no_text", 1), ({"decreto": " "}, "manifest_incomplete", 3), ({"estado": "otro"}, "state_unknown", 3), ({"checksum": "bad"}, "checksum", 3),
    ({"texto": "sin articulos"}, "no_articles", 6), ({"texto": TEXT + "\nARTICULO 2.- Otra vez."}, "repeated_numbers", 8), ({"texto": TEXT + "\nARTICULO 3.- conocido"}, "known_content", 8),
    ({"texto": TEXT + "\nARTICULO 3.- llame al 2234-5678"}, "private_data", 10), ({"texto": TEXT + "\nARTICULO 3.- [Cliente_Anónimo]"}, "private_data", 10), ({"approved_by": None}, "not_approved", 15),
]


def test_each_rule_rejects_exactly_its_package(spark):
    rows = []
    for i, (change, _, _) in enumerate(CASES):
        row = GOOD | {"norm_id": f"n{i}"} | change
        row["checksum"] = row["checksum"] or hashlib.sha256((row["texto"] or "").encode()).hexdigest()
        rows.append(tuple(row[k] for k in GOOD))
    packages = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in GOOD))
    known = spark.createDataFrame([(hashlib.sha256(b"ARTICULO 3.- conocido").hexdigest(),)], "hash string")
    articles = C.package_articles(packages)
    rejected = C.first_rejection(C.rules(packages, articles, known))
    assert {r["norm_id"]: r["rejected_by"] for r in rejected.collect()} == {f"n{i}": c[1] for i, c in enumerate(CASES)}
    steps = {}
    for r in C.step_log(rejected).collect():
        steps.setdefault(r["norm_id"], []).append((r["number"], r["result"]))
    for i, (_, reason, last) in enumerate(CASES):
        assert sorted(steps[f"n{i}"]) == [*((k, "ok") for k in range(1, last)), (last, "rejected" if reason else "ok")]
    lines = [json.loads(r["line"]) for r in C.jsonl(rejected, articles).collect()]
    assert {x["norm_id"] for x in lines} == {"n0", f"n{len(CASES) - 1}"} and set(lines[0]) == {"norm_id", "num_articulo", "contenido", "decreto", "materia", "autoridad", "estado", "hash"}


def test_a_second_matter_is_mixed(spark):
    row = GOOD | {"checksum": hashlib.sha256(TEXT.encode()).hexdigest()}
    packages = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in GOOD))
    seen = spark.createDataFrame([("n", "m"), ("n", "other")], "norm_id string, materia string")
    ruled = C.rules(packages, C.package_articles(packages), spark.createDataFrame([], "hash string"), seen)
    assert C.first_rejection(ruled).first()["rejected_by"] == "mixed_matters"


def plain_code(text):
    heads = [(int(m[1]), m.start(), m.end()) for m in re.finditer(r"(?m)^\s*Art[íi]culo\s+(\d+)\s*\.\s*[-–—]?", text)]
    first = next((i for i, h in enumerate(heads) if h[0] == 1), len(heads))
    kept, last = [], 0
    for h in heads[first:]:
        if last < h[0] <= last + 5:
            kept.append(h)
            last = h[0]
    out = []
    if not kept:
        return out
    for h, after in zip(kept, [*kept[1:], (0, len(text), 0)], strict=True):
        body = text[h[2] : after[1]]
        m = re.match(r"\s*([A-ZÁÉÍÓÚÑÜ][A-ZÁÉÍÓÚÑÜ\s,;/().\-]{3,120}?)\.\s", body)
        words = re.sub(r"\s+", " ", body[m.end() :] if m else body).strip()
        if len(words) >= 20:
            out.append((h[0], m[1].strip() if m else None, words))
    return out


TEXTS = [
    "Artículo 7.- antes\nArtículo 1.- DE LA LEY. Esta ley rige desde hoy mismo.\nArtículo 9.- cita lejana en el cuerpo\nArtículo 3. Otra disposición bastante larga aquí.",
    "Artículo 1.- corto\n Artículo 2 . – TÍTULO CON Ü, (BIS) I/II.\nTexto del segundo artículo, largo.\nArtículo 2.- repetido dentro del cuerpo", "sin artículos", "", None, "Artículo 2.- nunca empieza aquí el código entero",
]


def test_whole_codes_equal_a_plain_parser(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc int, text string")
    got = sorted(((r["doc"], r["num"], r["epigraph"], r["text"]) for r in A.code_articles(df).collect()), key=str)
    assert got == sorted(((i, *row) for i, t in enumerate(TEXTS) for row in plain_code(t or "")), key=str) and len(got) == 3


def test_ingesting_a_code_twice_adds_nothing(spark):
    codes = spark.createDataFrame([(TEXTS[0],)], "text string")
    options = {"code": "CPC", "decree": "D.1", "matter": "02_CIVIL", "source": "S", "prefix": "cpc_"}
    none = spark.createDataFrame([], "id string")
    rows = A.ingest_code(none, codes, "normas", V.SeededProvider(8), **options)
    got = {r["id"]: r for r in rows.collect()}
    assert sorted(got) == ["normas:cpc_a0001_c00", "normas:cpc_a0003_c00"]
    one = got["normas:cpc_a0001_c00"]
    assert one["contenido"].startswith("Artículo 1 CPC (D.1) — DE LA LEY. Esta ley") and json.loads(one["metadata"])["epigrafe"] == "DE LA LEY" and len(one["embedding"]) == 8
    assert A.ingest_code(rows.select("id"), codes, "normas", V.SeededProvider(8), **options).count() == 0


def test_providers_agree_with_the_expression(spark):
    texts = ["", "hola", "é\U0001d518x", None, "x" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = V.embedded(df, "t", V.SeededProvider(384), batch=2).withColumn("own", V.seeded_vector(F.col("t"), 384)).orderBy("i").collect()
    for r in got:
        assert (r["embedding"] is None) == (r["t"] is None)
        if r["t"] is not None:
            assert len(r["own"]) == 384 and max(abs(a - b) for a, b in zip(r["embedding"], r["own"], strict=True)) < 1e-12


def test_contributions_are_recorded_and_approved_ones_indexed(spark):
    long = "Nota sobre el plazo de apelación. " * 5
    docs = spark.createDataFrame([(1, long, None, "nota"), (2, "corta", None, "nota"), (3, long + " DNI 0801199012345", "01", "nota"), (4, long, None, "nota"), (5, "x" * 100_001, None, "nota")], "doc_id int, content string, materia string, tipo_documento string")
    verdicts = spark.createDataFrame([(1, 0.9, True, False, "02"), (3, 0.9, True, False, "02")], "doc_id int, score double, legit boolean, third boolean, inferred string")
    rows = C.contributions(docs, verdicts, auto_approve=True)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert [got[i]["error"] for i in range(1, 6)] == [None, "too_short", None, None, "too_long"]
    assert [got[i]["decision"] for i in range(1, 6)] == ["aprobado", None, "en_revision", "en_revision", None]
    assert got[1]["materia"] == "02" and got[3]["materia"] == "01" and "[DNI]" in got[3]["anonymised"]
    chunks = C.contribution_chunks(rows, V.SeededProvider(4)).collect()
    assert [r["id"] for r in chunks] == ["1:000"] and len(chunks[0]["embedding"]) == 4


def test_routes_search_their_collections(spark):
    rows = [(f"{c}{i}", c, m, [1.0, i / 10], i % 2 == 0, "[Cliente_Anonimo]" if i == 1 else "texto") for c in ("normativos", "procedimental") for i in range(8) for m in ("01_PENAL" if i < 4 else "02_CIVIL",)]
    corpus = spark.createDataFrame(rows, "id string, coleccion string, materia string, embedding array<double>, es_norma_vigente boolean, contenido string")
    found = lambda *a, **k: [(r["pass"], r["id"][:5]) for r in R.route_search(corpus, [1.0, 0.0], *a, **k).collect()]
    assert {x for x in found("A")} == {(1, "proce")} and {x for x in found("B")} == {(1, "norma")} and {x for x in found("C")} == {(1, "norma"), (2, "proce")} and found("D") == []
    penal = R.route_search(corpus, [1.0, 0.0], "A", criminal=True).collect()
    assert penal and {(r["coleccion"], r["materia"]) for r in penal} == {("normativos", "01_PENAL")} and not any("Cliente" in r["contenido"] for r in penal)


def test_long_deltas_are_whole_and_the_last_usage_wins(spark):
    long = "x" * 1_200_000
    lines = [json.dumps({"delta": long, "usage": {"n": 1}}), json.dumps({"delta": "y"}), json.dumps({"usage": {"n": 2}})]
    df = spark.createDataFrame([("k", i, f"data: {x}\n") for i, x in enumerate(lines)], "k string, s int, c string")
    got = alerts.joined_deltas(df, "k", "s", "c").first()
    assert got["text"] == long + "y" and json.loads(got["usage"]) == {"n": 2}


def test_progress_is_that_of_the_first_stage(spark):
    rows = [("u", 1, "starts", None), ("u", 2, "Tavily searches", {"eventType": "FINDING_DISCOVERED"}), ("u", 3, "Claude", {"eventType": "RESOLUTION_RECOMMENDED"}), ("v", 1, "nothing", None)]
    df = spark.createDataFrame(rows, "k string, s int, message string, metadata map<string,string>")
    got = {r["k"]: (r["progress"], r["findings"], r["resolutions"]) for r in alerts.console(df, "k", "s").collect()}
    assert got == {"u": (60, 1, 1), "v": (20, 0, 0)}


@pytest.mark.parametrize(
    "changes,decision",
    [({}, "activated"), ({"since_ms": 9_999}, "throttled"), ({"since_ms": 10_000}, "activated"), ({"provider_sub_id": None}, "nothing_linked"), ({"requested_id": "other"}, "reconciliation_required"), ({"status": "active"}, "already_active"),
     ({"outcome": "plan_mismatch"}, "plan_mismatch"), ({"reason": "duplicate_active_subscription"}, "duplicate_active_subscription"), ({"reason": None}, "pending")],
)
def test_manual_checks(spark, changes, decision):
    row = {"requested_id": "S", "provider_sub_id": "S", "status": "pending", "outcome": "verified", "reason": "updated", "since_ms": None} | changes
    df = spark.createDataFrame([tuple(row.values())], "requested_id string, provider_sub_id string, status string, outcome string, reason string, since_ms int")
    assert L.manual_checks(df).first()["decision"] == decision


def test_reconciled_agrees_for_any_reason(spark):
    subs = spark.createDataFrame([("a", "S1", "pro", "cancelled"), ("b", "S2", "pro", "active"), ("c", "S3", "pro", "active"), ("d", "S4", "pro", "active")], "user_identifier string, provider_sub_id string, tier string, status string")
    answers = spark.createDataFrame(
        [("S1", 200, "S1", "ACTIVE", "other", "a"), ("S2", 200, "S2", "ACTIVE", "other", "b"), ("S3", None, None, None, None, None), ("S4", 200, "S9", "ACTIVE", "pro", "d")], "sub_id string, http int, answered_id string, status string, plan_tier string, custom_uid string"
    )
    got = {r["user_identifier"]: (r["outcome"], r["action"]) for r in L.reconciled(subs, answers).collect()}
    assert got == {"a": ("plan_mismatch", "match"), "b": ("plan_mismatch", "manual_review"), "c": ("provider_error", "retry_later"), "d": ("id_mismatch", "manual_review")}


def test_small_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(T.is_uuid4(lit("12345678-9ABC-4def-89ab-0123456789ab"))) and not one(T.is_uuid4(lit("12345678-9abc-1def-89ab-0123456789ab"))) and not one(T.is_uuid4(lit(None).cast("string")))
    assert one(T.bare_email(lit("ana@x.hn"))) == "an***@x.hn" and one(T.bare_email(lit("ana"))) == "***" and one(T.bare_email(lit(None).cast("string"))) == "(none)"
    assert one(T.project_reference(lit("https://abcdefghij.supabase.co"))) == "abcde…ghij" and one(T.project_reference(lit(None).cast("string"))) == "no_url"
    assert one(T.bare_error(lit("at https://a.b/c?d " + "k" * 30))) == "at [url] [tok]"
    meta = F.create_map(lit("a"), lit("None"), lit("b"), lit("\x00val" + "x" * 300))
    assert one(T.first_key(meta, ("a", "z", "b"))) == "val" + "x" * 196 and one(T.first_key(meta, ("a", "z"))) is None
    assert json.loads(one(T.faq(lit("q?"), lit("x" * 400))))["mainEntity"][0]["acceptedAnswer"]["text"] == "x" * 320 + T.MORE


def test_feedback_takes_and_refuses(spark):
    good = "12345678-9abc-4def-89ab-0123456789ab"
    taken, refused = W.feedback(spark.createDataFrame([(good, "true", "  c " * 400), (good, None, "c"), ("x", "false", None), (good, "false", None)], "consulta_id string, util string, comentario string"))
    assert sorted((r["util"], len(r["comentario"] or "")) for r in taken.collect()) == [(False, 0), (True, 500)]
    assert sorted(r["reason"] for r in refused.collect()) == ["bad_flag", "bad_id"]


def test_texts_are_cut_once_for_jsonl_and_not_shuffled_for_the_rules(spark):
    plan = lambda name: entry.queries()[name](spark, entry.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan("ingest_jsonl")
    assert lines.count("posexplode") == 0 and lines.count("Relation [norm_id") == 2
    above = plan("ingest_rules").split("Join")[0]
    assert "checksum_matches" in above and "sha2" not in above and "texto" not in above
