"""Corpus loads, ingestion rules, review, moderation and the keyword analyser."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import vectors as V
from scriptorium.operators import articles as A
from scriptorium.operators import charges as H
from scriptorium.operators import corpus as C
from scriptorium.plans.registry import query
from scriptorium.plans.text_queries import FLAG, NORMAL
from scriptorium.sources.scratch import stored
from scriptorium.sources.views import table, view


@query("select coleccion, count(*) as n from corpus group by coleccion", "corpus")
def corpus_count_by_collection(spark, d):
    return view(spark, d, "corpus").groupBy("coleccion").agg(F.count("*").alias("n"))


@query(
    """select coalesce(l.coleccion, r.coleccion) as coleccion, coalesce(l.n, 0) as here, coalesce(r.n, 0) as loaded, coalesce(r.n, 0) >= coalesce(l.n, 0) as complete
       from (select coleccion, count(*) as n from corpus group by 1) l full join (select coleccion, count(*) as n from corpus where not es_norma_vigente or coleccion = 'c1' group by 1) r on r.coleccion = l.coleccion""",
    "corpus",
)
def corpus_load_completeness(spark, d):
    corpus = view(spark, d, "corpus")
    return C.completeness(corpus, corpus.where("not es_norma_vigente or coleccion = 'c1'"), "coleccion")


@query(
    """select coleccion, n as missing from (select coleccion, unnest(range(1, max(vec_id) + 1)) as n from corpus group by coleccion) s
       where not exists (select 1 from corpus c where c.coleccion = s.coleccion and c.vec_id = s.n)""",
    "corpus",
)
def corpus_sequence_gaps(spark, d):
    return C.gaps(view(spark, d, "corpus"), "coleccion", "vec_id")


@query("select source, count(*) as total, count(*) filter (lang = 'en') as pending, count(*) - count(*) filter (lang = 'en') as done, cast(round(100.0 * (count(*) - count(*) filter (lang = 'en')) / count(*)) as int) as percent from documents group by source")
def completion_report(spark, d):
    return C.completion(table(spark, d, "documents"), "source", F.col("lang") == "en")


@query("select count(*) as n, count(*) filter (vec_id between 100 and 199) as in_range, max(vec_id) as most from corpus", "corpus")
def range_count(spark, d):
    return view(spark, d, "corpus").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id").between(100, 199)).alias("in_range"), F.max("vec_id").alias("most"))


@query(
    """select coalesce(d.source, e.source) as source, coalesce(n, 0) as n, coalesce(expected, 0) as expected from (select source, count(*) as n from documents group by source) d
       full join (select source, count(*) as expected from documents where lang <> 'de' group by source union all select 'absent', 3) e on e.source = d.source where coalesce(n, 0) <> coalesce(expected, 0)"""
)
def count_verification(spark, d):
    """Sources whose number of rows is not the one that a manifest expects; the manifest knows no German ones, and one source too many."""
    docs = table(spark, d, "documents")
    expected = docs.where("lang <> 'de'").groupBy("source").agg(F.count("*").alias("expected")).union(spark.range(1).selectExpr("'absent'", "3L"))
    return C.unexpected_counts(docs, "source", expected)


@query(
    """select id, coleccion from corpus where coleccion in (select coleccion from (select coleccion, count(*) as n, count(*) filter (not es_norma_vigente or coleccion = 'c1') as loaded from corpus group by 1) where loaded < n)""",
    "corpus",
)
def resume_load(spark, d):
    corpus = view(spark, d, "corpus")
    return C.to_load(corpus, corpus.where("not es_norma_vigente or coleccion = 'c1'"), "coleccion").select("id", "coleccion")


@query(
    """select 'lib:' || doc_id as id, case when doc_id % 2 = 0 then '01' end as materia, substr(coalesce(text, ''), 1, 8000) as contenido, case when doc_id % 4 = 1 then null when doc_id % 4 = 2 then source else 'a' || doc_id end as num_articulo
       from documents"""
)
def library_rows(spark, d):
    """Chunks of a vector store with metadata of different shapes, as rows of the library."""
    key = F.col("doc_id").cast("string")
    meta = F.when(F.col("doc_id") % 4 == 1, F.lit(None)).otherwise(
        F.map_from_arrays(F.array(F.lit("materia"), F.lit("articulo"), F.lit("num")), F.array(F.when(F.col("doc_id") % 2 == 0, "01"), F.when(F.col("doc_id") % 4 == 2, "None").otherwise(F.concat(F.lit("a"), key)), F.col("source")))
    )
    rows = table(spark, d, "documents").select(key.alias("chunk_id"), F.col("text").alias("document"), meta.alias("metadata"), F.array(F.lit(1.0)).alias("embedding"))
    return C.library_rows(rows, "lib", ("articulo", "num"), ("fuente",)).select("id", "materia", "contenido", "num_articulo")


LETTER = 'Here: {"tipo_instrumento": "demanda", "titulo": "T", "contenido_plantilla": "Yo, {{nombre}}", "variables": ["nombre"]} end'
PHONE = 'Here: {"tipo_instrumento": "demanda", "titulo": "T", "contenido_plantilla": "llame al 2234-5678", "variables": ["a"]}'


@query(
    """select doc_id, error, case when error is null then 'Yo, {{nombre}}' end as contenido_plantilla, error is null as verificado_sin_pii from (
        select doc_id, case when length(regexp_replace(coalesce(text, ''), '^[\\s ]+|[\\s ]+$', '', 'g')) < 80 then 'too_short' when doc_id % 4 = 0 then 'failed' when doc_id % 4 = 1 then 'private_data' end as error from documents)"""
)
def template_generation(spark, d):
    """Originals whose model answered with no object, with a telephone number left in it, or with a clean template."""
    docs, kind = table(spark, d, "documents"), F.col("doc_id") % 4
    answers = docs.select("doc_id", F.when(kind == 0, "no object").when(kind == 1, PHONE).otherwise(LETTER).alias("answer"))
    return C.generated_templates(docs.select("doc_id", "text"), answers, "doc_id").select("doc_id", "error", "contenido_plantilla", "verificado_sin_pii")


RECORD = f"""(select doc_id, text, case when length(regexp_replace(text, '^[\\s ]+|[\\s ]+$', '', 'g')) < 100 then 'too_short' when length(text) > 100000 then 'too_long' end as error, ({FLAG}) as found,
    case when doc_id % 10 = 9 or doc_id % 13 = 0 then null else (doc_id % 10) / 10.0 end as score, doc_id % 8 <> 0 and doc_id % 13 <> 0 as legit, doc_id % 12 = 1 and doc_id % 13 <> 0 as third, case when doc_id % 3 = 0 then '01' when doc_id % 13 <> 0 then '02' end as materia from uploads)"""


def contributions(spark, d):
    docs = view(spark, d, "uploads").select("doc_id", F.col("text").alias("content"), F.when(F.col("doc_id") % 3 == 0, "01").alias("materia"), F.lit("nota").alias("tipo_documento"))
    verdicts = docs.where("doc_id % 13 <> 0").select("doc_id", F.expr("case when doc_id % 10 <> 9 then (doc_id % 10) / 10.0 end").alias("score"), F.expr("doc_id % 8 <> 0").alias("legit"), F.expr("doc_id % 12 = 1").alias("third"), F.lit("02").alias("inferred"))
    return C.contributions(docs, verdicts, auto_approve=True)


@query(
    f"""select doc_id, error, case when error is null then materia end as materia, case when error is null then (found or (third and score is not null)) end as pii,
        case when error is not null then null when score is null then 'en_revision' when not legit then 'rechazado' when found or third or score < 0.6 then 'en_revision' else 'aprobado' end as decision from {RECORD}""",
    "uploads",
)
def community_ingest(spark, d):
    """Contributions: what is refused by its length, and the record and decision of the rest."""
    return contributions(spark, d).select("doc_id", "error", "materia", "pii", "decision")


@query()
def community_chunks(spark, d):
    """The chunks that approved contributions add to the index, with vectors of the fake provider."""
    return C.contribution_chunks(contributions(spark, d), V.SeededProvider(16))


@query("select num_articulo, row_number() over (order by cast(num_articulo as int)) as place from editorial", "editorial")
def numeric_key_sort(spark, d):
    """The keys of the manifest in numeric, not alphabetic, order."""
    return C.numeric_places(view(spark, d, "editorial").select("num_articulo"), "num_articulo")


@query("select user_identifier, age_ms from subs order by age_ms, user_identifier limit 50", "subs")
def latest_first(spark, d):
    return view(spark, d, "subs").orderBy("age_ms", "user_identifier").limit(50).select("user_identifier", "age_ms")


@query("select a.id, exists (select 1 from articles b where b.es_norma_vigente and sha256(b.contenido) = sha256(a.contenido)) as known from articles a", "articles")
def corpus_dedupe_by_hash(spark, d):
    rows = view(spark, d, "articles")
    return C.known_by_hash(rows, rows.where("es_norma_vigente"), "contenido").select("id", "known")


@query("select fuente_tipo, num_articulo, count(*) as n from articles group by all having count(*) > 1", "articles")
def batch_duplicate_keys(spark, d):
    return C.duplicate_keys(view(spark, d, "articles"), "fuente_tipo", "num_articulo")


@query("select num_articulo, count(distinct materia) as n_matters, count(distinct materia) > 1 as mixed from articles group by num_articulo", "articles")
def mixed_matter(spark, d):
    return C.matters(view(spark, d, "articles"), "num_articulo", "materia")


@query("select num_articulo, bool_and(es_norma_vigente) as every_in_force, bool_or(fuente is null) as some_unnamed from articles group by num_articulo", "articles")
def quantifiers(spark, d):
    return view(spark, d, "articles").groupBy("num_articulo").agg(F.bool_and("es_norma_vigente").alias("every_in_force"), F.bool_or(F.col("fuente").isNull()).alias("some_unnamed"))


PARTS = f"""(select norm_id, generate_subscripts(parts, 1) - 1 as seq, unnest(list_transform(parts, lambda x: regexp_replace(x, '^[\\s ]+|[\\s ]+$', '', 'g'))) as contenido
    from (select norm_id, string_split(regexp_replace({NORMAL.replace("{x}", "texto")}, '(?im)^([ \\t]*ART[IÍ]CULO\\s+(\\d+)[.\\-:°º]*)', chr(1) || '\\1', 'g'), chr(1)) as parts from packages))"""
ARTICLES = f"(select norm_id, seq, contenido, regexp_extract(contenido, '(?i)ART[IÍ]CULO\\s+(\\d+)', 1) as num_articulo from {PARTS} where seq > 0)"
COUNTS = f"""(select norm_id, count(*) as n_articles, count(*) filter (contenido = '') as n_empty, count(*) - count(distinct num_articulo) as n_repeated, count(*) filter (num_articulo = '') as n_not_numeric,
    count(*) filter (sha256(contenido) = sha256('ARTICULO 3.- Derogado.')) as n_known,
    count(*) filter (regexp_matches(contenido, '\\[(Cliente|Empresa)_An[oó]nimo|Tel[eé]fono_Oculto|Expediente_Anonimizado\\]') or regexp_matches(contenido, '(?i)\\b\\d{{4}}-\\d{{4}}\\b|\\bRTN\\s*[:#]?\\s*\\d{{14}}\\b|\\bDNI\\s*[:#]?\\s*\\d{{13}}\\b')) as n_private
    from {ARTICLES} group by norm_id)"""
PACK = f"""(select p.*, trim(coalesce(texto, '')) <> '' as received, array_to_string(list_filter([case when trim(coalesce(autoridad, '')) = '' then 'autoridad' end, case when trim(coalesce(decreto, '')) = '' then 'decreto' end,
      case when trim(coalesce(publicacion, '')) = '' then 'publicacion' end, case when trim(coalesce(materia, '')) = '' then 'materia' end, case when trim(coalesce(estado, '')) = '' then 'estado' end,
      case when trim(coalesce(checksum, '')) = '' then 'checksum' end, case when trim(coalesce(responsable, '')) = '' then 'responsable' end], lambda x: x is not null), ',') as missing,
    estado in ('vigente', 'derogado', 'reformado', 'pendiente_verificacion') as known_state, coalesce(checksum = sha256(texto), false) as checksum_matches,
    coalesce(k.n_articles, 0) as n_articles, coalesce(k.n_empty, 0) as n_empty, coalesce(k.n_repeated, 0) as n_repeated, coalesce(k.n_not_numeric, 0) as n_not_numeric, coalesce(k.n_known, 0) as n_known, coalesce(k.n_private, 0) as n_private,
    case when first_doc % 23 = 12 then 2 else 1 end as n_matters from packages p left join {COUNTS} k on k.norm_id = p.norm_id)"""
STOPPED = """case when not received then 1 when missing <> '' or (trim(url) = '' and trim(autoridad) = '') or not known_state or not checksum_matches then 3 when n_empty > 0 or n_articles = 0 then 6
    when n_repeated > 0 or n_not_numeric > 0 or n_known > 0 then 8 when n_matters > 1 then 9 when n_private > 0 then 10 when approved_by is null then 15 end"""
REASON = """case when not received then 'no_text' when missing <> '' then 'manifest_incomplete' when not known_state then 'state_unknown' when not checksum_matches then 'checksum' when n_empty > 0 then 'empty_articles'
    when n_articles = 0 then 'no_articles' when n_repeated > 0 then 'repeated_numbers' when n_not_numeric > 0 then 'numbers_not_numeric' when n_known > 0 then 'known_content' when n_matters > 1 then 'mixed_matters'
    when n_private > 0 then 'private_data' when approved_by is null then 'not_approved' end"""
RULED = "norm_id missing known_state checksum_matches n_articles n_empty n_repeated n_not_numeric n_known n_matters n_private".split()


def package_rules(spark, d, keep=lambda articles: articles):
    """The packages' articles, as keep returns them, and what the rules look at."""
    packages = view(spark, d, "packages")
    articles = keep(C.package_articles(packages))
    hashes = spark.range(1).select(F.sha2(F.lit("ARTICULO 3.- Derogado."), 256).alias("hash"))
    other = packages.where("first_doc % 23 = 12").select("norm_id", F.lit("03_OTRA").alias("materia"))
    return articles, C.rules(packages, articles, hashes, other)


@query(f"select {', '.join(RULED)} from {PACK}", "packages")
def ingest_rules(spark, d):
    return package_rules(spark, d)[1].select(*RULED)


@query(f"select norm_id, {STOPPED} as stopped_at, {REASON} as rejected_by, ({REASON}) is null as accepted from {PACK}", "packages")
def ingest_first_rejection(spark, d):
    return C.first_rejection(package_rules(spark, d)[1]).select("norm_id", "stopped_at", "rejected_by", "accepted")


@query(
    f"""select norm_id, unnest(range(1, coalesce(stopped, 16) + 1)) as number, case when unnest(range(1, coalesce(stopped, 16) + 1)) = stopped then 'rejected' else 'ok' end as result
        from (select norm_id, {STOPPED} as stopped from {PACK})""",
    "packages",
)
def ingest_step_log(spark, d):
    return C.step_log(C.first_rejection(package_rules(spark, d)[1])).select("norm_id", "number", "result")


@query(
    f"""select a.norm_id, a.seq, json_object('norm_id', a.norm_id, 'num_articulo', num_articulo, 'contenido', contenido, 'decreto', decreto, 'materia', materia, 'autoridad', autoridad, 'estado', estado, 'hash', sha256(contenido)) as line
        from {ARTICLES} a join (select *, {STOPPED} as stopped from {PACK}) p on p.norm_id = a.norm_id where coalesce(stopped, 16) > 11""",
    "packages",
)
def ingest_jsonl(spark, d):
    articles, ruled = package_rules(spark, d, stored)
    return C.jsonl(C.first_rejection(ruled), articles)


@query(
    """select event_id, case when cast(substr(estado_destino, 2) as int) <> cast(substr(estado_origen, 2) as int) + 1 then 'not_next' when estado_destino in ('V4', 'V5') and rol not in ('abogado_revisor_senior', 'propietario_despacho') then 'role_missing'
       else 'promoted' end as outcome, estado_destino in ('V4', 'V5') as shown, estado_destino in ('V3', 'V4', 'V5') as searchable from attempts""",
    "attempts",
)
def review_transitions(spark, d):
    return C.promotions(view(spark, d, "attempts")).select("event_id", "outcome", "shown", "searchable")


VERDICT = """case when score is null then 'en_revision' when not legit then 'rechazado' when pii or third or score < 0.6 then 'en_revision' else 'aprobado' end"""
VERDICTS = f"(select doc_id, ({FLAG}) as pii, case when doc_id % 10 = 9 then null else (doc_id % 10) / 10.0 end as score, doc_id % 8 <> 0 as legit, doc_id % 12 = 1 as third from uploads)"


@query(f"select doc_id, {VERDICT} as decision, (pii or (third and score is not null)) as pii from {VERDICTS}", "uploads")
def moderation_decision(spark, d):
    rows = view(spark, d, "uploads").select(
        "doc_id", T.has_structured(F.col("text")).alias("pii"), F.when(F.col("doc_id") % 10 != 9, (F.col("doc_id") % 10) / 10.0).alias("score"), (F.col("doc_id") % 8 != 0).alias("legit"), (F.col("doc_id") % 12 == 1).alias("third")
    )
    return C.moderated(rows, auto_approve=True).select("doc_id", "decision", "pii")


SHEETS = {
    0: " solicita prisión preventiva del imputado acusado por el delito de robo, código penal, fecha hora lugar, testigo, autor, el 5 de mayo de 2020",
    1: " registro y allanamiento sin más, el 05/11/2021",
    2: " confesó el hecho; llamadas y comunicaciones",
    3: " imputado con domicilio conocido; delito de hurto tipificado en el decreto; prueba: consta; realizó; se pide; gravedad del delito; todos ellos",
    4: " gravedad del delito: imputado, dni, fecha, hora, lugar, artículo, decreto, informe, coautor, requerimiento, el 1 de enero de 2020",
    5: " imputado, dni, fecha, hora, lugar, artículo, decreto, informe, coautor, requerimiento, arraigo",
    6: "",
}
TAILS = "case doc_id % 7 " + " ".join(f"when {k} then '{v}'" for k, v in SHEETS.items()) + " end"


def present(words) -> str:
    return " + ".join(f"cast(contains(x, '{w}') as int)" for w in words)


COUNTED = "(select *, " + ", ".join(f"({present(words)}) >= {least} as {name}" for name, (least, words) in H.ELEMENTS.items()) + ", "
COUNTED += ", ".join(f"(regexp_matches(x, '{'|'.join(yes)}') and not regexp_matches(x, '{'|'.join(no)}')) as {name}" for name, (yes, no) in (H.ALERTS | H.DEFECTS).items())
COUNTED += f", not regexp_matches(t, '{H.DATED}') as undated from (select doc_id, text || {TAILS} as t, lower(text || {TAILS}) as x from documents))"
FLAGS = [*H.ELEMENTS, *H.ALERTS, *H.DEFECTS, "undated"]


@query(
    f"""select doc_id, too_short, {", ".join(f"case when not too_short then {n} end as {n}" for n in FLAGS)}, case when not too_short then missing end as missing,
        not too_short and missing = 0 and not (abstract_gravity or collective or undated) as complies,
        case when too_short then '{H.TRIAL}' when confession or search or interception then '{H.NULLITY}' when missing >= 3 then '{H.NO_ACTION}' when not facts and (not role or collective) then '{H.NULLITY}'
            when (not custody or abstract_gravity) and missing <= 1 then '{H.CUSTODY}' when undated then '{H.DISMISSAL}' else '{H.TRIAL}' end as strategy
        from (select *, length(trim(t)) < {H.SHORTEST} as too_short, {" + ".join(f"cast(not {n} as int)" for n in H.ELEMENTS)} as missing from {COUNTED})"""
)
def charge_analyser(spark, d):
    """Charge sheets: whole texts with an ending that holds the terms of one outcome."""
    sheets = table(spark, d, "documents").select("doc_id", F.concat("text", F.expr(TAILS)).alias("text"))
    return H.analysed(sheets, "text").select("doc_id", "too_short", *FLAGS, "missing", "complies", "strategy")


@query("select event_id, s in ('V4', 'V5') as professional, s = 'V3' as with_warning, s = 'V4' as beta, s = 'V5' as production from (select event_id, estado_destino as s from attempts)", "attempts")
def state_availability(spark, d):
    return view(spark, d, "attempts").select("event_id", *[c.alias(n) for n, c in C.availability(F.col("estado_destino")).items()])


@query("select id, coalesce(e.estado, 'contaminado') as estado, case when e.estado is null then 'artículo sin entrada en el manifest de estado editorial — tratado como contaminado por seguridad' when e.estado = 'limpio' then 'revisado' end as motivo from (select *, cast(doc_id as varchar) as key from articles) a left join editorial e on e.num_articulo = a.key", "articles editorial")
def status_reason(spark, d):
    manifest = view(spark, d, "editorial").withColumn("motivo", F.when(F.col("estado") == "limpio", "revisado"))
    rows = view(spark, d, "articles").withColumn("num_articulo", F.col("doc_id").cast("string"))
    return A.with_status(rows, manifest).select("id", "estado", "motivo")
