"""Tables of an application, derived from the generic test tables. Each view is one SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name: (base tables, SQL)
VIEWS = {
    "usage": (
        "select concat('user:', user_id) as user_identifier, cast(ts as date) as query_date, cast(count(*) as int) as query_count,"
        " case user_id % 4 when 0 then 'free' when 1 then 'pro' when 2 then 'academico' else 'admin' end as tier"
        " from events group by user_id, cast(ts as date)"
    ),
    "subs": (
        "select concat('user:', c_custkey) as user_identifier,"
        " case when c_custkey % 9 = 0 then null else concat('SUB-', c_custkey) end as provider_sub_id,"
        " case when c_custkey % 2 = 0 then 'pro' else 'academico' end as tier,"
        " case c_custkey % 5 when 0 then 'pending' when 1 then 'trialing' when 2 then 'active' when 3 then 'cancelled' else 'past_due' end as status,"
        " (c_custkey % 40) * 60000 as age_ms from customer"
    ),
    "canonical": (
        "select concat('SUB-', c_custkey) as sub_id, case when c_acctbal > 0 then 'ACTIVE' else 'SUSPENDED' end as status,"
        " case when c_custkey % 11 = 0 then 'other' when c_custkey % 2 = 0 then 'pro' else 'academico' end as plan_tier,"
        " case when c_custkey % 13 = 0 then 'user:0' else concat('user:', c_custkey) end as custom_uid,"
        " case when c_custkey % 19 = 0 then 404 when c_custkey % 23 = 0 then 500 when c_custkey % 29 <> 0 then 200 end as http,"
        " case when c_custkey % 17 = 0 then 'SUB-x' else concat('SUB-', c_custkey) end as answered_id"
        " from customer where c_mktsegment <> 'MACHINERY'"
    ),
    "corpus": (
        "select concat('c', label % 3, ':', vec_id) as id, vec_id, concat('c', label % 3) as coleccion, concat('0', 1 + label % 2) as materia,"
        " cast(vec_id % 50 as varchar(9)) as num_articulo, concat('src', label) as fuente, case when vec_id % 4 = 0 then 'HN' else 'ES' end as jurisdiccion,"
        " vec_id % 4 = 0 as es_norma_vigente, embedding from embeddings"
    ),
    "moderation": (
        "select d.doc_id, d.source, d.lang, d.text, case when l.doc_id is null then 'pendiente' when l.toxic = 1 then 'rechazado'"
        " when l.quality = 1 then 'aprobado' else 'en_revision' end as estado_moderacion"
        " from documents d left join labels l on l.doc_id = d.doc_id"
    ),
    "articles": (
        "select concat('a', doc_id) as id, doc_id, cast(doc_id % 50 + 1 as varchar(9)) as num_articulo,"
        " case when doc_id % 7 = 0 then concat('ARTICULO ', doc_id % 50 + 1, '.- [Cliente_Anonimo] ', coalesce(text, ''))"
        " when doc_id % 5 = 0 then coalesce(text, '') else concat('ARTICULO ', doc_id % 50 + 1, '.- ', coalesce(text, '')) end as contenido,"
        " case doc_id % 4 when 0 then 'Codigo Penal' when 1 then 'Codigo Procesal Penal' when 2 then 'Codigo Civil' else null end as fuente,"
        " case when doc_id % 3 = 0 then 'sentencia' else 'codigo' end as fuente_tipo,"
        " case when doc_id % 4 = 2 then '02_CIVIL' else '01_PENAL' end as materia, doc_id % 6 <> 0 as es_norma_vigente from documents"
    ),
    "editorial": (
        "select cast(doc_id as varchar(19)) as num_articulo, case when doc_id % 10 < 7 then 'contaminado' else 'limpio' end as estado"
        " from documents where source <> 'src2'"
    ),
    "billing": (
        "select event_id, ts, concat('user:', user_id) as user_identifier,"
        " concat('SUB-', user_id, '-', cast(regexp_extract(props, '([0-9]+)', 1) as int) % 3) as sub_id,"
        " case when cast(regexp_extract(props, '([0-9]+)', 1) as int) % 2 = 0 then 'pro' else 'academico' end as tier,"
        " case event_type when 'signup' then 'BILLING.SUBSCRIPTION.CREATED' when 'purchase' then 'BILLING.SUBSCRIPTION.ACTIVATED'"
        " when 'view' then case when event_id % 4 = 0 then 'INVOICE.PAYMENT_SUCCEEDED' else 'PAYMENT.SALE.COMPLETED' end"
        " when 'error' then case when event_id % 3 = 0 then 'PAYMENT.SALE.DENIED' else 'BILLING.SUBSCRIPTION.PAYMENT.FAILED' end"
        " else case event_id % 5 when 0 then 'BILLING.SUBSCRIPTION.EXPIRED' when 1 then 'BILLING.SUBSCRIPTION.SUSPENDED' when 2 then 'CUSTOMER.DISPUTE.CREATED' else 'BILLING.SUBSCRIPTION.CANCELLED' end end as kind,"
        " case event_type when 'signup' then false when 'view' then cast(regexp_extract(props, '([0-9]+)', 1) as int) % 5 <> 0"
        " else event_type = 'purchase' end as grants from events"
    ),
    "attempts": (
        "select event_id, concat('V', event_id % 6) as estado_origen, concat('V', (event_id + user_id) % 6) as estado_destino,"
        " case event_id % 3 when 0 then 'abogado_revisor_senior' when 1 then 'propietario_despacho' else 'pipeline_automatico' end as rol from events"
    ),
    "templates": "select vec_id, concat('tipo', label % 4) as tipo_instrumento, vec_id % 3 <> 0 as verificado_sin_pii, embedding from embeddings",
    # Questions put to the corpus: a lead that names articles, codes or matters, then a passage.
    "questions": (
        "select conv_id, turn, role, concat(case conv_id % 8 when 0 then concat('Que dice el articulo ', conv_id % 50 + 1, ' del Codigo Penal sobre el plazo: ')"
        " when 1 then 'Cual es el plazo para el recurso de apelacion: ' when 2 then concat('Texto del art. ', conv_id % 50 + 1, ' ')"
        " when 3 then 'Segun el corpus, ' when 4 then concat('Articulo ', conv_id % 50 + 1, ' del Codigo Procesal Penal: ') when 5 then 'Cita la fuente civil: '"
        " when 6 then concat('art ', conv_id % 50 + 1, ' codigo civil ') else '' end, coalesce(text, '')) as content,"
        " case conv_id % 5 when 0 then 'sala_ia' when 1 then 'analisis' when 2 then 'documento' when 3 then 'sala_penal' else 'analisis_penal' end as mode"
        " from conversations"
    ),
    # Uploaded texts with personal data and layout marks at known places.
    "uploads": (
        "select doc_id, source, concat(case when doc_id % 5 = 0 then concat('DNI: ', 1000000000000 + doc_id, ' ') else '' end,"
        " case when doc_id % 6 = 0 then 'Tel 2234-5678 ' else '' end, case when doc_id % 7 = 0 then concat('mail a', doc_id, '@mail.example.hn ') else '' end,"
        " case when doc_id % 11 = 0 then concat('RTN: ', 10000000000000 + doc_id, ' ') else '' end,"
        " case when doc_id % 13 = 0 then concat('Expediente: ', 1000 + doc_id % 99, '-', 2000 + doc_id % 20, ' ') else '' end,"
        " coalesce(text, '')) as text from documents"
    ),
    # Statute texts: three headings around the halves of a text, page lines, trailing blanks and blank lines.
    "statutes": (
        "select doc_id, source, concat('Preambulo ', chr(13), chr(10), source, '  ', chr(10), chr(10), chr(10), chr(10), 'ARTICULO ', doc_id % 9 + 1, '.- ', replace(substr(text, 1, half), chr(10), ' '),"
        " chr(10), 'Pagina 3 de 9', chr(10), 'Articulo ', doc_id % 9 + 2, ': ', replace(substr(text, half + 1), chr(10), ' '), chr(10), '  ', 'ARTICULO ', doc_id % 9 + 9, ' fin', chr(10)) as text"
        " from (select doc_id, source, coalesce(text, '') as text, cast(floor(length(coalesce(text, '')) / 2) as int) as half from documents)"
    ),
    # One package for each document: three articles around its text, with the defect of one rule in chosen ones.
    "packages": (
        "select concat('norm', doc_id) as norm_id, doc_id as first_doc, texto, 'https://example.org' as url, case when doc_id % 23 = 6 then '' else 'Congreso' end as autoridad,"
        " case when doc_id % 23 = 10 then null else 'Decreto 9' end as decreto, '2020-05-10' as publicacion, '01_PENAL' as materia,"
        " case when doc_id % 23 = 7 then 'desconocido' else 'vigente' end as estado, case when doc_id % 23 = 8 then '  ' else 'revisor' end as responsable,"
        " case when doc_id % 23 = 9 then 'wrong' else {sha} end as checksum, case when doc_id % 23 = 11 then null else 'approver' end as approved_by"
        " from (select doc_id, case when doc_id % 23 = 0 then '   ' when doc_id % 23 = 1 then concat('Preambulo ', body) else concat('Preambulo', chr(10), 'ARTICULO 1.- ', body, chr(10), case when doc_id % 23 = 2 then 'ARTICULO 1.- ' else 'Articulo 2: ' end,"
        " case doc_id % 23 when 3 then 'DNI: 1234567890123' when 4 then 'demanda de [Cliente_Anonimo] y otros' else 'texto' end, chr(10), 'ARTICULO 3.- ', case when doc_id % 23 = 5 then 'Derogado.' else 'Vigencia.' end) end as texto"
        " from (select doc_id, replace(coalesce(text, ''), chr(10), ' ') as body from documents))"
    ),
    # Whole codes: citations before and between the headings, epigraphs, a short body and a gap in the numbers.
    "codes": (
        "select doc_id, concat('Decreto', chr(10), 'Artículo 4.- citado antes', chr(10), 'Artículo 1.- DE LAS PENAS. ', substr(body, 1, half), chr(10), ' Artículo 9. – de otra ley', chr(10), 'Artículo 2. ', substr(body, half + 1),"
        " chr(10), 'Articulo 3.-', 'corto', chr(10), 'Artículo ', doc_id % 3 + 5, '.-  DISPOSICIONES FINALES, I/II. ', 'Esta ley entra en   vigor', chr(10), ' el dia de su publicacion.') as text"
        " from (select doc_id, replace(coalesce(text, ''), chr(10), ' ') as body, cast(floor(length(coalesce(text, '')) / 2) as int) as half from documents)"
    ),
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, planned as part of the query that uses it."""
    sql = VIEWS[name]
    for base in TABLES:
        sql = re.sub(rf"\b(from|join) {base}\b", rf"\1 {{{base}}}", sql)
    used = {base: table(spark, sf_dir, base) for base in TABLES if f"{{{base}}}" in sql}
    sql = sql.replace("{sha}", "sha2(texto, 256)")
    return spark.sql(sql, **used)


def with_views(names: str, sql: str) -> str:
    """sql for DuckDB, with the named views in front of it."""
    parts = ", ".join(f"{n} as ({VIEWS[n]})" for n in names.split()).replace("{sha}", "sha256(texto)")
    return f"with recursive {parts} {sql}" if parts else sql
