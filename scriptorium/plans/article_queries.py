"""Exact articles, segmentation, chunking and editorial status."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import articles as A
from scriptorium.plans.registry import ORACLES, query
from scriptorium.plans.text_queries import NORMAL, NUMBER, first_sql, rx
from scriptorium.sources.views import VIEWS, table, view

ASKED = f"(select conv_id * 100 + turn as question_id, {NUMBER} as number, {first_sql(T.MATTERS)} as matter, {first_sql(T.INSTRUMENTS)} as instrument from questions)"
CANDIDATES = f"""(select q.*, a.* from {ASKED} q join articles a on a.num_articulo = q.number and (q.matter is null or q.matter = a.materia)
    where q.number is not null and a.fuente_tipo = 'codigo' and a.es_norma_vigente)"""
SAME = "case instrument " + " ".join(f"when '{n}' then regexp_matches(fuente, {rx(p)})" for n, p in A.SOURCES) + " else false end"
SOUND = f"(coalesce(not regexp_matches(contenido, '{T.CONTAMINATED}') and regexp_matches(contenido, '(?i)art[ií]culo\\s*' || number || '\\s*\\.-') and {SAME}, false))"


def questions(spark, d):
    return view(spark, d, "questions").select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), "content")


@query(f"select question_id, id from {CANDIDATES}", "questions articles")
def exact_article_candidates(spark, d):
    return A.candidates(view(spark, d, "articles"), questions(spark, d)).select("question_id", "id")


RESOLVED = f"""(select question_id, count(*) as n_candidates, count(*) filter (sound) as n_sound, (count(*) filter (sound) > 1 and count(distinct case when sound then materia end) > 1) as ambiguous,
    case when not (count(*) filter (sound) > 1 and count(distinct case when sound then materia end) > 1) then min(case when sound then id end) end as article_id
    from (select *, {SOUND} as sound from {CANDIDATES}) group by question_id)"""


@query(f"select * from {RESOLVED}", "questions articles")
def exact_article_resolution(spark, d):
    return A.resolved(view(spark, d, "articles"), questions(spark, d))


@query(
    f"""select question_id, plan, article_id, case when plan = 'semantic' then asked_matter end as matter from (select q.question_id, q.matter as asked_matter, case when q.number is null then 'semantic' when coalesce(r.ambiguous, false) then 'ambiguous' when r.article_id is not null then 'exact'
        when q.matter is not null or q.instrument is not null then 'abstain' else 'semantic' end as plan, r.article_id from {ASKED} q left join {RESOLVED} r on r.question_id = q.question_id)""",
    "questions articles",
)
def retrieval_driver(spark, d):
    """What answers each question: an exact article, nothing, or a semantic search."""
    return A.driven(view(spark, d, "articles"), questions(spark, d))


@query("select id, regexp_matches(contenido, '(?i)art[ií]culo\\s*' || num_articulo || '\\s*\\.-') as heading from articles", "articles")
def heading_test(spark, d):
    return view(spark, d, "articles").select("id", A.has_heading(F.col("contenido"), F.col("num_articulo")).alias("heading"))


SEGMENTS = f"""(select doc_id, source, seq, contenido, regexp_extract(contenido, '(?i)ART[IÍ]CULO\\s+(\\d+)', 1) as num_articulo from (
    select doc_id, source, generate_subscripts(parts, 1) - 1 as seq, unnest(list_transform(parts, lambda x: regexp_replace(x, '^[\\s ]+|[\\s ]+$', '', 'g'))) as contenido
    from (select doc_id, source, string_split(regexp_replace({NORMAL.replace("{x}", "text")}, '(?im)^([ \\t]*ART[IÍ]CULO\\s+(\\d+)[.\\-:°º]*)', chr(1) || '\\1', 'g'), chr(1)) as parts from statutes)) where seq > 0)"""


@query(f"select doc_id, seq, num_articulo, contenido from {SEGMENTS}", "statutes")
def segment_articles(spark, d):
    texts = view(spark, d, "statutes").select("doc_id", T.normalised(F.col("text")).alias("text"))
    return A.segmented(texts)


@query(f"select source, trim(string_split(contenido, chr(10))[1]) as line, count(*) as n from {SEGMENTS} group by 1, 2 having count(*) > 1", "statutes")
def repeated_headers(spark, d):
    texts = view(spark, d, "statutes").select("doc_id", "source", T.normalised(F.col("text")).alias("text"))
    return A.repeated_first_lines(A.segmented(texts), "source")


HEADINGS = "(select doc_id, generate_subscripts(ns, 1) as n, cast(unnest(ns) as int) as number from (select doc_id, regexp_extract_all(text, '(?m)^\\s*Art[íi]culo\\s+(\\d+)\\s*\\.\\s*[-–—]?', 1) as ns from codes))"
NEXT = "case when f.last = 0 then o.number = 1 else o.number > f.last and o.number <= f.last + 5 end"


@query("_", "codes")
def monotonic_headings(spark, d):
    """Which headings of whole codes begin an article."""
    numbers = F.regexp_extract_all("text", F.lit(A.CODE_HEADING), F.lit(1))
    headings = view(spark, d, "codes").select("doc_id", F.posexplode(numbers).alias("at", "number"))
    return A.monotonic(headings, "doc_id", "at", "number").select("doc_id", (F.col("at") + 1).cast("long").alias("n"), "accepted")


ORACLES["monotonic_headings"] = f"""with recursive codes as ({VIEWS['codes']}), o as {HEADINGS},
    f as (select doc_id, n, number = 1 as accepted, case when number = 1 then 1 else 0 end as last from o where n = 1
      union all select o.doc_id, o.n, {NEXT}, case when {NEXT} then o.number else f.last end from f join o on o.doc_id = f.doc_id and o.n = f.n + 1)
    select doc_id, n, accepted from f"""


EPIGRAPH = "'^\\s*([A-ZÁÉÍÓÚÑÜ][A-ZÁÉÍÓÚÑÜ\\s,;/().\\-]{3,120}?)\\.\\s'"
BODY = "case doc_id % 4 when 0 then 'DE LAS PENAS. ' when 1 then 'DE LA VIGÜENZA, I/II (BIS) Y SS.' || chr(10) when 2 then 'SIN ESPACIO.' else '' end || contenido"


@query(f"select id, nullif(trim(regexp_extract(body, {EPIGRAPH}, 1)), '') as epigraph, length(regexp_replace(body, {EPIGRAPH}, '')) as left_over from (select id, {BODY} as body from articles)", "articles")
def epigraphs(spark, d):
    lead = F.expr("case doc_id % 4 when 0 then 'DE LAS PENAS. ' when 1 then 'DE LA VIGÜENZA, I/II (BIS) Y SS.\\n' when 2 then 'SIN ESPACIO.' else '' end")
    body = F.concat(lead, "contenido")
    return view(spark, d, "articles").select("id", A.epigraph(body).alias("epigraph"), F.length(A.without_epigraph(body)).cast("long").alias("left_over"))


CODE_PARTS = """(select doc_id, generate_subscripts(parts, 1) - 1 as seq, unnest(parts) as part from (select doc_id, string_split(regexp_replace(text, '(?m)^(\\s*Art[íi]culo\\s+(\\d+)\\s*\\.\\s*[-–—]?)', chr(1) || '\\2' || chr(2) || '\\1' || chr(3), 'g'), chr(1)) as parts from codes))"""
CODE_ARTICLES = f"""h as (select doc_id, seq, cast(split_part(part, chr(2), 1) as int) as n, split_part(split_part(part, chr(2), 2), chr(3), 1) as head, split_part(part, chr(3), 2) as body from {CODE_PARTS} where seq > 0),
    f as (select doc_id, seq, case when n = 1 then 1 else 0 end as last, n = 1 as ok from h where seq = 1
      union all select h.doc_id, h.seq, case when (f.last = 0 and h.n = 1) or (f.last > 0 and h.n > f.last and h.n <= f.last + 5) then h.n else f.last end, (f.last = 0 and h.n = 1) or (f.last > 0 and h.n > f.last and h.n <= f.last + 5) from f join h on h.doc_id = f.doc_id and h.seq = f.seq + 1),
    whole as (select f.doc_id, f.last as num, string_agg(case when f.ok then '' else h.head end || h.body, '' order by f.seq) as body from f join h on h.doc_id = f.doc_id and h.seq = f.seq where f.last > 0 group by f.doc_id, f.last)
    select doc_id, num, epigraph, text from (select doc_id, num, nullif(trim(regexp_extract(body, {EPIGRAPH}, 1)), '') as epigraph, trim(regexp_replace(regexp_replace(body, {EPIGRAPH}, ''), '[\\s ]+', ' ', 'g')) as text from whole) where length(text) >= 20"""


@query("_", "codes")
def code_articles(spark, d):
    """The articles of whole codes: citations absorbed, epigraphs apart, short bodies out."""
    return A.code_articles(view(spark, d, "codes"))


ORACLES["code_articles"] = f"with recursive codes as ({VIEWS['codes']}), {CODE_ARTICLES}"
CPC = {"code": "CPC", "decree": "D.211-2006", "matter": "02_CIVIL", "source": "CPC_TEXTO_BASE_D211-2006"}


@query()
def code_chunks(spark, d):
    """The chunks of whole codes, with ids, passages and metadata."""
    return A.article_chunks(A.code_articles(view(spark, d, "codes")), prefix="cpc_base_", **CPC)


@query()
def chunk_a(spark, d):
    return A.chunk_ids(A.chunks_by_space(table(spark, d, "documents").select("doc_id", "text")), "doc_id")


@query()
def chunk_b(spark, d):
    return A.chunk_ids(A.chunks_by_paragraph(table(spark, d, "documents").select("doc_id", "text")), "doc_id")


STATUS = "(select a.id, a.num_articulo, a.contenido, coalesce(e.estado, 'contaminado') as estado from (select *, cast(doc_id as varchar) as key from articles) a left join editorial e on e.num_articulo = a.key)"


def with_status(spark, d):
    rows = view(spark, d, "articles").withColumnRenamed("num_articulo", "shown").withColumn("num_articulo", F.col("doc_id").cast("string"))
    return A.with_status(rows, view(spark, d, "editorial"))


@query(f"select id, estado, regexp_matches(contenido, '{T.CONTAMINATED}') as marked from {STATUS}", "articles editorial")
def contamination_split(spark, d):
    return with_status(spark, d).select("id", "estado", T.contaminated(F.col("contenido")).alias("marked"))


@query("select 'https://example.org' || p as url from (values (''), ('/planes'), ('/consultas')) t(p) union all select 'https://example.org/leyes/' || num_articulo from editorial where estado = 'limpio'", "editorial")
def sitemap(spark, d):
    return A.sitemap(view(spark, d, "editorial"), "https://example.org")


@query(
    f"""select id, 'articulo-' || num_articulo || '-legislacion-penal-honduras' as slug, num_articulo as back, regexp_replace(substr(contenido, 1, 420), '^[\\s ]+|[\\s ]+$', '', 'g') as teaser, length(contenido) > 420 as truncated, estado = 'limpio' as indexed,
        '/leyes/' || num_articulo as canonical from {STATUS}""",
    "articles editorial",
)
def article_page(spark, d):
    rows = with_status(spark, d)
    slug = A.slug(F.col("shown"))
    return rows.select(
        "id", slug.alias("slug"), A.number_of_slug(slug).alias("back"), T.teaser(F.col("contenido"), 420).alias("teaser"), (F.length("contenido") > 420).alias("truncated"),
        (F.col("estado") == "limpio").alias("indexed"), F.concat(F.lit("/leyes/"), "shown").alias("canonical"),
    )


@query(f"select id, contenido, estado from {STATUS} where num_articulo = '7' order by length(id), id limit 1", "articles editorial")
def article_fetch(spark, d):
    return with_status(spark, d).where("shown = '7'").orderBy(F.length("id"), "id").limit(1).select("id", "contenido", "estado")


@query(
    """select cast(doc_id as varchar) || ':' || lpad(cast(seq as varchar), 3, '0') as chunk_id, 'passage: [' || lang || ' · ' || source || '] ' || text as passage,
       coalesce(nullif(nullif(case when seq % 2 = 0 then '' else lang end, ''), 'None'), source) as origin
       from (select doc_id, lang, source, text, n_chars % 7 as seq from documents)"""
)
def chunk_rows(spark, d):
    seq = (F.col("n_chars") % 7).cast("string")
    some = lambda c: F.nullif(F.nullif(c, F.lit("")), F.lit("None"))
    return table(spark, d, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.lpad(seq, 3, "0")).alias("chunk_id"),
        F.concat(F.lit("passage: ["), "lang", F.lit(" · "), "source", F.lit("] "), "text").alias("passage"),
        F.coalesce(some(F.when(F.col("n_chars") % 7 % 2 == 0, "").otherwise(F.col("lang"))), "source").alias("origin"),
    )
