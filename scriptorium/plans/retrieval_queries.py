"""Vector retrieval, fusion, citations and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import vectors as V
from scriptorium.operators import retrieval as R
from scriptorium.operators import search as S
from scriptorium.plans import article_queries
from scriptorium.plans.registry import ORACLES, query
from scriptorium.sources.views import VIEWS, table, view


def query_vector(spark, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector as the question's."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").limit(1).collect()
    return [float(x) for x in rows[0][0]]


SIM = "list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0))"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("similarity", 6).alias("similarity"))


@query(f"select id, materia, round({SIM}, 6) as similarity from corpus where coleccion = 'c0' order by {SIM} desc, id limit 5", "corpus")
def retrieval_topk(spark, d):
    return rounded(R.search_library(view(spark, d, "corpus"), query_vector(spark, d), "c0", k=5), "id", "materia")


@query(f"select id, round({SIM}, 6) as similarity from corpus where {SIM} >= 0.3 order by {SIM} desc, id limit 5", "corpus")
def retrieval_threshold(spark, d):
    return rounded(R.search_threshold(view(spark, d, "corpus"), query_vector(spark, d)), "id")


@query(f"select id, materia, round({SIM}, 6) as similarity from corpus where coleccion = 'c1' and materia = '02' order by {SIM} desc, id limit 20", "corpus")
def retrieval_optional_filter(spark, d):
    return rounded(R.search_library(view(spark, d, "corpus"), query_vector(spark, d), "c1", "02", k=50), "id", "materia")


@query(
    f"""select id, stage, round(similarity, 6) as similarity from (
        select * from (select id, 1 as stage, {SIM} as similarity from corpus order by similarity desc, id limit 5)
        union all
        select * from (select id, 2 as stage, {SIM} as similarity from corpus where es_norma_vigente order by similarity desc, id limit 3) b
        where id not in (select id from (select id, {SIM} as s from corpus order by s desc, id limit 5)))
        where cast(split_part(id, ':', 2) as int) not in (select doc_id from articles where regexp_matches(contenido, '\\[(Cliente|Empresa)_An[oó]nimo|Tel[eé]fono_Oculto|Expediente_Anonimizado\\]'))""",
    "corpus articles",
)
def retrieval_in_force_fusion(spark, d):
    return rounded(R.fused(with_content(spark, d), query_vector(spark, d)), "id", "stage")


def with_content(spark, d) -> DataFrame:
    """The corpus with the texts of the articles of the same number as its content."""
    return view(spark, d, "corpus").join(view(spark, d, "articles").select(F.col("doc_id").alias("vec_id"), "contenido"), "vec_id", "left")


KEPT = "vec_id not in (select doc_id from articles where regexp_matches(contenido, '\\[(Cliente|Empresa)_An[oó]nimo|Tel[eé]fono_Oculto|Expediente_Anonimizado\\]'))"


@query(
    """select conv_id, turn, route, criminal, pass, coleccion, materia, k from (
        select *, 1 as pass, case when criminal or route <> 'A' then 'normativos' else 'procedimental' end as coleccion, case when criminal then '01_PENAL' end as materia, 5 as k from asked where route <> 'D'
        union all select *, 2, 'procedimental', null, 3 from asked where route = 'C' and not criminal)""".replace("asked", "(select conv_id, turn, case conv_id % 4 when 0 then 'A' when 1 then 'B' when 2 then 'C' else 'D' end as route, conv_id % 3 = 0 as criminal from conversations)")
)
def routed_searches(spark, d):
    route = F.expr("case conv_id % 4 when 0 then 'A' when 1 then 'B' when 2 then 'C' else 'D' end")
    asked = table(spark, d, "conversations").select("conv_id", "turn", route.alias("route"), (F.col("conv_id") % 3 == 0).alias("criminal"))
    return R.routed(asked)


def fused_sql(where: str, k: int, n: int) -> str:
    first = f"(select id, vec_id, {SIM} as similarity from corpus where {where} order by similarity desc, id limit {k})"
    second = f"(select id, vec_id, {SIM} as similarity from corpus where {where} and es_norma_vigente order by similarity desc, id limit 3)"
    return f"select id, {n} as pass, round(similarity, 6) as similarity from (select * from {first} union all select * from {second} where id not in (select id from {first})) where {KEPT}"


@query(f"{fused_sql('coleccion = ' + repr('c1'), 5, 1)} union all {fused_sql('coleccion = ' + repr('c0'), 3, 2)}", "corpus articles")
def route_second_pass(spark, d):
    """A civil question of route C: the collection's search, then the procedural one behind it."""
    return rounded(R.route_search(with_content(spark, d), query_vector(spark, d), "C", civil={"A": "c0", "C": "c1"}), "id", "pass")


@query(
    """select conv_id, case when block is null then asked when regexp_matches(asked, '^[\\s ]*$') then block else block || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**Consulta del usuario:**' || chr(10) || asked end as sent
       from (select conv_id, coalesce(any_value(text) filter (turn = 0), '') as asked,
         string_agg('📎 **Documento adjunto: f' || turn || '.txt**' || chr(10) || '```' || chr(10) || text || chr(10) || '```', chr(10) || chr(10) order by turn) filter (turn between 1 and 3) as block from conversations group by conv_id)"""
)
def attachment_blocks(spark, d):
    """The first message of each conversation with the next three as attachments."""
    c = table(spark, d, "conversations")
    files = c.where("turn between 1 and 3").select("conv_id", "turn", F.concat(F.lit("f"), F.col("turn").cast("string"), F.lit(".txt")).alias("filename"), "text")
    asked = c.select("conv_id").distinct().join(c.where("turn = 0").select("conv_id", F.col("text").alias("content")), "conv_id", "left")
    return R.attachment_blocks(files, asked, "conv_id", "turn")


@query(
    f"""select c.id, round({SIM}, 6) as similarity from corpus c join moderation m on m.doc_id = c.vec_id
        where m.estado_moderacion = 'aprobado' order by {SIM} desc, c.id limit 5""",
    "corpus moderation",
)
def retrieval_community(spark, d):
    chunks = view(spark, d, "corpus").withColumnRenamed("vec_id", "documento_id")
    return rounded(R.search_community(chunks, view(spark, d, "moderation"), query_vector(spark, d)), "id")


@query(f"select vec_id, tipo_instrumento, round({SIM}, 6) as similarity from templates where verificado_sin_pii and tipo_instrumento = 'tipo1' order by {SIM} desc, vec_id limit 3", "templates")
def retrieval_templates(spark, d):
    return rounded(R.search_templates(view(spark, d, "templates"), query_vector(spark, d), "tipo1"), "vec_id", "tipo_instrumento")


@query(
    """select query_id, id, rank, round(similarity, 6) as similarity from (
        select q.vec_id as query_id, c.id, list_cosine_similarity(c.embedding::double[], q.embedding::double[]) as similarity,
               row_number() over (partition by q.vec_id order by list_cosine_similarity(c.embedding::double[], q.embedding::double[]) desc, c.id) as rank
        from corpus c, embeddings q where q.vec_id % 100 = 0) where rank <= 5""",
    "corpus",
)
def retrieval_multi_query(spark, d):
    questions = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(R.nearest_of_each(view(spark, d, "corpus"), questions, 5), "query_id", "id", "rank")


@query(
    """select vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) as squared, round(u[1], 6) as first from (
        select vec_id, list_transform(embedding::double[], lambda x: x * 3 / sqrt(list_sum(list_transform(embedding::double[], lambda y: 9 * y * y)))) as u from embeddings)"""
)
def vector_normalise(spark, d):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = table(spark, d, "embeddings").select("vec_id", V.l2_normalised(tripled).alias("u"))
    return unit.select("vec_id", F.round(V.dot(F.col("u"), F.col("u")), 6).alias("squared"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query(
    """select label, pos, round(avg(x), 6) as mean from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings)
       group by label, pos"""
)
def vector_mean_pool(spark, d):
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return parts.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query(
    """select doc_id, list_reduce(list_prepend(0::bigint, list_transform(string_split(coalesce(text, ''), ''), lambda c: unicode(c)::bigint)), lambda h, c: case when c < 65536 then (h * 31 + c) & 4294967295
       else ((h * 31 + ((c - 65536) >> 10) + 55296) * 31 + ((c - 65536) & 1023) + 56320) & 4294967295 end) as h from documents"""
)
def text_hash31(spark, d):
    return table(spark, d, "documents").select("doc_id", V.hash31(F.coalesce("text", F.lit(""))).alias("h"))


@query()
def fake_embedding(spark, d):
    """Vectors of whole passages, as the fake provider makes them; tests compare it with the same rule in Python."""
    docs = table(spark, d, "documents").select("doc_id", V.seeded_vector(F.coalesce("text", F.lit("")), 384).alias("v"))
    return docs.select("doc_id", F.size("v").alias("dims"), F.round(V.norm(F.col("v")), 6).alias("length"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query("select vec_id, '[' || array_to_string(list_transform(embedding, lambda x: format('{:.6f}', x::double)), ',') || ']' as literal from embeddings")
def vector_literal(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.literal(F.col("embedding")).alias("literal"))


FRAGMENTS = """(select c.vec_id as pos, c.num_articulo, d.text as contenido, c.fuente, c.es_norma_vigente, c.jurisdiccion,
    case when c.vec_id % 3 = 0 then 'sentencia' else 'codigo' end as fuente_tipo, (c.vec_id % 100) / 100.0 as relevancia, c.vec_id // 20 as question
    from corpus c join documents d on d.doc_id = c.vec_id)"""


def fragments(spark, d) -> DataFrame:
    """Fragments as a retrieval returns them: positions, articles, sources and texts."""
    corpus = view(spark, d, "corpus")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("contenido"))
    kind = F.when(F.col("vec_id") % 3 == 0, "sentencia").otherwise("codigo")
    joined = corpus.drop("embedding").join(docs, "vec_id").withColumns({"fuente_tipo": kind, "relevancia": (F.col("vec_id") % 100) / 100.0, "question": F.expr("vec_id div 20"), "pos": F.col("vec_id")})
    return joined


@query(
    f"""select pos, num_articulo as articulo, case when length(contenido) > 600 then substr(contenido, 1, 600) || '…' else contenido end as texto, fuente,
        substr(sha256(concat_ws('|', contenido, coalesce(num_articulo, ''), fuente)), 1, 8) as hash
        from (select *, row_number() over (partition by num_articulo, fuente order by pos) as nth from {FRAGMENTS} where es_norma_vigente) where nth = 1 order by pos limit 5""",
    "corpus",
)
def citations(spark, d):
    return R.citations(fragments(spark, d))


LABEL = """case when es_norma_vigente then 'NORMA VIGENTE HONDURAS' when jurisdiccion <> '' and jurisdiccion <> 'HN' then 'DOCTRINA/JURISPRUDENCIA COMPARADA — ' || jurisdiccion
    when fuente_tipo in ('sentencia', 'doctrina') then 'DOCTRINA/JURISPRUDENCIA — NO ES NORMA VIGENTE' end"""


@query(f"select pos, {LABEL} as label from {FRAGMENTS}", "corpus")
def context_labels(spark, d):
    return fragments(spark, d).select("pos", R.context_label(F.col("es_norma_vigente"), F.col("jurisdiccion"), F.col("fuente_tipo")).alias("label"))


@query(
    f"""select question, string_agg('[FRAGMENTO ' || n || coalesce(' — Art. ' || num_articulo, '') || coalesce(' [' || label || ']', '') || ' | relevancia: '
        || cast(floor(relevancia * 100 + 0.5) as bigint) || '%]' || chr(10) || regexp_replace(contenido, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) order by n) as block
        from (select *, {LABEL} as label, row_number() over (partition by question order by pos) as n from {FRAGMENTS}) group by question""",
    "corpus",
)
def context_block(spark, d):
    return R.context_blocks(fragments(spark, d), "question", "pos")


@query(
    """select vec_id, fuente, first_pos from (select fuente, vec_id % 5 as vec_id, min(vec_id) as first_pos from corpus where es_norma_vigente group by fuente, vec_id % 5)""",
    "corpus",
)
def distinct_articles(spark, d):
    """Distinct values in order of appearance, as their first positions."""
    return view(spark, d, "corpus").where("es_norma_vigente").groupBy("fuente", (F.col("vec_id") % 5).alias("vec_id2")).agg(F.min("vec_id").alias("first_pos")).withColumnRenamed("vec_id2", "vec_id")


WEB = """(select page_id, url, html, (page_id % 10) / 10.0 as score, page_id // 10 as search from pages)"""


@query(
    f"""select search, page_id, domain, snippet from (
        select *, row_number() over (partition by search order by page_id) as nth from (
          select *, row_number() over (partition by search, key order by page_id) as same from (
            select search, page_id, lower(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')) as key,
                   regexp_replace(regexp_extract(url, '://([^/?#]+)', 1), '^www\\.', '') as domain, substr(trim(regexp_replace(html, '\\s+', ' ', 'g')), 1, 450) as snippet
            from {WEB} where score >= 0.3)) where same = 1) where nth <= 5"""
)
def web_results_clean(spark, d):
    return web_results(spark, d).select("search", "page_id", "domain", "snippet")


def web_results(spark, d) -> DataFrame:
    pages = table(spark, d, "pages").withColumns({"score": (F.col("page_id") % 10) / 10.0, "search": F.expr("page_id div 10")}).where("score >= 0.3")
    held = pages.select("search", "page_id", "url", T.normal_url(F.col("url")).alias("key"), T.domain(F.col("url")).alias("domain"), T.snippet(F.col("html")).alias("snippet"))
    first = held.withColumn("same", F.row_number().over(Window.partitionBy("search", "key").orderBy("page_id"))).where("same = 1")
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("search").orderBy("page_id"))).where("nth <= 5")


CLEAN = f"""(select *, row_number() over (partition by search order by page_id) as n from (
    select *, row_number() over (partition by search, key order by page_id) as same from (
      select search, page_id, url, lower(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')) as key,
             regexp_replace(regexp_extract(url, '://([^/?#]+)', 1), '^www\\.', '') as domain, substr(trim(regexp_replace(html, '\\s+', ' ', 'g')), 1, 450) as snippet
      from {WEB} where score >= 0.3)) where same = 1)"""


@query(
    f"""select search, string_agg('[Web ' || n || '] page ' || page_id || chr(10) || '  Dominio: ' || domain || chr(10) || '  URL:     ' || url || chr(10) || '  Fragmento: "' || snippet || '"', chr(10) || chr(10) order by n) as block
        from {CLEAN} where n <= 5 group by search"""
)
def context_web(spark, d):
    found = web_results(spark, d).withColumn("title", F.concat(F.lit("page "), F.col("page_id").cast("string")))
    return R.web_blocks(found, "search", "page_id")


@query(
    """select question, string_agg('[Comunidad ' || n || '] (' || source || ')' || chr(10) || text, chr(10) || chr(10) order by n) as block
       from (select *, doc_id // 20 as question, row_number() over (partition by doc_id // 20 order by doc_id) as n from moderation where estado_moderacion = 'aprobado') group by question""",
    "moderation",
)
def context_community(spark, d):
    approved = view(spark, d, "moderation").where("estado_moderacion = 'aprobado'")
    return R.community_blocks(approved.select(F.expr("doc_id div 20").alias("question"), "doc_id", F.col("source").alias("kind"), F.col("text").alias("content")), "question", "doc_id")


@query(
    """select question, string_agg('[PLANTILLA ' || n || '] ' || source || ' (similitud: ' || cast(floor(similarity * 100 + 0.5) as bigint) || '%)' || chr(10) || 'Variables a completar: ' || lang || ', ' || source || chr(10) || chr(10) || text,
       chr(10) || chr(10) || '---' || chr(10) || chr(10) order by n) as block
       from (select *, doc_id // 20 as question, row_number() over (partition by doc_id // 20 order by doc_id) as n from (select *, (n_chars % 100) / 100.0 as similarity from documents) where similarity >= 0.75) group by question"""
)
def context_template(spark, d):
    docs = table(spark, d, "documents").select(
        F.expr("doc_id div 20").alias("question"), "doc_id", F.col("source").alias("title"), ((F.col("n_chars") % 100) / 100.0).alias("similarity"), F.array("lang", "source").alias("variables"), F.col("text").alias("content")
    )
    return R.template_blocks(docs, "question", "doc_id")


COSINE = "list_cosine_similarity(c.embedding::double[], q.embedding::double[])"


@query(
    f"""select query_id, id, rank, round(similarity, 6) as similarity from (
        select q.vec_id as query_id, c.id, {COSINE} as similarity, row_number() over (partition by q.vec_id order by {COSINE} desc, c.id) as rank
        from embeddings q join corpus c on c.coleccion = concat('c', q.vec_id % 3) and (q.vec_id % 2 = 0 or c.materia = '01') and (q.vec_id % 4 <> 3 or c.es_norma_vigente)) where rank <= 5""",
    "corpus",
)
def retrieval_pruned_search(spark, d):
    """Every vector as a question of one collection, odd ones of one matter, some of statutes in force only, through the index."""
    i = F.col("vec_id")
    asked = table(spark, d, "embeddings").select(
        i.alias("query_id"), F.col("embedding").alias("query"), F.concat(F.lit("c"), (i % 3).cast("string")).alias("c"), F.when(i % 2 == 1, "01").alias("m"), F.when(i % 4 == 3, F.lit(True)).alias("f")
    )
    index = S.Index(view(spark, d, "corpus"), "id", ("coleccion", "materia", "es_norma_vigente"))
    return rounded(index.search(asked, 5, wanted={"coleccion": "c", "materia": "m", "es_norma_vigente": "f"}), "query_id", "id", "rank")


#: Collections and matters of the corpus by the names that questions use, and the vector of a question.
NAMED = "(select id, embedding, vec_id, es_norma_vigente, case coleccion when 'c0' then 'normativos' else 'procedimental' end as coleccion, case materia when '01' then '01_PENAL' else '02_CIVIL' end as materia from corpus)"
VECTOR = "(select vec_id, embedding from embeddings where vec_id < 100)"


def driver_sql() -> str:
    asked = "(select p.*, q.embedding, case when p.question_id % 2 = 0 then 'normativos' else 'procedimental' end as coleccion from plans p join vectors q on q.vec_id = p.question_id % 100 where p.plan = 'semantic')"
    kinds = f"(select distinct question_id % 100 as v, coleccion, matter, embedding from {asked})"
    hit = f"select q.v, q.coleccion, q.matter, c.id, c.vec_id, {COSINE} as similarity, row_number() over (partition by q.v, q.coleccion, q.matter order by {COSINE} desc, c.id) as nth from {kinds} q join named c on c.coleccion = q.coleccion and (q.matter is null or c.materia = q.matter)"
    return f"""with recursive corpus as ({VIEWS["corpus"]}), articles as ({VIEWS["articles"]}), plans as materialized ({ORACLES["retrieval_driver"]}), vectors as {VECTOR}, named as {NAMED},
        one as (select *, 1 as stage from ({hit}) where nth <= 5), two as (select *, 2 as stage from ({hit} where c.es_norma_vigente) where nth <= 3),
        found as (select * from one union all select two.* from two where not exists (select 1 from one where one.v = two.v and one.coleccion = two.coleccion and one.matter is not distinct from two.matter and one.id = two.id)),
        clean as (select *, row_number() over (partition by v, coleccion, matter order by stage, nth) as rank from found where {KEPT})
        select p.question_id, p.plan, c.stage, case when p.plan = 'semantic' then c.rank when p.article_id is not null then 1 end as rank, case when p.plan = 'semantic' then c.id else p.article_id end as id, round(c.similarity, 6) as similarity
        from plans p left join clean c on p.plan = 'semantic' and c.v = p.question_id % 100 and c.matter is not distinct from p.matter and c.coleccion = case when p.question_id % 2 = 0 then 'normativos' else 'procedimental' end"""


@query(driver_sql())
def retrieval_answers(spark, d):
    """What answers each question, from its text to the fragments: an exact article, nothing, or a search with the question's own filters."""
    q = article_queries.questions(spark, d)
    vectors = table(spark, d, "embeddings").where("vec_id < 100").select(F.col("vec_id").alias("v"), F.col("embedding").alias("query"))  # a vector for each of 100 kinds of questions
    asked = q.withColumn("v", F.col("question_id") % 100).join(F.broadcast(vectors), "v").withColumns({"coleccion": F.expr("if(question_id % 2 = 0, 'normativos', 'procedimental')"), "materia": F.lit(None).cast("string")})
    corpus = with_content(spark, d).withColumns({"coleccion": F.expr("if(coleccion = 'c0', 'normativos', 'procedimental')"), "materia": F.expr("if(materia = '01', '01_PENAL', '02_CIVIL')")})
    return S.answered(view(spark, d, "articles"), corpus, asked).withColumn("similarity", F.round("similarity", 6))
