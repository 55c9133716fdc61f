"""Detection, routing, anonymising, redaction and other text columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.plans.registry import query
from scriptorium.sources import documents as DOC
from scriptorium.sources.views import table, view

SALT = "scriptorium-2026"
UPLOAD_CAP = 20_000


def rx(pattern: str) -> str:
    """A pattern for DuckDB, quotes doubled, without regard to case."""
    return "'(?i)" + pattern.replace("'", "''") + "'"


ASKED = r"regexp_replace(content, '^[\s ]+|[\s ]+$', '', 'g')"
ROUTE = f"""case when mode in ('sala_ia', 'sala_penal') or length({ASKED}) < 15 or regexp_matches({ASKED}, {rx(T.GREETING)}) then 'D'
    when regexp_matches({ASKED}, {rx(T.PROCEDURAL)}) and regexp_matches({ASKED}, {rx(T.NORMATIVE)}) then 'C'
    when regexp_matches({ASKED}, {rx(T.PROCEDURAL)}) then 'A' when regexp_matches({ASKED}, {rx(T.NORMATIVE)}) then 'B'
    when mode in ('analisis', 'analisis_penal', 'documento', 'escritos_penales') then 'C' else 'A' end"""
NUMBER = f"nullif(regexp_extract(content, {rx(T.ARTICLE_NUMBER)}, 1), '')"


@query(f"select conv_id, turn, {ROUTE} as route from questions", "questions")
def route_classification(spark, d):
    return view(spark, d, "questions").select("conv_id", "turn", T.route(F.col("content"), F.col("mode")).alias("route"))


def first_sql(named) -> str:
    return "case " + " ".join(f"when regexp_matches(content, {rx(p)}) then '{n}'" for n, p in named) + " end"


@query(f"select conv_id, turn, {NUMBER} as number, {first_sql(T.MATTERS)} as matter, {first_sql(T.INSTRUMENTS)} as instrument from questions", "questions")
def article_detection(spark, d):
    c = F.col("content")
    return view(spark, d, "questions").select("conv_id", "turn", T.article_number(c).alias("number"), T.first_match(c, T.MATTERS).alias("matter"), T.first_match(c, T.INSTRUMENTS).alias("instrument"))


@query(
    f"""select conv_id, turn, (mode like 'analisis%' or regexp_matches(content, {rx(T.CORPUS_NAMED)}) or regexp_matches(content, {rx(T.EVIDENCE_ASKED)}) or {NUMBER} is not null) as needed
        from questions""",
    "questions",
)
def evidence_gate(spark, d):
    q = view(spark, d, "questions")
    return q.select("conv_id", "turn", T.evidence_needed(F.col("content"), F.col("mode").startswith("analisis")).alias("needed"))


@query(
    f"""select conv_id, turn, (needed and n = 0) as abstains from (select q.conv_id, q.turn, ({NUMBER} is not null) as needed, count(a.id) as n
        from questions q left join articles a on a.num_articulo = {NUMBER} and a.fuente_tipo = 'codigo' and a.es_norma_vigente and a.fuente = 'Codigo Civil'
        group by q.conv_id, q.turn, {NUMBER} is not null)""",
    "questions articles",
)
def fail_closed_abstention(spark, d):
    q = view(spark, d, "questions").select("conv_id", "turn", T.article_number(F.col("content")).alias("number"))
    a = view(spark, d, "articles").where("fuente_tipo = 'codigo' and es_norma_vigente and fuente = 'Codigo Civil'").groupBy("num_articulo").agg(F.count("*").alias("n"))
    found = q.join(a, q["number"] == a["num_articulo"], "left")
    return found.select("conv_id", "turn", (F.col("number").isNotNull() & (F.coalesce("n", F.lit(0)) == 0)).alias("abstains"))


@query("select conv_id, arg_max(trim(content), turn) as content from questions where role = 'user' and length(trim(content)) > 0 group by conv_id", "questions")
def last_user_message(spark, d):
    q = view(spark, d, "questions").where((F.col("role") == "user") & (F.length(F.trim("content")) > 0))
    return q.groupBy("conv_id").agg(F.max_by(F.trim("content"), "turn").alias("content"))


def nested(column: str, patterns) -> str:
    for p, mark in patterns:
        column = f"regexp_replace({column}, '{p}', '{mark}', 'g')"
    return column


@query(f"select doc_id, {nested('text', T.QUESTION)} as question, {nested('text', T.STRUCTURED)} as clean from uploads", "uploads")
def pii_anonymise(spark, d):
    t = F.col("text")
    return view(spark, d, "uploads").select("doc_id", T.anonymised_question(t).alias("question"), T.anonymised(t).alias("clean"))


FLAG = " or ".join(f"regexp_matches({nested('text', T.STRUCTURED[:k])}, '{p}')" for k, (p, _) in enumerate(T.STRUCTURED))


@query(f"select doc_id, ({FLAG}) as flagged from uploads", "uploads")
def pii_flags(spark, d):
    return view(spark, d, "uploads").select("doc_id", T.has_structured(F.col("text")).alias("flagged"))


@query(
    f"""select doc_id, (regexp_matches(text, '{T.IDENTITY}') or regexp_matches(text, '(?i){T.TAX}') or regexp_matches(text, '{T.EMAIL}') or regexp_matches(text, '{T.PHONE}')) as residue,
        (regexp_matches(text, '{T.CONTAMINATED}') or regexp_matches(text, '(?i){T.PRIVATE}')) as private from uploads""",
    "uploads",
)
def pii_residual(spark, d):
    t = F.col("text")
    return view(spark, d, "uploads").select("doc_id", T.has_residue(t).alias("residue"), T.has_private_data(t).alias("private"))


@query(
    f"""select c_custkey, substr(email, 1, 2) || '***@' || regexp_extract(email, '[^@]*$') as email_short, '***' || right(c_name, 4) as name_short,
        substr(regexp_replace('failed for ' || email || ' at login', '{T.EMAIL}', '[email]', 'g'), 1, 200) as error
        from (select *, lower(replace(c_name, '#', '.')) || '@mail.example.com' as email from customer)"""
)
def redaction(spark, d):
    email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.example.com"))
    return table(spark, d, "customer").select(
        "c_custkey", T.redacted_email(email).alias("email_short"), T.redacted_id(F.col("c_name")).alias("name_short"), T.sanitised_error(F.concat(F.lit("failed for "), email, F.lit(" at login"))).alias("error")
    )


@query(
    f"""select c_custkey, 'email:' || lower(trim('  ' || c_name || ' ')) as canonical,
        coalesce('email:' || nullif(case when c_custkey % 3 = 0 then '' else c_name end, ''), 'payer:' || case when c_custkey % 2 = 0 then cast(c_custkey as varchar) end, 'sub:' || c_mktsegment) as legacy,
        'ip:' || coalesce(nullif(trim(string_split(case when c_custkey % 4 = 0 then null else '10.0.0.' || c_nationkey || ' , 1.1.1.1' end, ',')[1]), ''), 'unknown') as client,
        substr(sha256(c_name || '{SALT}'), 1, 32) as hashed from customer"""
)
def identity_keys(spark, d):
    key = F.col("c_custkey")
    email = F.when(key % 3 == 0, "").otherwise(F.col("c_name"))
    payer = F.when(key % 2 == 0, key.cast("string"))
    forwarded = F.when(key % 4 != 0, F.concat(F.lit("10.0.0."), F.col("c_nationkey").cast("string"), F.lit(" , 1.1.1.1")))
    return table(spark, d, "customer").select(
        "c_custkey", T.identity_key(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("canonical"), T.legacy_identity(email, payer, F.col("c_mktsegment")).alias("legacy"),
        T.client_key(forwarded, F.lit(None).cast("string")).alias("client"), T.user_hash(F.col("c_name"), SALT).alias("hashed"),
    )


NORMAL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'),"
    r" '(?im)^\s*P[aá]gina\s+\d+(\s+de\s+\d+)?\s*$', '', 'g'), '^[\s ]+|[\s ]+$', '', 'g')"
)


@query(f"select doc_id, {NORMAL.replace('{x}', 'text')} as text from statutes", "statutes")
def text_normalise(spark, d):
    return view(spark, d, "statutes").select("doc_id", T.normalised(F.col("text")).alias("text"))


@query(r"select doc_id, substr(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), '^[\s ]+|[\s ]+$', '', 'g'), 1, 400) as asked from documents")
def query_sanitise(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sanitised_query(F.col("text")).alias("asked"))


@query("select doc_id, length(text) > 20000 as truncated, substr(text, 1, 20000) as text from (select doc_id, replace(text, chr(0), '') as text from documents)")
def upload_normalise(spark, d):
    """Uploads are cut at UPLOAD_CAP characters, which the flag tells."""
    clean = F.regexp_replace("text", r"\x00", "")
    return table(spark, d, "documents").select("doc_id", (F.length(clean) > UPLOAD_CAP).alias("truncated"), F.substring(clean, 1, UPLOAD_CAP).alias("text"))


MONTHS = T.DATES.replace("á", "á")


@query(f"select doc_id, regexp_matches(x, '(?i){T.DATES}') as dated from (select doc_id, case doc_id % 4 when 0 then 'el 5 de mayo de 2020 ' when 1 then '05/11/2021 ' when 2 then '5 de mayo ' else '' end || text as x from documents)")
def date_mentions(spark, d):
    lead = F.expr("case doc_id % 4 when 0 then 'el 5 de mayo de 2020 ' when 1 then '05/11/2021 ' when 2 then '5 de mayo ' else '' end")
    return table(spark, d, "documents").select("doc_id", F.rlike(F.concat(lead, "text"), F.lit("(?iu)" + T.DATES)).alias("dated"))


@query(
    """select doc_id, regexp_extract(x, '(?s)\\{.*\\}', 0) as block, try_cast(json_extract_string(regexp_extract(x, '(?s)\\{.*\\}', 0), '$.score') as double) as score
       from (select doc_id, 'Answer: {"score": ' || (doc_id % 10) / 10.0 || ', "lang": "' || lang || '"} end' as x from documents)"""
)
def llm_json_block(spark, d):
    answer = F.concat(F.lit('Answer: {"score": '), ((F.col("doc_id") % 10) / 10.0).cast("string"), F.lit(', "lang": "'), "lang", F.lit('"} end'))
    block = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return table(spark, d, "documents").select("doc_id", block.alias("block"), F.try_to_number(F.get_json_object(block, "$.score"), F.lit("9.9")).cast("double").alias("score"))


@query(
    """select page_id, case when path is null or path = '' or path not like '/%' or path like '//%' or path like '%://%' then '/chat' else path end as safe,
       (url like 'https://%' and regexp_extract(url, '^(https?://[^/?#]+)', 1) in ('https://therha.example.net', 'https://ththin.example.com')) as allowed
       from (select *, case page_id % 3 when 0 then regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1) when 1 then url else '//' || url end as path from pages)"""
)
def path_and_origin_guards(spark, d):
    path = F.expr(r"case page_id % 3 when 0 then regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1) when 1 then url else concat('//', url) end")
    bad = path.isNull() | (path == "") | ~path.startswith("/") | path.startswith("//") | path.contains("://")
    origin = F.concat(F.try_parse_url("url", F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url("url", F.lit("HOST")))
    return table(spark, d, "pages").select("page_id", F.when(bad, "/chat").otherwise(path).alias("safe"), F.coalesce(origin.isin("https://therha.example.net", "https://ththin.example.com"), F.lit(False)).alias("allowed"))


@query(
    """select c_custkey, regexp_extract(k, '^ak_live_([A-Za-z0-9]+)\\.(.+)$', 1) as key_id, sha256(regexp_extract(k, '^ak_live_([A-Za-z0-9]+)\\.(.+)$', 2)) = sha256('s' || c_nationkey) as valid
       from (select *, 'ak_live_' || c_custkey || '.s' || case when c_custkey % 2 = 0 then c_nationkey else -1 end as k from customer)"""
)
def api_key_parse(spark, d):
    key = F.concat(F.lit("ak_live_"), F.col("c_custkey").cast("string"), F.lit(".s"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).otherwise(-1).cast("string"))
    part = lambda n: F.regexp_extract(key, r"^ak_live_([A-Za-z0-9]+)\.(.+)$", n)
    return table(spark, d, "customer").select("c_custkey", part(1).alias("key_id"), (F.sha2(part(2), 256) == F.sha2(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")), 256)).alias("valid"))


@query(
    """select c_custkey, case when packed like '{%' then coalesce(json_extract_string(packed, '$.p'), 'pro') else 'pro' end as plan,
       case when packed like '{%' then json_extract_string(packed, '$.u') else packed end as uid
       from (select c_custkey, case when c_custkey % 3 = 0 then c_name else '{"p":"academico","u":"' || c_name || '"}' end as packed from customer)"""
)
def custom_id_parse(spark, d):
    packed = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.to_json(F.struct(F.lit("academico").alias("p"), F.col("c_name").alias("u"))))
    is_json = packed.startswith("{")
    plan = F.when(is_json, F.coalesce(F.get_json_object(packed, "$.p"), F.lit("pro"))).otherwise("pro")
    return table(spark, d, "customer").select("c_custkey", plan.alias("plan"), F.when(is_json, F.get_json_object(packed, "$.u")).otherwise(packed).alias("uid"))


@query("select c_custkey, md5('amount=' || c_nationkey || '&key=' || c_custkey || '&name=' || c_name) as signature from customer")
def signature_params(spark, d):
    params = F.create_map(F.lit("name"), "c_name", F.lit("key"), F.col("c_custkey").cast("string"), F.lit("amount"), F.col("c_nationkey").cast("string"))
    joined = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return table(spark, d, "customer").select("c_custkey", F.md5(joined).alias("signature"))


@query(
    """select event_id, upper(substr(sha256(cast(event_id as varchar)), 1, 8)) as ref, cast(ts as date) as day, cast(cast(ts as date) + interval 1 day as date) as resets,
       cast(ceil((900000 - event_id % 900000) / 1000.0) as bigint) as wait_s from events"""
)
def reference_ids(spark, d):
    day = F.to_date("ts")
    return table(spark, d, "events").select(
        "event_id", F.upper(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8)).alias("ref"), day.alias("day"), F.date_add(day, 1).alias("resets"), F.ceil((900000 - F.col("event_id") % 900000) / 1000).alias("wait_s")
    )


@query(
    """select conv_id, turn, substr(trim(case when instr(content, '**Consulta:**') > 0 then substr(content, instr(content, '**Consulta:**') + 13) else content end), 1, 350) as asked,
       case when mode in ('sala_ia', 'sala_penal') then 'fast' when mode in ('analisis', 'analisis_penal') then 'large' else 'default' end as model
       from (select *, case when conv_id % 2 = 0 then 'file **Consulta:** ' || content else content end as content2 from questions) q(conv_id, turn, role, old, mode, content)""",
    "questions",
)
def model_choice(spark, d):
    content = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("file **Consulta:** "), "content")).otherwise(F.col("content"))
    at = F.instr(content, "**Consulta:**")
    asked = F.when(at > 0, F.substr(content, at + 13)).otherwise(content)
    model = F.when(F.col("mode").isin("sala_ia", "sala_penal"), "fast").when(F.col("mode").isin("analisis", "analisis_penal"), "large").otherwise("default")
    return view(spark, d, "questions").select("conv_id", "turn", F.substring(F.trim(asked), 1, 350).alias("asked"), model.alias("model"))


@query(
    f"""select conv_id, turn, substr({nested('content', T.QUESTION)}, 1, 2000) as question, substr(sha256('user:' || conv_id || '{SALT}'), 1, 32) as user_hash, mode from questions""",
    "questions",
)
def analytics_log_rows(spark, d):
    q = view(spark, d, "questions")
    return q.select("conv_id", "turn", F.substring(T.anonymised_question(F.col("content")), 1, 2000).alias("question"), T.user_hash(F.concat(F.lit("user:"), F.col("conv_id").cast("string")), SALT).alias("user_hash"), "mode")


@query("select c_custkey, case when v in ('pro', 'academico') then v end as tier from (select c_custkey, case c_custkey % 4 when 0 then 'pro' when 1 then 'academico' when 2 then 'admin' end as v from customer)")
def plan_param(spark, d):
    value = F.expr("case c_custkey % 4 when 0 then 'pro' when 1 then 'academico' when 2 then 'admin' end")
    return table(spark, d, "customer").select("c_custkey", T.plan_param(value).alias("tier"))


@query("select doc_id, length(replace(text, chr(0), '')) as n, sha256(replace(text, chr(0), '')) as digest from documents")
def nul_strip(spark, d):
    marked = F.concat(F.lit("\x00"), "text", F.lit("\x00"))
    clean = T.without_nul(marked)
    return table(spark, d, "documents").select("doc_id", F.length(clean).cast("long").alias("n"), F.sha2(clean, 256).alias("digest"))


KEYS, SOURCE_KEYS = ("articulo", "num_articulo"), ("fuente", "archivo")


@query(
    """select doc_id, case when doc_id % 3 = 1 then substr('n' || doc_id || coalesce(text, ''), 1, 200) else 'a' || doc_id end as article, length(coalesce(text, '')) > 500 as cut, length(substr(coalesce(text, ''), 1, 500)) as n
       from documents"""
)
def metadata_map(spark, d):
    """The first usable key of a map of metadata, and its values cut to what a JSON column holds."""
    text = F.coalesce("text", F.lit(""))
    first = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, "").otherwise(F.concat(F.lit("a"), F.col("doc_id").cast("string")))
    second = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("n"), F.col("doc_id").cast("string"), text))
    meta = F.create_map(F.lit("articulo"), first, F.lit("num_articulo"), second, F.lit("texto"), text)
    short = T.shortened(meta)["texto"]
    return table(spark, d, "documents").select("doc_id", T.first_key(meta, KEYS).alias("article"), (F.length(text) > 500).alias("cut"), F.length(short).cast("long").alias("n"))


@query(
    r"""select c_custkey, regexp_matches(v, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') as valid from (select c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' ||
        case when c_custkey % 2 = 0 then '4' else '5' end || substr(h, 14, 3) || '-' || case when c_custkey % 3 = 0 then 'A' else '7' end || substr(h, 18, 3) || '-' || upper(substr(h, 21, 12)) as v from (select *, sha256(c_name) as h from customer))"""
)
def uuid_check(spark, d):
    h = F.sha2("c_name", 256)
    part = lambda a, n: F.substring(h, a, n)
    key = F.col("c_custkey")
    value = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.when(key % 2 == 0, "4").otherwise("5"), part(14, 3)), F.concat(F.when(key % 3 == 0, "A").otherwise("7"), part(18, 3)), F.upper(part(21, 12)))
    return table(spark, d, "customer").select("c_custkey", T.is_uuid4(value).alias("valid"))


@query(
    """select doc_id, json_object('@context', 'https://schema.org', '@type', 'FAQPage', 'mainEntity', [json_object('@type', 'Question', 'name', '¿Qué dice el artículo ' || doc_id || '?', 'acceptedAnswer',
         json_object('@type', 'Answer', 'text', regexp_replace(substr(x, 1, 320), '^[\\s ]+|[\\s ]+$', '', 'g') || case when length(x) > 320 then '… (continúa)' else '' end))]) as data
       from (select doc_id, coalesce(text, '') as x from documents)"""
)
def faq_page(spark, d):
    question = F.concat(F.lit("¿Qué dice el artículo "), F.col("doc_id").cast("string"), F.lit("?"))
    return table(spark, d, "documents").select("doc_id", T.faq(question, F.coalesce("text", F.lit(""))).alias("data"))


@query(
    """select c_custkey, case c_custkey % 3 when 0 then '(none)' when 1 then '***' else substr(c_name, 1, 2) || '***@example.com' end as email, case when c_custkey % 2 = 0 then substr(p, 1, 5) || '…' || right(p, 4) else 'no_url' end as project,
        substr(regexp_replace(regexp_replace('fetch https://x.example/' || c_name || ' failed ' || sha256(c_name), 'https?://\\S+', '[url]', 'g'), '[A-Za-z0-9_-]{25,}', '[tok]', 'g'), 1, 80) as error,
        'REF-' || upper(to_base(1700000000000 + c_custkey, 36)) || '-' || upper(substr(sha256(c_name), 1, 8)) as reference, '{"p":"pro","u":"' || substr(repeat(c_name, 8), 1, 100) || '"}' as packed
       from (select *, 'abcdefgh' || c_custkey as p from customer)"""
)
def bare_redaction(spark, d):
    key, name = F.col("c_custkey"), F.col("c_name")
    email = F.when(key % 3 == 1, name).when(key % 3 == 2, F.concat(name, F.lit("@example.com")))
    url = F.when(key % 2 == 0, F.concat(F.lit("https://abcdefgh"), key.cast("string"), F.lit(".supabase.co/x"))).otherwise("http://other")
    error = F.concat(F.lit("fetch https://x.example/"), name, F.lit(" failed "), F.sha2(name, 256))
    return table(spark, d, "customer").select(
        "c_custkey", T.bare_email(email).alias("email"), T.project_reference(url).alias("project"), T.bare_error(error).alias("error"), T.reference_id(key + 1_700_000_000_000, name).alias("reference"), T.packed_id(F.lit("pro"), F.repeat(name, 8)).alias("packed")
    )


@query(
    """select conv_id, turn, case when asked in ('large-1', 'large-2') then asked when route = 'C' or mode in ('analisis', 'analisis_penal', 'documento', 'escritos_penales') then 'large-1' else 'small-1' end as model
       from (select *, case conv_id % 3 when 0 then 'C' else 'A' end as route, case turn % 4 when 1 then 'large-2' when 2 then 'evil' end as asked from questions)""",
    "questions",
)
def model_override(spark, d):
    route, asked = F.expr("case conv_id % 3 when 0 then 'C' else 'A' end"), F.expr("case turn % 4 when 1 then 'large-2' when 2 then 'evil' end")
    return view(spark, d, "questions").select("conv_id", "turn", T.model_for(route, F.col("mode"), asked, ("large-1", "large-2"), "large-1", "small-1").alias("model"))


@query(
    """select doc_id, case when doc_id % 11 = 0 then null when doc_id % 2 = 0 then substr(trim(one, BLANKS), 1, 20000) else substr(trim(two, BLANKS), 1, 20000) end as text,
        case when doc_id % 11 = 0 then null else length(trim(case when doc_id % 2 = 0 then one else two end, BLANKS)) > 20000 end as truncated, case when doc_id % 11 = 0 then 'unreadable' end as error from (
            select doc_id, regexp_replace(replace(x, chr(10), chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g') as two, regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g') as one
            from (select doc_id, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B-\x1F]', '', 'g') as x from documents))""".replace("BLANKS", "' ' || chr(9) || chr(10) || chr(160) || chr(12288) || chr(65279)")
)
def upload_extraction(spark, d):
    """Documents as uploaded files: text files with the line ends of another system, word-processor files, and damaged ones."""

    def packed(batches):
        for some in (batch.slice(i, DOC.AT_ONCE) for batch in batches for i in range(0, batch.num_rows, DOC.AT_ONCE)):
            rows = zip(some.column("text").to_pylist(), some.column("kind").to_pylist(), strict=True)
            made = [(t or "").replace("\n", "\r\n").encode() if kind == 0 else DOC.word_file((t or "").split("\n")) if kind == 1 else b"damaged" for t, kind in rows]
            yield pa.RecordBatch.from_arrays([some.column("path"), pa.array(made, pa.binary())], names=["path", "content"])

    kind = F.when(F.col("doc_id") % 11 == 0, 2).otherwise(F.col("doc_id") % 2)
    path = F.concat(F.col("doc_id").cast("string"), F.when((F.col("doc_id") % 2 == 0) & (F.col("doc_id") % 11 != 0), ".txt").otherwise(".docx"))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B-\x1F]", "")
    DOC.ship(spark)
    files = table(spark, d, "documents").select(path.alias("path"), plain.alias("text"), kind.alias("kind")).mapInArrow(packed, "path string, content binary")
    return DOC.extracted(files).select(F.substring_index("path", ".", 1).cast("long").alias("doc_id"), "text", "truncated", "error")
