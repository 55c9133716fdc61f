"""Keyed writes, retention, alerts and token streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import forms as FM
from scriptorium.operators import writes as W
from scriptorium.plans.registry import query
from scriptorium.sources import files as S
from scriptorium.sources.views import table, view
from scriptorium.streaming import alerts as AL
from scriptorium.streaming import tokens as TK


@query("select user_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def upsert_latest(spark, d):
    return W.latest(table(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "value")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id) as n from events where event_type = 'click') where n = 1 and user_id not in (select user_id from events where event_type = 'purchase' and value > 90)")
def insert_ignore(spark, d):
    e = table(spark, d, "events")
    have = e.where("event_type = 'purchase' and value > 90").select("user_id").distinct()
    return W.insert_ignore(have, e.where("event_type = 'click'"), ["user_id"], F.col("event_id")).select("user_id", "event_id")


@query("select user_identifier, case when u.k is not null then 'pro' else s.tier end as tier from subs s left join (select distinct concat('user:', user_id) as k from events where event_type = 'purchase') u on u.k = s.user_identifier", "subs")
def org_upsert(spark, d):
    subs = view(spark, d, "subs").select("user_identifier", "tier")
    paid = table(spark, d, "events").where("event_type = 'purchase'").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("user_identifier")).distinct().withColumn("tier", F.lit("pro"))
    return W.upsert(subs, paid.join(subs.select("user_identifier"), "user_identifier", "left_semi"), ["user_identifier"])


@query("select user_identifier, case when status = 'pending' and age_ms > 600000 then 'cancelled' else status end as status from subs", "subs")
def keyed_update(spark, d):
    return W.keyed_update(view(spark, d, "subs"), F.expr("status = 'pending' and age_ms > 600000"), status="cancelled").select("user_identifier", "status")


@query("select id from corpus where not starts_with(id, 'c1:')", "corpus")
def prefix_delete(spark, d):
    return W.delete_prefix(view(spark, d, "corpus"), "id", "c1:").select("id")


@query("select c.id, c.vec_id from corpus c where exists (select 1 from moderation m where m.doc_id = c.vec_id and m.estado_moderacion <> 'rechazado')", "corpus moderation")
def cascade_delete(spark, d):
    kept = view(spark, d, "moderation").where("estado_moderacion <> 'rechazado'")
    return W.cascade_delete(view(spark, d, "corpus"), kept, "vec_id", "doc_id").select("id", "vec_id")


@query("select event_id, case when u.user_identifier is not null then f.user_identifier end as user_identifier from (select event_id, concat('user:', user_id) as user_identifier from events) f left join (select distinct user_identifier from usage where tier <> 'free') u on u.user_identifier = f.user_identifier", "usage")
def feedback_join(spark, d):
    feedback = table(spark, d, "events").select("event_id", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("user_identifier"))
    return W.set_null_delete(feedback, view(spark, d, "usage").where("tier <> 'free'"), "user_identifier", "user_identifier").select("event_id", "user_identifier")


@query("select user_identifier, tier from subs where user_identifier = 'user:7'", "subs")
def rls_view(spark, d):
    return W.visible(view(spark, d, "subs"), "authenticated", "user:7").select("user_identifier", "tier")


@query(
    """select user_identifier, array_to_string(list_filter([case when status not in ('active', 'trialing', 'past_due') then 'status' end, case when age_ms >= 2000000 then 'age' end,
       case when provider_sub_id is null then 'sub' end], lambda x: x is not null), ',') as violations from subs""",
    "subs",
)
def constraint_split(spark, d):
    rows = W.checked(view(spark, d, "subs"), status=F.col("status").isin("active", "trialing", "past_due"), age=F.col("age_ms") < 2_000_000, sub=F.col("provider_sub_id").isNotNull())
    return rows.select("user_identifier", F.array_join("violations", ",").alias("violations"))


@query("select event_id from events where event_type <> 'error' or ts >= (select max(ts) from events) - interval 7 day")
def retention_filter(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))  # one row
    return e.crossJoin(F.broadcast(last)).where("event_type <> 'error' or ts >= last - interval 7 days").select("event_id")


@query("select user_id, event_id, nth from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as nth from events where event_type in ('error', 'signup')) where nth <= 8")
def retry_attempts(spark, d):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").where(F.col("event_type").isin("error", "signup")).withColumn("nth", nth).where("nth <= 8").select("user_id", "event_id", "nth")


@query(
    """select id, value, place from (select user_id as id, arg_max(event_id, event_id) as value, row_number() over (order by min(event_id) desc) as place from events where event_type <> 'error' group by user_id) where place <= 200"""
)
def alerts_merge(spark, d):
    e = table(spark, d, "events").where("event_type <> 'error'")
    return AL.merged(e, "user_id", "event_id").select(F.col("user_id").alias("id"), F.col("event_id").alias("value"), "place")


MESSAGE = "case event_type when 'view' then 'Ollama starts' when 'click' then 'MiniMax then Tavily' when 'purchase' then 'Claude answers' when 'signup' then 'Tavily searches' else 'no stage' end"
EVENT_TYPE = "case when event_id % 5 = 0 then 'FINDING_DISCOVERED' when event_id % 7 = 0 then 'RESOLUTION_RECOMMENDED' end"
SHARE = f"""case when contains({MESSAGE}, 'MiniMax') then 40 when contains({MESSAGE}, 'Tavily') then 60 when contains({MESSAGE}, 'Claude') then 100 when contains({MESSAGE}, 'Ollama') then 20 end"""


def alerts(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.expr(MESSAGE).alias("message"), F.expr(EVENT_TYPE).alias("type"))
    return rows.withColumn("metadata", F.when(F.col("type").isNotNull(), F.create_map(F.lit("eventType"), "type")))


@query(f"select event_id, {SHARE} as progress, coalesce({EVENT_TYPE} = 'FINDING_DISCOVERED', false) as is_finding, coalesce({EVENT_TYPE} = 'RESOLUTION_RECOMMENDED', false) as is_resolution from events")
def alert_progress(spark, d):
    return AL.progress(alerts(spark, d)).select("event_id", "progress", "is_finding", "is_resolution")


@query(
    f"""select user_id, coalesce(arg_min(share, event_id) filter (share is not null), 20) as progress, count(*) filter (kind = 'FINDING_DISCOVERED') as findings, count(*) filter (kind = 'RESOLUTION_RECOMMENDED') as resolutions
        from (select user_id, event_id, {SHARE} as share, {EVENT_TYPE} as kind from events) group by user_id"""
)
def alert_console(spark, d):
    return AL.console(alerts(spark, d), "user_id", "event_id")


OWN_FORMAT = TK.Source(("delta",), ("usage",), ("turn",))


@query("select conv_id, string_agg(text, '' order by turn) as answer, '{\"turn\":' || max(turn) || '}' as usage, count(*) as n_chunks from conversations group by conv_id")
def sse_parse(spark, d):
    """Token streams: each turn arrives as a data line; the deltas of a stream are joined in order, and malformed lines are left out."""
    delta = F.to_json(F.struct(F.col("text").alias("delta"), F.struct("turn").alias("usage")))
    lines = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), F.concat(F.lit("data: "), delta, F.lit("\n: comment\ndata: {broken\n")).alias("chunk"))
    found = TK.answers(TK.pieces(lines, "conv_id", "seq", "chunk", OWN_FORMAT), "conv_id", "seq", OWN_FORMAT)
    return found.select("conv_id", F.col("text").alias("answer"), F.to_json(F.struct("turn")).alias("usage"), "n_chunks")


#: Turns of a conversation from this one on stand behind the line that ends its stream.
ENDS = 5


@query(
    f"""select conv_id, coalesce(string_agg('say data: [DONE] now ' || text, '' order by turn) filter (turn < {ENDS}), '') as answer, count(*) > {ENDS} as done,
        max(case when turn < {ENDS} and turn % 2 = 0 then 10 * turn end) as prompt_tokens, max(case when turn < {ENDS} then turn end) as completion_tokens from (
            select conv_id, text, row_number() over (partition by conv_id order by turn) - 1 as turn from conversations) group by conv_id"""
)
def sse_provider_stream(spark, d):
    """The provider's format, in chunks that end inside lines and characters: the mark of the end stands in every delta, and as a line of
    its own before turn ENDS; even turns report the prompt, all turns the completion, and each count is the last one given."""
    turns = table(spark, d, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    content = F.array(F.struct(F.struct(F.concat(F.lit("say data: [DONE] now "), "text").alias("content")).alias("delta")))
    usage = F.struct(F.when(F.col("n") % 2 == 0, 10 * F.col("n")).alias("prompt_tokens"), F.col("n").alias("completion_tokens"))
    line = F.concat(F.when(F.col("n") == ENDS, "data: [DONE]\n").otherwise(""), F.lit("event: x\ndata: "), F.to_json(F.struct(content.alias("choices"), usage.alias("usage"))), F.lit("\n"))
    data = line.cast("binary")
    halves = turns.select("conv_id", "n", data.alias("data")).select("conv_id", "n", F.expr("inline(array(struct(0 as half, substring(data, 1, octet_length(data) div 2) as chunk), struct(1 as half, substring(data, octet_length(data) div 2 + 1) as chunk)))"))
    chunks = halves.select("conv_id", (2 * F.col("n") + F.col("half")).alias("seq"), "chunk")
    return TK.answers(TK.pieces(chunks, "conv_id", "seq", "chunk"), "conv_id", "seq").select("conv_id", F.col("text").alias("answer"), "done", "prompt_tokens", "completion_tokens")


FEEDBACK = """(select event_id, case when event_id % 4 = 0 then 'no id' else '12345678-9abc-4def-89ab-0123456789ab' end as consulta_id, case event_id % 3 when 0 then 'true' when 1 then 'false' end as util, repeat('  ' || event_type, 90) as comentario from events)"""


@query(
    f"""select event_id, case when consulta_id = 'no id' then 'bad_id' when util is null then 'bad_flag' end as reason, case when consulta_id <> 'no id' and util is not null then util = 'true' end as util,
        case when consulta_id <> 'no id' and util is not null then substr(trim(comentario), 1, 500) end as comentario from {FEEDBACK}"""
)
def feedback_insert(spark, d):
    """Feedback that is inserted, and what is refused with its reason."""
    rows = spark.sql("select * from " + FEEDBACK.replace("from events", "from {events}"), events=table(spark, d, "events"))
    taken, refused = W.feedback(rows)
    none = refused.select("event_id", "reason", F.lit(None).cast("boolean").alias("util"), F.lit(None).cast("string").alias("comentario"))
    return taken.select("event_id", F.lit(None).cast("string").alias("reason"), "util", "comentario").union(none)


@query(
    """select order_id, organization_id, coalesce(tier, 'pro') as tier, 0 as amount, 'HNL' as currency, 'approved' as status
       from (select case when event_id % 5 > 0 then 'o' || event_id end as order_id, case when event_id % 7 > 0 then 'org' || user_id end as organization_id, case event_id % 3 when 0 then 'pro' when 1 then 'academico' end as tier,
         case when event_type = 'purchase' then 'approved' else 'pending' end as state from events) where state = 'approved' and order_id is not null and organization_id is not null"""
)
def approved_orders(spark, d):
    e = table(spark, d, "events")
    rows = e.select(
        F.expr("case when event_id % 5 > 0 then concat('o', event_id) end").alias("order_id"), F.expr("case when event_id % 7 > 0 then concat('org', user_id) end").alias("organization_id"),
        F.expr("case event_id % 3 when 0 then 'pro' when 1 then 'academico' end").alias("tier"), F.when(F.col("event_type") == "purchase", "approved").otherwise("pending").alias("status"),
    )
    return W.approved_orders(rows)[1]


@query(
    """select c_custkey, array_to_string(list_filter([case when years is null or years < 0 or years > 40 then 'penalty' end, case when offence not in ('Robo', 'Hurto', 'Otro') then 'offence' end, case when fixed is null then 'home' end], lambda x: x is not null), ',') as errors
       from (select c_custkey, case when c_custkey % 5 > 0 then c_custkey % 60 - 5 end as years, case c_custkey % 3 when 0 then 'Robo' when 1 then 'Hurto' else 'Nada' end as offence, case when c_custkey % 4 > 0 then true end as fixed from customer)"""
)
def input_validation(spark, d):
    """Forms of a calculator: ranges, kinds and fields that must be there."""
    rows = table(spark, d, "customer").select("c_custkey", F.expr("case when c_custkey % 5 > 0 then c_custkey % 60 - 5 end").alias("years"), F.expr("case c_custkey % 3 when 0 then 'Robo' when 1 then 'Hurto' else 'Nada' end").alias("offence"), F.expr("case when c_custkey % 4 > 0 then true end").alias("fixed"))
    found = W.validated(rows, penalty=F.col("years").between(0, 40), offence=F.col("offence").isin("Robo", "Hurto", "Otro"), home=F.col("fixed").isNotNull())
    return found.select("c_custkey", F.array_join("errors", ",").alias("errors"))


@query(
    """select c_custkey, array_to_string(list_filter([
        case when c_custkey % 5 = 0 then 'pena_maxima_del_delito_anos: missing' when c_custkey % 60 - 5 not between 0 and 40 then 'pena_maxima_del_delito_anos: size' end,
        case c_custkey % 4 when 3 then 'fecha_comision_del_hecho: missing' when 1 then null else 'fecha_comision_del_hecho: date' end,
        case when c_custkey % 3 = 0 then 'hubo_acto_interruptivo: missing' end, case when c_custkey % 7 = 0 then 'fecha_ultimo_acto_interruptivo: date' end,
        case when c_custkey % 6 = 0 then 'es_delito_imprescriptible: kind' end], lambda x: x is not null), ',') as problems from customer"""
)
def form_validation(spark, d):
    """Forms as JSON texts, checked against a schema that is data."""
    fields = F.expr(
        """to_json(named_struct('pena_maxima_del_delito_anos', case when c_custkey % 5 > 0 then c_custkey % 60 - 5 end,
            'fecha_comision_del_hecho', case c_custkey % 4 when 0 then '2024-02-30T00:00:00Z' when 1 then '2023-05-01T10:00:00-06:00' when 2 then 'yesterday' end,
            'hubo_acto_interruptivo', case when c_custkey % 3 > 0 then c_custkey % 3 = 1 end, 'fecha_ultimo_acto_interruptivo', case when c_custkey % 7 = 0 then '2024-01-01' end))"""
    )
    flag = F.when(F.col("c_custkey") % 6 == 0, '"no"').otherwise("true")
    form = F.concat(F.regexp_replace(fields, r"\}$", ""), F.when(fields == "{}", "").otherwise(","), F.lit('"es_delito_imprescriptible":'), flag, F.lit("}"))
    rows = table(spark, d, "customer").select("c_custkey", form.alias("form"))
    return FM.checked_forms(rows, "form", FM.LIMITATION).select("c_custkey", F.array_join("problems", ",").alias("problems"))


@query(
    """select s.user_identifier, coalesce(case when e.n % 3 > 0 then 'payer' || e.n end, s.provider_sub_id) as provider_sub_id, s.tier, date '2026-01-05' as updated_at from subs s
       left join (select concat('user:', user_id) as user_identifier, count(*) as n from events group by user_id) e on e.user_identifier = s.user_identifier""",
    "subs",
)
def coalesce_update(spark, d):
    """A change that leaves what it does not know."""
    subs = view(spark, d, "subs").select("user_identifier", "provider_sub_id", "tier")
    counts = table(spark, d, "events").groupBy(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("user_identifier")).agg(F.count("*").alias("n"))
    changes = counts.select("user_identifier", F.when(F.col("n") % 3 > 0, F.concat(F.lit("payer"), F.col("n").cast("string"))).alias("provider_sub_id"))
    return W.stamped(W.coalesce_update(subs, changes, ["user_identifier"], "provider_sub_id"), F.lit("2026-01-05").cast("date"))


@query("select user_id, event_type, count(*) as n from events group by all having count(*) > 1")
def key_violations(spark, d):
    return S.key_violations(table(spark, d, "events"), "user_id", "event_type")
