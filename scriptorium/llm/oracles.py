"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from scriptorium.llm import quality, secrets

SPACE = r"[\x20\x09-\x0D]"

#: The law of bytes: rows in order of doc_id, cut at 40 equal parts of all bytes by the middle of each row.
OP1 = """
with recursive steps(n, c, k) as (
    select i, i, 0 from range(256) t(i)
    union all select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crc as (select list(c order by n) as tab from steps where k = 8),
bytes as materialized (select doc_id, strlen(coalesce(text, '')) as n, hex(encode(coalesce(text, ''))) as h from documents),
sized as (select doc_id, n + 16 as size,
    list_reduce(list_prepend(4294967295::bigint, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i::int + 1, 2))::bigint)),
                lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])) as c from bytes, crc),
so_far as (select *, sum(size) over (order by doc_id, c, size rows unbounded preceding) - size / 2.0 as middle, sum(size) over () as total, row_number() over (order by doc_id, c, size) as nth from sized),
cut as (select *, cast(least(floor(middle / total * 40), 39) as int) as shard from so_far)
select doc_id, cast(size as bigint) as size, cast(xor(c, 4294967295) as bigint) as text_crc32, 'bytes' as law, shard, nth - min(nth) over (partition by shard) as slot, cast(null as int) as grown_shard from cut
"""

OP3 = rf"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as sh from w),
n as (select doc_id, len(sh) as n from s),
e as (select doc_id, hash(unnest(sh)) as h from s),
links as (select a.doc_id as a, b.doc_id as b from e a join e b on a.h = b.h and a.doc_id < b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
    where 100 * least(na.n, nb.n) >= 90 * greatest(na.n, nb.n) group by 1, 2, na.n, nb.n having 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select doc_id, doc_id from n union select r.a, l.b from reach r join both_ways l on l.a = r.b)
select n.doc_id, cast(n.n as bigint) as n_shingles, min(r.b) as component_id from n join reach r on r.a = n.doc_id group by n.doc_id, n.n
"""


def parts(kind: str) -> str:
    """Places of a kind's matches: the gap before each match and the match add up."""
    pattern, group, least = (secrets.BASE | secrets.WEAK)[kind]
    sql = pattern.replace("'", "''").replace(r"\x20", " ")
    counted = f"regexp_extract_all(text, '{sql}', {group})"
    return f"""select doc_id, k, {secrets.KINDS.index(kind)} as kind, '{kind}' as name, ends - len(m) as start, ends as stop from (
        select doc_id, k, m, counted, sum(len(gap) + len(m)) over (partition by doc_id order by k) as ends from (
            select doc_id, generate_subscripts(ms, 1) as k, unnest(gaps) as gap, unnest(ms) as m, unnest(cs) as counted from (
                select doc_id, regexp_extract_all(text, '(?s)(.*?)(?:{sql})', 1) as gaps, regexp_extract_all(text, '{sql}', 0) as ms, {counted} as cs
                from documents where regexp_matches(text, '{sql}')))) where len(counted) >= {least}"""


OP6 = r"""
with rules(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(substr(rest, len(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut),
parsed as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from split)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from (
    select p.page_id, p.host, p.path, r.h || r.p as rule, r.verdict, row_number() over (partition by p.page_id, p.host, p.path order by len(r.h) desc, len(r.p) desc) as nth
    from parsed p left join rules r on (p.host = r.h or ends_with(p.host, '.' || r.h)) and starts_with(p.path, r.p)) where nth = 1
"""

OP8 = """
with good as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)
select query_id, cast(rank as int) as rank, vec_id, score from (
    select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score,
           row_number() over (partition by q.vec_id order by list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) desc, c.vec_id) as rank
    from good q join good c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)) where rank <= 5
"""


def histogram(counts: list[str]) -> str:
    return "[" + ", ".join(f"({c})::double" for c in counts) + "]"


def distance(own: str, reference: str) -> str:
    def part(x: str, y: str) -> str:
        return f"case when {x} > 0 then {x} * log2(2 * {x} / ({x} + {y})) else 0 end"

    x, y = f"z[1] / list_sum({own})", f"z[2] / list_sum({reference})"
    return f"case when list_sum({own}) > 0 and list_sum({reference}) > 0 then sqrt(greatest(list_sum(list_transform(list_zip({own}, {reference}), lambda z: ({part(x, y)} + {part(y, x)}) / 2)), 0)) end"


def op9() -> str:
    def count(of: str) -> str:
        return f"len(regexp_replace(x, '[^{of}]+', '', 'g'))"

    punctuation = r"!\"''()+,./:;=?@\[\\\]^_`{}~-"
    bins = " ".join(f"when lang = '{k}' then " + histogram([f"len(list_filter(ws, lambda w: w = '{w}'))" for w in ws]) for k, ws in quality.COMMON.items())
    return rf"""
with t as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as x from documents),
w as (select *, list_filter(regexp_split_to_array(x, '{SPACE}+'), lambda w: w <> '') as ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from t),
win as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as s from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, s) as c from win) where c > 1) group by doc_id),
f as (select w.doc_id, w.lang, len(ws) as n_words, len(regexp_replace(x, '{SPACE}+', '', 'g')) as word_chars, len(x) as n_chars, {count("#*$%&|<>")} as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(rep.n, 0) as n_repeat_words, {count("A-Z")} as up, {count("0-9")} as dg, {count(punctuation)} as pu, {count(r"\x{80}-\x{10FFFF}")} as ot, case {bins} end as b from w left join rep on rep.doc_id = w.doc_id),
h as (select *, {histogram(["word_chars - up - dg - n_symbols - pu - ot", "up", "dg", "n_symbols", "pu", "ot", "n_chars - word_chars"])} as c, list_append(b, n_words - list_sum(b)) as cw from f),
r as (select lang, [{", ".join(f"sum(c[{i}])" for i in range(1, 8))}] as rc, [{", ".join(f"sum(cw[{i}])" for i in range(1, 14))}] as rw from h group by lang),
j as (select h.*, {distance("c", "rc")} as dc, {distance("cw", "rw")} as dw, (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) as base_failed from h join r on r.lang = h.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not (base_failed or coalesce(n_words >= {quality.MIN_WORDS} and dc > {quality.MAX_CHARS}, false) or coalesce(n_words >= {quality.MIN_COMMON} and dw > {quality.MAX_COMMON}, false)) as kept from j
"""


def op5() -> str:
    """RE2 has no lookaround, so the weak 40-character keys are cut out of maximal runs of key characters."""
    weak = []
    for kind in secrets.WEAK:
        if kind == "key40":
            run = "[A-Za-z0-9+/=_.-]+"
            held = parts("hex").replace(secrets.BASE["hex"][0], run).replace(f"{secrets.KINDS.index('hex')} as kind, 'hex'", f"{secrets.KINDS.index(kind)} as kind, '{kind}'").replace(">= 32", "= 40")
            weak.append(held.replace("len(counted) = 40", "regexp_full_match(counted, '[A-Za-z0-9+/]{40}') and regexp_matches(counted, '[A-Z]') and regexp_matches(counted, '[a-z]') and regexp_matches(counted, '[0-9]')"))
        else:
            weak.append(parts(kind))
    names = ", ".join(f"count(*) filter (name = '{k}') as n_{k}" for k in secrets.BASE)
    role = "case name " + " ".join(f"when '{k}' then '{v}'" for k, v in secrets.PARTS.items()) + " end"
    near = f"o.doc_id = w.doc_id and o.start <= w.stop + {secrets.SCOPE} and o.stop >= w.start - {secrets.SCOPE} and (o.start >= w.stop or o.stop <= w.start)"
    needed = "case w.name " + " ".join(f"when '{k}' then {len(v)}" for k, v in secrets.NEEDS.items()) + " end"
    wanted = "(" + " or ".join(f"(w.name = '{k}' and o.role in ({', '.join(repr(x) for x in v)}))" for k, v in secrets.NEEDS.items()) + ")"
    return rf"""
with base as ({" union all ".join(parts(k) for k in secrets.BASE)}),
weak_all as ({" union all ".join(weak)}),
weak as (select * from weak_all w where not exists (select 1 from base b where b.doc_id = w.doc_id and b.start < w.stop and w.start < b.stop)),
every as (select *, {role} as role from (select * from base union all select * from weak)),
linked as (select w.doc_id, w.name, w.kind, w.start, w.stop from weak w join every o on {near} and {wanted} group by all having count(distinct o.role) = any_value({needed})),
found as (select doc_id, name, kind, start, stop from base union all select doc_id, name, kind, start, stop from linked),
line as (select doc_id, string_agg(name || ':' || start::bigint || ':' || stop::bigint, ',' order by start, kind) as spans from found group by doc_id),
base_line as (select doc_id, {names}, string_agg(name || ':' || start::bigint || ':' || stop::bigint, ',' order by start, kind) as spans from base group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b.spans, '')) as base_sha256, coalesce(l.spans, '') as spans
from documents d left join base_line b on b.doc_id = d.doc_id left join line l on l.doc_id = d.doc_id
"""


OP10 = r"""
with recursive l as (select conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from conversations),
p as (select conv_id, turn, pos, regexp_extract(line, '^(?:[\x20\x09-\x0D]*>)+') as mark, substr(line, len(regexp_extract(line, '^(?:[\x20\x09-\x0D]*>)+')) + 1) as rest from l),
x as (select *, len(regexp_replace(mark, '[^>]+', '', 'g')) as level, trim(regexp_replace(translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) as norm from p),
r as (select *, sum(case when level = before then 0 else 1 end) over (partition by conv_id, turn order by pos) as run, sum(case when norm = '' then 1 else 0 end) over (partition by conv_id, turn order by pos) as gap
    from (select *, lag(level) over (partition by conv_id, turn order by pos) as before from x)),
runs as (select conv_id, turn, level, run, string_agg(norm, ' ' order by pos) as t from r where norm <> '' group by all),
paragraphs as (select conv_id, turn, level, run, gap, string_agg(norm, ' ' order by pos) as t from r where norm <> '' group by all),
wrote as (select conv_id, turn, t from runs where level = 0 union select conv_id, turn, t from paragraphs where level = 0 union select conv_id, turn, norm from r where level = 0 and norm <> ''),
by_run as (select q.conv_id, q.turn, q.run, max(o.turn) as writer from runs q join wrote o on o.conv_id = q.conv_id and o.t = q.t and o.turn < q.turn where q.level > 0 group by all),
by_paragraph as (select q.conv_id, q.turn, q.run, q.gap, max(o.turn) as writer from paragraphs q join wrote o on o.conv_id = q.conv_id and o.t = q.t and o.turn < q.turn where q.level > 0 and len(q.t) >= 4 group by all),
by_line as (select q.conv_id, q.turn, q.pos, max(o.turn) as writer from r q join wrote o on o.conv_id = q.conv_id and o.t = q.norm and o.turn < q.turn where q.level > 0 and len(q.norm) >= 4 group by all),
met as (select * from (select r.conv_id, r.turn, r.level, r.pos, coalesce(a.writer, b.writer, c.writer) as writer from r left join by_run a on a.conv_id = r.conv_id and a.turn = r.turn and a.run = r.run
    left join by_paragraph b on b.conv_id = r.conv_id and b.turn = r.turn and b.run = r.run and b.gap = r.gap left join by_line c on c.conv_id = r.conv_id and c.turn = r.turn and c.pos = r.pos where r.level > 0 and r.norm <> '') where writer is not null),
votes as (select *, row_number() over (partition by conv_id, turn order by n desc, writer desc) as nth from (select conv_id, turn, writer, count(*) as n from met where level = 1 group by conv_id, turn, writer)),
parents as (select conv_id, turn, writer as parent_turn from votes where nth = 1),
m as (select conv_id, turn, role, coalesce(text, '') as text, row_number() over () as id from conversations),
chain as (select m.id, m.conv_id, m.turn as root from m union all select c.id, c.conv_id, p.parent_turn from chain c join parents p on p.conv_id = c.conv_id and p.turn = c.root),
threads as (select id, min(root) as thread_turn from chain group by id),
bodies as (select conv_id, turn, trim(string_agg(case when level = 0 then rest end, chr(10) order by pos), chr(13) || chr(10)) as body, count(*) filter (level > 0) as n_quoted, max(level) as max_level from x group by conv_id, turn),
linked as (select conv_id, turn, count(*) as n_linked from met group by conv_id, turn)
select m.conv_id, m.turn, m.role, coalesce(b.body, '') as body, b.n_quoted, coalesce(k.n_linked, 0) as n_linked, cast(b.max_level as int) as max_level, p.parent_turn, t.thread_turn,
    row_number() over (partition by m.conv_id order by t.thread_turn, m.turn) - 1 as position
from m join bodies b on b.conv_id = m.conv_id and b.turn = m.turn join threads t on t.id = m.id
left join parents p on p.conv_id = m.conv_id and p.turn = m.turn left join linked k on k.conv_id = m.conv_id and k.turn = m.turn
"""


def op11() -> str:
    def p(n: str, total: str) -> str:
        return f"1 + (1000000000 * ({n} + 1)::hugeint // ({total} + v))::bigint"

    def f(p: str, q: str) -> str:
        return f"(({p}) - ({q})) * (({p}) - ({q})) // ({q})"

    return rf"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
e as (select id, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as lang_n from e group by lang, term having count(distinct id) >= 3),
langs as (select lang, count(*) as v, sum(lang_n) as total from kept group by lang),
groups as (select distinct lang, source from d),
counts as (select lang, source, term, count(*) as n from e group by all),
every as (select g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) as n from groups g join kept k on k.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
totals as (select lang, source, sum(n) as total from every group by lang, source),
shares as (select e.lang, e.source, e.term, e.n, {p("e.n", "t.total")} as p, {p("e.lang_n", "l.total")} as q from every e join totals t on t.lang = e.lang and t.source = e.source join langs l on l.lang = e.lang),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join
    (select x.lang, x.source, y.source as item, sum({f("x.p", "y.p")}) as value from shares x join shares y on y.lang = x.lang and y.term = x.term and y.source <> x.source group by all) s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, term as item, {f("p", "q")} as value from shares where n > 0 and p > q),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
    union all select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms) where rank <= 200)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked
"""


OP12 = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda t: t <> '') as ws from p),
totals as (select lang, sum(len(ws)) as n from w group by lang),
g as (select lang, k, ws, unnest(range(1, len(ws) - k + 2)) as i from w, (values (1), (2), (3), (4), (5)) t(k) where len(ws) >= k),
f as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as a from g group by all having count(*) >= 100),
inside as (select lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') as phrase, max(a) as longer from (select *, unnest(range(1, k - m + 2)) as i from f, (values (2), (3), (4)) t(m) where m < k) group by all),
c as (select f.* from f left join inside o on o.lang = f.lang and o.phrase = f.phrase where f.k > 1 and (o.longer is null or 100 * o.longer < 100 * f.a)),
cuts as (select lang, phrase, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') as one, array_to_string(string_split(phrase, ' ')[j + 1:k], ' ') as two from (select *, unnest(range(1, k)) as j from c)),
scored as (select c.lang, c.phrase, c.a, x.a as l, y.a as r, t.n, (1000 * c.a::hugeint * t.n::hugeint // (x.a::hugeint * y.a::hugeint))::bigint as score, c.j from cuts c
    join f x on x.lang = c.lang and x.phrase = c.one join f y on y.lang = c.lang and y.phrase = c.two join totals t on t.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, rank, phrase, a, l, r, n::bigint as n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best) where rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_prefix_sharding": OP1,
    "op3_jaccard_join": OP3,
    "op5_linked_secrets": op5(),
    "op6_url_rules": OP6,
    "op8_kd_search": OP8,
    "op9_divergence_rules": op9(),
    "op10_quote_linking": OP10,
    "op11_source_divergence": op11(),
    "op12_phrase_collocations": OP12,
}
