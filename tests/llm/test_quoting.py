import random
import re

from scriptorium.llm import quoting

SCHEMA = "conv_id long, turn long, role string, text string"


def lines_of(text):
    out = []
    for line in (text or "").split("\n"):
        mark = re.match("(?:[\x20\x09-\x0d]*>)*", line)[0]
        rest = line[len(mark) :]
        norm = re.sub("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", "".join(c.lower() if c.isascii() else c for c in rest)).strip(" ")
        out.append((mark.count(">"), rest, norm))
    return out


def passages(text):
    """The runs of lines of one level, as (level, paragraphs), each paragraph a list of normal lines with words."""
    out, last = [], None
    for level, _, norm in lines_of(text):
        if level != last:
            out.append((level, [[]]))
            last = level
        if norm:
            out[-1][1][-1].append(norm)
        else:
            out[-1][1].append([])
    return [(level, [p for p in ps if p]) for level, ps in out]


def written(text):
    out = set()
    for level, ps in passages(text):
        if level == 0 and ps:
            out |= {" ".join(" ".join(p) for p in ps), *(" ".join(p) for p in ps), *(x for p in ps for x in p)}
    return out


def brute(rows, least=quoting.LEAST):
    out = []
    parents = {}
    for c, t, _, text in rows:
        votes, linked = {}, 0

        def writer(wanted, c=c, t=t):
            return max((t2 for c2, t2, _, x2 in rows if c2 == c and t2 < t and wanted in written(x2)), default=None)

        for level, ps in passages(text):
            if not level or not ps:
                continue
            found = []
            if (w := writer(" ".join(" ".join(p) for p in ps))) is not None:
                found = [w] * sum(map(len, ps))
            else:
                for p in ps:
                    if len(" ".join(p)) >= least and (w := writer(" ".join(p))) is not None:
                        found += [w] * len(p)
                    else:
                        found += [w for x in p if len(x) >= least and (w := writer(x)) is not None]
            linked += len(found)
            for w in found if level == 1 else ():
                votes[w] = votes.get(w, 0) + 1
        parents[c, t] = max(votes, key=lambda w: (votes[w], w)) if votes else None
        own = lines_of(text)
        out.append((c, t, "\n".join(r for v, r, _ in own if v == 0).strip("\r\n"), sum(v > 0 for v, _, _ in own), linked, max(v for v, _, _ in own), parents[c, t]))
    done = []
    for r in out:
        root = r[1]
        while parents[r[0], root] is not None:
            root = parents[r[0], root]
        done.append((*r, root))
    order = sorted(done, key=lambda r: (r[0], r[7], r[1]))
    return [(*r, sum(x[0] == r[0] for x in order[:i])) for i, r in enumerate(order)]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as key", "'y' as h", "1 as part", "2 as lines", "3 as run", "4 as block")
    got = quoting.conversations(df, **options).collect()
    return sorted([(r["conv_id"], r["turn"], r["body"], r["n_quoted"], r["n_linked"], r["max_level"], r["parent_turn"], r["thread_turn"], r["position"]) for r in got], key=lambda r: (r[0], r[8]))


def test_equals_brute_force(spark):
    r = random.Random(6)
    rows = []
    for c in range(12):
        texts = []
        for t in range(9):
            own = [f"Line {r.randrange(30)} of person {t % 3}!" for _ in range(r.randrange(3))]
            if texts and r.random() < 0.7:
                quoted = r.choice(texts).split("\n")
                own = [(">" if x.startswith(">") else "> ") + x.upper() for x in quoted] + own
            texts.append("\n".join(own))
            rows.append((c, t, "user", texts[-1]))
    assert found(spark, rows) == brute(rows)
    assert any(x[6] is not None and x[7] != x[6] for x in brute(rows))


def conversation(r, c, n, gap=1):
    """Messages that quote earlier ones whole, in part, wrapped anew, in upper case, nested, or not at all."""
    texts, rows = [], []
    for t in range(n):
        own = [" ".join(f"word{r.randrange(40)}" for _ in range(r.randrange(1, 9))) + r.choice([".", "!", ""]) if r.random() < 0.8 else "" for _ in range(r.randrange(4))]
        own += ["ok"] if r.random() < 0.1 else []
        if texts and r.random() < 0.7:
            quoted = r.choice(texts).split("\n")
            kind = r.randrange(5)
            if kind == 0:
                quoted = quoted[: max(1, len(quoted) // 2)]
            elif kind == 1:
                words = " ".join(x for x in quoted if not x.startswith(">")).split()
                quoted = [" ".join(words[i : i + 5]) for i in range(0, len(words), 5)] or [""]
            elif kind == 2:
                quoted = [x.upper() for x in quoted]
            elif kind == 3:
                quoted = [*quoted, "a line that nobody wrote"]
            own = [(">" if x.startswith(">") else "> ") + x for x in quoted] + own
        texts.append("\n".join(own))
        rows.append((c, t * gap, "user", texts[-1]))
    return rows


def test_thousands_of_messages_that_quote(spark, monkeypatch):
    monkeypatch.setattr(quoting, "TURNS", 16)
    r = random.Random(9)
    rows = [m for c in range(60) for m in conversation(r, c, 12, gap=r.choice([1, 5]))] + conversation(r, 99, 250)
    wanted = brute(rows)
    assert found(spark, rows) == wanted
    assert sum(x[4] > 0 for x in wanted) > 300 and any(x[6] is not None and x[7] != x[6] for x in wanted)
    assert found(spark, rows[:300], least=12) == brute(rows[:300], least=12)


def test_short_and_rewrapped_quotes_link(spark):
    rows = [(1, 0, "a", "yes\n\nThis is a longer answer, wrapped at one width."), (1, 1, "b", "> yes\nwhy"), (1, 2, "c", "> this is a longer\n> answer wrapped at\n> one width\nfine"), (1, 3, "d", "> no\nnever said")]
    assert [(r[4], r[6]) for r in found(spark, rows)] == [(r[4], r[6]) for r in brute(rows)]
    assert {r[1]: (r[4], r[6]) for r in found(spark, rows)} == {0: (0, None), 1: (1, 0), 2: (3, 0), 3: (0, None)}


def test_sql_equals_brute_force(tmp_path):
    import duckdb

    from scriptorium.llm.oracles import ORACLES

    r = random.Random(12)
    rows = [m for c in range(30) for m in conversation(r, c, 10)]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    order = ["conv_id", "turn", "body", "n_quoted", "n_linked", "max_level", "parent_turn", "thread_turn", "position"]
    got = con.execute(f"select {', '.join(order)} from ({ORACLES['op10_quote_linking']})").fetchall()
    assert sorted(got, key=lambda x: (x[0], x[8])) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "u", ""), (1, 2, "u", "> \n>>>"), (1, 3, "u", "x" * 40_000), (1, 4, "u", "> " + "x" * 40_000)]
    assert found(spark, rows) == brute(rows)


def test_long_runs_of_marks(spark):
    marks, mixed = ">" * 200_000, "> \t>" * 60_000
    rows = [(1, 0, "u", "a line here"), (1, 1, "u", marks + " a line here"), (1, 2, "u", mixed + " a line here\n" + marks), (1, 3, "u", " " * 100_000 + "no quote"), (1, 4, "u", (">" * 5_000 + "\n") * 3)]
    assert found(spark, rows) == brute(rows)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, 0, "u", "> a line here"), (1, None, "u", "a line here"), (1, 5, "u", "> a line here"), (1, 5, "u", "> a line here")]
    got = quoting.conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and all(r["parent_turn"] is None for r in got)
    assert sorted(r["position"] for r in got if r["conv_id"] == 1) == [0, 1, 2]
    assert quoting.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
