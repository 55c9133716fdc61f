import random
import re

import pytest

from scriptorium.llm import licenses
from tests.llm.helpers import ODD, SCHEMA, documents


def pattern_of(template):
    """The template as a regular expression over space-joined words, built apart from the automaton."""
    out = ""
    for part in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\[\]{}]+", template):
        if part == "[[":
            out += "(?:"
        elif part == "]]":
            out += ")?"
        elif part[:2] == "{{":
            out += "(?: [^ ]+){%s}" % part[2:-2].replace("-", ",")
        else:
            out += "".join(" " + re.escape(w) for w in licenses.wording(part).decode().split())
    return out + "(?![^ ])"


CASES = [
    "This work is licensed under the GNU General Public License, version 3.",
    "licensed under the terms of the GNU General Public License version 3 of the License or any later version",
    "licensed under the GNU General Public License version 2",
    "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "cc by cc by nc", "All rights reserved", "Copyright (c) 2020 by Some Body. All rights reserved.",
    "copyright a b c d e f g h i all rights reserved", "Released under the MIT License.", "Released under the terms of MIT License", "Licensed under the Apache License, Version 2.0",
    "We use the Apache web server", "Permission is hereby granted, free of charge", "general public license general public license",
]


@pytest.mark.parametrize("text", CASES)
def test_automata_accept_what_the_pattern_matches(text):
    held = " " + " ".join(licenses.wording(text).decode().split())
    want = {label for label, template, *_ in licenses.TEMPLATES if re.search(pattern_of(template), held)}
    base = {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in held + " "}
    n, n_base, first, last, base_labels, labels, score = licenses.scan_text(text)
    assert n == len(held.split()) and set(filter(None, base_labels.split(","))) == base
    assert set(filter(None, labels.split(","))) == base | want
    assert (score == 1) == bool(want) and 0 <= score <= 1


def random_template(r, depth=0):
    parts = []
    for _ in range(r.randrange(1, 4)):
        kind = r.random()
        if kind < 0.25 and depth < 2:
            parts.append(f"[[{random_template(r, depth + 1)}]]")
        elif kind < 0.4:
            least = r.randrange(3)
            parts.append(f"{{{{{least}-{least + r.randrange(1, 3)}}}}}")
        else:
            parts.append(" ".join(r.choice("abcd") for _ in range(r.randrange(1, 4))))
    return " ".join(parts)


def test_random_templates_on_random_texts():
    r, met = random.Random(3), 0
    for _ in range(400):
        template = "x " + random_template(r)
        automaton = licenses.compiled("own", template)
        for _ in range(15):
            words = [r.choice("abcdx") for _ in range(r.randrange(1, 14))]
            accepted, score = automaton.run([w.encode() for w in words])
            wanted = re.search(pattern_of(template), " " + " ".join(words)) is not None
            assert accepted == wanted and (score == 1 or not wanted), (template, words)
            met += wanted
    assert met > 300


def test_own_templates_are_an_argument(spark):
    df = documents(spark, ["use it under the Zed license", "use it under the very old Zed license now", None])
    got = licenses.scan(df, templates=[("zed", "under the [[very]] {{0-1}} Zed license")]).orderBy("doc_id").collect()
    assert [(r["labels"], r["score"]) for r in got] == [("zed", 1.0), ("zed", 1.0), ("", 0.0)]
    for bad in ("[[all optional]]", "open [[region"):
        with pytest.raises((ValueError, IndexError)):
            licenses.scan(df, templates=[("bad", bad)])


@pytest.mark.parametrize("at", [9, 10, 11])
def test_whole_licenses(at):
    templates = [t for t in licenses.TEMPLATES if len(t[1]) > 600]
    label, template, _ = templates[at % len(templates)]
    text = re.sub(r"\{\{(\d+)-\d+\}\}", lambda m: " ".join(["holder"] * int(m[1])), template.replace("[[", " ").replace("]]", " "))
    assert label in licenses.scan_text("Foo. " + text + " Bar.")[5].split(",")
    cut = text.replace(" MERCHANTABILITY", "")
    assert not any(licenses.automata()[licenses.TEMPLATES.index(t)].run(licenses.wording(cut).split())[0] for t in templates)


BASE_SQL = r"""
with w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from documents),
p as (select doc_id, len(words) as n_words, list_filter(range(len(words)), lambda i: words[i + 1] = 'cc' and words[i + 2] = 'by') as cc,
    list_filter(range(len(words)), lambda i: words[i + 1] = 'general' and words[i + 2] = 'public' and words[i + 3] = 'license') as gpl,
    list_filter(range(len(words)), lambda i: words[i + 1] = 'all' and words[i + 2] = 'rights' and words[i + 3] = 'reserved') as reserved from w)
select doc_id, n_words, len(cc) + len(gpl) + len(reserved) as n_base, list_min(list_concat(cc, gpl, reserved)) as first_word, list_max(list_concat(cc, gpl, reserved)) as last_word,
    array_to_string(list_filter([case when len(cc) > 0 then 'cc-by' end, case when len(gpl) > 0 then 'gpl' end, case when len(reserved) > 0 then 'reserved' end], lambda x: x is not null), ',') as base_labels from p"""


def test_base_columns_equal_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    want = con.sql(f"select {', '.join(columns)} from ({BASE_SQL}) order by doc_id").fetchall()
    got = [tuple(r) for r in licenses.scan(spark.read.parquet(f"{sf}/documents.parquet")).select(*columns).orderBy("doc_id").collect()]
    assert got == want and any(r[2] for r in want)


def test_places():
    assert licenses.scan_text("cc by, cc-by x All Rights RESERVED")[1:4] == (3, 0, 5)


def test_anchors_are_mandatory_words():
    for automaton in licenses.automata():
        assert automaton.anchor in automaton.words
        without = [w for w in automaton.words if w not in (None, automaton.anchor)]
        assert not automaton.run(without)[0]


def test_odd_rows(spark):
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, ODD, extra=True)).collect()}
    assert [got[i]["n_words"] for i in range(len(ODD))] == [len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) for t in ODD]
    assert got[0]["first_word"] is None and got[0]["labels"] == ""


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
