import copy
import json
import random
import re
from datetime import date

import pytest

from scriptorium.operators import forms

THEORY = {
    "version_fiscal_hechos": "x" * 50, "hechos_admitidos": [], "hechos_negados": ["uno"], "teoria_juridica_defensa": forms.DEFENCES[0], "linea_tematica": "é" * 200,
    "prueba_defensa": [{"tipo": "Pericial", "descripcion": "diez letras", "disponible": True, "acredita_hecho": ""}, {"tipo": "Digital", "descripcion": "𝔘" * 5, "disponible": False, "acredita_hecho": "h", "controvierte_hecho_fiscal": "c"}],
}
MEASURES = {"delito_imputado": "Violación", "pena_maxima_abstracta_anos": 12.5}
for rule in forms.MEASURES:
    if rule.kind == "object":
        MEASURES[rule.path] = {}
    elif "." in rule.path:
        above, name = rule.path.split(".")
        MEASURES[above][name] = rule.kind == "boolean" or 3
LIMITATION = {"pena_maxima_del_delito_anos": 40, "fecha_comision_del_hecho": "2024-02-29T23:59:59-06:00", "hubo_acto_interruptivo": False, "es_delito_imprescriptible": False, "more": [1]}
SCHEMAS = {"theory": (THEORY, forms.CASE_THEORY), "measures": (MEASURES, forms.MEASURES), "limitation": (LIMITATION, forms.LIMITATION)}
ABSENT = object()


def kind_of(v):
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text" if isinstance(v, str) else "list" if isinstance(v, list) else "object" if isinstance(v, dict) else "null"


def real_day(text):
    try:
        return bool(date.fromisoformat(text[:10]))
    except ValueError:
        return False


def problem(v, rule):
    if v is ABSENT:
        return None if rule.optional else "missing"
    if kind_of(v) != ("text" if rule.kind == "date" else rule.kind):
        return "kind"
    if rule.choices and v not in rule.choices:
        return "choice"
    if rule.kind == "date" and not (re.search(forms.DATE, v) and real_day(v)):
        return "date"
    if rule.low is None and rule.high is None:
        return None
    size = v if rule.kind == "number" else len(v.encode("utf-16-le")) // 2 if isinstance(v, str) else len(v)
    return "size" if (rule.low is not None and size < rule.low) or (rule.high is not None and size > rule.high) else None


def plain(form, schema):
    """The problems of a parsed form, one rule after another."""
    if not isinstance(form, dict):
        return ["form: kind"]
    out = []
    for rule in schema:
        held = form
        *above, name = rule.path.split(".")
        for step in above:
            held = held.get(step)
        if not isinstance(held, dict):
            continue
        v = held.get(name, ABSENT)
        if p := problem(v, rule):
            out.append(f"{rule.path}: {p}")
        for i, item in enumerate(v if rule.items and isinstance(v, list) else ()):
            if isinstance(rule.items, str):
                out += [f"{rule.path}[{i}]: kind"] if kind_of(item) != rule.items else []
            elif not isinstance(item, dict):
                out.append(f"{rule.path}[{i}]: kind")
            else:
                out += [f"{rule.path}[{i}].{f.path}: {p}" for f in rule.items if (p := problem(item.get(f.path, ABSENT), f))]
    return out


ODD = [ABSENT, None, True, 0, -1, 41, 1e30, "", "x" * 60, "é" * 201, "𝔘" * 101, [], ["a"], [1, None, "b"], [{}], {}, {"a": 1}, "2024-02-30T00:00:00Z", "2024-01-01T10:00:00", "2024-01-01T10:00:00.5+0530", "Pericial", "Robo"]


def damaged(form, r):
    """A form with one or two values, at any depth, replaced or taken away."""
    form = copy.deepcopy(form)
    for _ in range(r.choice([1, 1, 2])):
        places = []

        def walk(v, places=places):
            for k, x in list(v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()):
                places.append((v, k))
                walk(x)

        walk(form)
        if not places:
            break
        held, key = r.choice(places)
        new = r.choice(ODD)
        if new is ABSENT:
            del held[key]
        else:
            held[key] = copy.deepcopy(new)
    return form


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_equals_a_plain_check(spark, name):
    good, schema = SCHEMAS[name]
    r = random.Random(7)
    texts = [json.dumps(good, ensure_ascii=False), *(json.dumps(damaged(good, r)) for _ in range(400)), "[]", "5", "null", "{", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["problems"] for r in forms.checked_forms(df, "t", schema).orderBy("i").collect()]

    def parsed(t):
        try:
            return json.loads(t or "")
        except ValueError:
            return None

    assert got == [plain(parsed(t), schema) for t in texts] and got[0] == []


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_each_rule_has_a_failing_form(spark, name):
    good, schema = SCHEMAS[name]
    texts, want = [], []
    for rule in schema:
        form = copy.deepcopy(good)
        *above, last = rule.path.split(".")
        held = form
        for step in above:
            held = held[step]
        for bad in (None, "" if rule.low and rule.kind == "text" else [] if rule.kind == "list" and rule.low else 41 if rule.high == 40 else None):
            held[last] = bad
            texts.append(json.dumps(form))
            want.append(plain(form, schema))
            assert any(p.startswith(rule.path + ": ") for p in want[-1])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["problems"] for r in forms.checked_forms(df, "t", schema).orderBy("i").collect()] == want
